"""Log files as a DataFrame of numbered, parsed entries.

``read_log_lines`` is a plain ``spark.read.text`` scan over any number of
files and directories.  Spark splits large files into blocks, so no task holds
a whole file; the line number of each line is rebuilt exactly from the block
start offset and the scan order inside the block (see
:mod:`logfold.operators.context`).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.functions.patterns import ALLOWED_EXTENSIONS, EXTRA_LINE_SEPARATORS
from logfold.operators.context import sequence_entries
from logfold.operators.parse import parse_lines


def extension_glob(extensions: Iterable[str]) -> str:
    """Case-insensitive glob for file-name suffixes: ``.log`` -> ``*.[lL][oO][gG]``."""
    alts = []
    for ext in extensions:
        ext = ext.strip().lower().lstrip(".")
        if not ext:
            continue
        alts.append("".join(f"[{ch}{ch.upper()}]" if ch.isalpha() else ch for ch in ext))
    if len(alts) == 1:
        return f"*.{alts[0]}"
    return "*.{" + ",".join(alts) + "}"


def parse_extensions(value: str | Iterable[str]) -> tuple[str, ...]:
    """Accepts a comma list (``".log, txt"``) or an iterable; normalises to ``.ext`` lower case."""
    items = value.split(",") if isinstance(value, str) else list(value)
    out = []
    for item in items:
        item = item.strip().lower()
        if item:
            out.append(item if item.startswith(".") else "." + item)
    return tuple(out)


def read_log_lines(
    spark: SparkSession,
    paths: str | list[str],
    extensions: Iterable[str] | str = ALLOWED_EXTENSIONS,
    max_file_size_mb: float | None = None,
) -> DataFrame:
    """Raw physical lines: ``(source, block, mid, pos, raw_line)``.

    * ``extensions`` filters file names case-insensitively (``None`` = any);
    * ``max_file_size_mb`` drops files whose size in MiB is strictly above it
      (off by default: Spark splits big files, so no limit is needed);
    * invalid UTF-8 bytes become U+FFFD;
    * a physical line is split further on the separators Python's
      ``splitlines`` also honours (VT, FF, FS, GS, RS, NEL, LS, PS).

    ``mid`` is taken in the same projection as the scan: within one file
    split it increases with the position in the file.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if extensions is not None:
        reader = reader.option("pathGlobFilter", extension_glob(parse_extensions(extensions)))
    df = reader.text(paths if isinstance(paths, list) else [paths])
    scanned = df.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("mid"),
        F.make_valid_utf8("value").alias("value"),
    )
    if max_file_size_mb is not None:
        scanned = scanned.filter(F.col("_size") <= F.lit(float(max_file_size_mb) * 1024 * 1024))
    return scanned.select(
        "source", "block", "mid",
        F.posexplode(F.split("value", EXTRA_LINE_SEPARATORS, -1)).alias("pos", "raw_line"),
    )


def read_log_entries(
    spark: SparkSession,
    paths: str | list[str],
    extensions: Iterable[str] | str = ALLOWED_EXTENSIONS,
    max_file_size_mb: float | None = None,
) -> DataFrame:
    """Parsed entries of log files (schema: see ``logfold.plans.analysis.ENTRY_COLUMNS``)."""
    lines = read_log_lines(spark, paths, extensions, max_file_size_mb)
    parsed = parse_lines(lines)
    return sequence_entries(parsed, order=["mid", "pos"])
