"""Analyse log files as they arrive in a directory (Structured Streaming).

The file stream source hands each new file to exactly one micro-batch, whole,
so every batch holds complete sources: ``foreachBatch`` runs the same batch
plan as :func:`logfold.plans.analysis.analyze_files` on the batch's files and
writes one report per file to a JSON Lines sink.  Progress (which files are
done) lives in the stream checkpoint, by default one per output path in the
configured checkpoint folder, so a restarted query neither skips nor repeats
files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logfold.functions.patterns import ALLOWED_EXTENSIONS, EXTRA_LINE_SEPARATORS
from logfold.operators.context import sequence_entries
from logfold.operators.parse import parse_lines
from logfold.plans.analysis import result_json, static_result
from logfold.session import ensure_checkpoint_dir
from logfold.sources.text_files import extension_glob, parse_extensions
from logfold.staging import staging_run


def stream_lines(spark: SparkSession, directory: str,
                 extensions: Iterable[str] | str = ALLOWED_EXTENSIONS,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame ``(source, block, value)`` of new files under ``directory``."""
    reader = spark.readStream.format("text").option("pathGlobFilter", extension_glob(parse_extensions(extensions)))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(directory).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("value"),
    )


def batch_entries(batch: DataFrame) -> DataFrame:
    """Entries of one micro-batch of :func:`stream_lines` rows (whole files)."""
    lines = batch.select(
        "source", "block", F.monotonically_increasing_id().alias("mid"),
        F.posexplode(F.split("value", EXTRA_LINE_SEPARATORS, -1)).alias("pos", "raw_line"),
    )
    return sequence_entries(parse_lines(lines), order=["mid", "pos"])


def start_file_reports(spark: SparkSession, directory: str, output_path: str,
                       checkpoint_location: str | None = None,
                       extensions: Iterable[str] | str = ALLOWED_EXTENSIONS,
                       available_now: bool = False,
                       processing_time: str | None = "1 minute") -> StreamingQuery:
    """Start the stream; each micro-batch writes its reports under ``output_path``.

    ``checkpoint_location`` defaults to a folder under the session's
    ``spark.checkpoint.dir``.  ``available_now=True`` processes the files
    present now and stops (useful for scheduled runs and tests).
    """
    if checkpoint_location is None:
        # The configured folder itself: the context's own sub-folder is new in every application, and
        # staged tables next door may be cleared; either would report every file again.
        base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
        checkpoint_location = base.rstrip("/") + f"/logfold-streams/{hashlib.sha256(output_path.encode()).hexdigest()[:16]}"

    def handle(batch: DataFrame, batch_id: int) -> None:
        with staging_run(batch.sparkSession):
            result = static_result(batch_entries(batch))
            (result_json(result, include_source=True).select("json")
             .write.mode("overwrite").text(f"{output_path.rstrip('/')}/batch_id={batch_id}"))  # a retried batch replaces itself

    writer = (
        stream_lines(spark, directory, extensions).writeStream
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint_location)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()
