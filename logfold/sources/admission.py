"""File admission audit: one row per input file with its status.

A batch job over many files must not stop on one bad input, so every candidate
becomes an audit row ``(path, size, status, reason)``; the admitted ones are
analysed.  The listing is that of Spark's own file index: globs expanded,
directories listed recursively and in parallel, hidden names left out as in the
text scan.  Only names and lengths are read, never the content, and Python
touches no file name: the index, which any scan keeps, stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.functions.patterns import ALLOWED_EXTENSIONS
from logfold.sources.text_files import parse_extensions

AUDIT_SCHEMA = "path string, size bigint, status string, reason string"


def split_inputs(spark: SparkSession, paths: str | list[str]) -> tuple[list[str], list[str]]:
    """(inputs that match something, inputs that match nothing); one glob look-up per given input."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there, gone = [], []
    for p in [paths] if isinstance(paths, str) else list(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        # A name with glob characters in it may also exist as it stands.
        found = fs.exists(path) or bool(fs.globStatus(path))
        (there if found else gone).append(p)
    return there, gone


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size) of every file a Spark scan of ``paths`` finds; ``path`` as in the entries' ``source``.

    A scan leaves out zero-length files although its index names them, so the
    index's names (handed over inside the JVM) are joined with the scan's sizes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    sizes = files.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"))
    jvm = spark.sparkContext._jvm
    names = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(files._jdf.inputFiles())
    listed = spark._jsparkSession.createDataset(names, jvm.org.apache.spark.sql.Encoders.STRING()).toDF()
    key = F.regexp_replace("path", "^([^/:]+):///", "$1:/")  # an empty host is written in two ways
    both = DataFrame(listed, spark).toDF("path").select(key.alias("key")).join(sizes.withColumn("key", key), "key", "left")
    return both.select(F.coalesce("path", "key").alias("path"), F.coalesce("size", F.lit(0)).alias("size"))


def admission_audit(
    spark: SparkSession,
    paths: str | list[str],
    extensions: Iterable[str] | str | None = ALLOWED_EXTENSIONS,
    max_file_size_mb: float | None = None,
) -> DataFrame:
    """Audit rows for every file under ``paths`` (files, directories or globs).

    A file is admitted by the rule of the text scan: its name ends with an
    allowed extension in any case, and its size is not above the limit.
    """
    there, gone = split_inputs(spark, paths)
    audit = spark.createDataFrame([(p, None, "missing", "file does not exist") for p in gone], AUDIT_SCHEMA)
    if not there:
        return audit
    name = F.lower(F.regexp_extract("path", r"[^/]*$", 0))
    suffix = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    reason = F.lit(None).cast("string")
    if max_file_size_mb is not None:
        reason = F.when(F.col("size") > F.lit(float(max_file_size_mb) * 1024 * 1024),
                        F.lit(f"exceeds the size limit of {max_file_size_mb} MB"))
    if extensions is not None:
        fits = F.lit(False)
        for ext in parse_extensions(extensions):
            fits = fits | F.endswith(name, F.lit(ext))
        reason = F.when(~fits, F.concat(F.lit("unsupported file type '"), suffix, F.lit("'"))).otherwise(reason)
    judged = list_files(spark, there).withColumn("reason", reason)
    status = F.when(F.col("reason").isNull(), F.lit("admitted")).otherwise(F.lit("rejected"))
    return judged.select("path", "size", status.alias("status"), "reason").unionByName(audit)
