"""Stage an intermediate DataFrame as a Parquet table in the checkpoint folder.

Parsed lines and entries feed many consumers (report sections, evidence,
statistics).  Spark re-derives an unmaterialised DataFrame once per consumer
branch, and column pruning makes those branches differ, so exchanges are not
reused: the input would be scanned and regex-parsed once per branch.  Writing
the DataFrame once to the shared ``spark.checkpoint.dir`` cuts the lineage
(executor loss re-reads the table instead of recomputing the parse) and lets
every consumer read only the columns it needs.

Staged tables live under ``<spark.checkpoint.dir>/logfold/``.  A job wraps its
work in :func:`staging_run`: its tables get a folder of their own, removed at
the end, so jobs that share a checkpoint folder never touch each other's.
:func:`clear_staged` removes everything, for when no job is running.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from logfold.session import ensure_checkpoint_dir


_RUN: ContextVar[str | None] = ContextVar("logfold_staging_run", default=None)


def staged_root(spark: SparkSession, base: str | None = None) -> str:
    return (base or ensure_checkpoint_dir(spark)).rstrip("/") + "/logfold"


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path) and fs.delete(path, True))


@contextmanager
def staging_run(spark: SparkSession, base: str | None = None) -> Iterator[str]:
    """Stage everything inside the block in one folder of this run; removed at its end.

    Write or collect results before the block ends: DataFrames built in it read the folder.
    """
    folder = f"{staged_root(spark, base)}/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        _delete(spark, folder)


def stage(df: DataFrame, name: str = "stage", base: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the staging folder and read it back."""
    spark = df.sparkSession
    folder = staged_root(spark, base) if base else _RUN.get() or staged_root(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    # The schema is known: no footer reads to infer it.
    return spark.read.schema(df.schema).parquet(path)


def maybe_stage(df: DataFrame, enabled: bool, name: str = "stage") -> DataFrame:
    return stage(df, name) if enabled else df


def clear_staged(spark: SparkSession, base: str | None = None) -> bool:
    """Delete every staged table under the staging folder (Hadoop FileSystem API), those of other runs too.

    DataFrames read from staged tables must not be used afterwards.
    """
    return _delete(spark, staged_root(spark, base))
