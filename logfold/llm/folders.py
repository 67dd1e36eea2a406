"""Folders for files that tasks write themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from logfold.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder URI under ``spark.checkpoint.dir``, which all executors share."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    if "://" not in root:
        root = "file://" + root.removeprefix("file:")
    return f"{root}/{name}-{uuid.uuid4().hex}"
