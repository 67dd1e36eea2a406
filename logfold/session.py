"""Session helpers for local runs, tests and the benchmark.

Library functions never create or reconfigure a session; they take the
caller's.  ``local_session`` is for tests and ``bench.py`` only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "logfold") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LOGFOLD_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's ``spark.checkpoint.dir``; set a scratch one only when unset.

    On a cluster the setting names a shared folder and is left untouched; when
    it is unset there, this raises instead of falling back to a local folder.
    A ``/tmp`` scratch folder is only used for local sessions (tests).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # remote session: only the SQL conf is reachable
        sc = None
    current = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = sc.master if sc is not None else ""
        if master != "local" and not master.startswith("local["):
            # A machine-local folder is no place for shared intermediate tables.
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, object store) on a cluster")
        current = tempfile.mkdtemp(prefix="logfold-ckpt-", dir="/tmp")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # core conf not settable at runtime; the context setting below suffices
            pass
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current
