"""Log corpora derived from the test tables.

The test tables hold no log text, so two corpora are derived from them with
Spark expressions (the DuckDB oracle derives them identically):

* ``EV``: one log line per ``events`` row in twelve shapes (plain, ISO with
  zone, fraction + logger, slash date, day-first date, structured, structured
  with default ids, access log, exception, stack frame, key=value, blank);
  ``source = 'svc-' || user_id % 8``, file order = ``event_id``.
* ``DOC``: the lines of ``documents.text``; one source per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.sources.tables import entries_from_lines, split_text_lines

# FIXED VALUES of the EV corpus shape.
EV_MESSAGES = (
    "Database connection timeout",
    "Slow response observed",
    "retry attempt",
    "Memory usage high",
    "Application started",
    "Shutdown initiated",
    "Connection refused by peer",
)
EV_LEVELS = (("error", "ERROR"), ("purchase", "WARN"), ("signup", "INFO"), ("view", "INFO"), ("click", "DEBUG"))

# FIXED VALUES: the component words of the branch shapes.
BRANCH_COMPONENTS = ("Service", "Component", "Controller", "Worker", "Scheduler", "DB", "Cache", "API")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(events: DataFrame) -> DataFrame:
    """``(source, event_id, raw_line)``: one raw log line per event."""
    e, u, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    t = ts.cast("string")
    t19 = F.substring(t, 1, 19)
    tc = F.replace(t, F.lit("."), F.lit(","))
    lvl = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EV_LEVELS], F.lit("INFO"))
    msg = F.element_at(F.array(*[F.lit(m) for m in EV_MESSAGES]), (e % 7 + 1).cast("int"))
    sp = F.lit(" ")

    def cat(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    shape = e % 12
    raw = (
        F.when(shape == 0, cat(t19, sp, lvl, sp, msg))
        .when(shape == 1, cat(F.replace(t, F.lit(" "), F.lit("T")), "Z ", lvl, sp, msg))
        .when(shape == 2, cat(tc, sp, lvl, " [com.example.App", (u % 3).cast("string"), "] ", msg))
        .when(shape == 3, cat(F.replace(t19, F.lit("-"), F.lit("/")), sp, lvl, sp, msg))
        .when(shape == 4, cat(F.date_format(ts, "dd-MM-yyyy HH:mm:ss"), sp, lvl, sp, msg))
        .when(shape == 5, cat("[", lvl, "] [", tc, "] [pool-", (u % 4).cast("string"), "-thread-1] T:tr-",
                              e.cast("string"), " - R:req-", u.cast("string"), " [OrderService]: ", msg))
        .when(shape == 6, cat("[", lvl, "] [", tc, "] [dw-", (u % 4).cast("string"),
                              "] T:_default_ - R:_default_ [JobHandler] ", msg))
        .when(shape == 7, cat("10.0.0.", (u % 250).cast("string"), " - - - ", F.date_format(ts, "dd"), "/Jan/",
                              F.date_format(ts, "yyyy"), ":", F.date_format(ts, "HH:mm:ss"),
                              ' +0000 "GET /item/', e.cast("string"), ' HTTP/1.1" ',
                              F.when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("200")), " 123"))
        .when(shape == 8, cat("com.example.FooException: ", msg))
        .when(shape == 9, cat("\tat com.example.Foo.bar(Foo.java:", (e % 50).cast("string"), ")"))
        .when(shape == 10, cat(t19, sp, lvl, " request_id=r-", u.cast("string"), " thread=worker-",
                               (u % 5).cast("string"), " Service=Svc", (u % 6).cast("string"), sp, msg))
        .otherwise(F.lit("   "))
    )
    return events.select(
        F.concat(F.lit("svc-"), (u % 8).cast("string")).alias("source"),
        e.alias("event_id"),
        raw.alias("raw_line"),
    )


def branch_lines(events: DataFrame) -> DataFrame:
    """``(source, event_id, raw_line)``: ten generic shapes for the extractor branches the EV shapes do not reach.

    Fatal and critical levels, ``[x] LEVEL:`` prefixes, bracketed threads, bare
    logger words, ``T:`` and ``R:`` marks, session and trace keys, UUIDs,
    ``Caused by:`` lines and every component word.
    """
    e, u = F.col("event_id").cast("string"), F.col("user_id")
    us, t19 = u.cast("string"), F.substring(F.col("ts").cast("string"), 1, 19)
    word = F.element_at(F.array(*[F.lit(w) for w in BRANCH_COMPONENTS]), (u % len(BRANCH_COMPONENTS) + 1).cast("int"))
    shapes = [
        (t19, " FATAL disk lost T:trace", e, " halted"),
        ("[core] CRITICAL: quota of tenant ", us, " exceeded"),
        (t19, " ERROR [Thread-", (u % 4).cast("string"), "] queue full"),
        (t19, " INFO AuditLogger rotated file ", e),
        (t19, " WARN R:req", us, " slow answer"),
        (t19, " DEBUG job 0f8fad5b-d9cb-469f-a165-70867728", F.lpad((u % 10000).cast("string"), 4, "0"), " ended"),
        ("Caused by: java.io.IOException: stream ", us, " closed"),
        (t19, " INFO session-id=s", e, " thread name: worker", (u % 5).cast("string"), " opened"),
        (t19, " [hystrix-", (u % 3).cast("string"), "] TRACE trace_id=t", us, " step"),
        (t19, " INFO ", word, "=unit", (u % 6).cast("string"), " REQ-", e, " served"),
    ]
    lines = [F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]) for parts in shapes]
    raw = F.element_at(F.array(*lines), (F.col("event_id") % len(lines) + 1).cast("int"))
    return events.select(F.concat(F.lit("gen-"), (u % 8).cast("string")).alias("source"), "event_id", raw.alias("raw_line"))


def branch_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed entries of :func:`branch_lines` (file order = event_id within source)."""
    return entries_from_lines(branch_lines(table(spark, sf_dir, "events")), order="event_id")


def _spread(lines: DataFrame) -> DataFrame:
    """The driver's tables are single files: deal their lines out before the parse, which is the dear step."""
    return lines.repartition(lines.sparkSession.sparkContext.defaultParallelism)


def ev_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed entries of the EV corpus (file order = event_id within source)."""
    return entries_from_lines(event_lines(table(spark, sf_dir, "events")), order="event_id")


# Events per log file when the EV corpus is written out as text files.
EV_FILE_CHUNK = 1 << 16


def write_event_log_files(spark: SparkSession, sf_dir: str, chunk: int = EV_FILE_CHUNK) -> str:
    """Write the EV corpus as text files ``<dir>/source=<s>/chunk=<c>/part-*.txt``.

    One file per (source, event_id div chunk), lines in event_id order, so no
    task writes more than ``chunk`` events.  Written under the session's
    checkpoint folder; returns the directory.
    """
    import uuid

    from logfold.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logfold/ev-files-{uuid.uuid4().hex}"
    lines = event_lines(table(spark, sf_dir, "events")).withColumn(
        "chunk", F.floor(F.col("event_id") / F.lit(chunk)).cast("bigint"))
    (lines.repartition("source", "chunk").sortWithinPartitions("source", "chunk", "event_id")
     .select(F.col("raw_line").alias("value"), "source", "chunk")
     .write.partitionBy("source", "chunk").text(path))
    return path


#: Every how many events a line of the odd files ends in bytes that are no UTF-8: a lone FF and a cut-off C3.
ODD_BYTES_EVERY = 97


def write_odd_log_files(spark: SparkSession, sf_dir: str) -> str:
    """Write the EV corpus as files that test admission: one per source, some lines with bytes that are no UTF-8.

    Beside them an empty file and a JSON copy of the events.  Folders ``name=<source>``,
    ``name=empty`` and ``name=json`` under a new folder of the checkpoint folder, which is returned.
    """
    import uuid

    from logfold.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logfold/odd-files-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    odd = F.when(F.col("event_id") % ODD_BYTES_EVERY == 0, F.unhex(F.lit("20FF78C328"))).otherwise(F.lit(b"")).cast("string")
    lines = event_lines(events).select("source", "event_id", F.concat("raw_line", odd).alias("value"))
    (lines.repartition("source").sortWithinPartitions("source", "event_id").select("value", F.col("source").alias("name"))
     .write.partitionBy("name").text(path))
    lines.select("value").where(F.lit(False)).coalesce(1).write.text(f"{path}/name=empty")  # a file of no bytes
    events.write.json(f"{path}/name=json")
    return path


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return split_text_lines(docs, F.col("doc_id"), F.col("text"))


def doc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_from_lines(_spread(doc_lines(spark, sf_dir)))
