"""Benchmark at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Two groups of timings, every query executed in full with the ``noop`` sink
(all rows computed, nothing collected):

* ``ingest_*``: raw input -> parsed, numbered, context-filled entries staged
  as a table (EV corpus from ``events``, DOC corpus from ``documents``, and
  the EV corpus written as text files and read through the file source).
* report sections over the staged entries, as a user runs them after one
  ingest; plus ``driver_*``: three driver queries end to end (parse included).

The median of ``$BENCH_REPEAT`` runs (default 3) is reported after a warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from logfold.operators import aggregates as A  # noqa: E402
from logfold.operators.assist import evidence_bundle  # noqa: E402
from logfold.operators.evidence import evidence_lines  # noqa: E402
from logfold.operators.ranking import timeline  # noqa: E402
from logfold.operators.report import report_sections, report_table  # noqa: E402
from logfold.operators.snippets import snippets  # noqa: E402
from logfold.plans import queries as Q  # noqa: E402
from logfold.session import local_session  # noqa: E402
from logfold.sources.corpus import doc_entries, ev_entries, write_event_log_files  # noqa: E402
from logfold.sources.text_files import read_log_entries  # noqa: E402
from logfold.staging import stage  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, repeat: int) -> tuple[float, object]:
    samples, out = [], None
    for _ in range(repeat):
        t0 = time.perf_counter()
        out = fn()
        samples.append(time.perf_counter() - t0)
    return round(statistics.median(samples), 3), out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          app="logfold-bench")
    run(Q.q_overview(spark, "/root/testdata/sf0.001"))  # warm-up: JIT, codegen cache
    times: dict[str, float] = {}

    times["ingest_ev"], ev = timed(lambda: stage(ev_entries(spark, sf_dir), "entries"), repeat)
    times["ingest_doc"], doc = timed(lambda: stage(doc_entries(spark, sf_dir), "entries"), repeat)
    files = write_event_log_files(spark, sf_dir)
    times["ingest_files"], _ = timed(lambda: stage(read_log_entries(spark, files, extensions=[".txt"]),
                                                   "entries"), repeat)

    sections = {
        "overview_ev": lambda: Q.overview_of(ev),
        "stats_ev": lambda: A.statistics(ev),
        "error_groups_ev": lambda: A.error_groups(ev),
        "timeline_doc": lambda: timeline(doc),
        "signals_doc": lambda: Q.signals_of(doc),
        "snippets_ev": lambda: snippets(ev),
        "evidence_ev": lambda: evidence_lines(ev),
        "evidence_bundle_ev": lambda: evidence_bundle(ev, stage_entries=False).select(F.to_json("evidence")),
        "report_ev": lambda: report_sections(report_table(ev, stage_entries=False)),
        "report_doc": lambda: report_sections(report_table(doc, stage_entries=False)),
    }
    for name, build in sections.items():
        times[name], _ = timed(lambda: run(build()), repeat)
    for name in ("context_fill", "report_sections", "model_choice"):
        times[f"driver_{name}"], _ = timed(lambda: run(Q.QUERIES[name](spark, sf_dir)), repeat)

    n_lines = ev.count() + doc.count()
    ingest = times["ingest_ev"] + times["ingest_doc"]
    out = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
        "ingest_lines_per_sec": round(n_lines / ingest, 1) if ingest else None,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
