"""Command line: heuristic incident reports for log files.

    python -m logfold PATH [PATH ...] [--out DIR] [--extensions .log,.txt]
                       [--max-file-size-mb N] [--master local[*]]

Without ``--out`` the reports are printed, one JSON object per source (a
small number of files); with ``--out`` they are written as JSON Lines by the
executors, which is the way to run over many files.  Exit code 0 when at
least one file was admitted, 1 otherwise.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="logfold", description="Analyse log files into incident reports.")
    ap.add_argument("paths", nargs="+")
    ap.add_argument("--out")
    ap.add_argument("--extensions", default=".log,.txt")
    ap.add_argument("--max-file-size-mb", type=float, default=None)
    ap.add_argument("--master", default=None, help="only used when no session exists yet")
    args = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from logfold.plans.analysis import analyze_files, result_json, write_results
    from logfold.session import ensure_checkpoint_dir
    from logfold.sources.admission import admission_audit
    from logfold.staging import staging_run

    builder = SparkSession.builder.appName("logfold").config("spark.ui.enabled", "false")
    if args.master:
        builder = builder.master(args.master)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)

    audit = admission_audit(spark, args.paths, args.extensions, args.max_file_size_mb)
    for r in audit.filter(F.col("status") != "admitted").toLocalIterator():
        print(f"skipped {r.path}: {r.status} ({r.reason})", file=sys.stderr)
    if audit.filter(F.col("status") == "admitted").limit(1).count() == 0:
        print("no admissible log file", file=sys.stderr)
        return 1
    with staging_run(spark):
        result = analyze_files(spark, args.paths, args.extensions, args.max_file_size_mb)
        if args.out:
            write_results(result, args.out)
        else:
            for r in result_json(result, include_source=True).toLocalIterator():
                print(json.dumps(json.loads(r.json), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
