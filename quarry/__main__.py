"""Command line: ``python -m quarry evidence|report --data DIR --config YAML --output DIR``.

``evidence`` is the second program (manifests, tables, summary; dictionary
mode), ``report`` the first (statistics, per-group reports; whole words,
incremental), ``stream`` scans files as they arrive (Structured Streaming).  Spark settings come from the usual spark-submit options.
"""

from __future__ import annotations

import argparse
import json


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="quarry", description="Keyword evidence scan on Spark")
    ap.add_argument("job", choices=["evidence", "report", "stream"])
    ap.add_argument("--data", required=True, help="folder (any Hadoop path) to scan")
    ap.add_argument("--config", required=True, help="YAML file with Keyword_Groups")
    ap.add_argument("--output", required=True, help="output folder (excluded from the scan)")
    ap.add_argument("--case-sensitive", action="store_true", help="evidence: exact-case matching")
    ap.add_argument("--max-archive-depth", type=int, default=3, help="evidence: nested container depth")
    ap.add_argument("--copy-plan", action="store_true", help="write the evidence copy plan")
    ap.add_argument("--full", action="store_true", help="report: rescan everything (not incremental)")
    ap.add_argument("--continuous", action="store_true", help="stream: keep running (default: what is there, then stop)")
    args = ap.parse_args(argv)

    from quarry.plans.jobs import evidence_scan, evidence_stream, keyword_report
    from quarry.session import build_session
    from quarry.sources.dictionary import KeywordDictionary

    spark = build_session()
    d = KeywordDictionary.from_yaml(args.config)
    if args.job == "evidence":
        res = evidence_scan(spark, args.data, d, args.output, case_sensitive=args.case_sensitive,
                            max_depth=args.max_archive_depth, copy_plan=args.copy_plan)
        print(json.dumps({"run_id": res.run_id, **(res.metrics or {})}, default=str))
    elif args.job == "stream":
        evidence_stream(spark, args.data, d, args.output, available_now=not args.continuous,
                        max_depth=args.max_archive_depth).awaitTermination()
    else:
        res = keyword_report(spark, args.data, d, args.output, incremental=not args.full,
                             copy_plan=args.copy_plan)
        print(json.dumps({"run_id": res.run_id}))
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
