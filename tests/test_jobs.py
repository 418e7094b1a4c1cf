"""The two folder jobs end to end on a folder written from documents."""

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from conftest import SF001
from quarry.catalog import DICT
from quarry.plans.jobs import evidence_scan, keyword_report


def _folder(spark, n=40):
    d = tempfile.mkdtemp(prefix="quarry-job-")
    data = os.path.join(d, "data")
    rows = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").limit(n).collect()
    for r in rows:
        sub = os.path.join(data, r["source"])
        os.makedirs(sub, exist_ok=True)
        with open(os.path.join(sub, f"{r['doc_id']}.txt"), "w", encoding="utf-8") as f:
            f.write(r["text"])
    return data, os.path.join(data, "out"), rows


def test_evidence_scan(spark):
    data, out, rows = _folder(spark)
    res = evidence_scan(spark, data, DICT, out, copy_plan=True)
    files = spark.read.parquet(f"{out}/files")
    assert files.count() == len(rows)
    man = spark.read.json(f"{out}/manifest.jsonl")
    assert man.count() == files.where("matched").count() > 0
    assert man.where("copied_to = ''").count() == 0
    summary = spark.read.json(f"{out}/summary.json").first()
    assert summary["files"]["scanned"] == len(rows)
    # a second run into the same output does not scan the output folder
    evidence_scan(spark, data, DICT, out, run_id=2)
    assert spark.read.parquet(f"{out}/files").where("run_id = 2").count() == len(rows)
    assert res.run_id == 1
    from quarry.plans.jobs import register_views
    assert set(register_views(spark, out)) == {"runs", "files", "matches"}
    by_sql = {r[0]: r[1] for r in spark.sql(
        "SELECT keyword_group, COUNT(DISTINCT file_key) FROM matches WHERE run_id = 1 GROUP BY keyword_group").collect()}
    by_df = {r[0]: r[1] for r in res.result.facts.groupBy("keyword_group")
             .agg(F.countDistinct("source_path", "internal_path")).collect()}
    assert by_sql == by_df
    assert res.metrics["seen"] == len(rows) and res.metrics["failed"] == 0
    assert res.metrics["bytes_read"] == sum(len(r["text"].encode("utf-8")) for r in rows)


def test_keyword_report_incremental(spark):
    data, out, rows = _folder(spark, 20)
    r1 = keyword_report(spark, data, DICT, out)
    n1 = r1.result.facts.count()
    stats = json.loads(spark.read.json(f"{out}/statistics.json").toJSON().first())
    assert stats["Keyword_Groups"]
    # nothing changed: the second run reads nothing and the statistics stay the same
    r2 = keyword_report(spark, data, DICT, out)
    assert r2.run_id == 2
    assert spark.read.parquet(f"{out}/scanned").where("run_id = 2").count() == 0
    assert r2.result.facts.count() == n1
    # change one file: only it is rescanned, totals still cover every file
    path = os.path.join(data, rows[0]["source"], f"{rows[0]['doc_id']}.txt")
    time.sleep(1.1)
    with open(path, "w", encoding="utf-8") as f:
        f.write("password and token here")
    r3 = keyword_report(spark, data, DICT, out)
    assert spark.read.parquet(f"{out}/scanned").where("run_id = 3").count() == 1
    keys = {(x["source_path"], x["keyword"]) for x in r3.result.facts.collect()}
    rel = f"{rows[0]['source']}/{rows[0]['doc_id']}.txt"
    assert (rel, "password") in keys and (rel, "token") in keys


def test_command_line(spark, capsys):
    """``python -m quarry evidence|report`` on a folder (same session, same code path)."""
    import quarry.__main__ as cli
    from quarry import session as qs
    data, out, rows = _folder(spark, 8)
    cfg = os.path.join(os.path.dirname(data), "config.yaml")
    with open(cfg, "w", encoding="utf-8") as f:
        f.write("Keyword_Groups:\n  Common: [the, tion]\n  Contact: ['@']\n")
    original = qs.build_session
    try:
        cli_stop = spark.stop
        spark.stop = lambda: None          # keep the shared test session alive
        import quarry.session
        quarry.session.build_session = lambda *a, **k: spark
        assert cli.main(["evidence", "--data", data, "--config", cfg, "--output", out]) == 0
        printed = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        assert printed["seen"] == len(rows) and printed["failed"] == 0
        assert cli.main(["report", "--data", data, "--config", cfg, "--output", out + "-v1"]) == 0
        assert os.path.isdir(out + "-v1/statistics.json")
    finally:
        quarry.session.build_session = original
        spark.stop = cli_stop
