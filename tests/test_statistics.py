"""All statistics in one pass: equal to the reports one by one, one scan and one Expand in the plan."""

import random

from pyspark.sql import functions as F

from quarry import KeywordDictionary
from quarry.operators import reports as A
from quarry.plans.scan import boundary_scan, dictionary_scan

SCHEMA = "display_path string, keyword_group string, keyword string, count long, size long"


def some_facts(seed, n=400):
    rng = random.Random(seed)
    sizes = {f"f{i}": rng.randrange(10**12) for i in range(60)}
    rows = {(p, rng.choice("abc"), rng.choice("uvwxyz")): rng.randint(1, 9) for p in rng.choices(list(sizes), k=n)}
    return [(p, g, k, c, sizes[p]) for (p, g, k), c in rows.items()]


def test_rows_equal_the_reports_one_by_one(spark):
    facts = spark.createDataFrame(some_facts(1), SCHEMA)
    files = spark.createDataFrame([(".txt", "x"), (".txt", "y"), ("", "z"), (".md", ""), (None, "w")], "file_type string, text string")
    rows = A.statistics_rows(facts, files)
    got = {(r.what, r.keyword_group, r.keyword, r.file_type): r for r in rows.collect()}

    def same(df, what, key, **cols):
        own = {tuple(r[k] for k in key): r for r in df.collect()}
        mine = {k: r for k, r in got.items() if k[0] == what}
        assert len(own) == len(mine)
        for r in mine.values():
            for a, b in cols.items():
                assert r[a] == own[tuple(r[k] for k in key)][b], (what, a)

    same(A.files_per_group(facts), A.PER_GROUP, ["keyword_group"], files="files")
    same(A.group_matched_size(facts), A.PER_GROUP, ["keyword_group"], files="files", bytes="bytes")
    same(A.files_per_keyword(facts), A.PER_GROUP_KEYWORD, ["keyword_group", "keyword"], files="files")
    same(A.keyword_totals(facts), A.PER_KEYWORD, ["keyword"], hits="hits")
    same(A.filetype_counts(files), A.PER_TYPE, ["file_type"], files="files")
    (run,) = [r for r in got.values() if r.what == A.PER_RUN]
    assert run.multi == A.files_multi_group(facts).first()[0] > 0
    assert round(run.bytes / A.GIB, 4) == A.matched_size_gb(facts).first()[0]


def test_one_scan_and_one_expand(spark, tmp_path):
    spark.createDataFrame(some_facts(2), SCHEMA).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    plan = A.statistics_rows(facts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand ") == 1 and plan.count("Relation [") == 1 and "Join" not in plan
    files = spark.createDataFrame([], "file_type string, text string")
    assert A.global_statistics(files, facts)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_no_facts(spark):
    facts = spark.createDataFrame([], SCHEMA)
    files = spark.createDataFrame([], "file_type string, text string")
    assert A.statistics_rows(facts, files).count() == 0
    (r,) = A.global_statistics(files, facts).collect()
    assert tuple(r) == ({}, {}, {}, 0, 0.0)


def test_facts_and_files_come_from_one_read(spark, tmp_path):
    d = KeywordDictionary({"g": ["needle", "straße"], "h": ["needle"]})
    rows = [("a", "a needle, NEEDLE", "", 0), ("a", "STRASSE", "", 1), ("b", "é nothing", "", 0), ("c", "needle", "bad", 0), ("d", None, "", 0), ("e", "", "", 0)]
    units = (spark.createDataFrame(rows, "source_path string, text string, error string, unit_idx int")
             .selectExpr("source_path", "'' AS internal_path", "source_path AS display_path", "'' AS file_type", "5L AS size",
                         "timestamp_micros(1700000000123456L) AS mtime", "text", "error", "unit_idx"))
    units.write.parquet(str(tmp_path / "units"))
    units = spark.read.parquet(str(tmp_path / "units"))
    for scan, hits in ((dictionary_scan, {("a", "g", "needle", 2), ("a", "h", "needle", 2), ("a", "g", "straße", 1)}),
                       (boundary_scan, {("a", "g", "needle", 1), ("a", "h", "needle", 1)})):
        for of in (units, units.where("unit_idx = 0").drop("unit_idx")):
            r = scan(of, d)
            assert r.files._jdf.queryExecution().logical().toString().count("Relation [") == 1
            files = {x.source_path: x for x in r.files.collect()}
            found = {(x.source_path, x.keyword_group, x.keyword, x["count"]) for x in r.facts.collect()}
            assert found == (hits if "unit_idx" in of.columns else {h for h in hits if h[2] != "straße"})
            assert {p: x.bytes_read for p, x in files.items()} == {"a": 23 if "unit_idx" in of.columns else 16, "b": 10, "c": 0, "d": 0, "e": 0}
            assert [p for p, x in files.items() if x.matched] == ["a"] and files["c"].error == "bad"
            assert {x.mtime.microsecond for x in files.values()} == {123456}
            r.release()
