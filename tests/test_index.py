"""The stored index: lookups read one bucket, chunks are bounded, a replaced index holds the new paths."""

import re

from quarry.plans import index as N

SCHEMA = "display_path string, keyword_group string, keyword string, count long, size long"


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    rows = [(f"f{i}", g, k, 1, 1) for i in range(500) for g, k in (("a", "hot"), ("b", "hot"), ("a", f"k{i % 40}"))]
    facts = spark.createDataFrame(rows, SCHEMA)
    N.store_index(facts, "index_test", str(tmp_path / "index"), buckets=16, chunk=50)
    got = N.lookup(spark, "index_test", "hot")
    # the plan names the buckets it reads only where the scan also reports its bucketing
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    plan = N.lookup(spark, "index_test", "hot")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert re.search(r"SelectedBucketsCount: 1 out of 16", plan), plan
    assert sorted(r.path for r in got.collect()) == sorted(f"f{i}" for i in range(500))
    assert sorted(r.path for r in N.lookup(spark, "index_test", "k7").collect()) == sorted(f"f{i}" for i in range(7, 500, 40))
    assert N.lookup(spark, "index_test", "unknown").count() == 0
    stored = spark.table("index_test").collect()
    assert sum(r.keyword == "hot" for r in stored) >= 8 and max(len(r.paths) for r in stored) < 110
    assert all(list(r.paths) == sorted(set(r.paths)) for r in stored)
    N.store_index(facts.where("keyword <> 'hot'"), "index_test", str(tmp_path / "index2"), buckets=4)
    assert N.lookup(spark, "index_test", "hot").count() == 0 and N.lookup(spark, "index_test", "k7").count() == 13
    spark.sql("DROP TABLE index_test")


def test_no_facts(spark, tmp_path):
    N.store_index(spark.createDataFrame([], SCHEMA), "index_empty", str(tmp_path / "index"), buckets=4)
    assert N.lookup(spark, "index_empty", "x").count() == 0
    spark.sql("DROP TABLE index_empty")
