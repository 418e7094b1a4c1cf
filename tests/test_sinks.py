"""Sinks: written tables and manifests read back equal; upsert; copy plans."""

import json
import tempfile


from conftest import SF001
from quarry.catalog import DICT
from quarry.operators import reports as A
from quarry.plans import sinks as K
from quarry.plans.scan import dictionary_scan
from quarry.sources import corpus


def test_write_run_and_read_back(spark):
    out = tempfile.mkdtemp(prefix="quarry-sink-")
    r1 = dictionary_scan(corpus.docs(spark, SF001), DICT, run_id=1)
    r2 = dictionary_scan(corpus.pages(spark, SF001), DICT, run_id=2)
    K.write_run(r1.files, r1.facts, out)
    K.write_run(r2.files, r2.facts, out)
    K.write_run(r1.files, r1.facts, out)   # replacing run 1 keeps run 2
    files = spark.read.parquet(f"{out}/files")
    assert files.where("run_id = 1").count() == r1.files.count()
    assert files.where("run_id = 2").count() == r2.files.count()
    pruned = A.run_filter(files, 2)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    matches = spark.read.parquet(f"{out}/matches").where("run_id = 1")
    assert sorted(map(tuple, matches.select("display_path", "keyword_group", "keyword", "count").collect())) == \
        sorted(map(tuple, r1.facts.select("display_path", "keyword_group", "keyword", "count").collect()))
    assert files.select("file_key").distinct().count() == files.count()


def test_manifests_round_trip(spark):
    out = tempfile.mkdtemp(prefix="quarry-manifest-")
    r = dictionary_scan(corpus.docs(spark, SF001), DICT)
    K.write_manifests(r.facts, out)
    back = spark.read.json(f"{out}/manifest.jsonl")
    assert back.count() == r.files.where("matched").count()
    one = json.loads(back.toJSON().first())
    assert set(one) == {"display_path", "source_path", "internal_path", "file_type", "size", "groups",
                        "keyword_counts", "copied_to"}
    csv = spark.read.option("header", True).csv(f"{out}/manifest.csv")
    assert csv.columns == ["display_path", "source_path", "internal_path", "file_type", "size", "groups",
                           "keywords", "copied_to"]
    assert csv.count() == back.count()
    K.write_summary(1, r.files, r.facts, out)
    s = spark.read.json(f"{out}/summary.json").first()
    assert s["run_id"] == 1 and s["files"]["scanned"] == r.files.count()


def test_latest_per_key(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "k string, seq int, v string")
    got = {r["k"]: r["v"] for r in K.latest_per_key(rows, ["k"]).collect()}
    assert got == {"a": "new", "b": "only"}


def test_copy_plan_collisions(spark):
    facts = spark.createDataFrame(
        [("G", "x/a.txt"), ("G", "y/a.txt"), ("G", "z/a.txt"), ("G", "w/a_1.txt"), ("H", "x/a.txt")],
        "keyword_group string, display_path string")
    plan = K.group_copy_plan(facts)
    dests = [r["dest"] for r in plan.collect()]
    assert len(dests) == len(set(dests)) == 5
    g = sorted(d for d in dests if d.startswith("G/"))
    assert "G/a.txt" in g and "G/a_1.txt" in g and "H/a.txt" in dests


def test_copy_plan_never_takes_a_real_name(spark):
    rows = [("G", f"{d}/a.txt") for d in "xyz"] + [("G", "p/a_1.txt"), ("G", "p/a_3.txt"), ("G", "q/a_3.txt"), ("G", "r/a_3_1.txt"), ("G", "r/a"), ("G", "s/a")]
    plan = K.group_copy_plan(spark.createDataFrame(rows, "keyword_group string, display_path string"))
    dests = {r["path"]: r["dest"] for r in plan.collect()}
    assert len(set(dests.values())) == len(rows)
    assert dests["p/a_1.txt"] == "G/a_1.txt" and dests["r/a_3_1.txt"] == "G/a_3_1.txt"


def test_copy_plan_reads_long_numbers(spark):
    rows = [("G", f"{d}/a.txt") for d in "xy"] + [("G", "p/a_999999999.txt"), ("G", "p/a_1000000000.txt"), ("G", f"p/a_{10 ** 20}.txt")]
    dests = sorted(r["dest"] for r in K.group_copy_plan(spark.createDataFrame(rows, "keyword_group string, display_path string")).collect())
    assert dests == sorted(["G/a.txt", "G/a_999999999.txt", "G/a_1000000000.txt", f"G/a_{10 ** 20}.txt", f"G/a_{10 ** 20 + 1}.txt"])


def test_evidence_plan(spark):
    files = spark.createDataFrame(
        [("a b/c?.txt", "", "a b/c?.txt"), ("arc.zip", "in/x.docx", "arc.zip::in/x.docx")],
        "source_path string, internal_path string, display_path string")
    got = {r["display_path"]: r["dest"] for r in K.evidence_plan(files).collect()}
    assert got["a b/c?.txt"] == "evidence/a b/c_.txt"
    import hashlib
    h = hashlib.sha256("arc.zip::in/x.docx".encode()).hexdigest()[:12]
    assert got["arc.zip::in/x.docx"] == f"evidence/arc.zip/container_{h}.docx"
