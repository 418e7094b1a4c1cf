"""Incremental scan state and availableNow streams."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from conftest import SF001, SF01
from quarry.catalog import DICT
from quarry.operators.match import match_dictionary
from quarry.sources import corpus
from quarry.streaming import incremental as I


def test_changed_plus_unchanged_is_new_listing(spark):
    old, new = corpus.snapshots(spark, SF01)
    fp = DICT.fingerprint()
    state = I.state_from_listing(old, fp)
    changed = I.changed_files(new, state, fp)
    unchanged = new.join(changed.select("path"), "path", "left_anti")
    assert changed.count() + unchanged.count() == new.count()
    nxt = I.next_state(state, changed, fp, new)
    assert sorted(map(tuple, nxt.select("path", "mtime", "size").collect())) == \
        sorted(map(tuple, new.select("path", "mtime", "size").collect()))
    # second pass over the same listing: nothing changed
    assert I.changed_files(new, nxt, fp).count() == 0
    # a new dictionary rescans everything
    assert I.changed_files(new, nxt, "other").count() == new.count()


def test_failed_files_are_not_marked_done(spark):
    listing = spark.createDataFrame([("a", 1, ""), ("b", 2, "boom")], "path string, size long, error string") \
        .withColumn("mtime", F.current_timestamp())
    empty = I.state_from_listing(listing.limit(0).drop("error"), "fp")
    nxt = I.next_state(empty, listing, "fp")
    assert [r["path"] for r in nxt.collect()] == ["a"]


def test_newest_scan_wins_whatever_the_mtime(spark):
    rows = [("older", 50, 9), ("same", 100, 7), ("kept", 100, 1), ("gone", 100, 1)]
    cols = "path string, mtime long, size long"
    state = I.state_from_listing(spark.createDataFrame([(p, 100, 1) for p, *_ in rows], cols), "fp")
    listing = spark.createDataFrame(rows[:3], cols)
    changed = I.changed_files(listing, state, "fp")
    assert sorted(r.path for r in changed.collect()) == ["older", "same"]
    nxt = I.next_state(state, changed, "fp", listing)
    assert sorted((r.path, r.mtime, r.size) for r in nxt.select("path", "mtime", "size").collect()) == sorted(rows[:3])
    assert I.changed_files(listing, nxt, "fp").count() == 0


def test_a_changed_file_that_fails_is_tried_again(spark):
    cols = "path string, mtime long, size long"
    state = I.state_from_listing(spark.createDataFrame([("a", 1, 1)], cols), "fp")
    failed = spark.createDataFrame([("a", 2, 1)], cols).withColumn("error", F.lit("boom"))
    assert I.next_state(state, failed, "fp").count() == 0


def test_stream_twice_adds_nothing(spark):
    src = tempfile.mkdtemp(prefix="quarry-stream-src-")
    shutil.copy(f"{SF001}/documents.parquet", os.path.join(src, "documents.parquet"))
    base = tempfile.mkdtemp(prefix="quarry-stream-out-")
    match = lambda b: match_dictionary(b.select(F.col("doc_id").cast("string").alias("id"), "text"),
                                       DICT, keys=["id"])
    for _ in range(2):
        q = I.stream_facts(I.table_stream(spark, src, "documents"), match, f"{base}/facts", f"{base}/ckpt")
        q.awaitTermination()
    out = spark.read.parquet(f"{base}/facts")
    batch = match(spark.read.parquet(f"{SF001}/documents.parquet"))
    assert out.drop("epoch").count() == batch.count()
    assert out.select("epoch").distinct().count() == 1


def test_binary_file_stream_scans_only_new_files(spark):
    from quarry.plans.jobs import evidence_stream
    rows = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").limit(12).collect()
    src = tempfile.mkdtemp(prefix="quarry-bin-src-")
    out = tempfile.mkdtemp(prefix="quarry-bin-out-")
    ckpt = tempfile.mkdtemp(prefix="quarry-bin-ckpt-")

    def put(rs):
        for r in rs:
            with open(os.path.join(src, f"{r['doc_id']}.txt"), "w", encoding="utf-8") as f:
                f.write(r["text"])

    put(rows[:6])
    evidence_stream(spark, src, DICT, out, checkpoint=ckpt).awaitTermination()
    first = spark.read.parquet(f"{out}/files").count()
    put(rows[6:])
    evidence_stream(spark, src, DICT, out, checkpoint=ckpt).awaitTermination()
    files = spark.read.parquet(f"{out}/files")
    assert first == 6 and files.count() == 12
    assert files.select("source_path").distinct().count() == 12
    facts = spark.read.parquet(f"{out}/matches")
    exp = match_dictionary(spark.createDataFrame([(f"{r['doc_id']}.txt", r["text"]) for r in rows],
                                                 "source_path string, text string"), DICT, keys=["source_path"])
    assert sorted(map(tuple, facts.select("source_path", "keyword_group", "keyword", "count").collect())) == \
        sorted(map(tuple, exp.collect()))


def test_table_stream_reads_a_folder_of_part_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    rows.repartition(4).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    (tmp_path / "in" / "other.parquet").mkdir()
    for per_trigger in (None, 1):
        out = tmp_path / f"out{per_trigger}"
        stream = I.table_stream(spark, str(tmp_path / "in"), "documents", per_trigger)
        I.stream_facts(stream, lambda b: b, f"{out}/facts", f"{out}/checkpoint").awaitTermination()
        assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/facts").collect()) == list(range(20))


def test_stream_queries_read_tables_of_part_files(spark, tmp_path):
    from quarry.catalog import QUERIES
    spark.read.parquet(f"{SF001}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("stream_scan", "stream_group_totals"):
        got, want = (sorted(map(tuple, QUERIES[name](spark, d).collect())) for d in (str(tmp_path), SF001))
        assert got == want and got
