"""The continuous scan: hidden and rewritten files, paths that go, restarts, counters, large files."""

import os

import pytest
from pyspark.sql import functions as F

from quarry import KeywordDictionary
from quarry.plans.jobs import COUNTERS, evidence_scan, evidence_stream, stream_tables
from quarry.sources import ranges as R
from quarry.streaming import listing as L

D = KeywordDictionary({"g1": ["needle", "straw"], "g2": ["needle"]})


def test_stream_sees_hidden_rewritten_and_lost_files_and_repeats_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "RANGE_BYTES", 2000)            # the large file is scanned by ranges
    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / "sub" / ".deep").mkdir(parents=True)
    write = lambda name, text: (root / name).write_text(text)
    write(".env", "a needle")
    write("_n.txt", "straw and a needle")
    write("sub/a.txt", "nothing")
    write("sub/.deep/b.txt", "needle needle")
    write("large.txt", "hay " * 5000 + "needle")
    (root / "loop").symlink_to(root)
    (root / "dangling").symlink_to(root / "nowhere")

    def run():
        evidence_stream(spark, str(root), D, out).awaitTermination()
        return spark.read.parquet(f"{out}/files").count()

    assert run() == 6
    first = {r.source_path: r for r in spark.read.parquet(f"{out}/files").collect()}
    assert {p for p, r in first.items() if r.matched} == {".env", "_n.txt", "sub/.deep/b.txt", "large.txt"}
    assert [p for p, r in first.items() if r.error] == ["dangling"]
    assert run() == 6                                      # a restart scans nothing twice
    write("sub/a.txt", "now a needle")
    os.utime(root / "_n.txt", (1, 1))                      # restored with an older time
    os.remove(root / ".env")
    write("new.md", "straw")
    assert run() == 9
    assert run() == 9                                      # the lost file is told with the listing after
    now = stream_tables(spark, out)
    batch = evidence_scan(spark, str(root), D, str(tmp_path / "batch"))
    cols = ["source_path", "size", "mtime", "bytes_read", "matched", "error"]
    assert sorted(map(tuple, now.files.select(*cols).collect())) == sorted(map(tuple, batch.result.files.select(*cols).collect()))
    cols = ["source_path", "keyword_group", "keyword", "count"]
    assert sorted(map(tuple, now.facts.select(*cols).collect())) == sorted(map(tuple, batch.result.facts.select(*cols).collect()))


def test_counters_of_the_batches_add_up_to_the_batch_jobs(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    for step in range(3):
        for i in range(4):
            (root / f"{step}_{i}.txt").write_text("a needle" if i % 2 else "hay " * i)
        evidence_stream(spark, str(root), D, out).awaitTermination()
    rows = spark.read.parquet(f"{out}/metrics")
    assert rows.count() == 3 and rows.where("seconds > 0").count() == 3
    total = rows.agg(*[F.sum(c).alias(c) for c in COUNTERS]).first().asDict()
    batch = evidence_scan(spark, str(root), D, str(tmp_path / "batch")).metrics
    assert total == {c: batch[c] for c in COUNTERS}


def test_another_dictionary_scans_everything_anew(spark, tmp_path):
    rows = [("p", "p", 1, "2024-01-01 00:00:00", "", "1970-01-01 00:00:01"), ("q", "q", None, None, "bad", "1970-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "path string, rel_path string, size long, mtime string, error string, listed_at string")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("mtime", "listed_at")})
    got = []
    for i, fp in enumerate(["one", "one", "two"]):
        df.withColumn("listed_at", F.timestamp_seconds(F.lit(i + 1))).write.parquet(f"{tmp_path}/in/n={i}")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/n=*")
        q = (L.listing_changes(stream, fp).writeStream.outputMode("update")
             .foreachBatch(lambda b, _, i=i: got.extend((i, r.rel_path, r.change, r.error) for r in b.collect()))
             .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
    assert sorted(got) == [(0, "p", "new", ""), (0, "q", "new", "bad"), (2, "p", "changed", ""), (2, "q", "changed", "bad")]


@pytest.mark.parametrize("wide", [1, 2, 64])
def test_a_trigger_lists_every_folder_once(tmp_path, monkeypatch, wide):
    monkeypatch.setattr(L, "WIDE", wide)
    for i in range(5):
        (tmp_path / f"d{i}" / "e" / "f").mkdir(parents=True)
        (tmp_path / f"d{i}" / "e" / "f" / "x.txt").write_text("x")
        (tmp_path / f"d{i}" / "y").write_text("yy")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "z").write_text("z")
    reader = L._ListingReader({"path": f"file://{tmp_path}", "exclude": "out"})
    parts = reader.partitions(reader.initialOffset(), {"at": 5})
    rows = [r for p in parts for r in reader.read(p)]
    assert sorted(r[1] for r in rows) == sorted([f"d{i}/y" for i in range(5)] + [f"d{i}/e/f/x.txt" for i in range(5)])
    assert len(parts) >= min(wide, 5) and {r[5].timestamp() for r in rows} == {0.005} and reader.latestOffset()["at"] > 10**12
