import zlib

from pyspark.sql import functions as F

from quarry.llm.queries import op5_byte_shards
from quarry.llm.sharding import shard_by_bytes
from rows import clashing, docs, empty


def test_shards_are_contiguous_balanced_and_gapless(spark):
    rows = [(i, 1 + (i * 7919) % 500) for i in range(3000)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, size long"), 7).collect()
    order = sorted(got, key=lambda r: r.doc_id)
    total, start = sum(s for _, s in rows), 0
    for r in order:
        assert r.shard == sum(start >= i * total // 7 for i in range(1, 7))
        start += r["size"]
    for s in range(7):
        own = [r for r in order if r.shard == s]
        assert [r.slot for r in own] == list(range(len(own)))


def test_small_groups_stay_whole_and_a_hot_group_is_cut(spark):
    rows = [(i, i // 5, 10) for i in range(4000)] + [(10_000 + i, 333, 10) for i in range(3000)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, g long, size long"), 8, group="g").collect()
    where, sizes = {}, [0] * 8
    for r in got:
        where.setdefault(r.g, set()).add(r.shard)
        sizes[r.shard] += r["size"]
    assert len(where[333]) > 1 and all(len(w) == 1 for g, w in where.items() if g != 333)
    assert max(sizes) - min(sizes) <= 2 * 0.01 * sum(sizes) / 8 + 20


def test_nulls_repeats_and_clashing_columns(spark):
    df = clashing(docs(spark)).withColumn("size", F.octet_length("text").cast("long"))
    got = shard_by_bytes(df, 3)
    assert got.columns[-2:] == ["shard", "slot"] and got.count() == 11
    assert shard_by_bytes(empty(spark).withColumn("size", F.lit(1).cast("long")), 3).count() == 0


def test_query_on_the_given_documents(spark):
    SF001 = "/root/testdata/sf0.001"
    got = op5_byte_shards(spark, SF001).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "bytes")
