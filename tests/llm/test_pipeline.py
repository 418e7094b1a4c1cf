import pytest

import corpus_pipeline as C
from rows import clashing, docs, empty

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order_and_their_columns(spark):
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "benchmark_leaks", "mix_sources", "shards"] and C.ORACLE_SQL is None
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in whole.select("doc_id").collect()}
    out = C.run(spark, SF)
    rows = out.collect()
    assert out.columns == [*COLUMNS, "size", "shard", "slot"] and rows
    assert {r.doc_id for r in rows} <= ids
    for s in range(C.N_SHARDS):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_each_stage_on_nulls_repeats_and_empty_tables(spark, name, stage):
    got = stage(spark, docs(spark), SF)
    assert got.columns[:5] == COLUMNS and (name in ("shards", "mix_sources") or got.columns == COLUMNS)
    n = got.count()
    assert n == {"quality": 8, "near_duplicates": 8, "benchmark_leaks": 11, "shards": 11}.get(name, n)
    assert stage(spark, empty(spark), SF).count() == 0
    assert stage(spark, clashing(docs(spark)).drop("size", "shard", "slot"), SF).count() == n


def test_mix_keeps_targets(spark):
    rows = [(i, "word " * (1 + i * 7 % 90), "en", f"s{i % 5}", 1) for i in range(2000)]
    before = docs(spark, rows)
    after = C.mix_sources(spark, before, SF).collect()
    total = sum(len(t.split()) for _, t, *_ in rows)
    shares = {"s0": 5, "s1": 2, "s2": 1, "s3": 5, "s4": 2}
    for s, w in shares.items():
        own = sum(len(r.text.split()) for r in after if r.source == s)
        assert own == pytest.approx(total * w / 15, rel=0.05)
