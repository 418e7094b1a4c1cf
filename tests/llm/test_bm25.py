import collections
import math
import random
import re

import pytest

from quarry.llm import bm25
from rows import clashing, docs, empty


def words(t):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())


def brute(rows, queries, k, limit):
    bags = [collections.Counter(words(t)) for _, t in rows]
    df = collections.Counter(w for b in bags for w in b)
    n, mean = len(rows), max(1, sum(sum(b.values()) for b in bags) / len(rows))
    idf = {w: math.log(1 + (n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    out = {}
    for q, t in queries:
        own = collections.Counter(words(t))
        weight = {w: idf.get(w, math.log(1 + (n + 0.5) / 0.5)) * (bm25.K3 + 1) * c / (bm25.K3 + c) for w, c in own.items()}
        assert len(weight) <= limit
        scores = []
        for (i, _), b in zip(rows, bags):
            s = sum(x * b[w] * (bm25.K1 + 1) / (b[w] + bm25.K1 * (1 - bm25.B + bm25.B * sum(b.values()) / mean)) for w, x in weight.items() if w in b)
            if s > 0:
                scores.append((-round(s, 7), i))
        out[q] = sorted(scores)[:k]
    return out


@pytest.mark.parametrize("block, shard, ranges", [(8192, 32768, 128), (3, 100, 4)])
def test_exact_top_k_against_brute_force(spark, monkeypatch, block, shard, ranges):
    monkeypatch.setattr(bm25, "RANGE", ranges)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(300)], k=rng.randint(0, 60)))) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(12)]
    queries = [(i, t) for i, t in rows if i % 50 == 0 and t]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    got = collections.defaultdict(list)
    for r in bm25.search(df, asked, k=10, query_terms=100, block=block, shard=shard).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-round(r.score, 7), r.doc_id))
    assert dict(got) == brute(rows, queries, 10, 100)


def test_registered_defaults_use_the_whole_text_of_long_queries(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(3000)], k=rng.choice([5, 80, 400, 3000])))) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(12)]
    queries = [(i, t) for i, t in rows if i % 50 == 0]
    assert max(len(set(words(t))) for _, t in queries) > 500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.defaultdict(list)
    for r in bm25.search(df, df.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.doc_id))
    want = brute(rows, queries, 10, 3000)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=1e-6)


def test_blocks_are_skipped_and_results_stay_exact(monkeypatch):
    import numpy as np
    monkeypatch.setattr(bm25, "RANGE", 32)
    rng = np.random.default_rng(5)
    # three kinds of documents with words of their own and a few in common
    bags = [np.unique(np.where(rng.random(60) < 0.05, rng.integers(0, 20, 60), 20 + 400 * (i % 3) + rng.zipf(1.4, 60) % 400), return_counts=True) for i in range(1500)]
    df = np.bincount(np.concatenate([t for t, _ in bags]), minlength=1220)
    share, idf = df / len(bags), np.log(1 + (len(bags) - df + 0.5) / (df + 0.5))
    size = np.array([len(t) for t, _ in bags])
    index = bm25.Index(np.concatenate([t for t, _ in bags]).astype(np.int32), np.concatenate([c for _, c in bags]).astype(np.int32), size,
                       np.full(len(bags), 60.0), 60.0)
    own = [(i, t.astype(np.int32), idf[t] * (bm25.K3 + 1) * c / (bm25.K3 + c)) for i, (t, c) in enumerate(bags) if i % 50 == 0]
    queries, ids = bm25.Queries(own, share), np.arange(len(bags))
    who, docs_, score = index.search(queries, 10, ids)
    assert index.scored < 0.6 * index.pairs
    every = index.exact(queries, np.repeat(np.arange(len(own)), len(bags)), np.tile(ids, len(own))).reshape(len(own), -1)
    for q in range(len(own)):
        best = np.lexsort((ids, -every[q]))[:10]
        assert docs_[who == q].tolist() == best.tolist() and score[who == q].tolist() == every[q][best].tolist()
    # a block's bound is never below a score in it
    block = index.order(share)[64:96]
    assert (index.bounds(queries, block)[:, None] >= every[:, block]).all()


def test_many_equal_documents_are_settled_exactly(spark, monkeypatch):
    monkeypatch.setattr(bm25, "HELD", 50)
    monkeypatch.setattr(bm25, "RANGE", 16)
    rows = [(i, "the same few words in each") for i in range(199, -1, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = bm25.search(df, df.where("doc_id = 150").withColumnRenamed("doc_id", "query_id")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(10))


def test_a_query_is_its_weightiest_terms(spark):
    rows = [(i, "common words") for i in range(20)] + [(50, "common words rare"), (51, "rare rare"), (52, "common words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = bm25.search(df, df.where("doc_id = 50").withColumnRenamed("doc_id", "query_id"), query_terms=1).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in got] == [(1, 51), (2, 50)]


def test_nulls_repeats_and_clashing_columns(spark):
    df = clashing(docs(spark))
    got = bm25.search(df, df.withColumnRenamed("doc_id", "query_id"), k=3)
    rows = got.collect()
    assert got.columns == ["query_id", "rank", "doc_id", "score"] and not [r for r in rows if r.query_id in (2, 3, 4)]
    assert [(r.rank, r.doc_id) for r in rows if r.query_id == 7] == [(1, 7), (2, 8)]
    assert sorted((r.rank, r.doc_id) for r in rows if r.query_id == 5) == [(1, 1), (2, 5), (3, 5)]
    assert bm25.search(empty(spark), empty(spark).withColumnRenamed("doc_id", "query_id")).count() == 0
    assert bm25.search(docs(spark), empty(spark).withColumnRenamed("doc_id", "query_id")).count() == 0
    assert bm25.search(empty(spark), docs(spark).withColumnRenamed("doc_id", "query_id")).count() == 0


def test_texts_are_read_as_often_for_many_passes_as_for_one(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i, f"some words of number{i % 7} and word{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInArrow(counted, "doc_id long, text string")
    asked = spark.createDataFrame([(i, t) for i, t in rows if i % 6 == 0], "query_id long, text string")
    seen, found = [], []
    for block in (100, 2):
        before = read.value
        found.append(sorted(map(tuple, bm25.search(df, asked, k=4, block=block).collect())))
        seen.append(read.value - before)
    assert found[0] == found[1] and len(found[0]) == 40
    assert seen[0] == seen[1]


def test_kinds_far_apart_by_common_terms_share_no_block(monkeypatch):
    import numpy as np
    monkeypatch.setattr(bm25, "RANGE", 32)
    rng = np.random.default_rng(6)
    # two kinds of documents: even and odd term numbers, the common ones of both beside each other
    bags = [np.unique(2 * (rng.zipf(1.3, 80) % 300) + i % 2, return_counts=True) for i in range(1200)]
    df = np.bincount(np.concatenate([t for t, _ in bags]), minlength=600)
    share, idf = df / len(bags), np.log(1 + (len(bags) - df + 0.5) / (df + 0.5))
    size = np.array([len(t) for t, _ in bags])
    index = bm25.Index(np.concatenate([t for t, _ in bags]).astype(np.int32), np.concatenate([c for _, c in bags]).astype(np.int32), size,
                       np.full(len(bags), 80.0), 80.0)
    queries = bm25.Queries([(i, t.astype(np.int32), idf[t] * (bm25.K3 + 1) * c / (bm25.K3 + c)) for i, (t, c) in enumerate(bags) if i % 40 < 2], share)
    order = index.order(share)[32:] % 2
    assert np.mean([len(set(order[a:a + 32])) == 1 for a in range(0, len(order), 32)]) > 0.9
    index.search(queries, 10, np.arange(len(bags)))
    assert index.scored < 0.56 * index.pairs


def test_a_bar_from_earlier_shards_leaves_only_what_can_be_better():
    import numpy as np
    rng = np.random.default_rng(7)
    bags = [np.unique(rng.zipf(1.3, 50) % 400, return_counts=True) for _ in range(300)]
    share = np.bincount(np.concatenate([t for t, _ in bags]), minlength=400) / len(bags)
    index = bm25.Index(np.concatenate([t for t, _ in bags]).astype(np.int32), np.concatenate([c for _, c in bags]).astype(np.int32),
                       np.array([len(t) for t, _ in bags]), np.full(len(bags), 50.0), 50.0)
    queries, ids = bm25.Queries([(i, t.astype(np.int32), 1.0 + t % 7) for i, (t, _) in enumerate(bags[:20])], share), np.arange(len(bags))
    who, docs_, score = index.search(queries, 10, ids)
    bar = np.array([score[who == q][4] for q in range(20)])
    who2, docs2, score2 = index.search(queries, 10, ids, bar * (1 - 1e-4))
    left = score >= bar[who]
    assert set(zip(who[left], docs_[left])) <= set(zip(who2, docs2)) and score2.min() > 0 and (score2 >= 0.999 * bar[who2]).all()
