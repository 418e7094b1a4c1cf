import random

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import importance as I
from rows import clashing, docs, empty

SF1 = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    seen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0)
    got = I.classify(d, seen).join(labels.join(seen, "doc_id", "left_anti"), "doc_id")
    share = {(r.quality, r.toxic): r.kept for r in got.groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert share[1, 0] > 0.95 and share[0, 0] < 0.05 and share[0, 1] < 0.1 and share[1, 1] < 0.5


def test_counts_are_of_documents(spark):
    rows = [(1, "good plain words"), (2, "good other words"), (3, "bad!! bad!!"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert I.fit(df, labels).max() <= 0
    assert not I.fit(df, labels.limit(0)).any()


def test_kth_largest_by_bins(spark):
    rng = random.Random(1)
    keys = [rng.choice([rng.gauss(0, 1), rng.expovariate(0.01), 3.0, -1e9]) for _ in range(9000)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key double")
    for k in (1, 2, 500, 4500, 8999, 9000, 20_000):
        assert I.top_k_from(df, "key", k, few=64) == sorted(keys, reverse=True)[min(k, len(keys)) - 1]
    assert I.top_k_from(df, "key", 0) is None and I.top_k_from(df.limit(0), "key", 5) is None


def test_gumbel_top_k_draws_by_weight(spark):
    n = 4000
    rows = [(i, "plain words here" if i % 2 else "odd!! words??") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ratio = np.zeros(I.BUCKETS, np.float32)
    odd = next(I.features(__import__("pyarrow").array(["odd!! words??"])))
    plain = next(I.features(__import__("pyarrow").array(["plain words here"])))
    ratio[np.setdiff1d(odd, plain)[:1]] = -1.0
    w = float(ratio[odd].sum() / np.sqrt(len(odd) + I.EVEN))
    got = I.resample(df, ratio, k=n // 4, tolerance=0.0, power=np.log(3) / -w).collect()
    kept = [r for r in got if r.keep]
    assert len(kept) == n // 4
    assert 0.70 < sum(r.doc_id % 2 for r in kept) / len(kept) < 0.80          # three to one, less what runs out
    again = I.resample(df.repartition(7), ratio, k=n // 4, tolerance=0.0, power=np.log(3) / -w).where("keep").collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in kept}


def test_nulls_repeats_and_clashing_columns(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, 0, None), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = I.classify(clashing(docs(spark)), labels)
    rows = got.collect()
    assert len(rows) == 11 and not any(r.keep for r in rows if r.doc_id in (2, 3, 4))
    assert all(r.keep for r in rows if r.doc_id in (1, 5, 7, 8, 9, None))
    assert got.columns[-2:] == ["log_weight", "keep"]
    assert I.classify(empty(spark), labels).count() == 0
    assert I.classify(docs(spark), labels.limit(0)).where("keep").count() == 8
