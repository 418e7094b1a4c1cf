from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing
from rows import clashing, docs, empty


def brute_seats(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min(votes, key=lambda v: (-Fraction(votes[v], 2 * won[v] + 1), v))
        won[best] += 1
    return won


@pytest.mark.parametrize("votes, seats", [
    ({"a": 53, "b": 24, "c": 23}, 7), ({"a": 1, "b": 1, "c": 1}, 2), ({"a": 1000, "b": 1, "c": 0}, 40), ({"a": 5}, 0),
    ({f"p{i:02d}": (i * 37) % 101 + 1 for i in range(30)}, 211), ({f"p{i}": 10 for i in range(9)}, 14)])
def test_sainte_lague_is_highest_quotients(spark, votes, seats):
    df = spark.createDataFrame([(k, v) for k, v in votes.items()], "source string, votes long")
    df = df.withColumns({"seats": F.lit(seats), "g": F.lit(0)})
    got = {r.source: r.quota for r in mixing.sainte_lague(df, ["g"], ["source"]).collect()}
    assert got == brute_seats(votes, seats)


def brute_targets(sizes, weights, most=3):
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        share = sum(weights[s] for s in free)
        want = {s: (total - sum(capped.values())) * weights[s] / share for s in free}
        over = [s for s in free if want[s] > most * sizes[s]]
        if not over:
            return {**capped, **want}
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 200, "c": 3000}, {"a": 1, "b": 1, "c": 1, "d": 1000, "e": 5}, {"a": 7}, {"a": 0, "b": 10, "c": 4}])
def test_targets_stop_at_three_times_the_source(spark, sizes):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, mixing.cycle_weights()).collect()}
    assert got == pytest.approx(brute_targets(sizes, weights))


def test_mix_reaches_targets_and_repeats_no_token_too_often(spark):
    rows = [(i, f"s{i % 7}" if i % 3 else "s0", 1 + (i * 7919) % 400) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    source = {i: s for i, s, _ in rows}
    for s in set(source.values()):
        own = [r for r in got if source[r.doc_id] == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=max(1, len(rows) // 100))
        assert sum(r["size"] for r in own) == own[0].source_size
    again = mixing.mix(df.repartition(13)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_nulls_ties_repeats_and_clashing_columns(spark):
    df = clashing(docs(spark)).drop("size").withColumn("size", mixing.word_count(F.col("text")))
    got = mixing.mix(df).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert by[2]["size"] == by[3]["size"] == by[4]["size"] == 0 and by[2].taken == 0
    assert by[9]["size"] == 60_000 and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(empty(spark).withColumn("size", F.lit(1))).count() == 0
    kept = mixing.apply_mix(clashing(docs(spark)))
    assert kept.columns == clashing(docs(spark)).columns and 0 < kept.count() <= 33
    assert mixing.apply_mix(empty(spark)).count() == 0
