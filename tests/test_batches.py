"""Bounded batches in tasks: pieces of Arrow batches, and a match task's facts."""

import pyarrow as pa

from quarry import KeywordDictionary
from quarry.functions.batches import pieces
from quarry.operators.match import _count_job, match_dictionary, plan_spec

D = KeywordDictionary({"g": ["needle", "hay"]})


def test_pieces_are_bounded_and_whole():
    texts = ["x" * (i % 50) for i in range(5000)] + [None, "y" * 10_000, ""]
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts)})
    got = list(pieces([batch, batch.slice(7, 3), batch.slice(0, 0)], rows=100, size=1000))
    assert [x for b in got for x in b.column("t").to_pylist()] == texts + texts[7:10]
    assert all(b.num_rows == 1 or b.num_rows <= 100 and b.nbytes <= 1000 for b in got)


def test_a_match_task_hands_out_facts_in_bounded_batches():
    n = 10_000
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(n), pa.int64()), "text": pa.array(["needle in hay"] * n)})
    job = _count_job(["id"], "text", "dictionary", False, plan_spec(D, "dictionary", False), False, False, totals=True)
    got = list(job(iter([batch])))
    assert sum(b.num_rows for b in got) == 3 * n and max(b.num_rows for b in got) <= 3100
    assert sorted(set(pa.Table.from_batches(got).column("id").to_pylist())) == list(range(n))


def test_match_keeps_large_and_missing_numbers(spark):
    big = 2**60 + 1
    rows = spark.createDataFrame([(big, "needle"), (None, "needle"), (None, "needle"), (big + 1, "hay")], "id long, text string").coalesce(1)
    got = sorted(map(tuple, match_dictionary(rows, D, keys=["id"], spread=False).select("id", "keyword", "count").collect()), key=str)
    assert got == sorted([(big, "needle", 1), (None, "needle", 1), (None, "needle", 1), (big + 1, "hay", 1)], key=str)
