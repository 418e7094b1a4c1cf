"""Columns that the caller has come back untouched, whatever an operator calls its own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from quarry.llm import importance, jaccard_tree, line_dedup, linkgraph, mixing
from rows import docs

SF = "/root/testdata/sf0.001"
NAMES = ["_key", "_exponent", "_copies", "_copy", "_of", "_id", "_th", "_at", "_p", "_w", "id", "th", "keep", "log_weight", "size", "shard", "slot", "low",
         "said", "pages", "good", "bad", "trust", "distrust", "lo", "hi", "island", "new", "removed", "n_lines", "n_removed", "target", "taken", "group",
         "passes", "copies", "crc", "host", "path", "rule", "verdict", "src", "dst", "w", "mass", "a", "b", "s", "n", "m", "lead", "component_id",
         "n_shingles", "_kept_0_", "_kept_7_", "with space", "dotted.name"]


def marked(df):
    own = {c: F.concat(F.lit(f"mine {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in NAMES if c not in df.columns}
    return df.withColumns(own), list(own)


def check(out, names, new=()):
    rows = out.collect()
    assert rows and len({c.lower() for c in out.columns}) == len(out.columns)
    for c in names:
        assert c in out.columns
        if c not in new:
            assert all(r[c] == f"mine {c} {'null' if r.doc_id is None else r.doc_id}" for r in rows), c
    return rows


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_stages(spark, tmp_path, name, stage):
    df, names = marked(docs(spark))
    out = stage(spark, df, SF)
    new = ("size", "shard", "slot") if name == "shards" else ()
    check(out, names, new)
    assert set(out.columns) == set(df.columns)
    out.write.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("name, operator, new", [
    ("classify", lambda s, d: importance.classify(d, s.read.parquet(f"{SF}/labels.parquet")), ("log_weight", "keep")),
    ("one_of_each", lambda s, d: jaccard_tree.one_of_each(d), ()),
    ("apply_mix", lambda s, d: mixing.apply_mix(d), ()),
    ("dedup_lines", lambda s, d: line_dedup.dedup_lines(d), ("n_lines", "n_removed", "removed"))])
def test_operators(spark, name, operator, new):
    df, names = marked(docs(spark))
    out = operator(spark, df)
    check(out, names, new)
    if name == "classify":
        assert set(r.keep for r in out.collect()) <= {True, False}


def test_judge(spark):
    rows = [(1, "http://www.example.com/en/x", None), (2, "http://b.net/es/1", ""), (3, None, None)]
    df, names = marked(spark.createDataFrame(rows, "doc_id long, url string, html string"))
    new = ("host", "path", "rule", "verdict", "trust", "distrust")
    got = check(linkgraph.judge(df), names, new)
    assert {r.doc_id: r.verdict for r in got} == {1: "allow", 2: "block", 3: "allow"}
