"""The q-gram filter join: facts equal to the automaton's, for thousands of keywords and without a Python worker."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quarry import KeywordDictionary
from quarry.operators.match import match_boundary, match_dictionary
from quarry.operators.qgram import match_table
from quarry.sources import corpus


def table_of(spark, d: KeywordDictionary, mode="dictionary", case_sensitive=False):
    if mode == "dictionary":
        rows = [(g, e.display, e.norm) for e in d.normalised(case_sensitive) for g in e.groups]
    else:
        rows = d.boundary_entries()
    return spark.createDataFrame(rows, "keyword_group string, keyword string, norm string")


def facts(df, *keys):
    return sorted(tuple(r) for r in df.select(*keys, "keyword_group", "keyword", "count").collect())


def many_keywords(spark, n):
    words = (corpus.table(spark, SF001, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[\\p{L}]{3,}"), F.lit(0))).alias("w"))
             .groupBy("w").count().orderBy(F.desc("count"), "w").limit(n).collect())
    groups = {}
    for i, r in enumerate(words):
        groups.setdefault(f"g{i % 7}", []).append(r["w"])
    return KeywordDictionary(groups)


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_a_thousand_keywords_equal_the_automaton(spark, broadcast_bytes):
    docs, d = corpus.docs(spark, SF001), many_keywords(spark, 1000)
    for mode, match in (("dictionary", match_dictionary), ("boundary", match_boundary))[:2 if broadcast_bytes else 1]:
        got = match_table(docs, table_of(spark, d, mode), keys=["display_path"], mode=mode, broadcast_bytes=broadcast_bytes)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan
        assert facts(got, "display_path") == facts(match(docs, d, keys=["display_path"]), "display_path")


@pytest.mark.parametrize("case_sensitive", [False, True])
@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_short_odd_and_shared_keywords(spark, case_sensitive, broadcast_bytes):
    rng = random.Random(9)
    d = KeywordDictionary({"a": ["aa", "x", "ß", "a.b", "\\E", "Σ", "NEEDLE", "needle"], "b": ["needle", "x", "(a", "a b", "aaa", "中文"]})
    marks = ["a", "aa", "x", "X", "ß", "SS", "a.b", "\\E", "Σ", "ς", "needle", "Needle", "(a", " ", "\n", "中", "文", "-", "_"]
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(300, None), (301, ""), (5, "x x"), (None, "x")]
    units = spark.createDataFrame(rows, "id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = match_table(units, table_of(spark, d, case_sensitive=case_sensitive), keys=["id"], case_sensitive=case_sensitive, broadcast_bytes=broadcast_bytes)
    expected = match_dictionary(units.where("id is not null"), d, keys=["id"], case_sensitive=case_sensitive)
    rows = sorted((tuple(r) for r in got.collect()), key=key)
    assert sorted(r for r in rows if r[0] is not None) == sorted(tuple(r) for r in expected.collect())
    assert [r[1:] for r in rows if r[0] is None] == [("a", "x", 1), ("b", "x", 1)]


def test_no_keywords(spark):
    units = spark.createDataFrame([(1, "text")], "id long, text string")
    none = spark.createDataFrame([], "keyword_group string, keyword string, norm string")
    got = match_table(units, none, keys=["id"])
    assert got.columns == ["id", "keyword_group", "keyword", "count"] and got.count() == 0
    with pytest.raises(ValueError):
        match_table(units, none, keys=["id"], mode="other")


def test_fold_of_plain_and_other_texts(spark):
    """Texts of ASCII only skip the table of folds; its expression stands in the other branch alone."""
    from quarry.functions.text import casefold_col
    texts = ["ABC xyz 0~", "Straße ŉ İ ẞ ﬀ", "ΟΣΟΣ ſK", "", None, "a" * 5000 + "ẞ", "\x7f\x00[]"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    column = casefold_col(F.col("text"))
    assert [r[0] for r in rows.select(column).collect()] == [t and t.casefold() for t in texts]
    assert "octet_length" in str(column)
