"""Matching: golden counts, hand-made edge cases, exact windowing, native == automaton."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from quarry.catalog import DICT
from quarry.operators.match import (match_boundary, match_dictionary, match_file_scope,
                                    match_units, roll_up)
from quarry.sources import corpus
from quarry.sources.dictionary import KeywordDictionary

# golden (units with a hit, total hits) per display keyword at sf0.01, dictionary mode
GOLDEN_DOCS = {"token": (12, 13), "token = ": (12, 13), "License": (39, 64),
               "GNU General Public License": (9, 9), "licensed under": (29, 29), "@": (11, 12),
               "example.com": (11, 12), "mail5.example.com": (3, 3), "the": (701, 25915),
               "tion": (744, 16144), "thth": (481, 2328), "This": (436, 1347), "auss": (34, 52),
               "nicht": (97, 316)}
GOLDEN_PAGES = {"token": (3, 3), "License": (8, 14), "example.com": (95, 97), "the": (231, 6662),
                "tion": (214, 4156), "thth": (185, 734), "This": (106, 356), "auss": (13, 27),
                "nicht": (44, 122)}
BOUNDARY_DOC_GROUPS = {"Credentials": 12, "Licensing": 39, "Contact": 11, "Common": 677,
                       "German": 94, "Misc": 47}
BOUNDARY_DOC_KEYWORDS = {("Credentials", "token"): 12, ("Licensing", "License"): 35,
                         ("Licensing", "GNU General Public License"): 9, ("Licensing", "licensed under"): 29,
                         ("Contact", "@"): 11, ("Contact", "example.com"): 11,
                         ("Contact", "mail5.example.com"): 3, ("Common", "the"): 615, ("Common", "tion"): 320,
                         ("Common", "thth"): 252, ("Common", "This"): 423, ("German", "nicht"): 94,
                         ("Misc", "token"): 12, ("Misc", "license"): 35}


def _per_keyword(facts, key):
    once = facts.groupBy(key, "keyword").agg(F.max("count").alias("c"))
    rows = once.groupBy("keyword").agg(F.count(F.lit(1)).alias("units"), F.sum("c").alias("hits")).collect()
    return {r["keyword"]: (r["units"], r["hits"]) for r in rows}


@pytest.mark.parametrize("method", ["automaton", "native"])
def test_dictionary_golden_documents(spark, method):
    f = match_dictionary(corpus.docs(spark, SF01), DICT, keys=["display_path"], method=method)
    assert _per_keyword(f, "display_path") == GOLDEN_DOCS


def test_dictionary_golden_pages(spark):
    f = match_dictionary(corpus.pages(spark, SF01), DICT, keys=["display_path"])
    got = _per_keyword(f, "display_path")
    for k, v in GOLDEN_PAGES.items():
        assert got[k] == v, k


def test_dictionary_golden_conversations(spark):
    f = match_dictionary(corpus.convs(spark, SF01), DICT, keys=["source_path", "unit_idx"])
    conv = roll_up(f, ["source_path"])
    got = _per_keyword(conv, "source_path")
    assert got["the"] == (82, 3719) and got["thth"] == (70, 360) and got["auss"] == (2, 3)
    groups = {r[0]: r[1] for r in conv.groupBy("keyword_group").agg(F.count_distinct("source_path")).collect()}
    assert groups == {"Common": 90, "German": 11}


@pytest.mark.parametrize("method", ["automaton", "native"])
def test_boundary_golden_documents(spark, method):
    f = match_boundary(corpus.docs(spark, SF01), DICT, keys=["display_path"], method=method)
    groups = {r[0]: r[1] for r in f.groupBy("keyword_group").agg(F.count_distinct("display_path")).collect()}
    assert groups == BOUNDARY_DOC_GROUPS
    kws = {(r[0], r[1]): r[2] for r in
           f.groupBy("keyword_group", "keyword").agg(F.count_distinct("display_path")).collect()}
    assert kws == BOUNDARY_DOC_KEYWORDS
    multi = f.groupBy("display_path").agg(F.count_distinct("keyword_group").alias("n")).where("n > 1").count()
    assert multi == 63


def _texts(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def _counts(df):
    return {(r["id"], r["keyword"]): r["count"] for r in df.collect()}


EDGE = [
    # (text, keyword, dictionary count, boundary hit)
    ("aaaa", "aa", 3, False),
    ("c++x", "c++", 1, True),
    ("c++ x", "c++", 1, False),
    ("épass", "pass", 1, False),
    ("a_pass", "pass", 1, False),
    ("Straße", "STRASSE", 1, False),
    ("Token token", "token", 2, True),
]


@pytest.mark.parametrize("method", ["automaton", "native"])
def test_edge_cases(spark, method):
    for i, (text, kw, n, hit) in enumerate(EDGE):
        d = KeywordDictionary({"G": [kw]})
        df = _texts(spark, [text])
        dic = _counts(match_dictionary(df, d, keys=["id"], method=method))
        assert dic.get((0, kw), 0) == n, (text, kw)
        bnd = _counts(match_boundary(df, d, keys=["id"], method=method))
        assert ((0, kw) in bnd) == hit, (text, kw)


def test_case_sensitive(spark):
    d = KeywordDictionary({"G": ["token"]})
    df = _texts(spark, ["Token token"])
    assert _counts(match_dictionary(df, d, keys=["id"], case_sensitive=True)) == {(0, "token"): 1}


def test_two_spellings_share_display(spark):
    d = KeywordDictionary({"A": ["Token"], "B": ["token"]})
    rows = match_dictionary(_texts(spark, ["TOKEN"]), d, keys=["id"]).collect()
    assert sorted((r["keyword_group"], r["keyword"], r["count"]) for r in rows) == [("A", "Token", 1), ("B", "Token", 1)]


def test_unit_vs_file_scope(spark):
    d = KeywordDictionary({"G": ["password"]})
    units = spark.createDataFrame([("f", 0, "pass"), ("f", 1, "word")], "file string, unit_idx int, text string")
    unit = roll_up(match_dictionary(units, d, keys=["file", "unit_idx"]), ["file"])
    assert unit.count() == 0
    whole = match_file_scope(units, d, file_keys=["file"])
    assert [(r["file"], r["count"]) for r in whole.collect()] == [("f", 1)]


def test_file_scope_many_short_units(spark):
    """Hits spanning several one-character units are found by the pointer-jumping seams."""
    d = KeywordDictionary({"G": ["abcdefgh", "hab", "a"]})
    text = "abcdefghabcdefgh"
    units = spark.createDataFrame([("f", i, ch) for i, ch in enumerate(text)], "file string, unit_idx int, text string")
    got = {r["keyword"]: r["count"] for r in match_file_scope(units, d, file_keys=["file"]).collect()}
    assert got == {"abcdefgh": 2, "hab": 1, "a": 2}


def _brute_count(text, kw):
    return sum(1 for i in range(len(text)) if text.startswith(kw, i))


def test_spread_rows_give_the_same_facts(spark):
    docs = corpus.docs(spark, SF01)
    keys = ["display_path"]
    for mode in ["dictionary", "boundary"]:
        a = sorted(tuple(r) for r in match_units(docs, DICT, keys=keys, mode=mode, spread=False).collect())
        b = sorted(tuple(r) for r in match_units(docs, DICT, keys=keys, mode=mode, spread=8).collect())
        assert a == b, mode


def test_long_texts_final_sigma_and_linear_time(spark):
    """A capital sigma keeps its neighbours; 16 Mi characters take about four times as long as 4 Mi."""
    import time
    d = KeywordDictionary({"G": ["ΟΣΑ", "needle"]})
    text = "x" * (1 << 20) + " ΟΣΑ " + "y" * (1 << 20) + "ΟΣ needle"
    got = _counts(match_dictionary(_texts(spark, [text]), d, keys=["id"], spread=False))
    assert got == {(0, "ΟΣΑ"): 1, (0, "needle"): 1}
    times = []
    for n in (4 << 20, 16 << 20):
        df = spark.range(1).selectExpr("id", f"repeat('abcd efg', {n // 8}) AS text")
        match_dictionary(df, d, keys=["id"], spread=False).count()
        t = time.time()
        assert match_dictionary(df, d, keys=["id"], spread=False).count() == 0
        times.append(time.time() - t)
    assert times[1] < 10 * times[0] + 2


def test_facts_accumulate_across_arrow_batches(spark):
    """Rows of one key that straddle Arrow batch borders are summed to one fact."""
    d = KeywordDictionary({"G": ["ab"]})
    df = spark.createDataFrame([(0, "ab" * 5)] * 100 + [(1, "xab")] * 30, "id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = _counts(match_dictionary(df, d, keys=["id"], spread=False))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    assert got == {(0, "ab"): 500, (1, "ab"): 30}


def test_boundary_mode_reads_universal_newlines(spark):
    d = KeywordDictionary({"G": ["foo\nbar"]})
    df = _texts(spark, ["foo\r\nbar", "foo\rbar", "foo\nbar", "foo\n\nbar"])
    for method in ("automaton", "native"):
        assert set(_counts(match_boundary(df, d, keys=["id"], method=method))) == {(i, "foo\nbar") for i in range(3)}, method


def test_random_against_python(spark):
    """Random texts over a small alphabet: both forms equal plain Python counting and re."""
    import random
    rnd = random.Random(7)
    alphabet = "ab_ ß.é"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    kws = ["ab", "aba", "b_a", "ss", " a", "é", "a.b", "ß"]
    d = KeywordDictionary({"G": kws})
    df = _texts(spark, texts)
    exp_dict, exp_bnd = {}, set()
    for i, t in enumerate(texts):
        for kw in dict.fromkeys(k.casefold() for k in kws):
            c = _brute_count(t.casefold(), kw)
            if c:
                disp = next(k for k in kws if k.casefold() == kw)
                exp_dict[(i, disp)] = c
        for kw in kws:
            if re.search(r"\b" + re.escape(kw.lower()) + r"\b", t.lower()):
                exp_bnd.add((i, kw))
    for method in ["automaton", "native"]:
        assert _counts(match_dictionary(df, d, keys=["id"], method=method)) == exp_dict, method
        assert set(_counts(match_boundary(df, d, keys=["id"], method=method))) == exp_bnd, method


def test_file_scope_both_modes_equal_joined_text(spark):
    """Random splits of random texts: file scope equals matching the joined text."""
    import random
    rnd = random.Random(11)
    kws = ["ab", "b a", "a_b", "ab.", "ba", "aba"]
    d = KeywordDictionary({"G": kws, "H": ["ab"]})
    rows, whole = [], {}
    for f in range(40):
        text = "".join(rnd.choice("ab _.") for _ in range(rnd.randint(1, 40)))
        cuts = sorted(rnd.sample(range(1, len(text)), k=min(len(text) - 1, rnd.randint(0, 6)))) if len(text) > 1 else []
        parts = [text[i:j] for i, j in zip([0] + cuts, cuts + [len(text)])]
        for i, p in enumerate(parts):
            rows.append((f"f{f}", i, p))
        whole[f"f{f}"] = text
    units = spark.createDataFrame(rows, "file string, unit_idx int, text string")
    joined = spark.createDataFrame(list(whole.items()), "file string, text string")
    for mode in ["dictionary", "boundary"]:
        got = sorted(map(tuple, match_file_scope(units, d, file_keys=["file"], mode=mode).collect()))
        exp = sorted(map(tuple, match_units(joined, d, keys=["file"], mode=mode).collect()))
        assert got == exp, mode


def test_file_scope_ignores_index_gaps_and_empty_units(spark):
    d = KeywordDictionary({"G": ["password"]})
    rows = [("f", 0, "xpass"), ("f", 3, ""), ("f", 7, "word"), ("g", 1, "pass"), ("h", 2, "word")]
    units = spark.createDataFrame(rows, "file string, unit_idx int, text string")
    got = {r["file"]: r["count"] for r in match_file_scope(units, d, file_keys=["file"]).collect()}
    assert got == {"f": 1}


def test_file_scope_plan_does_not_grow_with_the_keyword(spark):
    units = spark.createDataFrame([("f", i, "ab") for i in range(9)], "file string, unit_idx int, text string")
    sizes = []
    for n in (3, 200):
        df = match_file_scope(units, KeywordDictionary({"G": ["ab" * n]}), file_keys=["file"])
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD"))
    assert sizes[0] == sizes[1] and sizes[0] <= 3
