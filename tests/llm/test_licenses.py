import re

from quarry.llm import licenses as L
from rows import LONG, clashing, docs, empty

TEXTS = ["Licensed under the Apache License, Version 2.0.", "cc by CC-BY cc by", "general public  license all rights RESERVED",
         "x " * 200 + "Released under the MIT License." + " y" * 50, "license apache the under 2 0 version licensed",
         "released under the mit", "This work is licensed under the GNU General Public License, version 3.", "", None,
         "CC BY-NC 4.0", "Licensed under CC BY-NC 4.0 " + "all rights reserved " * 3, "reservedall rights reserved", LONG]


def words(t):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(t):
    w = words(t)
    places, base = [], set()
    for p, label in L.PHRASES.items():
        ws = p.split()
        own = [i for i in range(len(w)) if w[i:i + len(ws)] == ws]
        places += own
        base |= {label} if own else set()
    step = max(len(x.split()) for x in L.TEMPLATES)
    found, best = set(base), 1.0 if places else 0.0
    for a in range(0, len(w), step):
        block = set(w[a:a + 2 * step])
        for x, label in L.TEMPLATES.items():
            share = len(block & set(x.split())) / len(set(x.split()))
            if share >= L.CONTAINMENT:
                found.add(label)
                best = max(best, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(found)), best)


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in L.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(TEXTS[r.doc_id]), r.doc_id


def test_blocks_name_their_matches(spark):
    df = spark.createDataFrame([(1, TEXTS[3])], "doc_id long, text string")
    (r,) = L.scan(df).collect()
    assert {b.label for b in r.blocks} == {"mit"} and all(b.share >= 0.9 and b.first_word <= 200 for b in r.blocks)


def test_nulls_repeats_and_clashing_columns(spark):
    got = L.scan(clashing(docs(spark))).collect()
    assert len(got) == 11 and {r.n_words for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert L.scan(empty(spark)).count() == 0
    assert L.scan(docs(spark), templates={}, phrases={}).where("labels <> '' OR score > 0").count() == 0


def test_global_token_order_does_not_change_matches(spark):
    many = [(i, "the license the license") for i in range(50)] + [(99, TEXTS[0])]
    got = {r.doc_id: r.labels for r in L.scan(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    assert got[99] == "apache-2.0" and got[0] == ""
