import random
import re

import pytest

from quarry.llm import line_dedup as L
from rows import clashing, docs, empty


def brute(rows, min_words):
    kept, runs = {}, []
    count = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s))
    solid = {d: [(i, x, count(x)) for i, x in enumerate(t.split("\n")) if count(x)] for d, t in rows}
    for d, own in solid.items():
        found = set()
        for a in range(len(own)):
            for b in range(a, len(own)):
                if sum(w for *_, w in own[a:b + 1]) >= min_words:
                    found.add((a, b))
                    break
            for b in range(a, -1, -1):
                if sum(w for *_, w in own[b:a + 1]) >= min_words:
                    found.add((b, a))
                    break
        runs += [(d, a, b, tuple(x for _, x, _ in own[a:b + 1])) for a, b in found]
    first, gone = {}, {d: set() for d, _ in rows}
    for d, a, b, key in sorted(runs):
        if key not in first:
            first[key] = d, b
        else:
            lead, end = first[key]
            lo = max(a, end + 1) if lead == d else a
            if lo <= b:
                gone[d] |= set(range(solid[d][lo][0], solid[d][b][0] + 1))
    for d, t in rows:
        kept[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), len(gone[d])
    return kept


@pytest.mark.parametrize("seed, min_words", [(1, 4), (2, 8), (3, 20)])
def test_against_brute_force(spark, seed, min_words):
    rng = random.Random(seed)
    lines = ["", " ", "a", "a b", "c d e", "f g h i j", "k l", "m n o p q r s t"] + [f"line {i} x" for i in range(6)]
    passage = [rng.choice(lines) for _ in range(12)]
    rows = []
    for d in range(60):
        own = [rng.choice(lines + [f"own {d} {i}" for i in range(20)]) for i in range(rng.randint(0, 14))]
        at = rng.randint(0, len(own))
        if rng.random() < 0.4:
            own[at:at] = passage[rng.randint(0, 4):]
        rows.append((d, "\n".join(own)))
    rows.append((900, "same words again\n" * 40))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in L.dedup_lines(df, min_words).collect()}
    assert got == brute(rows, min_words)


def test_every_line_stays_somewhere(spark):
    passage = "\n".join(f"line {i} of a passage that is shared by many" for i in range(9))
    rows = [(i, f"start {i}\n{passage}\nend {i}") for i in range(200)]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"start {i}\nend {i}" for i in range(1, 200))


def test_nulls_repeats_and_clashing_columns(spark):
    long = "\n".join(f"row {i} with words" for i in range(5000))
    more = [(20, long, "en", "a", 1), (21, long, "en", "a", 1), (21, long, "en", "a", 1)]
    from rows import ROWS
    got = L.dedup_lines(clashing(docs(spark, ROWS + more)))
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].text is None and by[2][0].n_lines == 0 and by[3][0].text == "" and by[3][0].n_lines == 1
    assert by[20][0].n_removed == 0 and [r.text for r in by[21]] == ["", ""] and by[21][0].n_removed == 5000
    assert len(by[5]) == 2 and by[9][0].n_removed == 0
    assert L.dedup_lines(empty(spark)).count() == 0
