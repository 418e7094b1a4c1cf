import random
import re

import numpy as np
import pytest

from quarry.llm import jaccard_tree as J
from rows import clashing, docs, empty


def sets(texts, k=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute(rows):
    s = sets([t for _, t in rows])
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= 80 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                top[max(a, b, key=lambda x: rows[x][0])] = min(a, b, key=lambda x: rows[x][0])
    return {rows[i][0]: (len(s[i]), rows[find(i)][0]) for i in range(len(rows))}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstu")
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 5, 9, 40, 120, 300]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    chain = [word() for _ in range(200)]
    for i in range(30):                                    # each links with the next ones only
        texts.append(" ".join(chain[i * 4:] + [f"n{j}" for j in range(i * 4)]))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [256, 3])
def test_components_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "FAMILY", block)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_trees_lose_no_pair_that_can_link():
    rng = np.random.default_rng(3)
    own = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(1, 400, 120)]
    own += [np.unique(np.concatenate([x[: len(x) * 9 // 10], rng.integers(0, 2**63, len(x) // 12).astype(np.uint64)])) for x in own if len(x) > 12]
    n = np.array([len(x) for x in own])
    i, j = J.may_link(np.arange(len(own)), n, np.arange(len(own)), np.full(len(own), 2), [J.bitmap(x) for x in own], 80)
    left = set(zip(i.tolist(), j.tolist()))
    for a in range(len(own)):
        for b in range(a):
            both = len(np.intersect1d(own[a], own[b]))
            if 100 * both >= 80 * (n[a] + n[b] - both):
                assert (a, b) in left or (b, a) in left
    assert len(left) < len(own) ** 2 // 10                 # and drop nearly all that can't


def test_nulls_repeats_and_clashing_columns(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.link_components(clashing(docs(spark))).collect()]
    assert len(got) == 11
    by = {d: (n, c) for d, n, c in got}
    assert by[1] == (7, 1) and by[5] == (7, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (0, 4)
    assert by[7] == (1, 7) and by[8] == (1, 7) and by[None] == (1, None) and by[9][0] == 59_996
    assert J.link_components(empty(spark)).count() == 0
    one = J.one_of_each(clashing(docs(spark)))
    assert one.columns == clashing(docs(spark)).columns
    assert sorted([r.doc_id for r in one.collect()], key=str) == sorted([1, 2, 3, 4, 7, 9, -4, None], key=str)
