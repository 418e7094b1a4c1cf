import random

import numpy as np

from quarry.llm import decontaminate as D
from rows import clashing, docs, empty


def word(rng):
    return rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuvw") + rng.choice("aeiou")


def fixture(spark, seed=4):
    rng = random.Random(seed)
    items = [(i, " ".join(word(rng) for _ in range(rng.choice([5, 9, 15, 33, 60, 130, 300])))) for i in range(25)]
    rows, planted = [], set()
    for d in range(120):
        text = [word(rng) for _ in range(rng.randint(0, 400))]
        if d % 3 == 0:
            i, t = rng.choice(items)
            at = rng.randint(0, len(text))
            text[at:at] = t.upper().split()
            planted.add((d, i))
        rows.append((d, " ".join(text)))
    return (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
            planted, dict(rows), dict(items))


def test_finds_every_planted_item_and_nothing_else(spark):
    d, b, planted, texts, items = fixture(spark)
    got = D.find_leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    for r in got:
        assert abs(r.similarity - 1) < 1e-9 and r.n_words == len(items[r.item_id].split())
        assert texts[r.doc_id].lower().split()[r.start_word:r.start_word + r.n_words] == items[r.item_id].split()
    clean = {r.doc_id for r in D.decontaminate(d, b).collect()}
    assert clean == set(texts) - {i for i, _ in planted}


def test_an_edit_in_one_half_is_found(spark):
    rng = random.Random(9)
    item = [word(rng) for _ in range(60)]
    other = list(item)
    other[7] = "edited"
    rows = [(1, " ".join([word(rng) for _ in range(50)] + other)), (2, " ".join(item[:30]))]
    got = D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, round(r.similarity, 3)) for r in got] == [(1, 5, round(51 / 56, 3))]


def edited(rng, item):
    """Copies of an item: trimmed, changed within, with words inserted, moved apart."""
    n, other = len(item), [word(rng) + "x" for _ in range(400)]
    c = max(1, n // 13)
    yield item[c:n - c]
    yield item[n // 12:]
    yield item[:n // 2] + other[:n // 4 + 1] + item[n // 2:]
    yield item[:n // 2] + other[:3 * n] + item[n // 2:]
    yield item[:n // 2] + other[:1] + item[n // 2 + 1:]
    yield item[:n // 2] + other[:2] + item[n // 2 + 2:]
    yield item[:n // 3] + other[:1] + item[n // 3 + 1:2 * n // 3] + other[1:2] + item[2 * n // 3 + 1:]
    yield item[:n // 2]


def test_edited_copies_against_brute_force(spark):
    rng = random.Random(12)
    stem = [word(rng) for _ in range(14)]                    # some items share words, which weigh less
    items = [[word(rng) for _ in range(n)] for n in (15, 25, 30, 38, 38, 59, 59, 200, 800)] + [stem + [word(rng) for _ in range(n)] for n in (6, 20, 40)]
    texts = [[word(rng) for _ in range(30)] + copy + [word(rng) for _ in range(30)] for item in items for copy in edited(rng, item)]
    texts += [list(copy) for item in items for copy in edited(rng, item)]
    cuts = [{tuple(x[a:a + D.K]) for a in range(len(x) - D.K + 1)} for x in items]
    count = {s: sum(s in c for c in cuts) for c in cuts for s in c}
    want = {}
    for d, t in enumerate(texts):
        own = {tuple(t[a:a + D.K]) for a in range(len(t) - D.K + 1)}
        for i, c in enumerate(cuts):
            share = sum(1 / count[s] for s in c & own) / sum(1 / count[s] for s in c)
            if share >= D.SIMILARITY:
                want[d, i] = round(share, 9)
    docs_ = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    assert 60 < len(want) < len(texts)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in D.find_leaks(docs_, bench).collect()} == want
    assert {r.doc_id for r in D.decontaminate(docs_, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_lookup_at_other_radii():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 100).astype(np.uint64)
    x = np.concatenate([prints ^ np.uint64(1 << b) for b in (0, 17, 62)] + [prints, prints ^ np.uint64(31), prints ^ np.uint64(127)])
    for radius in (0, 1, 5):
        got = set(zip(*(z.tolist() for z in D.Index(prints, radius).near(x))))
        assert got == {(i, j) for i in range(len(x)) for j in range(100) if int(x[i] ^ prints[j]).bit_count() <= radius}


def test_block_lookup_finds_all_within_the_radius():
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 2**63, 300).astype(np.uint64)
    x = np.concatenate([rng.integers(0, 2**63, 500).astype(np.uint64), prints])
    for i in range(300):
        for bit in rng.choice(64, rng.integers(0, 8), replace=False):
            x[500 + i] ^= np.uint64(1) << np.uint64(bit)
    index = D.Index(prints, D.RADIUS)
    got = set(zip(*(z.tolist() for z in index.near(x))))
    assert got == {(i, j) for i in range(len(x)) for j in range(300) if int(x[i] ^ prints[j]).bit_count() <= D.RADIUS}


def test_windows_are_simhashes():
    words = np.random.default_rng(1).integers(0, 2**63, 400).astype(np.uint64)
    for size, prints in D.fingerprints(words, [5, 255, 500]).items():
        for a in (0, 3, len(prints) - 1):
            bits = [sum(int(w) >> j & 1 for w in words[a:a + size]) for j in range(64)]
            assert int(prints[a]) == sum(1 << j for j in range(64) if bits[j] > size // 2)


def test_benchmark_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEM_BYTES", 2000)
    d, b, planted, *_ = fixture(spark)
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(d, b).collect()} == planted


def test_nulls_repeats_and_clashing_columns(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "cat sat on the mat and looked"), (4, "cat sat on the mat and looked")],
                                  "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in D.find_leaks(clashing(docs(spark)), items).collect())
    assert set(got) == {(1, 4), (5, 4)}
    assert D.find_leaks(empty(spark), items).count() == 0 and D.find_leaks(docs(spark), items.limit(0)).count() == 0
    kept = D.decontaminate(clashing(docs(spark)), items)
    assert kept.columns == clashing(docs(spark)).columns and kept.count() == 8


def test_an_items_own_windows_are_looked_up_within_the_radius():
    assert D.RADIUS > 0
    rng = random.Random(21)
    far = 0
    for n in (12, 40, 60, 130, 300):
        item = [word(rng) for _ in range(n)]
        bench = D.Benchmark([7], [" ".join(item)], D.K, D.RADIUS, D.SIMILARITY)
        size = max(z for z in D.SIZES if z <= n)
        assert set(bench.index) == {D.K, size}
        index, items = bench.index[size]
        own = D.fingerprints(word_hashes(item), [size])[size]
        assert {int(own[0]), int(own[-1])} <= set(map(int, index.prints)) and set(items) == {0}
        for at in range(size):
            changed = list(item)
            changed[at] = word(rng) + "z"
            x = D.fingerprints(word_hashes(changed), [size])[size]
            near = set(index.near(x)[0].tolist())
            assert near == {i for i in range(len(x)) if min((int(x[i]) ^ int(p)).bit_count() for p in index.prints) <= D.RADIUS}
            far += any(min((int(x[i]) ^ int(p)).bit_count() for p in index.prints) > 0 for i in near)
    assert far > 50                                          # edited copies that only a radius finds


def word_hashes(words):
    import pyarrow as pa
    ((_, _, hashes),) = list(D.words_of(D._lower(pa.array([" ".join(words)])), kind=D.PLAIN))
    return hashes
