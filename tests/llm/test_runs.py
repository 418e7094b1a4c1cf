import hashlib
import random
import zlib

import numpy as np
import pytest

from quarry.llm import runs as R
from quarry.llm.queries import QUERIES
from rows import LONG, ROWS, clashing, docs, empty


def brute(words, least=R.LEAST, power=R.POWER):
    """Every period by itself, the smallest first."""
    n, out = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def planted(rng):
    n = rng.randint(0, rng.choice([12, 60, 220]))
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n else 0):
        start, period = rng.randrange(n), rng.randint(1, 20)
        for j in range(start + period, min(n, start + rng.randint(1, 120))):
            words[j] = words[j - period]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force_however_words_are_appended(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = planted(rng)
        expected = brute(words)
        for step in (1, rng.choice([2, 3, 7, 50]), 1 << 16):
            assert R.word_runs(words, step=step) == expected, (words, step)


def test_other_bounds_and_too_small_a_power():
    words = [b"a", b"b"] * 3
    assert R.word_runs(words) == [] and R.word_runs(words, 6, 3) == brute(words, 6, 3) == [(0, 6, 2)]
    with pytest.raises(ValueError):
        R.Catchers(power=2)


def test_long_runs_are_few_steps_and_equal_spans_are_compared_word_by_word(monkeypatch):
    assert R.word_runs([b"x"] * 200_000) == [(0, 200_000, 1)]
    blocks = ([b"a"] * 999 + [b"b"]) * 40
    assert R.word_runs(blocks) == sorted([(0, 40_000, 1000)] + [(1000 * i, 999, 1) for i in range(40)])
    # every hash equal: spans seem equal everywhere, what is reported is still true
    monkeypatch.setattr(R, "mixed", lambda x: np.zeros(len(x), np.uint64))
    for seed in range(20):
        words = planted(random.Random(seed))
        for start, length, period in R.word_runs(words):
            assert words[start:start + length - period] == words[start + period:start + length]


def test_nulls_empties_repeats_and_clashing_columns(spark):
    run = "again and " * 20
    rows = [*ROWS, (20, run, "en", "a", 1), (20, run, "en", "a", 1), (21, "x\x1cx \x85 " + "z\x0bz " * 30, "en", "a", 1)]
    got = R.find_runs(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "n_words", "runs", "collapsed"}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[20]) == 2 and by[20][0] == by[20][1] and [tuple(x) for x in by[20][0].runs] == [(0, 40, 2)] and by[20][0].collapsed == "again and"
    for r in (by[2][0], by[3][0], by[4][0]):
        assert (r.n_words, r.runs, r.collapsed) == (0, [], "")
    assert len(by[None]) == 1 and by[9][0].collapsed == LONG and by[21][0].n_words == 62
    assert R.find_runs(empty(spark)).count() == 0


def rebuilt(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected_row(doc_id, text):
    words = rebuilt(doc_id, (text or "").encode().split())
    runs = brute(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rows = [r for r in ROWS if r[1] != LONG] + [(1000 + i, " \n".join(w.decode() for w in planted(rng)), "en", "a", 1) for i in range(400)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((expected_row(r[0], r[1]) for r in rows), key=repr)
    assert sum(r.n_runs > 0 for r in out.collect()) > 100
