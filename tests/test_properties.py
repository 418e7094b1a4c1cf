"""Property tests: the matcher against plain Python on random texts and dictionaries."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators.match import hit_counter, match_boundary, match_dictionary, plan_spec
from quarry.sources.dictionary import KeywordDictionary

ALPHABET = "abAB _-.ßſé1\n"
texts = st.text(alphabet=ALPHABET, max_size=80)
keywords = st.lists(st.text(alphabet=ALPHABET, min_size=1, max_size=4), min_size=1, max_size=5)


def _brute(text, kw):
    return sum(1 for i in range(len(text)) if text.startswith(kw, i))


@settings(max_examples=300, deadline=None)
@given(texts, keywords, st.booleans())
def test_dictionary_counter_equals_brute_force(text, kws, cs):
    d = KeywordDictionary({"G": kws})
    spec = plan_spec(d, "dictionary", cs)
    got = hit_counter(spec, "dictionary", cs)(text)
    fold = (lambda s: s) if cs else str.casefold
    for i, w in enumerate(spec[1]):
        assert got.get(i, 0) == _brute(fold(text), w)


@settings(max_examples=300, deadline=None)
@given(texts, keywords)
def test_boundary_counter_equals_python_re(text, kws):
    d = KeywordDictionary({"G": kws})
    spec = plan_spec(d, "boundary", False)
    got = hit_counter(spec, "boundary", False)(text)
    for i, w in enumerate(spec[1]):
        exp = re.search(r"\b" + re.escape(w) + r"\b", text.lower()) is not None
        assert bool(got.get(i)) == exp, (text, w)


@settings(max_examples=200, deadline=None)
@given(texts, keywords, st.integers(min_value=1, max_value=9))
def test_windows_sum_to_whole(text, kws, size):
    """Cutting a text into windows (hits counted where they start) loses and doubles nothing."""
    d = KeywordDictionary({"G": kws})
    for mode in ["dictionary", "boundary"]:
        spec = plan_spec(d, mode, False)
        count = hit_counter(spec, mode, False)
        longest = max(len(w) for w in spec[1])
        pre, post = (1, longest) if mode == "boundary" else (0, longest - 1)
        total = {}
        for s in range(0, max(len(text), 1), size):
            part = count(text[s:s + size], text[max(s - pre, 0):s], text[s + size:s + size + post])
            for w, c in part.items():
                total[w] = max(total.get(w, 0), c) if mode == "boundary" else total.get(w, 0) + c
        assert total == count(text), mode


@settings(max_examples=5, deadline=None)
@given(st.lists(texts, min_size=1, max_size=40), keywords)
def test_native_equals_automaton(spark, rows, kws):
    d = KeywordDictionary({"G": kws, "H": kws[:1]})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string")
    for fn in (match_dictionary, match_boundary):
        a = sorted(map(tuple, fn(df, d, keys=["id"], method="automaton").collect()))
        b = sorted(map(tuple, fn(df, d, keys=["id"], method="native").collect()))
        assert a == b, fn.__name__


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab _.", min_size=1, max_size=6), min_size=1, max_size=6),
                min_size=1, max_size=12),
       st.lists(st.text(alphabet="ab _.", min_size=1, max_size=4), min_size=1, max_size=4))
def test_file_scope_equals_joined_text(spark, files, kws):
    from quarry.operators.match import match_file_scope, match_units
    d = KeywordDictionary({"G": kws})
    units = spark.createDataFrame([(f"f{i}", j, u) for i, parts in enumerate(files) for j, u in enumerate(parts)],
                                  "file string, unit_idx int, text string")
    joined = spark.createDataFrame([(f"f{i}", "".join(parts)) for i, parts in enumerate(files)],
                                   "file string, text string")
    for mode in ("dictionary", "boundary"):
        got = sorted(map(tuple, match_file_scope(units, d, file_keys=["file"], mode=mode).collect()))
        exp = sorted(map(tuple, match_units(joined, d, keys=["file"], mode=mode).collect()))
        assert got == exp, mode
