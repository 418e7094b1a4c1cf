import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import cross_parse as C
from quarry.llm.queries import QUERIES
from rows import ROWS, clashing, docs, empty

SF = "/root/testdata/sf0.01"


def brute_phrases(known: bytes, text: bytes) -> int:
    """Longest matches by search, one after the other; a piece ends after PIECE bytes."""
    n = 0
    for a in range(0, len(text), C.PIECE):
        piece, i = text[a:a + C.PIECE], 0
        while i < len(piece):
            size = 0
            while i + size < len(piece) and piece[i:i + size + 1] in known:
                size += 1
            i += max(1, size)
            n += 1
    return n


@pytest.mark.parametrize("seed", range(5))
def test_automaton_phrases_equal_search(seed):
    rng = random.Random(seed)
    known = bytes(rng.choice(b"abc ") for _ in range(rng.choice([1, 5, 60, 400])))
    texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.choice([0, 1, 3, 50, 255, 256, 257, 900]))) for _ in range(40)]
    models = [("x", C.SuffixAutomaton(known), math.log2(max(2, len(known))))]
    got = C.entropies(texts, models)[:, 0]
    expected = [models[0][2] * brute_phrases(known, t) / max(1, len(t)) for t in texts]
    assert np.allclose(got, expected)


def test_letters_only():
    assert C.letters_only("It's  ÉTÉ_2\n—中文3x") == "it s été 中文 x".encode() and C.letters_only(" 12 _-\n") == b""


def test_prediction_equals_brute_force(spark):
    labelled = [(1, "the cat and the dog and the bird sing", "en"), (2, "der hund und die katze und der vogel", "de"), (3, "12", "xx"), (4, "text", None)]
    train = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    samples = C.samples_of(train)
    assert samples == [("de", b"der hund und die katze und der vogel"), ("en", b"the cat and the dog and the bird sing")]
    texts = ["the dog sings", "der hund singt", "und", "and", "zzzz", "The Cat. " * 200]
    rows = [(i, t, None, None, 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in C.predict_language(docs(spark, rows), train).collect()}
    for i, t in enumerate(texts):
        t = C.letters_only(t)
        bits = [brute_phrases(own, t) * math.log2(len(own)) / len(t) for _, own in samples]
        best = bits.index(min(bits))
        assert got[i].lang_pred == samples[best][0] and got[i].score == pytest.approx(1 - bits[best] / bits[1 - best])


def test_nulls_empties_repeats_clashes_and_no_labels(spark):
    train = spark.createDataFrame([("the cat", "en"), ("die katze", "de")], "text string, lang string")
    got = C.predict_language(clashing(docs(spark)).withColumn("lang_pred", F.lit("x")), train).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {2: "und", 3: "und", 4: "und"}
    assert len({r for r in got if r.doc_id == 5}) == 1 and all(r.lang_pred == "en" for r in got if r.doc_id in (1, 5))
    assert C.predict_language(empty(spark), train).count() == 0
    for nothing in (train.limit(0), train.withColumn("lang", F.lit(None).cast("string"))):
        assert {(r.lang_pred, r.score) for r in C.predict_language(docs(spark), nothing).collect()} == {("und", 0.0)}
    one = C.predict_language(docs(spark), train.where("lang = 'en'")).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("und", 0.0), ("en", 1.0)}


def test_samples_are_bounded_and_follow_texts_alone(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]} number {'klmnop'[i % 6]} " * (1 + i % 40), "en") for i in range(900)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = C.samples_of(train, 50, 1000)
    again = C.samples_of(train.withColumn("doc_id", F.col("doc_id") + 5).repartition(7).unionByName(train), 50, 1000)
    assert own == again and 900 <= len(own[0][1]) <= 1000 + 50


def test_held_out_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op13_language_id"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(rows) and all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.99 * len(held) > 300


def test_label_source_and_id_are_no_inputs_of_a_prediction(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    d.withColumn("lang", F.when(fold == 1, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    a = {r.doc_id: tuple(r) for r in QUERIES["op13_language_id"](spark, SF).collect()}
    b = {r.doc_id: tuple(r) for r in QUERIES["op13_language_id"](spark, str(tmp_path)).collect()}
    assert a == b
