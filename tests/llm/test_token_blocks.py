import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import token_blocks as T
from rows import ROWS, clashing, docs, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPEC = open(PATH, encoding="utf-8").read()


def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("ids", [[], [0], [50256] * 300, list(range(1000)), [2**32 - 1, 0, 5], list(np.random.default_rng(1).zipf(1.3, 5000) % 50257)])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    data = T.encode(ids)
    assert (T.decode(data) == ids).all()
    for a, b in ((0, 1), (1, 3), (2, 2), (5, 9)):
        assert (T.decode(data, a, b) == ids[a * T.BLOCK:b * T.BLOCK]).all()


def test_outliers_are_patched_and_blocks_are_small():
    ids = np.tile(np.arange(16, dtype=np.uint32), 800)
    ids[::97] = 50_000
    assert len(T.encode(ids)) < len(ids) * 1.1


def test_not_a_segment():
    with pytest.raises(ValueError):
        T.decode(b"nothing of the kind")


def test_pieces_give_the_librarys_ids():
    rng = random.Random(2)
    marks = list("ab'st 5.,( \n\tÉé×œ²½ªΣ\x1c\x85\xa0　dm'l'") + ["it's", " 's", "  ", "\n\n", "don't ", "'ll", "<|endoftext|>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 16))) for _ in range(4000)] + [t for _, t, *_ in ROWS if t]
    ids, sizes = T.Encoder(SPEC, most=500)(texts)
    ends = np.cumsum(sizes)
    for t, e, a, b in zip(texts, library().encode_batch_fast(texts, add_special_tokens=False), ends - sizes, ends):
        assert e.ids + [0] == ids[a:b].tolist(), t


def test_special_tokens_are_found_as_by_the_library():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y<|endoftext|>", "<|endoftext", "中文 <|endoftext|> ÿ", "a  b <|endoftext|>  c"]
    ids, sizes = T.Encoder(SPEC)(texts)
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, ends - sizes, ends):
        assert library().encode(t, add_special_tokens=False).ids + [0] == ids[a:b].tolist(), t
    assert ids[:5].tolist() == [64, 220, 50256, 275, 0]


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    encoder = T.Encoder(SPEC)
    texts = ["the cat sat", "the dog ran", "not his own", "the cat", "a b c d", "ein Haus", "ÿéß"]
    for hashes in (lambda d, b, e: b.astype(np.uint64), lambda d, b, e: np.zeros(len(b), np.uint64), lambda d, b, e: (e - b).astype(np.uint64)):
        monkeypatch.setattr(T, "hash_spans", hashes)
        for batch in (texts[:1], texts, texts[::-1]):
            ids, _ = encoder(batch)
            assert ids.tolist() == [i for t in batch for i in library().encode(t, add_special_tokens=False).ids + [0]]


def test_hash_table():
    rng = np.random.default_rng(3)
    table, known = T.HashTable(), {}
    for n in (1, 5, 1000, 50_000, 200_000):
        keys = rng.integers(1, 1 << 40, n, dtype=np.uint64) << np.uint64(20)        # all in one slot at first
        keys = np.array([k for k in dict.fromkeys(keys.tolist()) if k not in known][:2000 if n > 1000 else n], np.uint64)
        places = np.arange(len(known), len(known) + len(keys), dtype=np.int32)
        table.add(keys, places)
        known.update(zip(keys.tolist(), places.tolist()))
    ask = np.array([*known, 7, 9], np.uint64)
    assert table.find(ask).tolist() == [*known.values(), -1, -1]


def test_file_holds_all_rows_in_order(spark, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 50)
    rows = ROWS + [(100 + i, f"text number {i}", "en", "a", 1) for i in range(200)]
    got = sorted(T.token_file(clashing(docs(spark, rows)), SPEC).collect(), key=lambda r: r.start)
    expected = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    tokenizer, start = library(), 0
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, expected):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_table(spark):
    assert T.token_file(empty(spark), SPEC).count() == 0
