"""Token ids in patched frame-of-reference blocks: written in document order, read back with an index."""

from __future__ import annotations

import json
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import partitions, shared_folder
from quarry.llm.shingles import hash_spans

BLOCK = 128           # ids in a block
PERCENTILES = (0.75, 0.9, 0.97, 1.0)    # a block's width fits so many of its ids, whichever makes it smallest
SEGMENT = 1 << 18     # ids after which a segment is closed (at a document's end)
MAGIC = b"PFR2"
TEXTS = 256           # texts that are encoded together

SEGMENTS = "part int, seq int, first_start long, n_ids long, n_docs int, payload binary, docs binary"


def encode(ids: np.ndarray) -> bytes:
    """A segment of ids as bytes.

    Header: magic, number of ids, number of exceptions (u32), bytes of an exception's value (u8).  Then per block its
    minimum (u32), bit width (u8), bits' start (u32, bytes) and first exception (u32); then
    the packed bits; then the exceptions' places in their blocks (u8) and values.  A block keeps ``id - minimum`` in
    a width chosen by percentile; where more bits are needed the place and the bits beyond the width are an exception.
    All little-endian.
    """
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]
    rows = full.reshape(blocks, BLOCK)
    low = rows.min(1) if blocks else np.zeros(0, np.uint32)
    rest = rows - low[:, None]
    width, least = np.zeros(blocks, np.int64), np.full(blocks, np.iinfo(np.int64).max)
    if n:
        ranks = [min(BLOCK - 1, int(np.ceil(p * BLOCK)) - 1) for p in PERCENTILES]
        at = np.partition(rest, ranks, axis=1)[:, ranks]
        value_bytes = 2 if int(rest.max()) < 1 << 16 else 4
        for c in range(len(ranks)):
            w = np.ceil(np.log2(at[:, c].astype(np.float64) + 1)).astype(np.int64)
            over = (rest.astype(np.int64) >= (1 << w)[:, None]).sum(1) if PERCENTILES[c] < 1 else 0
            cost = BLOCK // 8 * w + (1 + value_bytes) * over
            width, least = np.where(cost < least, w, width), np.minimum(cost, least)
    else:
        value_bytes = 2
    high = rest.astype(np.int64) >> width[:, None]
    over = (high > 0).reshape(-1)
    over[n:] = False
    places = np.flatnonzero(over)
    values = high.reshape(-1)[places].astype(f"<u{value_bytes}")
    bit_at = np.concatenate([[0], np.cumsum(BLOCK // 8 * width)]).astype(np.uint32)
    bits = np.zeros(int(bit_at[-1]), np.uint8)
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        raw = np.unpackbits(rest[which].astype("<u4").view(np.uint8).reshape(len(which), BLOCK, 4), axis=2, bitorder="little")
        packed = np.packbits(raw[:, :, :w].reshape(len(which), -1), axis=1, bitorder="little")
        bits[(bit_at[which][:, None] + np.arange(packed.shape[1])).astype(np.int64)] = packed
    first = np.searchsorted(places, np.arange(blocks) * BLOCK).astype("<u4")
    head = MAGIC + np.array([n, len(places)], "<u4").tobytes() + bytes([value_bytes])
    return b"".join([head, low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), bit_at[:-1].astype("<u4").tobytes(),
                     first.tobytes(), bits.tobytes(), (places % BLOCK).astype(np.uint8).tobytes(), values.tobytes()])


def decode(data: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of a segment, or of its blocks ``first_block`` up to (not with) ``last_block``, found by the index."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, patched = (int(x) for x in np.frombuffer(data, "<u4", 2, 4))
    value_bytes = data[12]
    blocks = -(-n // BLOCK)
    low = np.frombuffer(data, "<u4", blocks, 13)
    width = np.frombuffer(data, np.uint8, blocks, 13 + 4 * blocks)
    bit_at = np.frombuffer(data, "<u4", blocks, 13 + 5 * blocks)
    first = np.append(np.frombuffer(data, "<u4", blocks, 13 + 9 * blocks), patched)
    body = 13 + 13 * blocks
    tail = len(data) - (1 + value_bytes) * patched
    bits = np.frombuffer(data, np.uint8, tail - body, body)
    places = np.frombuffer(data, np.uint8, patched, tail)
    values = np.frombuffer(data, f"<u{value_bytes}", patched, tail + patched)
    last_block = blocks if last_block is None else min(last_block, blocks)
    some = np.arange(min(first_block, last_block), last_block)
    out = np.zeros((len(some), BLOCK), np.uint32)
    for w in np.unique(width[some]):
        which = np.flatnonzero(width[some] == w)
        if w:
            raw = bits[(bit_at[some[which]][:, None] + np.arange(BLOCK // 8 * int(w))).astype(np.int64)]
            full = np.zeros((len(which), BLOCK, 32), np.uint8)
            full[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(which), BLOCK, int(w))
            out[which] = np.packbits(full, axis=2, bitorder="little").reshape(len(which), -1).view("<u4")
    if len(some):
        a, b = int(first[some[0]]), int(first[last_block])
        row = np.repeat(np.arange(len(some)), np.diff(first[some[0]:last_block + 1].astype(np.int64)))
        out[row, places[a:b]] |= values[a:b].astype(np.uint32) << width[some][row].astype(np.uint32)
        out += low[some][:, None]
    return out.reshape(-1)[: max(0, min(n, last_block * BLOCK) - first_block * BLOCK)].copy()


# Letters that the fine cut knows; a text with other characters beyond ASCII is cut at spaces only.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile(rf"[^{_L}\x00-\x7F]")
_TWO = re.compile(r"\s\s")
_COARSE = re.compile(r"(?<=\S)(?= \S)")
_LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])


def is_plain(text: str) -> bool:
    """Whether the fine cut holds: known letters only, and no two white-space characters in a row."""
    return (text.isascii() or not _OTHER.search(text)) and not _TWO.search(text)


def fine_cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Begins of the pieces of plain texts, laid one after the other in ``data`` (UTF-8) from ``starts`` on.

    The vocabulary's split rule always cuts before a single space, after a run of letters, and
    before one that no space leads; contractions (letters, apostrophe, letters) stay whole here.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    letter, space, mark = _LETTER[data], data == 32, data == 39
    edge = np.zeros(len(data) + 1, bool)
    edge[starts[starts < len(data)]] = True                # a text's first byte
    led = np.append(letter[1:], False) & ~edge[1:]         # a letter of the same text follows
    cut = edge[:-1].copy()
    cut[1:] |= space[1:] | (letter[:-1] & ~letter[1:] & ~(mark & led)[1:])
    cut[1:] |= ~letter[:-1] & ~space[:-1] & ~mark[:-1] & letter[1:]
    return np.flatnonzero(cut)


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: visible bytes for themselves, the others from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in seen]
    return {**{b: chr(b) for b in seen}, **{b: chr(256 + i) for i, b in enumerate(other)}}


class HashTable:
    """Places of 64-bit hashes, looked up and added many at a time (open addressing in numpy arrays)."""

    def __init__(self):
        self.n = 0
        self.keys, self.places = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where there is none."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(hashes), -1, np.int64)
        todo, at = np.arange(len(hashes)), hashes & mask
        while len(todo):
            key = self.keys[at]
            hit = key == hashes[todo]
            out[todo[hit]] = self.places[at[hit]]
            on = ~hit & (key != 0)
            todo, at = todo[on], (at[on] + np.uint64(1)) & mask
        return out

    def add(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Hashes that are not there yet, each once and none of them 0."""
        self.n += len(hashes)
        if 2 * self.n > len(self.keys):
            there = self.keys != 0
            hashes, places = np.concatenate([self.keys[there], hashes]), np.concatenate([self.places[there], places])
            size = 1 << int(4 * self.n - 1).bit_length()
            self.keys, self.places = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        mask = np.uint64(len(self.keys) - 1)
        at = hashes & mask
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]             # of several for one slot the last stays
            mine = self.keys[at] == hashes
            self.places[at[mine]] = places[mine]
            hashes, places, at = hashes[~mine], places[~mine], (at[~mine] + np.uint64(1)) & mask


class Encoder:
    """A tokenizer of the library behind a memory of pieces: each distinct one goes to the library once while remembered.

    Texts that hold the string of an added (special) token go to the library whole, which finds that token first.
    """

    def __init__(self, spec: str, most: int = 3_000_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.most = most
        spec = json.loads(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        # plain byte-level split: a run of letters is one word of the model, which can then be asked directly
        self.direct = spec.get("normalizer") is None and spec["pre_tokenizer"].get("type") == "ByteLevel" and (
            not spec["pre_tokenizer"]["add_prefix_space"] and spec["pre_tokenizer"].get("use_regex", True))
        self.letters = _byte_letters()
        self.forget()

    def forget(self):
        self.by_hash = HashTable()                        # of pieces of plain texts
        self.by_text: dict[str, int] = {}                 # of pieces of other texts
        self.count = 0
        self.ends = np.zeros(1, np.int64)                 # piece i has the ids ends[i]:ends[i + 1]
        self.ids = np.zeros(1, np.uint32)
        self.byte_ends = np.zeros(1, np.int64)            # and, of a plain text, the bytes byte_ends[i]:byte_ends[i + 1]
        self.bytes = np.zeros(1, np.uint8)

    @staticmethod
    def _grown(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(size, array.dtype)])

    def _store(self, got: list[list[int]], raw: np.ndarray, raw_sizes: np.ndarray) -> np.ndarray:
        """The places of new pieces with these ids and bytes (no bytes for pieces kept by text)."""
        known, n = self.count, self.count + len(got)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
        used, held = int(self.ends[known]), int(self.byte_ends[known])
        self.ends, self.byte_ends = self._grown(self.ends, n + 1), self._grown(self.byte_ends, n + 1)
        self.ids, self.bytes = self._grown(self.ids, used + len(flat)), self._grown(self.bytes, held + len(raw))
        self.ends[known + 1:n + 1] = used + np.cumsum(sizes)
        self.ids[used:used + len(flat)] = flat
        self.byte_ends[known + 1:n + 1] = held + np.cumsum(raw_sizes)
        self.bytes[held:held + len(raw)] = raw
        self.count = n
        return np.arange(known, n)

    def _ask(self, flat: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """The ids of pieces that lie one after the other in ``flat`` (UTF-8): words from the model, others from the library."""
        ends = np.cumsum(sizes)
        begins = ends - sizes
        letters = np.add.reduceat(_LETTER[flat], begins, dtype=np.int64)
        word = (letters + (flat[begins] == 32) == sizes) & (letters > 0) & self.direct
        whole = flat.tobytes()
        others = [whole[b:e].decode() for b, e in zip(begins[~word].tolist(), ends[~word].tolist())]
        slow = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        spelled, ask = whole.decode("latin-1").translate(self.letters), self.tokenizer.model.tokenize
        return [[t.id for t in ask(spelled[b:e])] if w else next(slow).ids for b, e, w in zip(begins.tolist(), ends.tolist(), word.tolist())]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """The places of each plain text's pieces: found by a 64-bit hash, then held against their bytes."""
        if not texts:
            return []
        raw = [t.encode() for t in texts]
        starts = np.cumsum([0, *map(len, raw)])
        whole = b"".join(raw)
        data = np.frombuffer(whole, np.uint8)
        begins = fine_cuts(data, starts)
        ends = np.append(begins[1:], len(data))
        hashes = hash_spans(data, begins, ends) | np.uint64(1)          # never 0
        at = self.by_hash.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            own, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            at[new] = self._remember(data, begins[new[first]], ends[new[first]], own)[back]
        # pieces lie one after the other, so what is remembered of them must be the texts' bytes
        sizes = ends - begins
        there = self.byte_ends[at + 1] - self.byte_ends[at] == sizes
        shift = np.repeat(np.where(there, self.byte_ends[at] - begins, -begins), sizes)
        wrong = self.bytes[np.minimum(shift + np.arange(len(data)), len(self.bytes) - 1)] != data
        if wrong.any() or not there.all():                # another piece of the same hash: these are asked about each time
            bad = np.flatnonzero(~there | (np.add.reduceat(wrong, begins) > 0))
            at[bad] = [self._by_text([whole[b:e].decode()])[0] for b, e in zip(begins[bad].tolist(), ends[bad].tolist())]
        return np.split(at, np.searchsorted(begins, starts[1:-1]))

    def _remember(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        sizes = ends - begins
        flat = data[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        places = self._store(self._ask(flat, sizes), flat, sizes)
        self.by_hash.add(hashes, places.astype(np.int32))
        return places

    def _by_text(self, pieces: list[str]) -> list[int]:
        new = [p for p in dict.fromkeys(pieces) if p not in self.by_text]
        if new:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.by_text.update(zip(new, self._store(got, np.zeros(0, np.uint8), np.zeros(len(new), np.int64)).tolist()))
        return [self.by_text[p] for p in pieces]

    def _other(self, text: str) -> np.ndarray:
        own = [text] if any(a in text for a in self.added) else _COARSE.split(text) if text else []
        return np.array(self._by_text(own), np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, id 0 after each text, and the number of each text's ids (with the 0)."""
        if self.count > self.most:
            self.forget()
        plain = [is_plain(t) and not any(a in t for a in self.added) for t in texts]
        easy = iter(self._plain([t for t, p in zip(texts, plain) if p]))
        end = np.array([-1])                              # stands for id 0
        place = np.concatenate([np.zeros(0, np.int64)] + [x for t, p in zip(texts, plain) for x in (next(easy) if p else self._other(t), end)])
        last = place < 0
        start = np.where(last, 0, self.ends[place])
        size = np.where(last, 1, self.ends[place + 1] - start)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(start - (ends - size), size) + np.arange(total)]
        ids[ends[last] - 1] = 0
        return ids, np.diff(ends[last], prepend=0)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One encoder for each worker process and vocabulary; its memory outlives a task."""
    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def _writer(spec: str):
    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext
        encoder, part, seq, start = _encoder(spec), TaskContext.get().partitionId(), 0, 0
        ids, names, sizes, held = [], [], [], 0

        def segment():
            data = np.concatenate(ids)
            table = json.dumps([names, np.concatenate(sizes).tolist()]).encode()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([len(data)], pa.int64()), pa.array([len(names)], pa.int32()),
                 pa.array([encode(data)], pa.binary()), pa.array([zlib.compress(table, 1)], pa.binary())],
                ["part", "seq", "first_start", "n_ids", "n_docs", "payload", "docs"])

        for batch in batches:
            own = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), TEXTS):
                got, n = encoder([t or "" for t in texts[i:i + TEXTS]])
                ids.append(got)
                sizes.append(n)
                names += own[i:i + TEXTS]
                held += len(got)
                if held >= SEGMENT:
                    yield segment()
                    seq, start, ids, names, sizes, held = seq + 1, start + held, [], [], [], 0
        if names:
            yield segment()
    return run


def write_tokens(rows: DataFrame, spec: str, path: str, order: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all ``rows`` in ascending ``order`` as segments below ``path``.

    Rows are range-partitioned by ``order``, so task p writes the segments of the
    p-th stretch of the whole sequence; a segment ends with a document.  Each
    document's ids are followed by id 0.  A null text is empty (id 0 alone); null ids come
    first; repeated rows are written each; an empty table writes no segment.  A lost task is
    written anew from its rows.  ``spec`` is the tokenizer's JSON (one vocabulary, some MB).
    """
    n = partitions(rows.sparkSession)
    dealt = rows.select(order, text).repartitionByRange(n, order).sortWithinPartitions(order, text)
    dealt.mapInArrow(_writer(spec), SEGMENTS).write.parquet(path)


def _reader(batches):
    for batch in batches:
        cols = batch.to_pydict()
        for base, payload, docs in zip(cols["base"], cols["payload"], cols["docs"]):
            ids = decode(payload)
            names, sizes = json.loads(zlib.decompress(docs))
            ends = np.cumsum(np.array(sizes, np.int64))
            starts = ends - sizes
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * int(a):4 * int(b)]) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` decoded from the segments below ``path``.

    Starts add up the totals of the parts before (one row per part) and the place in the part.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = segments.join(F.broadcast(offsets), "part").select(
        (F.col("offset") + F.col("first_start")).alias("base"), "payload", "docs")
    return placed.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file(rows: DataFrame, spec: str) -> DataFrame:
    """Writes ``rows`` to a fresh folder in the shared checkpoint folder and reads it back."""
    path = shared_folder(rows.sparkSession, "tokens")
    write_tokens(rows, spec, path)
    return read_tokens(rows.sparkSession, path)
