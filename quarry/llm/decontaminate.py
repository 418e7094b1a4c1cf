"""Benchmark decontamination: SimHash windows, multi-index Hamming lookup, exact weighted-shingle check."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shingles import PLAIN, shingles, words_of

K = 5                         # words in a shingle
SIMILARITY = 0.8              # of an item's shingle weight found in the text
RADIUS = 3                    # bits that two fingerprints may differ in
SIZES = (8, 11, 16, 22, 32, 44, 64, 90, 127, 180, 255)       # sizes of an item's own windows: each about 1.4 times the one before
PLACES = 8                    # steps at most between an item's own windows
ITEM_BYTES = 16 << 20         # benchmark text that travels with one pass over the documents
SUMMED = 255                  # words of a window at most
SLAB = 1 << 15                # windows handled at once
PAIRS = 1 << 22               # shingles of candidates compared at once
_POP = getattr(np, "bitwise_count")


def fingerprints(words: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """SimHash of every window of each size: bit j is set if more than half of the window's word hashes have it."""
    ones = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(words) + 1, 64), np.uint8)             # sums modulo 256; windows are shorter than that
    np.cumsum(ones, axis=0, dtype=np.uint8, out=total[1:])
    out = {}
    for w in sizes:
        if len(words) >= w:
            out[w] = np.packbits(total[w:] - total[:-w] > w // 2, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``first[i] .. first[i] + count[i] - 1`` of all ``i``, one run after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


class Index:
    """Fingerprints of one window size; finds all within the radius.

    64 bits are cut into ``radius + 1`` blocks: two fingerprints that differ in at
    most ``radius`` bits agree on one block at least, so looking up every block finds all.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.blocks = []
        for a, b in zip(edges, edges[1:]):
            key = self._block(prints, a, b)
            order = np.argsort(key, kind="stable")
            low = (1 << min(b - a, max(10, 4 + len(prints).bit_length()))) - 1
            some = np.zeros(low + 1, bool)                       # which low bits any key has
            some[key & low] = True
            self.blocks.append((a, b, order, key[order], low, some))

    @staticmethod
    def _block(x: np.ndarray, a: int, b: int) -> np.ndarray:
        return ((x >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``x``, place in the index), each once."""
        found = []
        for a, b, order, keys, low, some in self.blocks:
            key = self._block(x, a, b)
            hit = np.flatnonzero(some[key & low])
            if not len(hit):
                continue
            first = np.searchsorted(keys, key[hit])
            many = np.searchsorted(keys, key[hit], "right") - first
            i = np.repeat(hit, many)
            j = order[_runs(first, many)]
            ok = _POP(x[i] ^ self.prints[j]) <= self.radius
            found.append(i[ok] * len(self.prints) + j[ok])
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


class Benchmark:
    """Items with their weighted shingles, and for each window size an index of the items' fingerprints.

    An item has two kinds of probes.  Its own windows are nearly as long as itself, from its first word to its last: a copy with a few
    words changed differs there in a few bits.  A text that holds ``similarity`` of an item's weight lacks at most the rest of it; so it has
    one at least of any shingles that weigh more than this rest, whatever was trimmed, changed or inserted.  The item's
    rarest are such probes too, windows of one shingle's words.
    """

    def __init__(self, ids: list, texts: list[str], k: int, radius: int, similarity: float):
        words = [w[a:b] for _, off, w in words_of(_lower(pa.array(texts, pa.string())), kind=PLAIN) for a, b in zip(off[:-1], off[1:])]
        self.ids, self.k, self.size, self.length = ids, k, min(k, SUMMED), [len(w) for w in words]
        sets = [np.unique(shingles(w if len(w) >= k else w[:0], k), return_index=True) for w in words]
        self.every, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in sets]]), return_counts=True)
        self.many = np.array([len(x) for x, _ in sets], np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.own = np.searchsorted(self.every, np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in sets]]))
        self.place = np.concatenate([np.zeros(0, np.int64), *[at for _, at in sets]])
        self.weight = 1.0 / counts[self.own]                     # a shingle that many items share tells less
        probes: dict[int, list] = {}                             # of each window size: fingerprint, item
        for i, w in enumerate(words):
            if len(w) >= k:
                own = slice(self.first[i], self.first[i] + self.many[i])
                rare = np.argsort(-self.weight[own], kind="stable")
                sums = np.cumsum(self.weight[own][rare])
                rest = (1 - similarity + 1e-9) * sums[-1]
                rare = rare[:np.searchsorted(sums, rest, "right") + 1]
                at = {self.size: self.place[own][rare]}
                if len(w) >= SIZES[0]:
                    size = max(z for z in SIZES if z <= len(w))
                    at[size] = np.concatenate([at.get(size, np.zeros(0, np.int64)), np.linspace(0, len(w) - size, PLACES + 1).astype(np.int64)])
                for size, prints in fingerprints(w, sorted(at)).items():
                    probes.setdefault(size, []).extend((x, i) for x in np.unique(prints[at[size]]))
        self.index = {size: (Index(np.array([x for x, _ in own], np.uint64), radius), np.array([i for _, i in own], np.int64))
                      for size, own in sorted(probes.items())}

    def matches(self, words: np.ndarray, offsets: np.ndarray, similarity: float):
        """``(text, item, similarity, first word)``: the items that reach ``similarity`` in each text, and the best place of each."""
        if not self.index:
            return []
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        found = [np.zeros(0, np.int64)]
        for a in range(0, len(words), SLAB):
            for size, prints in fingerprints(words[a:a + SLAB + max(self.index) - 1], list(self.index)).items():
                prints = prints[:SLAB]
                own = text_of[a:a + len(prints)] == text_of[a + size - 1:a + size - 1 + len(prints)]     # no window over two texts
                at = np.flatnonzero(own)
                index, items = self.index[size]
                i, j = index.near(prints[at])
                found.append(np.unique(text_of[a + at[i]] * len(self.ids) + items[j]))
        text, item = np.divmod(np.unique(np.concatenate(found)), len(self.ids))
        if not len(text):
            return []
        # the benchmark's shingles in the texts with candidates
        asked = np.zeros(len(offsets) - 1, bool)
        asked[text] = True
        kinds = shingles(words, self.k)[:max(0, len(words) - self.k + 1)]
        at = np.flatnonzero(asked[text_of[:len(kinds)]] & (text_of[:len(kinds)] == text_of[len(words) - len(kinds):]))
        kind = np.searchsorted(self.every, kinds[at])
        ok = kind < len(self.every)
        ok[ok] = self.every[kind[ok]] == kinds[at][ok]
        at, kind = at[ok], kind[ok]
        held = np.unique(text_of[at] * len(self.every) + kind)
        out = []
        sums = np.cumsum(self.many[item])
        for part in np.split(np.arange(len(item)), np.searchsorted(sums, np.arange(PAIRS, int(sums[-1]), PAIRS))):
            many = self.many[item[part]]
            mine = _runs(self.first[item[part]], many)
            key = np.repeat(text[part], many) * len(self.every) + self.own[mine]
            has = np.searchsorted(held, key)
            has = (has < len(held)) & (held[np.minimum(has, len(held) - 1)] == key) if len(held) else np.zeros(len(key), bool)
            pair = np.repeat(np.arange(len(part)), many)
            share = np.bincount(pair, self.weight[mine] * has, len(part)) / np.bincount(pair, self.weight[mine], len(part))
            for p in np.flatnonzero(share >= similarity - 1e-12):
                t, i = int(text[part[p]]), int(item[part[p]])
                lo, hi = np.searchsorted(at, [offsets[t], offsets[t + 1]])
                out.append((t, i, float(share[p]), self._place(i, at[lo:hi] - int(offsets[t]), kind[lo:hi])))
        return out

    def _place(self, item: int, at: np.ndarray, kind: np.ndarray) -> int:
        """The first word of the window as long as the item that holds most of its weight, the item's words aligned there."""
        own = slice(self.first[item], self.first[item] + self.many[item])
        of = np.searchsorted(self.own[own], kind)
        ok = of < self.many[item]
        ok[ok] = self.own[own][of[ok]] == kind[ok]
        at, of = at[ok], of[ok]
        starts = np.unique(at - self.place[own][of])
        best = -1.0, 0
        for start, a, b in zip(starts, np.searchsorted(at, starts), np.searchsorted(at, starts + self.length[item] - self.k, "right")):
            weight = float(self.weight[own][np.unique(of[a:b])].sum())
            if weight > best[0] + 1e-12:
                best = weight, max(0, int(start))
        return best[1]


def _finder(bench: Benchmark, similarity: float, item_type: pa.DataType):
    def run(batches):
        for batch in batches:
            names = batch.column(0)
            rows = []
            for first, offsets, words in words_of(_lower(batch.column(1)), kind=PLAIN):
                rows += [(first + t, *rest) for t, *rest in bench.matches(words, offsets, similarity)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [names.take(at), pa.array([bench.ids[r[1]] for r in rows], item_type), pa.array([r[2] for r in rows], pa.float64()),
                 pa.array([r[3] for r in rows], pa.int64()), pa.array([bench.length[r[1]] for r in rows], pa.int64())],
                ["doc_id", "item_id", "similarity", "start_word", "n_words"])
    return run


def _passes(benchmark: DataFrame) -> tuple[DataFrame, int]:
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, -(-size // ITEM_BYTES) or 1


def _bench(items: DataFrame, passes: int, p: int, k: int, radius: int, similarity: float) -> Benchmark:
    own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()       # about ITEM_BYTES
    return Benchmark([r.item_id for r in own], [r.text for r in own], k, radius, similarity)


def _arrow_type(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, k: int = K) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_words``: the benchmark items that documents hold, and where.

    Every document (``doc_id, text``) is read whole, at every word a window of ``k`` words and one of each size of the items' own
    windows.  Those whose SimHash is within ``radius`` bits of a probe of an item (``item_id, text``) are all found by block lookups; then the share of the item's
    ``k``-word shingles, weighted by how few items have them, that the document holds decides: ``similarity`` or more.  An
    item's probes are windows nearly as long as itself and its rarest shingles, as many as no document with that share can lack, so at every radius all such
    documents are found, also trimmed and edited copies and those with other words inserted, however many.
    ``start_word`` is where the item would begin in its best place: in the window of ``n_words`` that holds most of it.
    Words are runs of letters, digits and anything beyond ASCII, in lower case.

    Documents are a map over tasks, never shuffled.  Benchmark text travels with
    the tasks, at most ``ITEM_BYTES`` of it in one pass; a larger benchmark takes more passes.

    A null or empty text holds nothing; an item that is null or has fewer than ``k`` words
    can't be told from chance and matches nothing.  Repeated documents give repeated
    findings, repeated items one each; empty tables give no rows.  Other columns do not matter.
    """
    items, passes = _passes(benchmark)
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id long, item_id {kind}, similarity double, start_word long, n_words long"
    found = [docs.select("doc_id", "text").mapInArrow(_finder(_bench(items, passes, p, k, radius, similarity), similarity, _arrow_type(kind)), schema)
             for p in range(passes)]
    return reduce(DataFrame.unionByName, found)


def _dropper(bench: Benchmark, similarity: float):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, offsets, words in words_of(_lower(batch.column(batch.schema.get_field_index("text"))), kind=PLAIN):
                keep[[first + m[0] for m in bench.matches(words, offsets, similarity)]] = False
            yield batch.filter(pa.array(keep))
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, k: int = K) -> DataFrame:
    """``docs`` less the rows that hold a benchmark item, found as by ``find_leaks``; a map over the rows."""
    items, passes = _passes(benchmark)
    for p in range(passes):
        docs = docs.mapInArrow(_dropper(_bench(items, passes, p, k, radius, similarity), similarity), docs.schema)
    return docs
