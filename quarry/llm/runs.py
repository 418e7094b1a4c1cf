"""Maximal periodic runs of words, found online: words are appended, catchers over completed blocks report repetitions.

Method (online dyadic square catching).  At level k the words seen so far form blocks of ``2^k`` words; the last
completed block before a word's own block has a catcher.  Every appended word completes one window of
``2^k`` words on each level, which is compared with that block.  Where they agree at distance d
(``2^k <= d < 2^(k+1)``, so each distance has one level), the common stretch is followed to the left and
to the right; it stays open while it touches the last word and grows with what is appended.  From length ``2 d`` on it is a square;
squares of one period that overlap are one stretch, whose start and period name it.  A stretch of exponent 3 or
more always holds a block and its copy, so none is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shingles import _powers, mixed

LEAST, POWER = 6, 4       # a run has so many words and so many periods at least
ROWS = 512                # rows of a result batch

RUNS = "runs array<struct<start:bigint,length:bigint,period:bigint>>"


class Catchers:
    """The runs of a growing sequence of word numbers; ``append`` takes any number of them at a time.

    Spans are compared by a 64-bit polynomial hash; a stretch that would be reported is compared word by word as well.
    """

    def __init__(self, least: int = LEAST, power: int = POWER):
        if power < 3:
            raise ValueError("runs of fewer than three periods may lie between two blocks")
        self.least, self.power, self.n = least, power, 0
        self.words = np.zeros(0, np.int64)
        self.sums = np.zeros(1, np.uint64)
        self.up, self.down = _powers(0)
        self.open: dict[tuple[int, int], int] = {}            # (start, period) -> end, which is the last word's
        self.found: dict[tuple[int, int], int] = {}           # (start, end) -> smallest period

    def _span(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.down[at]

    def _equal_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b > a`` on (halving search on span hashes)."""
        low, high = np.zeros(len(a), np.int64), self.n - b
        while (low < high).any():
            size = (low + high + 1) // 2
            same = self._span(a, size) == self._span(b, size)
            low, high = np.where(same, size, low), np.where(same, high, size - 1)
        return low

    def _equal_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), a.copy()
        while (low < high).any():
            size = (low + high + 1) // 2
            same = self._span(a - size, size) == self._span(b - size, size)
            low, high = np.where(same, size, low), np.where(same, high, size - 1)
        return low

    def _long_enough(self, start, end, period):
        return end - start >= np.maximum(self.least, self.power * period)

    def _close(self, start: int, period: int, end: int) -> None:
        if not self._long_enough(start, end, period):
            return
        same = self.words[start:end - period] == self.words[start + period:end]
        if not same.all():                                     # two spans of one hash: each true part on its own
            bad = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
            for a, b in zip((bad[:-1] + 1).tolist(), bad[1:].tolist()):
                if b > a and self._long_enough(start + a, start + b + period, period):
                    self._keep(start + a, start + b + period, period)
            return
        self._keep(start, end, period)

    def _keep(self, start: int, end: int, period: int) -> None:
        self.found[start, end] = min(period, self.found.get((start, end), period))

    def append(self, new: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(new)
        self.words = np.concatenate([self.words, new])
        self.up, self.down = _powers(self.n + 1) if len(self.up) <= self.n else (self.up, self.down)
        own = mixed(new.astype(np.uint64) + np.uint64(1)) * self.up[before:self.n]
        self.sums = np.concatenate([self.sums, self.sums[-1] + np.cumsum(own, dtype=np.uint64)])
        if self.open and len(new):                             # what touched the last word grows or ends
            keys = list(self.open)
            period = np.array([p for _, p in keys])
            at = np.full(len(keys), before)
            grown = at + self._equal_after(at - period, at)
            self.open = {}
            for (start, p), end in zip(keys, grown.tolist()):
                self._caught(start, p, end)
        for level in range(max(0, self.n.bit_length() - 1)):
            self._level(level, before)

    def _caught(self, start: int, period: int, end: int) -> None:
        if end == self.n:
            self.open[start, period] = end
        else:
            self._close(start, period, end)

    def _level(self, level: int, before: int) -> None:
        """Compares the windows that the words from ``before`` on complete with the catching block of each."""
        size = 1 << level
        first, last = max(size, before - size + 1), self.n - size
        if last < first:
            return
        low = ((first >> level) - 1) << level
        spans = self._span(np.arange(low, last + 1), size)
        at = np.arange(first, last + 1)
        block = ((at >> level) - 1) << level
        hit = np.flatnonzero(spans[first - low:] == spans[block - low])
        if not len(hit):
            return
        at, block = at[hit], block[hit]
        # a hit inside a known run whose period is no longer than the block is at a multiple of that period: nothing new
        known = sorted([(s, e) for (s, e), p in self.found.items() if p <= size]
                       + [(s, e) for (s, p), e in self.open.items() if p <= size and self._long_enough(s, e, p)])
        if known:
            starts, ends = np.array(known).T
            reach = np.concatenate([[-1], np.maximum.accumulate(ends)])
            fresh = reach[np.searchsorted(starts, block, "right")] < at + size
            at, block = at[fresh], block[fresh]
        start = block - self._equal_before(block, at)
        end = at + size + self._equal_after(block + size, at + size)
        for s, p, e in set(zip(start.tolist(), (at - block).tolist(), end.tolist())):
            self._caught(s, p, e)

    def runs(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of all runs of the words so far, by start, then period."""
        found = dict(self.found)
        for (start, period), end in self.open.items():
            own, self.found = self.found, {}
            self._close(start, period, end)
            for key, p in self.found.items():
                found[key] = min(p, found.get(key, p))
            self.found = own
        return sorted((s, e - s, p) for (s, e), p in found.items())


def word_runs(words: list[bytes], least: int = LEAST, power: int = POWER, step: int = 1 << 16) -> list[tuple[int, int, int]]:
    """The runs of a list of words, appended ``step`` at a time; words are told apart exactly."""
    if len(words) < least:
        return []
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    catchers = Catchers(least, power)
    for i in range(0, len(ids), step):
        catchers.append(ids[i:i + step])
    return catchers.runs()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that some run holds after its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def _job(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            counts, runs, texts = [], [], []
            for text in part.column(1).cast(pa.large_binary()).to_pylist():
                words = (text or b"").split()                  # bytes.split parts at space, tab, LF, VT, FF and CR
                counts.append(len(words))
                runs.append(word_runs(words))
                texts.append(collapsed(words, runs[-1]))
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            ends = np.cumsum([0, *map(len, runs)])
            names = ["start", "length", "period"]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], names)),
                 pa.array(texts, pa.binary()).cast(pa.string())],
                [batch.schema.field(0).name, "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, runs, collapsed``: every maximal run of words of every whole text, and the text without the repeats.

    A run is a stretch of words with smallest period q, of ``max(LEAST, POWER * q)`` words or more, that no
    neighbouring word extends.  ``runs`` are sorted by start, then period; ``collapsed`` has the words that no run holds after
    its first q, joined by one space.  Words are what stands between space, tab, LF, VT, FF and CR.

    A null, empty or blank text has no words, no runs and the empty text.  Rows stand for themselves: repeated rows, ties and
    null keys are kept as they are; an empty table gives an empty one.  Other columns are left out, so none can clash.
    Rows never meet, so nothing is shuffled; a task holds one text and some 40 bytes a word of it.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(_job, f"`{key}` {kind}, n_words long, {RUNS}, collapsed string")


def repeated_in_place(words, h):
    """Column: ``words`` with the words from a on replaced by their first p, over and over, for a key hash ``h``.

    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)) with g = floor(h / 10).
    """
    n = F.size(words).cast("long")
    g = F.floor(h / 10)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (3 + g % 8))
    block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
    return F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), F.lit(1), n.cast("int"))
