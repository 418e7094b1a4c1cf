"""Words and word shingles of whole texts as 64-bit numbers, computed with numpy on Arrow's text buffers.

Used inside ``mapInArrow`` tasks; a batch's texts are hashed together, without a Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CHUNK = 1 << 22       # bytes hashed at once; a longer text is one piece of its own


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse modulo 2^64."""
    inverse = pow(int(BASE), -1, 1 << 64)
    out = []
    for b in (int(BASE), inverse):
        p = np.full(n, np.uint64(b), dtype=np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_TABLE: list = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


SPACED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])                       # runs of non-space
PLAIN = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])                          # letters and digits only


def spans(data: np.ndarray, starts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words: runs of bytes of ``kind`` that do not cross a text start."""
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = starts[starts < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, fold: bool = True, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in ``data`` (UTF-8 bytes) and, for every text start (plus the end), the words before it.

    A word is a run of bytes of ``kind``; it never crosses a text start.
    The hash is a polynomial in the bytes, A-Z folded if ``fold``, then mixed.
    """
    begins, ends = spans(data, starts, kind)
    low = data
    if fold:
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
    return hash_spans(low, begins, ends), np.searchsorted(begins, starts)


def hash_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans: a polynomial in the bytes, by prefix sums, mixed with the length."""
    n = len(data)
    if len(_TABLE[0]) < n + 1:
        _TABLE[:] = _powers(max(n + 1, 1 << 16))
    power, inverse = _TABLE[0], _TABLE[1]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))


def words_of(texts: pa.Array, fold: bool = True, kind: np.ndarray = SPACED):
    """Yields ``first text, offsets, word hashes`` for runs of texts; text ``first + i`` has words ``offsets[i]:offsets[i + 1]``.

    A null text has no words.
    """
    for i, data, starts in runs_of(texts):
        words, offsets = hash_words(data, starts, fold, kind)
        yield i, offsets, words


def runs_of(texts: pa.Array):
    """Yields ``first text, bytes, starts`` (with the end) for runs of texts of about ``CHUNK`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield i, data[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; with fewer words (but one at least) the whole as one."""
    if not len(words):
        return words
    if len(words) < k:
        k = len(words)
    out = np.full(len(words) - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        out += words[j:len(words) - k + 1 + j] * _FACTORS[j]
    return mixed(out)
