"""Language identification by cross-parsing: a text is cut into longest phrases known from a language's own text.

For each language a suffix automaton of a bounded sample of labelled text is built.  From its start state one walks along
the text as long as there is a way on, which gives the longest match; there a phrase ends and the next begins.
``phrases * log2(sample length) / text length`` estimates the cross entropy (Ziv and Merhav); the language with the least wins.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 200         # labelled documents of each language at most
SAMPLE_BYTES = 40_000     # bytes of their text (letters and single spaces, UTF-8) in the automaton; the same for all languages
PIECE = 256               # bytes after which a phrase is cut off, so that the pieces of a batch can be walked side by side
BATCH = 1 << 21           # bytes of text that are walked side by side

_LETTERS = re.compile(r"[^\W\d_]+")


def letters_only(text: str) -> bytes:
    """The letters of a text in lower case, with one space for whatever stands between them; empty without letters."""
    return " ".join(w for w in _LETTERS.findall(text.lower()) if not w.isspace()).encode("utf-8", "replace")


class SuffixAutomaton:
    """All substrings of a byte string as a table of next states over the byte classes that occur in it.

    ``step[state, kind]`` is the next state, 0 if there is none (nothing leads to the start state, which is 1).
    """

    def __init__(self, data: bytes):
        kinds = sorted(set(data))
        self.size = len(data)
        self.kind = np.zeros(256, np.uint8)                    # 0: a byte that does not occur
        self.kind[kinds] = np.arange(1, len(kinds) + 1)
        ways: list[dict[int, int]] = [{}, {}]
        link, length, last = [0, 0], [0, 0], 1
        for c in self.kind[np.frombuffer(data, np.uint8)].tolist():
            state = len(ways)
            ways.append({})
            link.append(1)
            length.append(length[last] + 1)
            p, last = last, state
            while p and c not in ways[p]:
                ways[p][c] = state
                p = link[p]
            if not p:
                continue
            q = ways[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
                continue
            clone = len(ways)
            ways.append(dict(ways[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = link[state] = clone
            while p and ways[p].get(c) == q:
                ways[p][c] = clone
                p = link[p]
        self.step = np.zeros((len(ways), len(kinds) + 1), np.int32)
        for state, own in enumerate(ways):
            if own:
                self.step[state, list(own)] = list(own.values())

    def phrases(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of phrases of every span of ``data``; spans are walked side by side, the longest first."""
        kinds, wide = self.kind[data], self.step.shape[1]
        order = np.argsort(starts - ends, kind="stable")
        at, size = starts[order], (ends - starts)[order]
        state, count = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
        flat = self.step.reshape(-1)
        alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")   # spans longer than i
        for i, n in enumerate(alive.tolist()):
            c = kinds[at[:n] + i]
            way = flat[state[:n] * wide + c]
            ended = way == 0                                   # the phrase before ends; this byte begins the next
            count[:n] += ended | (state[:n] == 1)
            state[:n] = np.where(ended, flat[wide + c], way)
            state[:n][state[:n] == 0] = 1                      # a byte that the language does not have is a phrase by itself
        out = np.empty(len(at), np.int64)
        out[order] = count
        return out


_MODELS: dict[int, list] = {}


def _models(samples: list[tuple[str, bytes]]) -> list:
    """``language, automaton, bits of a phrase``; built once in each worker process."""
    key = zlib.crc32(repr(samples).encode())
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = [(lang, SuffixAutomaton(text), float(np.log2(max(2, len(text))))) for lang, text in samples]
    return _MODELS[key]


def entropies(texts: list[bytes], models: list) -> np.ndarray:
    """Bits a byte of every text (rows) under every language (columns)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), len(models)))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    pieces = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(texts)), pieces)
    first = (ends - sizes)[owner] + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    last = np.minimum(first + PIECE, ends[owner])
    for j, (_, automaton, bits) in enumerate(models):
        n = np.bincount(owner, automaton.phrases(data, first, last), len(texts))
        out[:, j] = bits * n / np.maximum(sizes, 1)
    return out


def _predict(texts: list[str | None], models: list) -> tuple[list[str], list[float]]:
    plain = [letters_only(t) if t else b"" for t in texts]
    if not models:
        return ["und"] * len(texts), [0.0] * len(texts)
    langs = [m[0] for m in models]
    lang, score, a = [], [], 0
    while a < len(plain):
        b, held = a, 0
        while b < len(plain) and (b == a or held + len(plain[b]) <= BATCH):
            held += len(plain[b])
            b += 1
        bits = entropies(plain[a:b], models)
        for t, row in zip(plain[a:b], bits):
            if not t:
                lang.append("und")
                score.append(0.0)
                continue
            best = int(row.argmin())                           # ties: the first by code point
            second = min((x for j, x in enumerate(row) if j != best), default=None)
            lang.append(langs[best])
            score.append(1.0 if second is None else float(1 - row[best] / second) if second > 0 else 0.0)
        a = b
    return lang, score


def _job(samples):
    def run(batches):
        models = _models(samples)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                lang, score = _predict(part.column(1).to_pylist(), models)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 [batch.schema.field(0).name, "lang_pred", "score"])
    return run


def samples_of(labelled: DataFrame, docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> list[tuple[str, bytes]]:
    """For every label the text that its automaton is built from, by label: ``size`` bytes of up to ``docs`` documents.

    ``labelled`` has ``text`` and ``lang``.  The documents are those whose texts' hashes are smallest (each text once), so the
    choice depends on texts alone; their letters are laid one after the other, the same share of each.  Labels without a letter are left out.
    At most ``docs`` texts a language reach the driver, one at a time.
    """
    slim = labelled.where("lang is not null and text rlike '\\\\p{L}'").select("lang", F.xxhash64("text").alias("h")).distinct()
    # the smallest of each sixteenth of a language first, so no task gets a whole language's hashes
    least = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= docs).drop("r")
    ranked = least(least(slim, "lang", F.pmod("h", F.lit(16))), "lang")
    chosen = (labelled.withColumn("h", F.xxhash64("text")).join(F.broadcast(ranked), ["lang", "h"])
              .groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h"))
    texts: dict[str, list[bytes]] = {}
    for row in chosen.toLocalIterator():
        texts.setdefault(row["lang"], []).append(letters_only(row["text"])[:size])
    return [(lang, _even(own, size)) for lang, own in sorted(texts.items()) if any(own)]


def _even(texts: list[bytes], size: int) -> bytes:
    """``size`` bytes of the texts, of each as many as of the others where it has them (short ones leave more to the rest)."""
    left, out = size, []
    for i, t in enumerate(sorted(texts, key=len)):
        out.append(t[:left // (len(texts) - i)])
        left -= len(out[-1])
    return b" ".join(out)


def predict_language(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of every whole text of ``docs``, learned from ``labelled`` (``text``, ``lang``).

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing is labelled.  The score is what the best
    language saves against the second (0 to 1; 1 if there is one language only).  Repeated rows and null keys are kept as they are;
    other columns are left out.  Texts are not shuffled; every task gets the samples (``SAMPLE_BYTES`` a language) and builds the
    automata once a worker process.
    """
    kind = docs.schema[key].dataType.simpleString()
    samples = samples_of(labelled)
    return docs.select(key, F.col(text).cast("string")).mapInArrow(_job(samples), f"`{key}` {kind}, lang_pred string, score double")
