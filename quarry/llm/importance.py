"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, own_names
from quarry.llm.shingles import PLAIN, SPACED, hash_words, mixed, runs_of, spans

BUCKETS = 1 << 18          # of the hashed n-grams; both models are arrays of this length
SAMPLE = 20_000            # labelled target documents that the target model is fitted on, at most
PRIOR = 3.0                # documents by which a rare n-gram's ratio is drawn to 1
SURE = 3.0                 # standard errors from the expected count below which a ratio counts as 1
EVEN = 20                  # added to a document's number of n-grams before its root normalises the sum
TOLERANCE = 0.18           # normalised log weight down to which a document counts in full
POWER = 200.0              # exponent of the weights beyond: how far sampling leans on them against the Gumbel noise
SEED = 11

# Kinds of bytes in a word's shape: lower, upper, digit, beyond ASCII; any other byte is its own kind.
KIND = np.array([1 if chr(b).islower() and b < 128 else 2 if chr(b).isupper() and b < 128 else 3 if chr(b).isdigit() and b < 128
                 else 4 if b >= 128 else 5 + b for b in range(256)], np.uint64)


def _shapes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of non-space: a hash of the kinds of its first two and last two bytes."""
    a, e = spans(data, starts, SPACED)
    kinds = [KIND[data[i]] for i in (a, np.minimum(a + 1, e - 1), np.maximum(a, e - 2), e - 1)]
    out = kinds[0]
    for k in kinds[1:]:
        out = out * np.uint64(300) + k
    return mixed(out), np.searchsorted(a, starts)


def features(texts: pa.Array):
    """Yields each text's distinct n-gram buckets: words, pairs of word shapes, and whether a word repeats the one before."""
    for _, data, starts in runs_of(texts):
        words, w_at = hash_words(data, starts, True, PLAIN)
        shapes, s_at = _shapes(data, starts)
        for i in range(len(starts) - 1):
            w, s = words[w_at[i]:w_at[i + 1]], shapes[s_at[i]:s_at[i + 1]]
            grams = [mixed(w + np.uint64(1)), mixed(s[:1] + np.uint64(3)), mixed(s[1:] * np.uint64(31) + s[:-1])]
            again = w[1:] == w[:-1]
            runs = again[2:] & again[1:-1] & again[:-2] if len(again) > 2 else again[:0]       # a word four times in a row
            grams.append(mixed(np.array([77], np.uint64)) if runs.any() else np.zeros(0, np.uint64))
            yield np.unique(np.concatenate(grams) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counter(target: np.ndarray):
    def run(batches):
        raw, own = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        n = m = 0
        for batch in batches:
            ids = np.array([-1 if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            named = np.isin(ids, target) & np.array([i is not None for i in batch.column(0).to_pylist()], bool)
            for chosen, grams in zip(named, features(batch.column(1))):
                raw[grams] += 1
                n += 1
                if chosen:
                    own[grams] += 1
                    m += 1
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(raw[some], n)), pa.array(np.append(own[some], m))], ["bucket", "raw", "own"])
    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Log ratio of target to raw for every n-gram bucket, 0 at most.

    Raw text holds the target text, so an n-gram can speak far against a document
    but hardly for it; ratios above 1 are taken as 1, so length earns nothing.

    Raw counts (documents that hold the n-gram) are of all ``docs``; target counts are of labelled documents of
    quality 1 that are not toxic, at most ``sample`` of them, those with the smallest hashed id.  Each task
    adds up its documents; the sums, ``BUCKETS`` rows, go to the driver.
    """
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    chosen = np.array([r.doc_id for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()], np.int64)
    counts = (docs.select("doc_id", "text").mapInArrow(_counter(np.sort(chosen)), "bucket long, raw long, own long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).toPandas())
    raw, own = np.zeros(BUCKETS), np.zeros(BUCKETS)
    total = counts[counts.bucket < 0]
    counts = counts[counts.bucket >= 0]
    raw[counts.bucket], own[counts.bucket] = counts.raw, counts.own
    n, m = (int(total.raw.iloc[0]), int(total.own.iloc[0])) if len(total) else (0, 0)
    if not m:
        return np.zeros(BUCKETS, np.float32)
    expected = raw * m / n
    ratio = np.log((own + PRIOR) / (expected + PRIOR))
    sure = np.abs(own - expected) >= SURE * np.sqrt(expected + 1)
    return np.where(sure, np.minimum(ratio, 0), 0).astype(np.float32)


def _scorer(ratio: np.ndarray):
    def run(batches):
        for batch in batches:
            weight = [float(ratio[g].sum() / np.sqrt(len(g) + EVEN)) if len(g) else None for g in features(batch.column(batch.schema.get_field_index("text")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight, pa.float64())], [*batch.schema.names, "log_weight"])
    return run


def top_k_from(rows: DataFrame, key: str, k: int, few: int = 4096) -> float | None:
    """The ``k``-th largest ``key``, by counting in ever finer bins; at most ``few`` numbers reach the driver at once."""
    lo, hi, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return lo
    left, inside = k, rows.where(F.col(key).isNotNull()).select(key)
    while n > few and hi > lo:
        step = (hi - lo) / few
        at = F.least(F.lit(few - 1), F.floor((F.col(key) - lo) / step))
        bins = sorted(((r.b, r.c, r.x, r.y) for r in inside.groupBy(at.alias("b")).agg(
            F.count(key).alias("c"), F.min(key).alias("x"), F.max(key).alias("y")).collect()), reverse=True)
        for _, c, x, y in bins:
            if left <= c:
                lo, hi, n = x, y, c
                break
            left -= c
        inside = inside.where(F.col(key).between(lo, hi))
    return sorted((r[0] for r in inside.collect()), reverse=True)[left - 1] if n <= few else lo


@own_names("doc_id", "text")
def resample(docs: DataFrame, ratio: np.ndarray, k: int | None = None, tolerance: float = TOLERANCE, power: float = POWER,
             seed: int = SEED) -> DataFrame:
    """``docs`` plus ``log_weight`` (target against raw) and ``keep``.

    The log weight of a document is the sum of its n-grams' log ratios over the root of their number, the scale
    of the chance part of that sum.  Without replacement, ``k`` documents are drawn by Gumbel top-k with probabilities as
    ``exp(power * min(0, log_weight + tolerance))``: the ``k`` largest of that exponent plus Gumbel noise, which comes
    from the hashed id, so reruns agree.  ``k`` is, if not given, the number of documents that the weights stand for.

    A text without words (null, empty) has no weight and is rejected; rows with the same id get the same noise, so equal
    rows are kept or rejected together; null ids count as one id.  Without any target label all weights are 1.  An empty
    table gives no rows.  Other columns pass through; ``log_weight`` and ``keep`` of the input are replaced.
    """
    docs = docs.drop("log_weight", "keep")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    scored = docs.mapInArrow(_scorer(ratio), f"{fields}, log_weight double")
    unit = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    exponent = F.when(F.col("log_weight").isNotNull(), power * F.least(F.lit(0.0), F.col("log_weight") + tolerance))
    keyed = scored.withColumn("_key", exponent - F.log(-F.log(unit)))
    slim = cut(keyed.select(exponent.alias("_exponent"), "_key"))
    if k is None:
        k = int(round(slim.agg(F.sum(F.exp("_exponent"))).first()[0] or 0))
    least = top_k_from(slim, "_key", k)
    return keyed.withColumn("keep", F.coalesce(F.col("_key") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False)).drop("_key")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> DataFrame:
    """``docs`` plus ``log_weight`` and ``keep``, by models fitted on the same documents and ``labels``."""
    return resample(docs, fit(docs, labels, sample), **options)
