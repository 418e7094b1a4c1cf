"""Matching against a keyword *table* inside the JVM (M1, M2 for thousands to millions of keywords): a q-gram filter join.

Every normal form is represented by one of its q-grams, the rarest.  A text that holds the keyword holds this
q-gram, so the texts' distinct q-grams (one look-ahead regular expression) joined with the representatives give
all candidates; each is then verified and counted by its own pattern.  No Python worker, no dictionary in the task closure, and
the keywords never pass through the driver.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import WORD_CLASS, casefold_col
from quarry.operators.match import spread_target

Q = 5
SAMPLE = 2000                     # texts whose q-grams tell which are rare; the choice changes the speed, never the result
BROADCAST_BYTES = 32 << 20        # of representatives that go to every task; more are joined by a shuffle of q-grams


def _grams(text: Column, q: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1))


def _quoted(word: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _pattern(norm: Column, mode: str) -> Column:
    """Overlapping starts (dictionary mode) or the bordered word (boundary mode), as ``operators.match`` defines them."""
    if mode == "dictionary":
        return F.concat(F.lit("(?="), _quoted(norm), F.lit(")"))
    is_word = lambda c: c.rlike(f"^{WORD_CLASS}$")
    left = F.when(is_word(F.left(norm, F.lit(1))), f"(?<!{WORD_CLASS})").otherwise(f"(?<={WORD_CLASS})")
    right = F.when(is_word(F.right(norm, F.lit(1))), f"(?!{WORD_CLASS})").otherwise(f"(?={WORD_CLASS})")
    return F.concat(left, _quoted(norm), right)


def representatives(keywords: DataFrame, texts: DataFrame, mode: str, q: int = Q) -> DataFrame:
    """``gram, norm, pattern, labels``: one row for each normal form, by its rarest q-gram (the whole form if it is shorter).

    ``labels`` are its (group, keyword) pairs, bounded by the groups.  Rarity is counted over ``SAMPLE`` rows of ``texts``
    (column ``_t``), then over the forms themselves.
    """
    forms = (keywords.where("norm <> ''").groupBy("norm")
             .agg(F.array_sort(F.collect_set(F.struct("keyword_group", "keyword"))).alias("labels")))
    grams = forms.select("norm", F.explode(F.array_distinct(
        F.when(F.length("norm") < q, F.array("norm")).otherwise(_grams(F.col("norm"), q)))).alias("gram"))
    seen = (texts.limit(SAMPLE).select(F.explode(F.array_distinct(_grams(F.col("_t"), q))).alias("gram"))
            .groupBy("gram").agg(F.count(F.lit(1)).alias("in_texts")))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("in_forms"))
    best = (grams.join(shared, "gram").join(seen, "gram", "left").groupBy("norm")
            .agg(F.min_by("gram", F.struct(F.coalesce("in_texts", F.lit(0)), "in_forms", "gram")).alias("gram")))
    return best.join(forms, "norm").select("gram", "norm", _pattern(F.col("norm"), mode).alias("pattern"), "labels")


def match_table(units: DataFrame, keywords: DataFrame, *, keys: Sequence[str], text_col: str = "text", mode: str = "dictionary",
                case_sensitive: bool = False, q: int = Q, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Facts ``(keys..., keyword_group, keyword, count)`` of ``units`` for a table ``keyword_group, keyword, norm``.

    The same facts as ``match_dictionary`` (``norm`` case-folded, ``keyword`` the display form) or ``match_boundary``
    (``norm`` in lower case) give.  While the representatives are small they are broadcast and the texts stay where they are: q-grams,
    join, verification and count are one stage.  Beyond ``broadcast_bytes`` the q-grams are shuffled with the rows' keys only,
    and the candidate pairs meet the texts by ``keys``.
    """
    if mode not in ("dictionary", "boundary"):
        raise ValueError(f"unknown match mode {mode!r}")
    keys = list(keys)
    t = F.col(text_col)
    if mode == "boundary":
        t = F.lower(F.regexp_replace(t, "\r\n?", "\n"))
    elif not case_sensitive:
        t = casefold_col(t)
    n = spread_target(units)
    texts = (units.select(*keys, text_col).repartition(n, *keys) if n else units).select(*keys, t.alias("_t"))
    index = representatives(keywords.select("keyword_group", "keyword", "norm").distinct(), texts, mode, q).persist()
    size, widths = index.agg(F.sum(F.octet_length("norm") * 4 + 64 + 64 * F.size("labels")), F.collect_set(F.length("gram"))).first()
    if not size:
        index.unpersist()
        empty = index.select("norm", F.explode("labels").alias("l")).select("l.keyword_group", "l.keyword", F.lit(1).cast("bigint").alias("count")).limit(0)
        return units.select(*keys).limit(0).join(empty, F.lit(True))
    grams = reduce(lambda a, b: F.concat(a, b), [_grams(F.col("_t"), n) for n in sorted(widths)])
    if size <= broadcast_bytes:
        found = texts.select(*keys, "_t", F.explode(F.array_distinct(grams)).alias("gram")).join(F.broadcast(index), "gram")
    else:
        pairs = texts.select(*keys, F.explode(F.array_distinct(grams)).alias("gram")).join(index, "gram").drop("gram")
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        found = (texts.alias("a").join(pairs.dropDuplicates([*keys, "norm"]).alias("b"), reduce(lambda x, y: x & y, same))
                 .select("a.*", "b.norm", "b.pattern", "b.labels"))
    found = found.where(F.contains(F.col("_t"), F.col("norm")))
    count = F.regexp_count("_t", F.col("pattern")).cast("bigint") if mode == "dictionary" else F.rlike("_t", F.col("pattern")).cast("bigint")
    return (found.select(*keys, "labels", count.alias("count")).where("count > 0")
            .select(*keys, F.inline("labels"), "count"))
