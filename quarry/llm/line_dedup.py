"""Repeated line runs: prefix doubling over line ids of all documents; later copies are deleted."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, cut, own_names, ranged, running

MIN_WORDS = 50       # a repeated run counts from so many words on

KEY = ["id", "th"]   # a document: its id (null: the smallest number) and a hash of its text


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"id": F.coalesce("doc_id", F.lit(-2**63)), "th": F.xxhash64("text")})


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with a word in them: ``id, th, pos`` (among such lines), ``line`` (among all), ``a, b`` (identity), ``words``."""
    at = _keyed(docs).select(*KEY, F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    own = at.select(*KEY, "line", F.xxhash64("s").alias("a"), F.xxhash64("s", F.lit("second")).alias("b"),
                    F.regexp_count("s", F.lit(WORD)).cast("long").alias("words")).where("words > 0")
    own = own.repartition(*KEY).dropDuplicates([*KEY, "line"])         # a row that repeats wholly counts once
    return own.withColumn("pos", F.row_number().over(Window.partitionBy(*KEY).orderBy("line")) - 1)


def _runs(lines: DataFrame, min_words: int) -> DataFrame:
    """Shortest runs of ``min_words`` words or more from each line on and up to each line: ``pos, m`` and lines ``lo, hi``.

    Any longer run is the union of such runs inside it.
    """
    one = Window.partitionBy(*KEY)
    before = F.sum("words").over(one.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    c = lines.withColumn("c", F.coalesce(before, F.lit(0))).withColumn("e", F.col("c") + F.col("words"))
    ahead = one.orderBy("c").rangeBetween(0, min_words - 1)
    behind = one.orderBy("e").rangeBetween(-(min_words - 1), 0)
    c = c.withColumns({"last": F.max(F.struct("pos", "line", "e")).over(ahead),
                       "first": F.min(F.struct("pos", "line", "c")).over(behind)})
    on = c.where(F.col("last.e") - F.col("c") >= min_words).select(
        *KEY, "pos", (F.col("last.pos") - F.col("pos") + 1).alias("m"), F.col("line").alias("lo"), F.col("last.line").alias("hi"))
    up = c.where(F.col("e") - F.col("first.c") >= min_words).select(
        *KEY, F.col("first.pos").alias("pos"), (F.col("pos") - F.col("first.pos") + 1).alias("m"),
        F.col("first.line").alias("lo"), F.col("line").alias("hi"))
    return on.unionByName(up).withColumn("k", F.floor(F.log2(F.col("m").cast("double"))).cast("int"))


def _ranks(pairs: DataFrame) -> DataFrame:
    """Keeps rows whose pair ``a, b`` occurs at two places or more and adds its rank ``r`` in the order of pairs."""
    place = F.struct(*KEY, "pos")
    groups = (pairs.groupBy("a", "b").agg(F.min(place).alias("x"), F.max(place).alias("y"))
              .where("x <> y").select(F.col("a").alias("ga"), F.col("b").alias("gb")))
    ranks = running(ranged(groups, "ga", "gb"), ["ga", "gb"], {"r": F.lit(1).cast("long")})
    return pairs.join(ranks, (F.col("a") == F.col("ga")) & (F.col("b") == F.col("gb"))).select(*KEY, "pos", "r")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``id, th, lo, hi``: line ranges (ends included) that are later copies of an earlier run.

    The line ids of all documents, each ending in an end of its own, are the
    text of one suffix array.  Round k ranks the runs of 2^k lines by the pairs of
    ranks of their halves; suffixes whose run occurs nowhere else drop out, so a
    round holds only what still repeats.  Suffixes that share their first ``m``
    lines (an LCP interval at depth ``m``) have equal ranks of 2^k lines at the front
    and at the end of the run.  The depth that decides is the one where the
    lines make up ``min_words`` words; as each has a word, doubling ends there, and
    any longer maximal run is the union of such runs inside it.  In each interval the first
    place in order of document and line keeps its copy; a copy that overlaps the
    first one gives up only what lies beyond it.
    """
    lines = cut(_lines(docs))
    level = cut(_ranks(lines.select(*KEY, "pos", "a", "b")))
    levels = [level.withColumn("k", F.lit(0))]
    for k in range(1, int(math.log2(min_words)) + 1):
        half = 1 << (k - 1)
        right = level.select(*KEY, (F.col("pos") - half).alias("pos"), F.col("r").alias("b"))
        level = cut(_ranks(level.withColumnRenamed("r", "a").join(right, [*KEY, "pos"])))
        if not level.limit(1).count():
            break
        levels.append(level.withColumn("k", F.lit(k)))
    ranks = reduce(DataFrame.unionByName, levels)
    front = ranks.withColumnRenamed("r", "ra")
    back = ranks.select(*KEY, "k", F.col("pos").alias("back"), F.col("r").alias("rb"))
    runs = (_runs(lines, min_words).join(front, [*KEY, "pos", "k"])
            .withColumn("back", (F.col("pos") + F.col("m") - F.expr("shiftleft(1, k)")).cast("int")).join(back, [*KEY, "back", "k"])
            .select(*KEY, "pos", "m", "ra", "rb", "lo", "hi"))
    runs = cut(runs.distinct())
    place = F.struct(*KEY, "pos", "hi")
    interval = (runs.groupBy("m", "ra", "rb").agg(F.min(place).alias("lead"), F.max(place).alias("x")).where("lead <> x").drop("x"))
    later = runs.join(interval, ["m", "ra", "rb"]).where(F.struct(*KEY, "pos") > F.struct("lead.id", "lead.th", "lead.pos"))
    own = (F.col("id") == F.col("lead.id")) & (F.col("th") == F.col("lead.th"))
    return (later.select(*KEY, F.when(own, F.greatest("lo", F.col("lead.hi") + 1)).otherwise(F.col("lo")).alias("lo"), "hi")
            .where("lo <= hi").distinct())


@own_names("doc_id", "text")
def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` less the later copies of repeated runs, and ``n_lines, n_removed`` (lines) and ``removed`` (ranges).

    Runs of ``min_words`` words or more that occur before, in the same or another document (in order of
    ``doc_id``, null first, then text hash), are deleted whole with the blank lines inside.
    Runs are of whole lines: the parts of a repeated passage that begin or end inside a line stay, and so does one
    that lies within a line.
    A null text stays null with no lines; an empty text is one blank line.  Rows that repeat wholly (id and
    text) are one document, so each gets the same result; an empty table gives
    no rows.  Other columns pass through; clashing ones are replaced.
    """
    new = ("n_lines", "n_removed", "removed", "id", "th")
    docs = docs.drop(*[c for c in new if c in docs.columns])
    inner = Window.partitionBy(*KEY).orderBy("lo", "hi")
    reach = F.max("hi").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    islands = (repeated_runs(docs, min_words).withColumn("new", F.when(F.col("lo") > reach + 1, 1).otherwise(0))
               .withColumn("island", F.sum("new").over(inner)).groupBy(*KEY, "island")
               .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    gone = (islands.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("removed")))   # of one document
    got = _keyed(docs).join(gone, KEY, "left").drop(*KEY)
    got = got.withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<lo:int,hi:int>>")))
    lines, ends = F.split("text", "\n", -1), F.col("removed")
    piece = lambda i: F.slice(
        lines, F.when(i == 0, 1).otherwise(F.get(ends, i - 1).hi + 2),
        F.when(i == F.size(ends), F.size(lines)).otherwise(F.get(ends, i).lo) - F.when(i == 0, 0).otherwise(F.get(ends, i - 1).hi + 1))
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(ends)), piece)), "\n")
    return got.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r.hi - r.lo + 1),
        "text": F.when(F.size(ends) == 0, F.col("text")).otherwise(kept)}).select(*docs.columns, "n_lines", "n_removed", "removed")
