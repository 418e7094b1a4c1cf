"""Contiguous shards of equal bytes: global prefix sums of sizes cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, ranged, running


def shard_by_bytes(rows: DataFrame, n_shards: int, size: str = "size", order: tuple[str, ...] = ("doc_id",),
                   group: str | None = None, tolerance: float = 0.01) -> DataFrame:
    """``rows`` plus ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    The rows in ``order`` form one line; a row's start on it is the sum of all
    sizes before it (per-partition totals plus the sum inside the partition),
    and shard ``i`` takes the starts from ``i`` to ``i + 1`` n-ths of the total.
    With ``group`` (then the first sort key) a cut that falls into a group moves
    to the group's nearer end if that is at most ``tolerance`` of a shard away;
    a larger group is cut at the target, so a hot group never unbalances shards.

    Nulls sort first, in any column; a null size counts 0; repeated rows each
    get a slot (equal rows are interchangeable); an empty table gives no rows.
    Other columns pass through.  Columns ``shard``, ``slot`` of the input are replaced.
    """
    rows = rows.drop("shard", "slot", "_p", "_start", "_row")
    keys = ([group] if group else []) + [c for c in order if c != group]
    by = [*keys, size]
    base = ranged(rows, *by)
    at = cut(running(base, by, {"_start": F.coalesce(F.col(size), F.lit(0)), "_row": F.lit(1)})
             .withColumns({"_start": F.col("_start").cast("long"), "_row": F.col("_row").cast("long")}))
    end = F.col("_start") + F.coalesce(F.col(size), F.lit(0))
    total = at.agg(F.max(end)).first()[0] or 0
    cuts = [i * total // n_shards for i in range(1, n_shards)]        # one number per shard
    if group and cuts:
        goals = F.array(*[F.lit(c).cast("long") for c in cuts])
        inside = F.exists(goals, lambda c: (F.col("_start") <= c) & (c < end))
        hit = at.where(inside).select(F.col(group).alias("_g")).distinct()    # one group per cut at most
        spans = (at.join(F.broadcast(hit), F.col(group).eqNullSafe(F.col("_g"))).groupBy("_g")
                 .agg(F.min("_start").alias("lo"), F.max(end).alias("hi")).collect())
        near = tolerance * total / n_shards
        for s in spans:
            for i, c in enumerate(cuts):
                if s.lo < c < s.hi:
                    best = s.lo if c - s.lo <= s.hi - c else s.hi
                    cuts[i] = best if abs(best - c) <= near else c
    marks = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    put = at.withColumn("shard", F.size(F.filter(marks, lambda c: F.col("_start") >= c)))
    firsts = F.broadcast(put.groupBy("shard").agg(F.min("_row").alias("_first")))     # one row per shard
    return (put.join(firsts, "shard")
            .select(*rows.columns, "shard", (F.col("_row") - F.col("_first")).alias("slot")))
