"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, cut, own_names

SEED = "mix-1"
BLOCKS = 1 << 20      # equal-token blocks that the whole mix is made of


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def _number(hexes: Column, digits: int) -> Column:
    return F.conv(F.substring(hexes, 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weight: Column, max_repeats: int = 3) -> DataFrame:
    """Targets per source: shares of the whole by weight, none above ``max_repeats`` times its size.

    ``sizes`` has one row per source (``source, source_size``).  What a capped
    source gives up is shared again by weight.  Sorted by how soon a source
    reaches its cap, the capped ones are a prefix, so running sums settle it
    without rounds.
    """
    cap = F.col("source_size") * max_repeats
    everything = Window.partitionBy()
    soonest = Window.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    ordered = sizes.withColumn("w", weight).select(
        "source", "source_size", "w", F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("given"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left"),
        F.row_number().over(soonest).alias("k"))
    over = ordered.withColumn("over", cap * F.col("left") < (F.col("total") - F.col("given")) * F.col("w"))
    first = F.min(F.when(~F.col("over"), F.struct("k", "given", "left"))).over(everything)
    return over.withColumn("f", first).select(
        "source", "source_size", "total",
        F.when(F.col("f").isNull() | (F.col("k") < F.col("f.k")), cap.cast("double"))
        .otherwise(((F.col("total") - F.col("f.given")) * F.col("w")).cast("double") / F.col("f.left")).alias("target"))


def sainte_lague(votes: DataFrame, group: list[str], key: list[str], seats: str = "seats") -> DataFrame:
    """Adds ``quota``: each group's ``seats`` go to the highest quotients ``votes / (2 k + 1)``.

    ``seats`` is constant in a group.  Shares rounded for slightly fewer and for
    slightly more seats bound each quota from both sides (rounding moves at
    most half a seat per party), so only the few quotients in between are
    ranked; ties go to the smaller ``key``.
    """
    w = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(w), F.sum("votes").over(w)
    bounds = votes.withColumns({"_n": n, "_t": total}).withColumns({
        "_lo": F.when(F.col("votes") > 0, F.greatest(F.lit(0), F.floor(
            F.col("votes") * (F.col(seats) - F.col("_n") / 2) / F.col("_t") + 0.5) - 1)).otherwise(F.lit(0)).cast("long"),
        "_hi": F.when(F.col("votes") > 0, F.floor(
            F.col("votes") * (F.col(seats) + F.col("_n") / 2) / F.col("_t") + 0.5) + 1).otherwise(F.lit(0)).cast("long")})
    bounds = bounds.withColumn("_open", F.col(seats) - F.sum("_lo").over(w))
    tries = bounds.select("*", F.explode_outer(F.when(
        F.col("_hi") > F.col("_lo"), F.sequence(F.col("_lo"), F.col("_hi") - 1))).alias("_k"))
    quotient = F.col("votes") / (2 * F.col("_k") + 1)
    rank = F.row_number().over(w.orderBy(F.desc_nulls_last(quotient), *[F.col(c).asc_nulls_last() for c in key]))
    won = F.when(F.col("_k").isNotNull() & (rank <= F.col("_open")), 1).otherwise(0)
    keep = [c for c in votes.columns]
    return (tries.withColumn("_won", won).groupBy(*keep, "_lo").agg(F.sum("_won").alias("_w"))
            .select(*keep, (F.col("_lo") + F.col("_w")).alias("quota")))


def cycle_weights(weights: tuple[int, ...] = (5, 2, 1)) -> Column:
    """Weights for sources in code point order, null last, repeating."""
    r = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(x) for x in weights]), (r % len(weights) + 1).cast("int")).cast("long")


def mix(rows: DataFrame, weight: Column | None = None, max_repeats: int = 3, blocks: int = BLOCKS,
        also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` (and ``also``) of rows ``doc_id, source, size`` (in words).

    The mix is as long as the input and made of ``blocks`` blocks of equal
    tokens.  Sources get blocks by Sainte-Lague on their targets.  A source of n
    documents has about sqrt(n) shards, dealt by the seeded digest of the id (so
    neither a shard nor a source's list of shards grows as fast as the input),
    and its blocks go to its shards by Sainte-Lague again, on the shards'
    tokens, which gives integer quotas.  In a shard the documents in digest order form a ring
    of tokens; its quota is that many blocks in a row from a seeded place, so
    full turns repeat everything and the rest is a seeded selection.  Nothing is
    drawn at run time: reruns agree.  No token is taken more than ``max_repeats`` times.

    A null source is a source of its own, a null size counts 0 (nothing taken);
    repeated rows are taken each on its own; an empty table gives no rows.
    Other columns do not matter and are not returned.
    """
    mark = _digest(F.col("doc_id"))
    docs = cut(rows.select(*also, "doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
               .withColumn("digest", mark))
    widths = docs.groupBy(F.col("source").alias("src")).agg(
        F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("shards"))
    docs = (docs.join(widths, docs.source.eqNullSafe(widths.src))
            .select(*also, "doc_id", "source", "size", "digest", (_number(F.col("digest"), 12) % F.col("shards")).alias("shard")))
    parts = cut(docs.groupBy("source", "shard").agg(F.sum("size").alias("votes")))
    plan = targets(parts.groupBy("source").agg(F.sum("votes").alias("source_size")),
                   cycle_weights() if weight is None else weight, max_repeats)
    block = F.greatest(F.lit(1), F.floor(F.col("total") / blocks))
    seats = F.floor(F.col("total") / block)
    plan = plan.withColumns({"block": block, "seats": seats, "votes": F.col("target"), "_all": F.lit(0)})
    plan = cut(sainte_lague(plan, ["_all"], ["source"]).select(
        F.col("source").alias("src"), "source_size", "target", "block",
        F.least("quota", F.floor(F.col("source_size") * max_repeats / F.col("block"))).alias("seats")))
    quotas = sainte_lague(parts.join(plan, parts.source.eqNullSafe(plan.src)).drop("src"), ["source"], ["shard"])
    length = F.least(F.col("quota") * F.col("block"), F.col("votes") * max_repeats)
    quotas = quotas.select(
        F.col("source").alias("src"), F.col("shard").alias("sh"), "source_size", "target", F.col("votes").alias("ring"),
        length.alias("length"),
        F.when(F.col("votes") > 0, _number(_digest(F.col("source"), F.col("shard")), 12) % F.col("votes"))
        .otherwise(0).alias("at"))
    ring = Window.partitionBy("source", "shard").orderBy("digest", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = docs.withColumn("start", F.coalesce(F.sum("size").over(ring), F.lit(0)))
    both = placed.join(quotas, placed.source.eqNullSafe(quotas.src) & (placed.shard == quotas.sh))
    rest = F.expr("CASE WHEN ring > 0 THEN length % ring ELSE 0 END")
    upto = lambda p, q: F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), q) - F.greatest(F.col("start"), p))
    part = upto(F.col("at"), F.col("at") + rest) + upto(F.lit(0), F.col("at") + rest - F.col("ring"))
    taken = F.when(F.col("ring") > 0, F.floor(F.col("length") / F.col("ring")) * F.col("size") + part).otherwise(0)
    return both.select(*also, "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


@own_names("doc_id", "text", "source")
def apply_mix(docs: DataFrame, weight: Column | None = None, **options) -> DataFrame:
    """``docs`` (``doc_id, text, source`` and more) as the mix takes them: each row as often as its words are taken.

    A row that is taken in part, a fraction of a pass, stays or goes by its seeded digest with that
    chance, so sources keep their targets.  Rows that repeat wholly (id and text) share what they are taken.
    """
    th = F.xxhash64("text")
    sized = docs.select("doc_id", "source", th.alias("th"), word_count(F.col("text")).alias("size"))
    taken = mix(sized, weight, also=("th",), **options).groupBy(F.col("doc_id").alias("id"), "th").agg(
        F.try_divide(F.sum("taken"), F.sum("size")).alias("passes"))
    chance = _number(_digest(F.col("id"), F.col("th")), 12) / float(1 << 48)
    copies = taken.select("id", "th", F.floor(F.col("passes") + chance).cast("int").alias("copies")).where("copies > 0")
    copies = copies.select(F.col("id").alias("_id"), F.col("th").alias("_of"), F.col("copies").alias("_copies"))
    keyed = docs.withColumn("_th", th)
    both = keyed.join(copies, keyed.doc_id.eqNullSafe(copies._id) & (keyed._th == copies._of))
    return both.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")
