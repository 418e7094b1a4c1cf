"""Helpers shared by the training-data operators: lineage cuts, prefix sums, components.

All of them are DataFrame plans; none collects rows that grow with the input.
"""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Only these letters are folded (the contracts fold A-Z and nothing else).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_names(*needed: str, position: int = 0):
    """Decorator of an operator on rows: its working columns never meet the caller's, whatever these are called.

    All columns of the operator's frame (its argument number ``position``) but the ``needed`` ones get reserved names while it runs
    and have their own again in the result, untouched.  Where the operator adds a column of a name that the caller has too,
    the result has the operator's in its place.
    """
    def wrap(operator):
        @functools.wraps(operator)
        def run(*args, **options):
            df = args[position]
            hidden = {c: f"_kept_{i}_" for i, c in enumerate(df.columns) if c not in needed}
            plain = df.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in df.columns])
            out = operator(*args[:position], plain, *args[position + 1:], **options)
            back = {h: c for c, h in hidden.items()}
            new = {c.lower() for c in out.columns if c not in back}
            return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns if c not in back or back[c].lower() not in new])
        return run
    return wrap


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in ``spark.checkpoint.dir`` (survives lost executors).

    Only a purely local session without that setting (tests) gets a scratch
    folder; anywhere else a missing setting is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("name a shared folder in spark.checkpoint.dir")
            where = tempfile.mkdtemp(prefix="quarry-llm-")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, for tables that are written and reread."""
    import uuid
    cut(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def fold(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def ranged(df: DataFrame, *order) -> DataFrame:
    """Rows range-partitioned by ``order`` with their partition in ``_p``; written once, so ``_p`` is stable."""
    n = partitions(df.sparkSession)
    return cut(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))


def running(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """Exclusive global prefix sums of a ``ranged`` frame, one column per entry of ``sums``.

    Each partition sums its own rows; the per-partition totals (one row per
    partition, whatever the input) give the offsets.
    """
    totals = df.groupBy("_p").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", *[F.coalesce(F.sum(f"_t_{k}").over(w), F.lit(0)).alias(f"_o_{k}") for k in sums])
    inner = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(k) for k, c in sums.items()])
    return (out.join(F.broadcast(offsets), "_p")
            .select(*[c for c in df.columns if c != "_p"],
                    *[(F.col(k) + F.col(f"_o_{k}")).alias(k) for k in sums]))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable over ``links(a, b)``.

    Each round takes the smallest label among neighbours, then the label of
    that label (pointer jumping), until nothing changes.  Nodes without links
    never enter the rounds.  A hot node's row is one small row joined to its
    links, so skew handling can split the links.
    """
    both = cut(links.select("a", "b").where("a <> b").distinct())
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                 .select("v", F.least("v", "m").alias("l")))
    while True:
        near = (both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m")))
        low = labels.join(near, "v").select("v", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        up = labels.select(F.col("v").alias("l"), F.col("l").alias("up"))
        new = cut(low.join(up, "l").select("v", "old", F.least("l", "up").alias("l")))
        if not new.where("l <> old").limit(1).count():
            break
        labels = new.select("v", "l")
    return (nodes.join(labels.withColumnRenamed("v", "node"), "node", "left")
            .select("node", F.coalesce("l", "node").alias("component")))
