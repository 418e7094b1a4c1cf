"""Corpus pipeline over ``documents``: classify, remove near duplicates, decontaminate, mix sources, shard.

Every stage takes all rows its predecessor kept and returns the columns of
``documents``; the last adds ``size``, ``shard`` and ``slot`` (in place of columns of these names).  Other columns pass
through every stage untouched, whatever they are called.  Stages are written as Parquet and
read again, so a lost executor costs at most the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, importance, jaccard_tree, mixing, sharding
from quarry.llm.common import own_names, shared_folder

N_SHARDS = 8


@own_names("doc_id", "text", position=1)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the importance weights against the labelled target text reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.classify(docs, labels).where("keep").select(*docs.columns)


@own_names("doc_id", "text", position=1)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram Jaccard similarity stays: the one with the smallest id."""
    return jaccard_tree.one_of_each(docs)


@own_names("doc_id", "text", position=1)
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@own_names("doc_id", "text", "source", position=1)
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come to their target shares."""
    return mixing.apply_mix(docs)


@own_names("doc_id", "text", position=1)
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard of near equal bytes and their slot in it; copies of a text lie together.

    Places are found on ids, hashes and sizes alone.  Rows that repeat wholly (id and text; the mix
    repeats a document three times at most) are one row of text with its places, laid out at the end.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("_th", F.xxhash64("text"))
    slim = keyed.select(F.col("doc_id").alias("id"), F.col("_th").alias("th"), (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    placed = sharding.shard_by_bytes(slim, N_SHARDS, order=("id", "th"), group="crc")
    places = placed.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("size", "shard", "slot"))).alias("_at"))
    # without nulls in the keys the join's partitioning also serves the last step: texts are shuffled once
    own = lambda name: F.coalesce(name, F.lit(-2**63))
    places = places.select(own("id").alias("_id"), F.col("th").alias("_th"), "_at")
    one = keyed.withColumn("_id", own("doc_id")).join(places, ["_id", "_th"]).dropDuplicates(["_id", "_th"])
    return one.select(*docs.columns, F.inline("_at"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks),
          ("mix_sources", mix_sources), ("shards", shards)]

# SQL can't express the hashed models, the signature trees or the SimHash windows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
