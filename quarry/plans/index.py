"""The inverted index as a stored table (A6): bucketed and sorted by keyword, paths in bounded chunks.

A lookup of a keyword reads one bucket, and in it the row groups that its min/max statistics leave.  A hot
keyword (one that a third of all files hold) is many chunks, so no row and no task has to hold all its paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.reports import keyword_file_index

BUCKETS = 64
CHUNK = 4096              # paths of a row, about; a chunk is the paths of one hash, so sizes vary a little


def index_rows(facts: DataFrame, chunk: int = CHUNK, path_col: str = "display_path") -> DataFrame:
    """``keyword, chunk, paths``: each keyword's distinct paths, sorted, dealt by hash into as many chunks as they fill."""
    pairs = keyword_file_index(facts, path_col)
    chunks = pairs.groupBy("keyword").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("_chunks"))
    # one row a keyword, bounded by the dictionary
    dealt = pairs.join(F.broadcast(chunks), "keyword").withColumn("chunk", F.pmod(F.xxhash64("path"), F.col("_chunks")))
    return dealt.groupBy("keyword", "chunk").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def store_index(facts: DataFrame, table: str, path: str, buckets: int = BUCKETS, chunk: int = CHUNK, path_col: str = "display_path") -> None:
    """Writes the index as ``table`` with its files below ``path`` (a shared folder); an index of that name is replaced.

    Rows are dealt by (keyword, chunk) before they are written, so a hot keyword's chunks are written by many tasks into its bucket.
    """
    n = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (index_rows(facts, chunk, path_col).repartition(n, "keyword", "chunk")
     .write.mode("overwrite").bucketBy(buckets, "keyword").sortBy("keyword").option("path", path).format("parquet").saveAsTable(table))


def lookup(spark: SparkSession, table: str, keyword: str) -> DataFrame:
    """``keyword, path`` of one keyword; reads its bucket only."""
    return (spark.table(table).where(F.col("keyword") == F.lit(keyword)).select("keyword", F.explode("paths").alias("path")))
