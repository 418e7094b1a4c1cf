"""Sinks and output plans (K1–K8).

Result tables are Parquet partitioned by ``run_id``; manifests are JSON
lines and CSV written by Spark (one atomic job commit each); copy plans
are DataFrames of (source, destination) — the copy itself is left to a
file-system tool.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import base_name, file_suffix, sanitize_path
from quarry.operators.facts import file_match_maps
from quarry.operators.reports import matched_files, run_summary

FILE_KEYS = ["source_path", "internal_path"]


# ---------------------------------------------------------------- manifests
def manifest_records(facts: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """K1: one nested record per matched file (groups and keyword counts as maps).

    Built from the facts alone (they carry the file columns): one
    aggregation, no join with the file table.  ``copies`` (display_path,
    copied_to) fills ``copied_to`` when evidence was copied.
    """
    maps = file_match_maps(facts, ["display_path", "source_path", "internal_path", "file_type", "size"])
    if copies is None:
        rec = maps.withColumn("copied_to", F.lit(""))
    else:
        rec = maps.join(copies, "display_path", "left").withColumn("copied_to", F.coalesce("copied_to", F.lit("")))
    return rec.select("display_path", "source_path", "internal_path", "file_type", "size",
                      "groups", "keyword_counts", "copied_to")


def manifest_csv_rows(facts: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """K2: the flat manifest — sorted groups and keywords joined with ';'."""
    rec = manifest_records(facts, copies)
    return rec.select(
        "display_path", "source_path", "internal_path", "file_type", "size",
        F.array_join(F.array_sort(F.map_keys("groups")), ";").alias("groups"),
        F.array_join(F.array_sort(F.map_keys("keyword_counts")), ";").alias("keywords"),
        "copied_to")


def write_manifests(facts: DataFrame, out_dir: str, copies: DataFrame | None = None) -> None:
    manifest_records(facts, copies).write.mode("overwrite").json(f"{out_dir}/manifest.jsonl")
    (manifest_csv_rows(facts, copies).write.mode("overwrite").option("header", True)
     .csv(f"{out_dir}/manifest.csv"))


# ---------------------------------------------------------------- tables
def file_keys(files: DataFrame) -> DataFrame:
    """K4: deterministic surrogate key per (run, source, member) — stable across retries."""
    return files.withColumn("file_key", F.sha2(F.concat_ws(
        "\u0000", F.col("run_id").cast("string"), "source_path", "internal_path"), 256))


def latest_per_key(rows: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """K3: replace-on-key — the row with the highest ``seq`` per key.

    An aggregate (``max_by`` over a struct) rather than a window, so each
    key is combined map-side and a key with many versions never needs one
    task to hold them all.
    """
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def write_run(files: DataFrame, facts: DataFrame, out_dir: str) -> None:
    """Append/replace one run in the ``files`` and ``matches`` tables.

    Dynamic partition overwrite replaces only the partitions of this run.
    Facts are sorted by keyword within their partitions (no shuffle, so a
    hot keyword is not funnelled into one task); each file's Parquet
    min/max statistics on ``keyword`` still let keyword filters skip data.
    """
    spark = files.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    file_keys(files).write.mode("overwrite").partitionBy("run_id").parquet(f"{out_dir}/files")
    (file_keys(facts).sortWithinPartitions("run_id", "keyword")
     .write.mode("overwrite").partitionBy("run_id").parquet(f"{out_dir}/matches"))


def write_summary(run_id: int, files: DataFrame, facts: DataFrame, out_dir: str) -> None:
    """K6: the bounded summary row as JSON, and the matched-file list beside it."""
    run_summary(run_id, files, facts).coalesce(1).write.mode("overwrite").json(f"{out_dir}/summary.json")
    (matched_files(files, facts).orderBy("display_path")
     .write.mode("overwrite").json(f"{out_dir}/summary_matched_files.jsonl"))


# ---------------------------------------------------------------- copy plans
def _salt(col, buckets: int):
    """A well-spread bucket from md5 (the same value in any SQL engine)."""
    return F.pmod(F.conv(F.substring(F.md5(col), 1, 6), 16, 10).cast("long"), F.lit(buckets))


def group_copy_plan(facts: DataFrame, path_col: str = "display_path", name_col: str | None = None,
                    buckets: int | None = None) -> DataFrame:
    """K7: destination ``group/name`` per (group, file), colliding names get ``_1``, ``_2``...

    Ranking inside (group, name) is split by a salt bucket so that one hot
    name (say a third of all files) spreads over ``buckets`` tasks; the
    bucket offsets come from a small per-bucket count table; ``buckets``
    defaults to the shuffle width.  Suffixes are
    unique and deterministic: order is (bucket, path).  They start past the largest
    number that a real name ``stem_<number>.ext`` of the group has, so no
    copy takes a name that a file has, nor one that another copy gets.
    """
    if buckets is None:  # as wide as the shuffle: a hot name is split as finely as the data
        buckets = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.col(name_col) if name_col else base_name(F.col(path_col))
    rows = facts.select("keyword_group", F.col(path_col).alias("path"), name.alias("name")).distinct()
    rows = rows.withColumn("_b", _salt(F.col("path"), buckets))
    w = Window.partitionBy("keyword_group", "name", "_b").orderBy("path")
    ranked = rows.withColumn("_r", F.row_number().over(w) - 1)
    ext = F.regexp_extract("name", r"(?<=[^/])(\.[^./]+)$", 1)
    stem = F.expr("substring(name, 1, length(name) - length(ext))")
    counts = (rows.groupBy("keyword_group", "name", "_b").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("ext", ext).withColumn("stem", stem))
    taken = (counts.select("keyword_group", "ext", F.regexp_extract("stem", r"(?s)^(.*)_\d{1,37}$", 1).alias("stem"),
                           F.regexp_extract("stem", r"_(\d{1,37})$", 1).alias("number"))
             .where("number <> ''").groupBy("keyword_group", "stem", "ext").agg(F.max(F.col("number").cast("decimal(38,0)")).alias("_top")))
    wo = Window.partitionBy("keyword_group", "name").orderBy("_b")
    offsets = (counts.withColumn("_off", F.coalesce(F.sum("_n").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .join(taken, ["keyword_group", "stem", "ext"], "left")
               .select("keyword_group", "name", "_b", "stem", "ext", "_off", F.coalesce("_top", F.lit(0)).alias("_top")))
    idx = ranked.join(offsets, ["keyword_group", "name", "_b"]).withColumn("k", F.col("_off") + F.col("_r"))
    dest = F.when(F.col("k") == 0, F.col("name")).otherwise(
        F.concat("stem", F.lit("_"), (F.col("_top") + F.col("k")).cast("string"), "ext"))
    return idx.select("keyword_group", "path", F.concat_ws("/", "keyword_group", dest).alias("dest"))


def evidence_plan(files: DataFrame, root: str = "evidence") -> DataFrame:
    """K8: evidence destination per matched file.

    Plain files keep their sanitised relative path; a container member goes
    to ``<sanitised container path>/container_<sha256(display)[:12]><member suffix>``.
    """
    src = sanitize_path(F.col("source_path"))
    member = F.concat(src, F.lit("/container_"), F.substring(F.sha2(F.col("display_path"), 256), 1, 12),
                      file_suffix(F.col("internal_path")))
    dest = F.when(F.col("internal_path") == "", src).otherwise(member)
    return files.select("display_path", F.concat_ws("/", F.lit(root), dest).alias("dest"))
