"""Corpus views over the tables of a data folder (``{sf_dir}/{table}.parquet``).

Each view has the evidence columns of a scanned file — ``source_path``,
``internal_path``, ``display_path``, ``file_type``, ``size``, ``mtime`` —
plus the text of its unit.  The same definitions exist as SQL in
``quarry.oracle`` so DuckDB can check every report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import strip_html

# Extension given to documents by doc_id % 5.
DOC_EXTENSIONS = [".txt", ".csv", ".MD", "", ".bin"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _minutes_after_epoch(n: Column) -> Column:
    # an absolute instant (UTC), whatever the session time zone
    start = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    return F.timestamp_add("MINUTE", n, start)


def ntz_micros(col: Column) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ value, independent of the session time zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, col)


def doc_extension(doc_id: Column) -> Column:
    m = F.pmod(doc_id, F.lit(5))
    out = F.when(m == 0, DOC_EXTENSIONS[0])
    for i, ext in enumerate(DOC_EXTENSIONS[1:], start=1):
        out = out.when(m == i, ext)
    return out


def docs(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """``documents`` as files ``source/lang/doc_id<ext>``, one unit each."""
    d = table(spark, sf_dir, "documents")
    ext = doc_extension(F.col("doc_id"))
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ext))
    cols = [
        F.col("doc_id"),
        path.alias("source_path"),
        F.lit("").alias("internal_path"),
        path.alias("display_path"),
        F.lower(ext).alias("file_type"),
        F.octet_length("text").cast("bigint").alias("size"),
        _minutes_after_epoch(F.col("doc_id")).alias("mtime"),
    ]
    if with_text:
        cols.append(F.col("text"))
    return d.select(*cols)


def pages(spark: SparkSession, sf_dir: str, strip: bool = False) -> DataFrame:
    """``pages`` as files ``pages/<page_id>.html``; text raw or tag-stripped."""
    p = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    text = strip_html(F.col("html")) if strip else F.col("html")
    return p.select(
        F.col("page_id"),
        path.alias("source_path"),
        F.lit("").alias("internal_path"),
        path.alias("display_path"),
        F.lit(".html").alias("file_type"),
        F.octet_length("html").cast("bigint").alias("size"),
        _minutes_after_epoch(F.col("page_id")).alias("mtime"),
        text.alias("text"),
    )


def convs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as containers ``conversations/<conv_id>``; each turn a member and a unit."""
    c = table(spark, sf_dir, "conversations")
    src = F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"))
    internal = F.concat(F.lit("turn_"), F.col("turn").cast("string"))
    return c.select(
        F.col("conv_id"),
        src.alias("source_path"),
        internal.alias("internal_path"),
        F.concat_ws("::", src, internal).alias("display_path"),
        F.lit("").alias("file_type"),
        F.octet_length("text").cast("bigint").alias("size"),
        _minutes_after_epoch(F.col("conv_id")).alias("mtime"),
        F.col("turn").cast("int").alias("unit_idx"),
        F.col("role").alias("unit_kind"),
        F.col("text"),
    )


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events.props`` (JSON strings) scanned as plain text, one file per event."""
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".json"))
    return e.select(
        F.col("event_id"),
        path.alias("source_path"),
        F.lit("").alias("internal_path"),
        path.alias("display_path"),
        F.lit(".json").alias("file_type"),
        F.octet_length("props").cast("bigint").alias("size"),
        F.col("ts").alias("mtime"),
        F.col("props").alias("text"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two listings from ``events``: path = user, mtime = last event, size = events.

    ``old`` covers the first half of the time span.  ``new`` covers all events;
    there every seventh user's file was restored with its first event's time (an older mtime), every fifth of
    these with the old size too, and every eleventh user's file is gone.
    """
    # ts is TIMESTAMP_NTZ; compared as microseconds since 1970 (no time zone involved)
    e = table(spark, sf_dir, "events").select("user_id", "ts", ntz_micros(F.col("ts")).alias("ts_us"))
    # scalar subquery: one value, no join
    middle = e.agg(F.expr("(min(ts_us) + max(ts_us)) div 2")).scalar()

    def listing(df: DataFrame, mtime, size) -> DataFrame:
        return (df.groupBy("user_id").agg(mtime.alias("mtime"), size.alias("size"))
                .select("user_id", F.concat(F.lit("users/"), F.col("user_id").cast("string"), F.lit(".log")).alias("path"),
                        "mtime", F.col("size").cast("bigint").alias("size")))

    u = F.any_value("user_id")
    old = listing(e.where(F.col("ts_us") < middle), F.max("ts"), F.count(F.lit(1)))
    new = listing(e.withColumn("first_half", F.col("ts_us") < middle),
                  F.when(u % 7 == 0, F.min("ts")).otherwise(F.max("ts")),
                  F.when(u % 35 == 0, F.count_if("first_half")).otherwise(F.count(F.lit(1)))).where("user_id % 11 <> 0")
    return old.drop("user_id"), new.drop("user_id")
