"""Aggregations and reports over match facts.

Every report is a DataFrame job over the fact table (and the file table
where needed).  Reports whose natural form is one nested document with an
unbounded part (paths per keyword, the list of matched files) are kept as
flat distributed tables; only bounded parts (per group, per keyword, per
file type) are folded into maps.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GIB = 1024 ** 3


def _one_row(first: DataFrame, **scalars: DataFrame) -> DataFrame:
    """Extend a one-row aggregate with one-row, one-column aggregates as scalar subqueries."""
    return first.select("*", *[df.scalar().alias(name) for name, df in scalars.items()])


def files_per_group(facts: DataFrame, file_col: str = "display_path") -> DataFrame:
    """A1: distinct files per keyword group."""
    return facts.groupBy("keyword_group").agg(F.count_distinct(file_col).alias("files"))


def files_per_keyword(facts: DataFrame, file_col: str = "display_path") -> DataFrame:
    """A2: distinct files per (group, keyword)."""
    return facts.groupBy("keyword_group", "keyword").agg(F.count_distinct(file_col).alias("files"))


def keyword_totals(facts: DataFrame, file_col: str = "display_path") -> DataFrame:
    """A3 (true): hits per keyword, each file counted once even if the keyword is in several groups."""
    once = facts.groupBy(file_col, "keyword").agg(F.max("count").alias("count"))
    return once.groupBy("keyword").agg(F.sum("count").cast("bigint").alias("hits"))


def keyword_totals_by_group_row(facts: DataFrame) -> DataFrame:
    """A3 (reference form): SUM(count) over all fact rows, so n groups give n times the hits."""
    return facts.groupBy("keyword").agg(F.sum("count").cast("bigint").alias("hits"))


def filetype_counts(files: DataFrame, text_col: str = "text") -> DataFrame:
    """A4: files that yielded some text, per file type (matched or not)."""
    return (files.where(F.length(text_col) > 0)
            .groupBy("file_type").agg(F.count(F.lit(1)).alias("files")))


def multi_group_files(facts: DataFrame, file_col: str = "display_path") -> DataFrame:
    """Files that matched more than one group (the reference calls them 'multiple keywords')."""
    return (facts.groupBy(file_col).agg(F.count_distinct("keyword_group").alias("groups"))
            .where(F.col("groups") > 1))


def files_multi_group(facts: DataFrame, file_col: str = "display_path") -> DataFrame:
    """A5: one-row count of files matching more than one group."""
    return multi_group_files(facts, file_col).agg(F.count(F.lit(1)).alias("files_multi_group"))


def keyword_file_index(facts: DataFrame, path_col: str = "display_path") -> DataFrame:
    """Inverted index keyword -> path as a flat, de-duplicated table.

    Sort it with ``orderBy('keyword', path)`` when writing; it is never
    folded into one array per keyword (a common keyword hits most files).
    """
    return facts.select("keyword", F.col(path_col).alias("path")).distinct()


def matched_size_gb(facts: DataFrame, path_col: str = "display_path") -> DataFrame:
    """Total size of matched files (each once) in GiB, 4 decimals."""
    once = facts.groupBy(path_col).agg(F.max("size").alias("size"))
    return once.agg(F.round(F.coalesce(F.sum("size"), F.lit(0)) / F.lit(GIB), 4).alias("matched_size_gb"))


def group_matched_size(facts: DataFrame, path_col: str = "display_path") -> DataFrame:
    """Per group, matched files and their size (each file once per group)."""
    once = facts.groupBy("keyword_group", path_col).agg(F.max("size").alias("size"))
    return once.groupBy("keyword_group").agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"),
        F.round(F.coalesce(F.sum("size"), F.lit(0)) / F.lit(GIB), 4).alias("size_gb"))


def group_report(facts: DataFrame, path_col: str = "display_path") -> DataFrame:
    """A9 flattened: one row per (group, keyword, path) with the group's scalars.

    Paths are those of the keyword in any group, as in the reference.
    Written ``partitionBy('keyword_group')`` it gives one report per group.
    """
    per_group = group_matched_size(facts, path_col).select(
        "keyword_group", F.col("files").alias("group_files"), F.col("size_gb").alias("group_size_gb"))
    per_kw = files_per_keyword(facts, path_col).withColumnRenamed("files", "keyword_files")
    # a hot keyword's paths are spread over salts; the small side is repeated for each
    salts = 32
    index = keyword_file_index(facts, path_col).withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(salts)))
    small = per_kw.join(per_group, "keyword_group").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return (small.join(index, ["keyword", "_salt"])
            .select("keyword_group", "group_files", "group_size_gb", "keyword", "keyword_files", "path"))


#: Rows of ``statistics_rows``: what a row counts.
PER_GROUP, PER_GROUP_KEYWORD, PER_KEYWORD, PER_RUN, PER_TYPE = "group", "group_keyword", "keyword", "run", "file_type"


def statistics_rows(facts: DataFrame, files: DataFrame | None = None, path_col: str = "display_path", text_col: str = "text") -> DataFrame:
    """A1–A5, A7 and A8 (with ``files`` also A4) in one pass over the facts: one row per figure's key.

    ``GROUPING SETS`` over (path, group, keyword), each with its path, make every distinct pair once (one Expand, one shuffle);
    the counts over paths are then bounded by the dictionary and merge map-side.  Columns: ``what``
    (see the constants), ``keyword_group``, ``keyword``, ``file_type``, ``files``, ``hits`` (of a keyword: each file once; of a group's
    keyword: as stored), ``bytes`` (each file once), ``multi`` (files with more than one group, in the run's row).
    """
    path = F.col(path_col)
    once = (facts.select(path.alias("_path"), "keyword_group", "keyword", "count", "size", F.col("keyword_group").alias("_g"))
            .groupingSets([["_path", "keyword_group"], ["_path", "keyword_group", "keyword"], ["_path", "keyword"], ["_path"]],
                          "_path", "keyword_group", "keyword")
            .agg(F.grouping_id("_path", "keyword_group", "keyword").alias("_set"), F.max("count").alias("hits"), F.max("size").alias("bytes"),
                 (F.min("_g") != F.max("_g")).cast("long").alias("multi")))
    # grouping_id has a bit for each column that is left out
    what = F.element_at(F.create_map(*[F.lit(x) for p in ((1, PER_GROUP), (0, PER_GROUP_KEYWORD), (2, PER_KEYWORD), (3, PER_RUN)) for x in p]),
                        F.col("_set").cast("int"))
    one = F.lit(1).cast("long")
    rows = once.select(what.alias("what"), "keyword_group", "keyword", F.lit(None).cast("string").alias("file_type"), one.alias("files"),
                       F.when(F.col("_set").isin(0, 2), F.col("hits")).alias("hits"), F.col("bytes").cast("long").alias("bytes"), "multi")
    if files is not None:
        none = F.lit(None)
        rows = rows.unionByName(files.where(F.length(text_col) > 0).select(
            F.lit(PER_TYPE).alias("what"), none.cast("string").alias("keyword_group"), none.cast("string").alias("keyword"), "file_type",
            one.alias("files"), none.cast("long").alias("hits"), none.cast("long").alias("bytes"), none.cast("long").alias("multi")))
    return rows.groupBy("what", "keyword_group", "keyword", "file_type").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("files", "hits", "bytes", "multi")])


def global_statistics(files: DataFrame, facts: DataFrame, path_col: str = "display_path") -> DataFrame:
    """A10: the statistics document as one row of bounded maps and scalars, from one pass over the facts.

    ``FilesContainingKeyword`` is the flat index of :func:`keyword_file_index`
    and is written beside it, not inside it.
    """
    return statistics_document(statistics_rows(facts, files, path_col))


def statistics_document(rows: DataFrame) -> DataFrame:
    """A10 from the rows of ``statistics_rows``, or of ``merged.merged_rows``."""
    of = lambda what, *cols: F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct(*cols))))
    total = lambda c: F.coalesce(F.max(F.when(F.col("what") == PER_RUN, F.col(c))), F.lit(0)).cast("long")
    one = rows.agg(of(PER_GROUP, "keyword_group", "files").alias("g"), of(PER_GROUP_KEYWORD, "keyword_group", "keyword", "files").alias("k"),
                   of(PER_TYPE, "file_type", "files").alias("t"), total("multi").alias("multi"), total("bytes").alias("bytes"))
    within = lambda g: F.map_from_entries(F.transform(
        F.filter("k", lambda x: x["keyword_group"] == g), lambda x: F.struct(x["keyword"], x["files"])))
    groups = F.transform("g", lambda x: x["keyword_group"])
    return one.select(
        F.map_from_entries("g").alias("Keyword_Groups"), F.map_from_arrays(groups, F.transform(groups, within)).alias("Keywords"),
        F.map_from_entries("t").alias("FileTypes"), F.col("multi").alias("Files_With_Multiple_Keywords"),
        F.round(F.col("bytes") / F.lit(GIB), 4).alias("Global_Matched_Files_Size_GB"))


def run_totals(files: DataFrame) -> DataFrame:
    """Scanned, matched, failed files and bytes read (GiB to 4 decimals)."""
    b = F.coalesce(F.sum("bytes_read"), F.lit(0))
    return files.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.coalesce(F.sum(F.col("matched").cast("bigint")), F.lit(0)).alias("matched"),
        F.count_if(F.col("error") != "").alias("failed"),
        b.cast("bigint").alias("bytes_read"),
        F.round(b / F.lit(GIB), 4).alias("read_gb"))


def matched_files(files: DataFrame, facts: DataFrame, keys: Sequence[str] = ("source_path", "internal_path")) -> DataFrame:
    """Matched files with their sorted distinct groups and keywords.

    Per file the arrays are bounded by the dictionary.  Order by
    ``display_path`` only where written.
    """
    keys = list(keys)
    per = facts.groupBy(*keys).agg(
        F.array_sort(F.collect_set("keyword_group")).alias("groups"),
        F.array_sort(F.collect_set("keyword")).alias("keywords"))
    return (files.select(*keys, "display_path", "copied_to").join(per, keys, "inner")
            .select("display_path", "copied_to", "groups", "keywords"))


def run_summary(run_id: int, files: DataFrame, facts: DataFrame) -> DataFrame:
    """The bounded part of the summary document as one row.

    ``files`` totals, ``groups`` (files per group) and ``keywords`` (hits per
    keyword, reference form).  The matched-file list is :func:`matched_files`,
    written next to it as its own table.
    """
    totals = run_totals(files).select(F.struct("scanned", "matched", "failed", "bytes_read", "read_gb").alias("files"))
    rows = statistics_rows(facts)
    # the reference sums over all rows of a keyword, so one in several groups counts as often
    kws = (rows.where(F.col("what").isin(PER_GROUP, PER_GROUP_KEYWORD))
           .groupBy("what", F.when(F.col("what") == PER_GROUP, F.col("keyword_group")).otherwise(F.col("keyword")).alias("name"))
           .agg(F.sum("files").alias("files"), F.sum("hits").alias("hits")))
    parts = kws.agg(F.array_sort(F.collect_list(F.when(F.col("what") == PER_GROUP, F.struct("name", "files")))).alias("g"),
                     F.array_sort(F.collect_list(F.when(F.col("what") == PER_GROUP_KEYWORD, F.struct("name", "hits")))).alias("k"))
    both = parts.select(F.struct(F.map_from_entries("g").alias("groups"), F.map_from_entries("k").alias("keywords")).alias("s"))
    return (_one_row(totals, s=both)
            .select(F.lit(run_id).cast("bigint").alias("run_id"), "files", "s.groups", "s.keywords"))


def scan_metrics(files: DataFrame, facts: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """The progress counters as a result table (speed is left to the caller).

    ``archives`` are a scan's (``ScanResult.archives``): one row per archive opened, ``count`` the members found in it.
    """
    per_file = files.agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("error") == "").alias("scanned"),
        F.count_if(F.col("matched")).alias("matched"),
        F.count_if(F.col("error") != "").alias("failed"),
        F.coalesce(F.sum("bytes_read"), F.lit(0)).cast("bigint").alias("bytes_read"))
    hits = facts.groupBy("source_path", "internal_path", "keyword").agg(F.max("count").alias("c")) \
        .agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("matches"))
    extra = {"matches": hits}
    if archives is not None:
        extra["archives"] = archives.agg(F.count(F.lit(1)))
        extra["archive_members"] = archives.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint"))
    return _one_row(per_file, **extra)


def run_filter(table: DataFrame, run_id: int) -> DataFrame:
    """Rows of one run; on a table written ``partitionBy('run_id')`` this prunes partitions."""
    return table.where(F.col("run_id") == F.lit(run_id))
