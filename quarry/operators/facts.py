"""Per-file results built from match facts.

Facts are ``(file keys..., keyword_group, keyword, count)``: one row per
file, group and keyword with a hit.  Files are ``(file keys..., metadata)``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE_KEYS = ["source_path", "internal_path"]


def file_match_maps(facts: DataFrame, keys: Sequence[str] = FILE_KEYS) -> DataFrame:
    """M6: per file ``groups`` map<group, sorted keywords> and ``keyword_counts`` map<keyword, count>.

    One aggregation; a file's group holds at most one row per dictionary
    entry, so it is bounded by the dictionary size.
    """
    keys = list(keys)
    per = facts.groupBy(*keys).agg(
        F.collect_list(F.struct("keyword_group", "keyword", "count")).alias("_f"))
    groups = F.array_sort(F.array_distinct(F.transform("_f", lambda x: x["keyword_group"])))
    return per.select(
        *keys,
        F.map_from_arrays(
            groups,
            F.transform(groups, lambda g: F.array_sort(
                F.transform(F.filter("_f", lambda x: x["keyword_group"] == g), lambda x: x["keyword"])))
        ).alias("groups"),
        F.map_from_entries(F.array_sort(F.array_distinct(
            F.transform("_f", lambda x: F.struct(x["keyword"].alias("k"), x["count"].alias("v"))))))
        .alias("keyword_counts"),
        F.aggregate(F.transform(F.array_distinct(F.transform("_f", lambda x: F.struct(x["keyword"], x["count"]))),
                                lambda s: s["count"].cast("bigint")),
                    F.lit(0).cast("bigint"), lambda a, b: a + b).alias("hits"),
    )


def maps_as_text(maps: DataFrame) -> DataFrame:
    """Map columns of :func:`file_match_maps` as sorted ``;``-joined strings."""
    g = F.map_entries("groups")
    k = F.map_entries("keyword_counts")
    return maps.select(
        *[c for c in maps.columns if c not in ("groups", "keyword_counts")],
        F.array_join(F.transform(g, lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ","))), ";")
        .alias("groups"),
        F.array_join(F.transform(k, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
        .alias("keyword_counts"),
    )


def files_with_flag(files: DataFrame, facts: DataFrame, keys: Sequence[str] = FILE_KEYS) -> DataFrame:
    """M7: every file with ``hits`` and ``matched``; unmatched files are kept.

    Union and one aggregation instead of a join: the file rows and the fact
    rows meet in the same hash partition of their key, with partial sums.
    """
    keys = list(keys)
    meta = [c for c in files.columns if c not in keys and c != "text"]
    per_file = facts.groupBy(*keys).agg(F.sum("count").alias("_h"))
    left = files.select(*keys, *meta, F.lit(0).cast("bigint").alias("_h"), F.lit(True).alias("_file"))
    right = per_file.select(*keys, *[F.lit(None).cast(files.schema[c].dataType).alias(c) for c in meta],
                            F.col("_h").cast("bigint").alias("_h"), F.lit(False).alias("_file"))
    both = left.unionByName(right)
    agg = both.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in meta],
        F.sum("_h").cast("bigint").alias("hits"),
        F.max(F.col("_file").cast("int")).alias("_file"))
    return agg.where(F.col("_file") == 1).drop("_file").withColumn("matched", F.col("hits") > 0)


def files_unmatched(files: DataFrame, facts: DataFrame, keys: Sequence[str] = FILE_KEYS) -> DataFrame:
    """M7: files with no fact row (left anti join on the file key)."""
    keys = list(keys)
    return files.drop("text").join(facts.select(*keys).distinct(), keys, "left_anti")


def bytes_read(units: DataFrame, keys: Sequence[str] = FILE_KEYS, text_col: str = "text") -> DataFrame:
    """M8: UTF-8 bytes of text per file (sum over its units)."""
    return units.groupBy(*keys).agg(
        F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("bigint").alias("bytes_read"))


def container_rollup(facts: DataFrame, container: str = "source_path",
                     member: str = "internal_path") -> DataFrame:
    """M9: member facts plus one roll-up row per (container, group, keyword).

    Roll-up rows have ``member = ''``, ``is_rollup = true``, the summed hit
    count and the number of members with a hit.
    """
    members = facts.select(container, member, "keyword_group", "keyword", "count",
                           F.lit(1).cast("bigint").alias("members_hit"),
                           F.lit(False).alias("is_rollup"))
    rolled = (facts.groupBy(container, "keyword_group", "keyword")
              .agg(F.sum("count").cast("bigint").alias("count"),
                   F.count_distinct(member).cast("bigint").alias("members_hit"))
              .select(container, F.lit("").alias(member), "keyword_group", "keyword", "count",
                      "members_hit", F.lit(True).alias("is_rollup")))
    return members.unionByName(rolled)


def ancestor_rollup(facts: DataFrame, containers: DataFrame, container: str = "source_path", member: str = "internal_path") -> DataFrame:
    """M9 for nested containers: one row per (container at any depth, group, keyword) of what lies below it.

    ``containers`` names the containers as facts name files: the outermost by (``container``, ''), one inside it by its own path
    ``b.zip/c.zip``.  A hit of ``a.zip::b.zip/c`` counts for ``a.zip`` and for ``a.zip::b.zip``.  Every fact is summed under all
    its path prefixes first (map-side); only then the prefixes that are containers are kept, so a hot container is no hot task.
    ``count`` sums the hits, ``members_hit`` counts the files with one.
    """
    parts = F.split(member, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    per = (facts.where(F.col(member) != "").select(container, F.explode(above).alias("_above"), "keyword_group", "keyword", "count")
           .groupBy(container, "_above", "keyword_group", "keyword")
           .agg(F.sum("count").cast("bigint").alias("count"), F.count(F.lit(1)).alias("members_hit")))
    known = containers.select(container, F.col(member).alias("_above")).distinct()
    return (per.join(known, [container, "_above"], "left_semi")
            .select(container, F.col("_above").alias(member), "keyword_group", "keyword", "count", "members_hit"))


def scan_errors(files: DataFrame) -> DataFrame:
    """Rows whose extraction failed (the job itself went on)."""
    return files.where(F.col("error") != "")
