"""End-to-end scan jobs: text units -> (files, matches) tables.

``dictionary_scan`` is the second program's run (case-folded overlapping
counts, files + matches + manifests + summary); ``boundary_scan`` the first
program's (lower-cased whole words, statistics).  Both take any DataFrame
of text units with evidence columns — a corpus view, a binary-file
listing decoded by ``sources.files``, or exploded container members.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.facts import files_with_flag
from quarry.operators.match import match_units, roll_up
from quarry.sources.dictionary import KeywordDictionary

FILE_KEYS = ["source_path", "internal_path"]
META = ["source_path", "internal_path", "display_path", "file_type", "size"]

FILES_COLUMNS = ["run_id", "source_path", "internal_path", "display_path", "file_type", "size",
                 "mtime", "bytes_read", "matched", "copied_to", "error"]
MATCH_COLUMNS = ["run_id", "source_path", "internal_path", "display_path", "file_type", "size",
                 "keyword_group", "keyword", "count"]


@dataclass
class ScanResult:
    files: DataFrame
    facts: DataFrame
    cached: list = field(default_factory=list)
    archives: DataFrame | None = None      # archives opened, ``count`` the members found in each

    def release(self) -> None:
        """Frees what the scan persisted, once its tables are written."""
        for df in self.cached:
            df.unpersist()


def _ensure(df: DataFrame, name: str, value) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, value)


def scan(units: DataFrame, dictionary: KeywordDictionary, *, mode: str = "dictionary",
         run_id: int = 1, case_sensitive: bool = False, method: str = "automaton") -> ScanResult:
    """Match ``units`` and build the ``files`` and ``matches`` tables of one run.

    ``units`` has the evidence columns (``META`` plus ``mtime``), ``text``,
    and, when a file has several units, ``unit_idx``; ``error`` is optional.
    A file's facts are the sum of its units' (unit scope).
    """
    units = _ensure(units, "error", F.lit(""))
    units = _ensure(units, "mtime", F.lit(None).cast("timestamp"))
    multi = ["unit_idx"] if "unit_idx" in units.columns else []
    if method != "automaton":
        return _scan_native(units, dictionary, mode, run_id, case_sensitive, method, multi)
    # facts and files come out of one read of the texts; times travel as strings, which Python keeps as they are
    kind = units.schema["mtime"].dataType
    slim = units.select(*META, F.col("mtime").cast("string").alias("mtime"), "error", *multi, F.when(F.col("error") == "", F.col("text")).alias("text"))
    rows = match_units(slim, dictionary, keys=[*META, "mtime", "error", *multi], mode=mode, case_sensitive=case_sensitive, totals=True)
    # facts feed both the file flags and every report: compute the match once
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    facts, ends = rows.where("keyword is not null"), rows.where("keyword is null")
    facts = roll_up(facts, META, mode) if multi else facts
    mtime = F.col("mtime").cast(kind)
    ends = ends.groupBy(*META).agg(F.max(mtime).alias("mtime"), F.sum("bytes_read").alias("bytes_read"), F.sum("count").alias("count"),
                                   F.max("error").alias("error"))
    files = ends.select(F.lit(run_id).cast("bigint").alias("run_id"), *META, "mtime", F.col("bytes_read").cast("bigint").alias("bytes_read"),
                        (F.col("count") > 0).alias("matched"), F.lit("").alias("copied_to"), "error")
    facts = facts.select(F.lit(run_id).cast("bigint").alias("run_id"), *META, "keyword_group", "keyword", "count")
    return ScanResult(files, facts, [rows])


def _scan_native(units: DataFrame, dictionary: KeywordDictionary, mode: str, run_id: int, case_sensitive: bool, method: str, multi: list) -> ScanResult:
    """The scan by the native match, which has facts only: files are met with them afterwards."""
    ok = units.where(F.col("error") == "")
    facts = match_units(ok, dictionary, keys=META + multi, mode=mode, case_sensitive=case_sensitive, method=method)
    if multi:
        facts = roll_up(facts, META, mode)
        files = (units.groupBy(*META)
                 .agg(F.max("mtime").alias("mtime"),
                      F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("bytes_read"),
                      F.max("error").alias("error")))
    else:
        files = units.select(*META, "mtime",
                             F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes_read"),
                             "error")
    facts = facts.persist(StorageLevel.MEMORY_AND_DISK)
    flagged = files_with_flag(files, facts, FILE_KEYS)
    files_out = flagged.select(
        F.lit(run_id).cast("bigint").alias("run_id"), *META, "mtime", "bytes_read",
        F.col("matched"), F.lit("").alias("copied_to"), "error")
    facts_out = facts.select(F.lit(run_id).cast("bigint").alias("run_id"), *META,
                             "keyword_group", "keyword", "count")
    return ScanResult(files_out, facts_out, [facts])


def dictionary_scan(units: DataFrame, dictionary: KeywordDictionary, **kw) -> ScanResult:
    return scan(units, dictionary, mode="dictionary", **kw)


def boundary_scan(units: DataFrame, dictionary: KeywordDictionary, **kw) -> ScanResult:
    return scan(units, dictionary, mode="boundary", **kw)


def _is_text(flavor: str):
    """Whether a listed file is read as plain text: by its extension, or unknown and to be sniffed (second program)."""
    from quarry.functions.text import file_suffix
    from quarry.sources.containers import V1_TEXT_EXTENSIONS
    from quarry.sources.files import format_class
    kind = file_suffix(F.col("source_path"))
    return kind.isin(list(V1_TEXT_EXTENSIONS)) if flavor == "v1" else format_class(kind, F.col("source_path")).isin("text", "sniff")


def _range_job(spec, mode: str, case_sensitive: bool, context: int):
    """Hits of every piece of a range, counted where they start; one ``file`` row a range with what it read."""
    from quarry.operators.match import hit_counter
    from quarry.sources.containers import _textual_head
    from quarry.sources.ranges import file_head, pieces
    boundary = mode == "boundary"
    count = hit_counter(spec, mode, case_sensitive, newline_fix=boundary)

    def run(batches):
        import pandas as pd
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                read, error, totals = 0, "", {}
                try:
                    textual = not row.sniffed or _textual_head(file_head(row.path))
                except Exception as e:
                    textual, error = False, f"{type(e).__name__}: {e}"
                for _, _, _, pre, text, post, bad in pieces(row.path, row.size, row.offset, row.length, context) if textual else ():
                    if bad:
                        error = bad
                        continue
                    read += len(text.encode("utf-8", "ignore"))
                    for w, c in count(text, pre, post).items():
                        totals[w] = max(totals.get(w, 0), c) if boundary else totals.get(w, 0) + c
                own = (row.source_path, row.mtime_us, row.size)
                found = [(*own, "fact", None, None, g, kw, c) for w, c in totals.items() for g, kw in spec[2][w]]
                yield pd.DataFrame([(*own, "file", read, error, None, None, None), *found], columns=[c.split(" ")[0] for c in _RANGE_ROWS.split(", ")])
    return run


_RANGE_ROWS = ("source_path string, mtime_us long, size long, row_kind string, bytes_read long, error string, "
               "keyword_group string, keyword string, count long")


def scan_ranges(files: DataFrame, spec, mode: str, case_sensitive: bool, range_bytes: int, reliable: bool, cached: list) -> DataFrame:
    """``file`` and ``fact`` rows, as of a scan round, of large text files: their byte ranges are matched by many tasks, then added up."""
    from quarry.functions.text import file_suffix
    from quarry.session import cut_lineage
    from quarry.sources.files import format_class
    from quarry.sources.ranges import text_ranges
    kind = format_class(file_suffix(F.col("source_path")), F.col("source_path"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mt = F.unix_micros("mtime") if "mtime" in files.columns else F.lit(None).cast("long")
    ranges = text_ranges(files.select("source_path", "path", "size", mt.alias("mtime_us"), (kind == "sniff").alias("sniffed")), range_bytes)
    context = max(len(w) for w in spec[1]) + 1
    found = ranges.repartition(n, "path", "offset").mapInPandas(_range_job(spec, mode, case_sensitive, context), _RANGE_ROWS)
    found = cut_lineage(found) if reliable else found.persist(StorageLevel.MEMORY_AND_DISK)
    if not reliable:
        cached.append(found)
    own = ["source_path", "mtime_us", "size"]
    facts = (found.where("row_kind = 'fact'").groupBy(*own, "row_kind", "keyword_group", "keyword")
             .agg((F.max("count") if mode == "boundary" else F.sum("count")).alias("count")))
    facts = facts.select(*own, "row_kind", F.lit(None).cast("long").alias("bytes_read"), F.lit(None).cast("string").alias("error"),
                         "keyword_group", "keyword", "count")
    # of a file row only whether there are hits is used
    hits = facts.groupBy("source_path").agg(F.sum("count").alias("count"))
    ends = (found.where("row_kind = 'file'").groupBy(*own, "row_kind")
            .agg(F.sum("bytes_read").alias("bytes_read"), F.max("error").alias("error")).join(hits, "source_path", "left")
            .select(*own, "row_kind", "bytes_read", "error", F.lit(None).cast("string").alias("keyword_group"),
                    F.lit(None).cast("string").alias("keyword"), F.coalesce("count", F.lit(0)).alias("count")))
    return ends.unionByName(facts).withColumns({"internal_path": F.lit(""), "depth": F.lit(0)})


def scan_tree(files: DataFrame, dictionary: KeywordDictionary, *, mode: str = "dictionary",
              run_id: int = 1, case_sensitive: bool = False, max_depth: int = 3,
              flavor: str = "v2", reliable: bool = False, split_zip_bytes: int | None = None,
              split_text_bytes: int | None = None) -> ScanResult:
    """A scan of files that may be containers (S13/S8/S11/S12 + M1/M2 fused).

    ``files`` is ``(source_path, content[, mtime])``, any table of blobs, or
    ``(source_path, path, size, mtime)``, a listing whose files the tasks open.  Each round opens, decodes and matches in one
    Python pass per file, so contents are read once and text is never
    materialised; rounds follow nested members up to ``max_depth``.  Every
    file and member gets a ``files`` row (``error`` when unreadable); facts
    are per file or member, unit scope.

    ``flavor='v1'`` extracts like the first program instead: one whole text
    per file (XML nested walk, e-mail bodies, Word/ODF paragraphs, text
    with universal newlines) and no containers.

    Listed text files larger than ``split_text_bytes`` are scanned as byte ranges of that size, many tasks a file.
    """
    from quarry.functions.text import file_suffix
    from quarry.operators.match import plan_spec
    from quarry.sources.containers import DEFAULT_SPLIT_ZIP_BYTES, scan_rounds
    from quarry.sources.ranges import RANGE_BYTES
    spec = plan_spec(dictionary, mode, case_sensitive)
    large = None
    if "path" in files.columns and "content" not in files.columns:
        by_range = _is_text(flavor) & (F.col("size") > (split_text_bytes or RANGE_BYTES))
        large = files.where(by_range)
        files = files.where(~F.coalesce(by_range, F.lit(False)))
    rows = scan_rounds(files, spec, mode=mode, case_sensitive=case_sensitive, max_depth=max_depth,
                       flavor=flavor, cached=(cached := []), reliable=reliable, split_zip_bytes=split_zip_bytes or DEFAULT_SPLIT_ZIP_BYTES)
    if large is not None:
        in_ranges = scan_ranges(large, spec, mode, case_sensitive, split_text_bytes or RANGE_BYTES, reliable, cached)
        rows = rows.select(*in_ranges.columns).unionByName(in_ranges)
    name = F.when(F.col("internal_path") == "", F.col("source_path")).otherwise(F.col("internal_path"))
    disp = F.when(F.col("internal_path") == "", F.col("source_path")).otherwise(
        F.concat_ws("::", "source_path", "internal_path"))
    rows = rows.withColumn("display_path", disp).withColumn("file_type", file_suffix(name))
    # every column comes out of the scan job itself: no join of facts with files
    facts = (rows.where(F.col("row_kind") == "fact")
             .select(F.lit(run_id).cast("bigint").alias("run_id"), *META, "keyword_group", "keyword", "count"))
    files_out = rows.where(F.col("row_kind") == "file").select(
        F.lit(run_id).cast("bigint").alias("run_id"), *META, F.timestamp_micros("mtime_us").alias("mtime"),
        F.coalesce("bytes_read", F.lit(0)).cast("bigint").alias("bytes_read"),
        (F.coalesce("count", F.lit(0)) > 0).alias("matched"), F.lit("").alias("copied_to"), "error")
    # an archive that several tasks opened by ranges is one archive
    archives = (rows.where(F.col("row_kind") == "archive").groupBy("source_path", "internal_path").agg(F.sum("count").alias("count")))
    return ScanResult(files_out, facts, cached, archives)
