"""File sources: listing, exclusion, type routing, sniffing, decoding.

A folder is listed level by level: every round lists the directories that the
round before found, spread over the tasks.  All names count, also those with a leading
dot or underscore.  Contents are read later, inside the tasks that scan
them, by the path listed here; no job joins contents to a listing.
"""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import (casefold_col, file_suffix, looks_textual,
                                   utf8_text)
from quarry.session import cut_lineage

# Extensions the first program reads (no extension is accepted too).
V1_EXTENSIONS = [
    ".txt", ".csv", ".json", ".sql", ".conf", ".cfg",
    ".docx", ".docm", ".dotx", ".dotm",
    ".xlsx", ".xls", ".xlsm", ".xltx", ".xltm",
    ".pptx", ".pptm", ".potx", ".potm",
    ".odt", ".ods", ".odp",
    ".pdf", ".xml", ".ini", ".toml",
    ".eml", ".msg",
]

# The second program's format classes by extension.
TEXT_EXTENSIONS = [
    "", ".txt", ".csv", ".tsv", ".json", ".jsonl", ".sql", ".xml", ".html", ".htm",
    ".log", ".conf", ".cfg", ".ini", ".toml", ".yaml", ".yml", ".md", ".rst",
    ".py", ".js", ".ts", ".java", ".go", ".rs", ".c", ".cpp", ".h", ".hpp",
    ".cs", ".php", ".rb", ".pl", ".sh", ".bash", ".ps1", ".bat", ".cmd",
]
OOXML_EXTENSIONS = [".docx", ".docm", ".dotx", ".dotm", ".pptx", ".pptm", ".potx", ".potm",
                    ".xlsx", ".xlsm", ".xltx", ".xltm"]
ARCHIVE_EXTENSIONS = [".zip", ".7z", ".tar", ".tgz", ".tbz", ".tbz2", ".txz", ".gz", ".bz2", ".xz"]
ARCHIVE_NAME_ENDINGS = [".tar.gz", ".tar.bz2", ".tar.xz"]
ODF_EXTENSIONS = [".odt", ".ods", ".odp"]

LISTING = ("path string, rel_path string, is_dir boolean, size long, mtime_us long, error string")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a full URI without a trailing slash, whatever way it was spelled."""
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    full = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hp).toString().rstrip("/")
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def file_system(uri: str):
    """The file system of a full (unescaped) URI and the path in it."""
    from urllib.parse import quote

    from pyarrow import fs
    return fs.FileSystem.from_uri(quote(uri, safe=":/@"))


def children(system, at: str):
    """``name, is folder, size, mtime in us, error`` of what a folder holds.

    Links to folders are left out and so never entered, as a walk that does not follow links would do; a link to nothing, or what is
    no regular file, has an error.
    """
    from pyarrow import fs
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(at)):
            folder = info.type == fs.FileType.Directory
            yield info.base_name, folder, None if folder else info.size, None if info.mtime_ns is None else info.mtime_ns // 1000, ""
        return
    import os
    import stat
    with os.scandir(at) as entries:
        for e in entries:
            if e.is_dir():
                if not e.is_symlink():
                    yield e.name, True, None, None, ""
                continue
            try:
                s = e.stat()
            except OSError as x:
                yield e.name, False, None, None, f"{type(x).__name__}: {x.strerror}"
                continue
            regular = stat.S_ISREG(s.st_mode)
            yield e.name, False, s.st_size if regular else None, s.st_mtime_ns // 1000, "" if regular else "not a regular file"


def _list_job(root: str, exclude: str | None):
    """Lists the directories of a partition, one level; a directory that can't be listed is an error row."""
    def run(batches):
        import pandas as pd
        names = [c.split(" ")[0] for c in LISTING.split(", ")]
        system, base = file_system(root)
        base = base.rstrip("/")
        for pdf in batches:
            rows = []
            for rel in pdf["rel_path"]:
                try:
                    for name, folder, size, mtime, error in children(system, f"{base}/{rel}".rstrip("/") or "/"):
                        own = f"{rel}/{name}" if rel else name
                        if own != exclude:
                            rows.append((f"{root}/{own}", own, folder, size, mtime, error))
                except Exception as e:
                    rows.append((f"{root}/{rel}", rel, False, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names)
    return run


def list_files(spark: SparkSession, root: str, *, exclude: str | None = None,
               glob: str | None = None) -> DataFrame:
    """Recursive listing ``(path, rel_path, file_type, size, mtime, error)`` — no content read.

    ``exclude`` is a sub-folder (the output folder) that is not entered.
    ``rel_path`` is relative to ``root``, whichever way that is spelled.
    """
    root = qualified(spark, root)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    job = _list_job(root, exclude.strip("/") if exclude else None)
    folders, found = spark.createDataFrame([("",)], "rel_path string"), []
    while True:
        level = cut_lineage(folders.repartition(parts, "rel_path").mapInPandas(job, LISTING))
        found.append(level.where(~F.col("is_dir")))
        folders = level.where("is_dir").select("rel_path")
        if not folders.limit(1).count():
            break
    files = reduce(DataFrame.unionByName, found)
    if glob:
        files = files.where(F.element_at(F.split("rel_path", "/"), -1).rlike(fnmatch.translate(glob).replace("\\Z", "$").replace("\\z", "$")))
    return files.select("path", "rel_path", file_suffix(F.col("rel_path")).alias("file_type"), "size",
                        F.timestamp_micros("mtime_us").alias("mtime"), "error")


def read_contents(listing: DataFrame) -> DataFrame:
    """``listing`` plus ``content`` and ``error``: each file read whole inside its task; one that is gone keeps its error."""
    columns = [c for c in listing.columns if c not in ("content", "error")]
    fields = ", ".join(f"{c} {listing.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        from quarry.sources.containers import _open_path
        for pdf in batches:
            content, error = [], []
            for path in pdf["path"]:
                try:
                    with _open_path(path) as stream:
                        content.append(stream.read())
                    error.append("")
                except Exception as e:
                    content.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pdf[columns].assign(content=content, error=error)

    return listing.select(*columns).mapInPandas(run, f"{fields}, content binary, error string")


def exclude_subtree(df: DataFrame, subtree: str, path_col: str = "path") -> DataFrame:
    """Drop rows under ``subtree`` (the subtree itself included)."""
    p = F.col(path_col)
    s = subtree.rstrip("/")
    return df.where(~(p.startswith(s + "/") | (p == s)))


def allow_listed(df: DataFrame, path_col: str = "path", extensions=V1_EXTENSIONS) -> DataFrame:
    """S4 (first program): no extension, or an extension of the allow-list."""
    ext = file_suffix(F.col(path_col))
    return df.where((ext == "") | ext.isin(list(extensions)))


def format_class(file_type: Column, name: Column | None = None) -> Column:
    """S4 (second program): routing class of a file type."""
    arch = file_type.isin(ARCHIVE_EXTENSIONS)
    if name is not None:
        low = F.lower(name)
        for e in ARCHIVE_NAME_ENDINGS:
            arch = arch | low.endswith(e)
    return (F.when(arch, "archive")
            .when(file_type.isin(TEXT_EXTENSIONS), "text")
            .when(file_type.isin(OOXML_EXTENSIONS), "ooxml")
            .when(file_type == ".pdf", "pdf")
            .when(file_type == ".xls", "xls")
            .when(file_type.isin(ODF_EXTENSIONS), "odf")
            .when(file_type == ".eml", "eml")
            .when(file_type == ".msg", "msg")
            .otherwise("sniff"))


def with_format_class(df: DataFrame, path_col: str = "source_path") -> DataFrame:
    return df.withColumn("format_class", format_class(F.col("file_type"), F.col(path_col)))


def decode_units(df: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Text of plain-text files and of sniffed text-like files.

    Text class: UTF-8 with bad bytes dropped.  Unknown types: read as text
    only if the first 4 KiB look textual, else no text.  Other classes are
    left to the container jobs and get no text here.
    """
    ft = file_suffix(F.col(path_col))
    cls = format_class(ft, F.col(path_col))
    c = F.col(content_col)
    text = (F.when(cls == "text", utf8_text(c))
            .when((cls == "sniff") & looks_textual(c), utf8_text(c))
            .otherwise(F.lit("")))
    return df.withColumn("file_type", ft).withColumn("text", F.coalesce(text, F.lit("")))


def dictionary_table_from_text(bench: DataFrame, min_len: int = 6) -> DataFrame:
    """S7 from a table: every word of ``min_len``+ letters of ``benchmark`` as a keyword.

    group = ``bench<item_id mod 3>``; ``pos`` (item and place) keeps the text order.  The
    normal form is the exact casefold (native expressions); ``display`` is
    the first spelling of each normal form.
    """
    words = bench.select(
        F.concat(F.lit("bench"), F.pmod("item_id", F.lit(3)).cast("string")).alias("keyword_group"),
        "item_id",
        F.posexplode(F.regexp_extract_all("text", F.lit("\\p{L}{%d,}" % min_len), 0)).alias("i", "keyword"))
    d = words.select("keyword_group", "keyword", F.struct("item_id", "i").alias("pos"),
                     casefold_col(F.col("keyword")).alias("norm"))
    disp = d.groupBy("norm").agg(F.min_by("keyword", "pos").alias("display"))
    return d.join(disp, "norm").select("keyword_group", "keyword", "pos", "norm", "display")


def member_names_from_docs(documents: DataFrame) -> DataFrame:
    """Archive member names for the S14 safety test: one plain, three escaping forms per document."""
    i = F.col("doc_id").cast("string")
    return documents.select(F.explode(F.array(
        F.concat(F.col("source"), F.lit("/"), i, F.lit(".txt")),
        F.concat(F.lit("/etc/"), i),
        F.concat(F.col("source"), F.lit("/../"), i),
        F.concat(F.col("source"), F.lit("\\..\\"), i),
    )).alias("member"))
