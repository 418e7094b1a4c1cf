"""Incremental scans.

Batch (I1): the listing is anti-joined with the scan state on
(path, mtime, size) for the current dictionary fingerprint, so unchanged
files are skipped before their content is read and a changed dictionary
rescans everything.  The next state keeps, per path, what the newest scan
read without error, and drops paths that are gone.

Streaming (I2/I3): Spark's file source picks up new files; each
micro-batch is matched in ``foreachBatch`` and appended to the fact and
file tables.  The file source does not re-emit a modified file; the folder job
(``plans.jobs.evidence_stream``) uses ``streaming.listing`` instead, which sees rewritten, hidden and lost files.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_COLUMNS = ["path", "mtime", "size", "dict_fingerprint"]


def state_from_listing(listing: DataFrame, fingerprint: str) -> DataFrame:
    return listing.select("path", "mtime", "size", F.lit(fingerprint).alias("dict_fingerprint"))


def changed_files(listing: DataFrame, state: DataFrame, fingerprint: str) -> DataFrame:
    """Listing rows that are new, or differ in mtime or size, for this dictionary."""
    current = state.where(F.col("dict_fingerprint") == fingerprint).select("path", "mtime", "size")
    return listing.join(current, ["path", "mtime", "size"], "left_anti")


def next_state(state: DataFrame, scanned: DataFrame, fingerprint: str, listing: DataFrame | None = None) -> DataFrame:
    """State after a scan — per path what was scanned last, whatever its mtime.

    A scanned row replaces the path's old row, so a restored older file is
    done as well; a file that failed loses its row and is tried again.  Paths that ``listing``
    (the current ``path`` column) no longer holds leave the state.
    An aggregate (``max_by``) per path, not a window: combined map-side.
    """
    done = F.col("error") == "" if "error" in scanned.columns else F.lit(True)
    new = scanned.select("path", "mtime", "size", F.lit(fingerprint).alias("dict_fingerprint"),
                         F.lit(1).alias("scan"), done.alias("done"))
    old = state.select(*STATE_COLUMNS, F.lit(0).alias("scan"), F.lit(True).alias("done"))
    best = old.unionByName(new).groupBy("path").agg(
        F.max_by(F.struct("mtime", "size", "dict_fingerprint", "done"), F.struct("scan", "mtime", "size")).alias("s"))
    if listing is not None:
        best = best.join(listing.select("path").distinct(), "path", "left_semi")
    return best.where("s.done").select("path", "s.mtime", "s.size", "s.dict_fingerprint")


def stream_scan(spark: SparkSession, source_dir: str, handle_batch: Callable[[DataFrame, int], None],
                checkpoint: str, *, glob: str | None = None, max_files_per_trigger: int = 1000,
                available_now: bool = True):
    """A ``binaryFile`` stream over ``source_dir``; ``handle_batch(df, epoch)`` does S→M→sink.

    ``checkpoint`` must be a shared folder (under ``spark.checkpoint.dir``
    on a cluster) so that a restarted query resumes where it stopped.
    """
    schema = T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ])
    r = (spark.readStream.format("binaryFile").schema(schema)
         .option("recursiveFileLookup", "true")
         .option("maxFilesPerTrigger", max_files_per_trigger))
    if glob:
        r = r.option("pathGlobFilter", glob)
    stream = r.load(source_dir)
    w = stream.writeStream.foreachBatch(handle_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def group_presence(facts: DataFrame, file_col: str = "display_path") -> DataFrame:
    """One row per (file, group) from match facts, without a shuffle or state.

    The match job writes all facts of one text contiguously, so equal
    (file, group) rows are adjacent in a partition; a per-partition pass
    with carry-over across Arrow batches drops the repeats exactly.
    """
    import pandas as pd

    def run(batches):
        last_file, seen = None, set()
        for pdf in batches:
            keep = []
            for f, g in zip(pdf[file_col], pdf["keyword_group"]):
                if f != last_file:
                    last_file, seen = f, set()
                keep.append(g not in seen)
                seen.add(g)
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]

    slim = facts.select(file_col, "keyword_group")
    return slim.mapInPandas(run, slim.schema)


def stream_group_totals(facts_stream: DataFrame, file_col: str = "display_path") -> DataFrame:
    """Running count of files per group over a stream of match facts.

    Each arriving file counts once per group it matches (as the first
    program's counters do).  The only state is one row per group.
    """
    return (group_presence(facts_stream, file_col)
            .groupBy("keyword_group").agg(F.count(F.lit(1)).alias("files")))


def write_epoch(df: DataFrame, out_dir: str, epoch_id: int) -> None:
    """Idempotent micro-batch sink: a retried epoch overwrites its own partition only."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    (df.withColumn("epoch", F.lit(int(epoch_id)).cast("long"))
     .write.mode("overwrite").partitionBy("epoch").parquet(out_dir))


def stream_facts(stream: DataFrame, match: Callable[[DataFrame], DataFrame], out_dir: str,
                 checkpoint: str, *, available_now: bool = True):
    """Every micro-batch of ``stream`` matched by ``match`` and written to ``out_dir``.

    Returns the started query; with ``available_now`` it processes what is
    there and stops, so a second run over the same input adds nothing.
    """
    def handle(batch: DataFrame, epoch_id: int) -> None:
        write_epoch(match(batch), out_dir, epoch_id)

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def table_stream(spark: SparkSession, folder: str, table: str, max_files_per_trigger: int | None = None):
    """A file stream over ``{folder}/{table}.parquet``, one file or a folder of part files (schema taken from the table).

    ``max_files_per_trigger`` defaults to the session's cores, so that a micro-batch of a table of many files keeps them busy.
    """
    where = f"{folder.rstrip('/')}/{table}.parquet"
    # as a pattern: a stream's plain path must be a folder, what a pattern names may be a file as well
    return (spark.readStream.schema(spark.read.parquet(where).schema).format("parquet")
            .option("maxFilesPerTrigger", max_files_per_trigger or spark.sparkContext.defaultParallelism)
            .load(where[:-1] + "[t]"))
