"""End-to-end jobs over a folder: the two scan programs as Spark jobs.

``evidence_scan``  — second program: manifests (JSONL + CSV), result tables
                     partitioned by run, summary, optional copy plan.
``keyword_report`` — first program: statistics document, per-group
                     reports, group copy plan, incremental state.

Both list the folder without reading content, drop the output folder and
(for the incremental form) unchanged files; the tasks that scan the rest open the files.  Python is used only inside the map jobs (containers and
the automaton); everything else is DataFrame work.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import merged as B
from quarry.operators import reports as A
from quarry.operators.facts import ancestor_rollup
from quarry.plans import sinks as K
from quarry.plans.scan import ScanResult, scan_tree
from quarry.sources import files as S
from quarry.sources.dictionary import KeywordDictionary
from quarry.streaming import incremental as I


def next_run(spark: SparkSession, output: str, data_root: str, config: str) -> int:
    """Append a row to ``{output}/runs`` and return its id (max + 1)."""
    path = f"{output}/runs"
    run_id = 1
    if _exists(spark, path):
        run_id = int(spark.read.parquet(path).agg(F.max("run_id")).first()[0] or 0) + 1
    row = spark.createDataFrame([(run_id, data_root, output, config)],
                                "run_id long, data_root string, output_root string, config string")
    row.withColumn("started_at", F.current_timestamp()).write.mode("append").parquet(path)
    return run_id


@dataclass
class JobResult:
    run_id: int
    result: ScanResult
    output: str
    metrics: dict | None = None


def observed(files: DataFrame, name: str = "scan"):
    """A14 in batch: the progress counters gathered while the files table is written.

    ``DataFrame.observe`` computes them inside the same job — no extra pass.
    """
    from pyspark.sql import Observation
    obs = Observation(name)
    df = files.observe(
        obs,
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("error") == "").alias("scanned"),
        F.count_if(F.col("matched")).alias("matched"),
        F.count_if(F.col("error") != "").alias("failed"),
        F.coalesce(F.sum("bytes_read"), F.lit(0)).alias("bytes_read"))
    return df, obs


def _archive_counters(r: ScanResult) -> dict:
    """Archives opened, at any depth, and the members found in them."""
    row = r.archives.agg(F.count(F.lit(1)).alias("archives"), F.coalesce(F.sum("count"), F.lit(0)).alias("members")).first()
    return row.asDict()


def _named_files(listing: DataFrame) -> DataFrame:
    """The listed files for a scan, which opens them inside its tasks."""
    # what is no regular file is never opened (reading a pipe would wait for ever); its row says that it has no content
    return listing.select(F.col("rel_path").alias("source_path"), F.when(F.col("error") != "not a regular file", F.col("path")).alias("path"), "size", "mtime")


def evidence_scan(spark: SparkSession, data_root: str, dictionary: KeywordDictionary, output: str, *,
                  run_id: int | None = None, case_sensitive: bool = False, max_depth: int = 3,
                  copy_plan: bool = False) -> JobResult:
    """Scan ``data_root`` (second program): dictionary mode, containers, manifests, tables, summary."""
    if run_id is None:
        run_id = next_run(spark, output, data_root, dictionary.fingerprint(case_sensitive))
    started = time.time()
    listing = S.list_files(spark, data_root, exclude=_inside(spark, data_root, output))
    r = scan_tree(_named_files(listing), dictionary, mode="dictionary", run_id=run_id,
                  case_sensitive=case_sensitive, max_depth=max_depth, reliable=True)
    copies = None
    if copy_plan:
        copies = K.evidence_plan(r.files.where("matched")).withColumnRenamed("dest", "copied_to")
        copies.write.mode("overwrite").parquet(f"{output}/evidence_plan")
    files_obs, obs = observed(r.files)
    K.write_run(files_obs, r.facts, output)
    metrics = dict(obs.get)
    elapsed = max(time.time() - started, 1e-3)             # listing, reading and matching included
    metrics |= _archive_counters(r)
    metrics["read_mb"] = metrics["bytes_read"] / (1024 * 1024)
    metrics["speed_mb_s"] = metrics["read_mb"] / elapsed
    metrics["matches"] = int(r.facts.groupBy("source_path", "internal_path", "keyword")
                             .agg(F.max("count").alias("c")).agg(F.sum("c")).first()[0] or 0)
    K.write_manifests(r.facts, output, copies)
    # whatever has something inside it is a container: archives that were opened, documents with embedded files
    containers = r.archives.select("source_path", "internal_path").unionByName(r.files.select("source_path", "internal_path"))
    (ancestor_rollup(r.facts, containers).withColumn("run_id", F.lit(run_id).cast("bigint"))
     .write.mode("overwrite").partitionBy("run_id").parquet(f"{output}/rollups"))
    K.write_summary(run_id, r.files, r.facts, output)
    return JobResult(run_id, r, output, metrics)


def keyword_report(spark: SparkSession, data_root: str, dictionary: KeywordDictionary, output: str, *,
                   incremental: bool = True, copy_plan: bool = True) -> JobResult:
    """Scan ``data_root`` (first program): whole words, statistics, per-group reports.

    Incremental: only files that are new or changed (path, mtime, size)
    for this dictionary are read; failed files are retried next time.  Each
    run appends its facts and its scanned-file list as partition ``run_id``;
    the statistics use, per file, the latest run that scanned it, so they
    always cover every file seen so far.
    """
    fp = dictionary.fingerprint(mode="boundary")
    listing = S.allow_listed(S.list_files(spark, data_root, exclude=_inside(spark, data_root, output)), path_col="rel_path")
    present = listing.select(F.col("rel_path").alias("source_path"))
    state_path, scanned_path, facts_path = f"{output}/scan_state", f"{output}/scanned", f"{output}/facts"
    have_state = incremental and _exists(spark, state_path)
    run_id = next_run(spark, output, data_root, fp)
    if have_state:
        state = latest_state(spark, state_path)
        keyed = listing.withColumnRenamed("path", "abs_path").withColumnRenamed("rel_path", "path")
        listing = (I.changed_files(keyed, state, fp)
                   .withColumnRenamed("path", "rel_path").withColumnRenamed("abs_path", "path"))
    r = scan_tree(_named_files(listing), dictionary, mode="boundary", run_id=run_id, max_depth=0, flavor="v1", reliable=True)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    r.facts.write.mode("overwrite").partitionBy("run_id").parquet(facts_path)
    (r.files.select("run_id", "source_path", "internal_path", "display_path", "file_type", "size",
                    "mtime", "bytes_read", "error")
     .write.mode("overwrite").partitionBy("run_id").parquet(scanned_path))
    scanned = spark.read.parquet(scanned_path).join(present, "source_path", "left_semi")    # deleted files leave
    latest = scanned.groupBy("source_path").agg(F.max("run_id").alias("run_id"))
    files = scanned.join(latest, ["source_path", "run_id"])
    facts = spark.read.parquet(facts_path).join(latest, ["source_path", "run_id"])
    # the statistics merge each run's bitmaps; no earlier run's facts are read for them
    own = r.files.withColumn("text", F.when(F.col("bytes_read") > 0, F.lit("x")).otherwise(F.lit("")))
    B.write_run(own, r.facts, output, run_id)
    A.statistics_document(B.merged_rows(spark, output, latest)).coalesce(1).write.mode("overwrite").json(f"{output}/statistics.json")
    A.keyword_file_index(facts).orderBy("keyword", "path").write.mode("overwrite").json(
        f"{output}/files_containing_keyword")
    A.group_report(facts).write.mode("overwrite").partitionBy("keyword_group").json(f"{output}/statistics_by_group")
    if copy_plan:
        K.group_copy_plan(facts).write.mode("overwrite").parquet(f"{output}/group_copy_plan")
    if incremental:
        done = r.files.select(F.col("source_path").alias("path"), "mtime", "size", "error")
        base = state if have_state else I.state_from_listing(done.drop("error").limit(0), fp)
        nxt = I.next_state(base, done, fp, present.withColumnRenamed("source_path", "path")).withColumn("version", F.lit(run_id).cast("bigint"))
        # a new version beside the old ones: a failed run leaves the previous state intact
        nxt.write.mode("append").partitionBy("version").parquet(state_path)
    return JobResult(run_id, ScanResult(files, facts), output)


def latest_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The newest complete version of the scan state (partition pruning on ``version``)."""
    all_versions = spark.read.parquet(state_path)
    newest = all_versions.agg(F.max("version")).first()[0]
    return all_versions.where(F.col("version") == F.lit(newest)).drop("version")


def _inside(spark: SparkSession, root: str, out: str) -> str | None:
    """The output folder relative to the data folder if it lies in it, however both are spelled."""
    r, o = S.qualified(spark, root), S.qualified(spark, out)
    return o[len(r) + 1:] if o.startswith(r + "/") else None


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def evidence_stream(spark: SparkSession, data_root: str, dictionary: KeywordDictionary, output: str, *,
                    checkpoint: str | None = None, available_now: bool = True, max_depth: int = 3, case_sensitive: bool = False):
    """Scan files as they arrive, change or go: a listing stream, each path's state, one scan per micro-batch.

    Every trigger lists the folder (hidden names too); keyed state lets new and changed paths through (by mtime, size and
    dictionary), which the scan opens by path, large text files by ranges.  A path that is gone is told with the listing after.
    Each epoch's files, facts, counters and gone paths are written to ``{output}/files``, ``matches``, ``metrics`` and
    ``gone`` partitioned by ``epoch`` (a retried epoch replaces its own partition).  A path that changed has rows in several
    epochs: see ``stream_tables``.  The checkpoint lies in the output folder unless one is named, so a restart
    goes on with the next epoch and scans nothing twice.  Files below the output folder are not scanned.
    """
    from quarry.session import cut_lineage
    from quarry.streaming import listing as L
    listings = L.listing_stream(spark, data_root, _inside(spark, data_root, output))
    changes = L.listing_changes(listings, dictionary.fingerprint(case_sensitive))
    ckpt = checkpoint or f"{output.rstrip('/')}/_stream_checkpoint"

    def handle(batch: DataFrame, epoch_id: int) -> None:
        started = time.time()
        found = cut_lineage(batch)                         # used several times; the state is asked once
        if not found.limit(1).count():
            return
        now = found.where("change <> 'gone'")
        r = scan_tree(_named_files(now), dictionary, run_id=int(epoch_id), max_depth=max_depth, case_sensitive=case_sensitive, reliable=True)
        files, obs = observed(r.files)
        I.write_epoch(files, f"{output}/files", epoch_id)
        I.write_epoch(r.facts, f"{output}/matches", epoch_id)
        I.write_epoch(found.where("change = 'gone'").select(F.col("rel_path").alias("source_path")), f"{output}/gone", epoch_id)
        counters = {**obs.get, **_archive_counters(r), "seconds": time.time() - started}
        row = spark.createDataFrame([tuple(counters[c] for c in COUNTERS) + (counters["seconds"],)],
                                    ", ".join(f"{c} long" for c in COUNTERS) + ", seconds double")
        I.write_epoch(row, f"{output}/metrics", epoch_id)

    w = changes.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


COUNTERS = ["seen", "scanned", "matched", "failed", "bytes_read", "archives", "members"]


def stream_tables(spark: SparkSession, output: str) -> ScanResult:
    """The files and facts of what is there now: each path's last epoch, without paths that have gone since."""
    files, facts = (spark.read.parquet(f"{output}/{t}") for t in ("files", "matches"))
    gone = spark.read.parquet(f"{output}/gone")
    last = (files.select("source_path", "epoch", F.lit(True).alias("there"))
            .unionByName(gone.select("source_path", "epoch", F.lit(False).alias("there")))
            .groupBy("source_path").agg(F.max(F.struct("epoch", "there")).alias("last"))
            .where("last.there").select("source_path", F.col("last.epoch").alias("epoch")))
    keep = lambda t: t.join(last, ["source_path", "epoch"], "left_semi")
    return ScanResult(keep(files), keep(facts))


def register_views(spark: SparkSession, output: str, prefix: str = "") -> list[str]:
    """Register the written ``runs``, ``files`` and ``matches`` tables as SQL views.

    Queries over them (``WHERE run_id = ...``) prune to the run's partitions.
    """
    names = []
    for t in ("runs", "files", "matches"):
        path = f"{output}/{t}"
        if _exists(spark, path):
            spark.read.parquet(path).createOrReplaceTempView(prefix + t)
            names.append(prefix + t)
    return names
