"""Registry of the operators as queries over a data folder.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame computed from
the tables in ``sf_dir`` (through the corpus views).  ``quarry.oracle``
holds the DuckDB SQL for the same keys; column names agree one to one.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import file_suffix, looks_textual, member_is_safe, strip_html_simple
from quarry.operators import facts as M
from quarry.operators import reports as A
from quarry.operators.match import match_boundary, match_dictionary, match_file_scope, roll_up
from quarry.plans import sinks as K
from quarry.plans.scan import META, boundary_scan, dictionary_scan, scan_tree
from quarry.sources import containers as X
from quarry.sources import packing as P
from quarry.sources import corpus
from quarry.sources import files as S
from quarry.sources.dictionary import KeywordDictionary, TEST_DICTIONARY
from quarry.streaming import incremental as I

DICT = KeywordDictionary(TEST_DICTIONARY)

# A second dictionary for the JSON ``props`` strings of events.
PROPS_DICTIONARY = {"Keys": ['"k"', '"k": 1'], "Digits": ["1", "7", "42"]}
PROPS_DICT = KeywordDictionary(PROPS_DICTIONARY)


def _docs_dict(spark, sf):
    return dictionary_scan(corpus.docs(spark, sf), DICT)


def _docs_bnd(spark, sf):
    return boundary_scan(corpus.docs(spark, sf), DICT)


def _fact_cols(df: DataFrame) -> DataFrame:
    return df.select("display_path", "keyword_group", "keyword", "count")


# ---------------------------------------------------------------- sources
def q_file_inventory(spark, sf):
    inv = corpus.docs(spark, sf, with_text=False)
    return inv.select(F.col("source_path").alias("path"), "size",
                      F.unix_timestamp("mtime").alias("mtime_s"))


def q_exclude_subtree(spark, sf):
    inv = corpus.docs(spark, sf, with_text=False)
    return S.exclude_subtree(inv, "src1", path_col="source_path").select("source_path")


def q_file_type_of(spark, sf):
    inv = corpus.docs(spark, sf, with_text=False)
    return inv.select("source_path", file_suffix(F.col("source_path")).alias("file_type"))


def q_ext_filter(spark, sf):
    inv = corpus.docs(spark, sf, with_text=False)
    return S.allow_listed(inv, path_col="source_path").select("source_path")


def q_format_class_counts(spark, sf):
    inv = corpus.docs(spark, sf, with_text=False).select("source_path", "file_type") \
        .unionByName(corpus.pages(spark, sf).select("source_path", "file_type")) \
        .unionByName(corpus.props(spark, sf).select("source_path", "file_type"))
    return S.with_format_class(inv).groupBy("format_class").agg(F.count(F.lit(1)).alias("files"))


def q_textual_sniff(spark, sf):
    d = corpus.docs(spark, sf)
    return d.select("source_path", looks_textual(F.encode("text", "UTF-8")).alias("textual"))


def q_utf8_text_units(spark, sf):
    d = corpus.docs(spark, sf)
    raw = d.select("source_path", F.encode("text", "UTF-8").alias("content"))
    return S.decode_units(raw, path_col="source_path").select(
        "source_path", F.octet_length("text").alias("bytes"))


def q_bench_dictionary(spark, sf):
    d = S.dictionary_table_from_text(corpus.table(spark, sf, "benchmark"))
    return d.select("keyword_group", "keyword", F.col("pos.item_id").alias("item_id"), F.col("pos.i").cast("bigint").alias("pos"),
                    "norm", "display")


def q_dictionary_norm(spark, sf):
    d = S.dictionary_table_from_text(corpus.table(spark, sf, "benchmark"))
    from quarry.sources.dictionary import dictionary_norm
    return dictionary_norm(d).select("norm", F.array_join("groups", ";").alias("groups"), "display")


def q_html_strip(spark, sf):
    return corpus.pages(spark, sf, strip=True).select("page_id", "text")


def q_html_strip_simple(spark, sf):
    p = corpus.table(spark, sf, "pages")
    return p.select("page_id", strip_html_simple(F.col("html")).alias("text"))


def q_unsafe_member_filter(spark, sf):
    names = S.member_names_from_docs(corpus.table(spark, sf, "documents"))
    return names.select("member", member_is_safe(F.col("member")).alias("safe"))


def q_archive_dedup(spark, sf):
    d = corpus.docs(spark, sf, with_text=False).select("source_path", "internal_path")
    c = corpus.convs(spark, sf).select("source_path", "internal_path")
    seen = d.unionByName(c).unionByName(c)  # the same members reached twice
    return seen.dropDuplicates(["source_path", "internal_path"])


def q_scan_props_text(spark, sf):
    r = dictionary_scan(corpus.props(spark, sf), PROPS_DICT)
    return _fact_cols(r.facts)


# ---------------------------------------------------------------- matching
def q_match_boundary(spark, sf):
    return _fact_cols(_docs_bnd(spark, sf).facts)


def q_match_dictionary(spark, sf):
    return _fact_cols(_docs_dict(spark, sf).facts)


def q_match_case_sensitive(spark, sf):
    return _fact_cols(dictionary_scan(corpus.docs(spark, sf), DICT, case_sensitive=True).facts)


def q_match_pages(spark, sf):
    return _fact_cols(dictionary_scan(corpus.pages(spark, sf), DICT).facts)


def q_match_unit_scope(spark, sf):
    c = corpus.convs(spark, sf)
    f = match_dictionary(c, DICT, keys=["source_path", "unit_idx"])
    return roll_up(f, ["source_path"]).select("source_path", "keyword_group", "keyword", "count")


def q_match_file_scope(spark, sf):
    c = corpus.convs(spark, sf)
    f = match_file_scope(c, DICT, file_keys=["source_path"], idx_col="unit_idx")
    return f.select("source_path", "keyword_group", "keyword", "count")


def q_match_file_scope_boundary(spark, sf):
    c = corpus.convs(spark, sf)
    f = match_file_scope(c, DICT, file_keys=["source_path"], idx_col="unit_idx", mode="boundary")
    return f.select("source_path", "keyword_group", "keyword", "count")


def q_file_match_maps(spark, sf):
    r = _docs_dict(spark, sf)
    return M.maps_as_text(M.file_match_maps(r.facts, ["display_path"]))


def q_files_with_flag(spark, sf):
    d = corpus.docs(spark, sf).drop("text")
    f = match_dictionary(corpus.docs(spark, sf), DICT, keys=META)
    return M.files_with_flag(d, f).select("display_path", "file_type", "size", "hits", "matched")


def q_files_unmatched(spark, sf):
    d = corpus.docs(spark, sf)
    f = match_dictionary(d, DICT, keys=META)
    return M.files_unmatched(d, f).select("display_path", "file_type", "size")


def q_bytes_read(spark, sf):
    return M.bytes_read(corpus.convs(spark, sf), ["source_path"])


def q_container_rollup(spark, sf):
    f = match_dictionary(corpus.convs(spark, sf), DICT, keys=["source_path", "internal_path"])
    return M.container_rollup(f)


# ---------------------------------------------------------------- containers
def _documents(spark, sf):
    return corpus.table(spark, sf, "documents")


def q_archive_members(spark, sf):
    members = X.expand(P.pack_archives(_documents(spark, sf))).members
    # the size of a nested archive depends on the compressor
    return members.withColumn("size", F.when(~F.col("internal_path").endswith(".zip"), F.col("size")))


def q_archive_facts(spark, sf):
    r = scan_tree(P.pack_archives(_documents(spark, sf)), DICT)
    return _fact_cols(r.facts)


def q_archive_files(spark, sf):
    r = scan_tree(P.pack_archives(_documents(spark, sf)), DICT)
    return r.files.select("display_path", "file_type", "size", "bytes_read", "matched", "error")


def q_scan_errors(spark, sf):
    r = scan_tree(P.pack_archives(_documents(spark, sf), damage=True), DICT)
    return M.scan_errors(r.files).select("source_path", "internal_path", "error")


def q_archive_rollup(spark, sf):
    r = scan_tree(P.pack_archives(_documents(spark, sf)), DICT)
    return M.container_rollup(r.facts)


def _unit_cols(exp):
    return exp.units.select("source_path", "internal_path", "unit_idx", "unit_kind", "part_name",
                            F.length("text").alias("chars"))


def q_ooxml_units(spark, sf):
    return _unit_cols(X.expand(P.pack_office(_documents(spark, sf), "docx")))


def q_odf_units(spark, sf):
    return _unit_cols(X.expand(P.pack_office(_documents(spark, sf), "odt")))


def q_eml_units(spark, sf):
    return _unit_cols(X.expand(P.pack_office(_documents(spark, sf), "eml")))


def q_xml_units(spark, sf):
    return X.xml_units(P.pack_xml(_documents(spark, sf))).select(
        "source_path", F.length("text").alias("chars"))


def q_container_facts(spark, sf):
    """Facts of every container kind at once: docx, odt, eml, gz."""
    blobs = P.pack_mixed(_documents(spark, sf))
    return _fact_cols(scan_tree(blobs, DICT).facts)


# ---------------------------------------------------------------- reports
def q_files_per_group(spark, sf):
    return A.files_per_group(_docs_bnd(spark, sf).facts)


def q_files_per_keyword(spark, sf):
    return A.files_per_keyword(_docs_bnd(spark, sf).facts)


def q_keyword_totals(spark, sf):
    return A.keyword_totals(_docs_dict(spark, sf).facts)


def q_keyword_totals_by_group_row(spark, sf):
    return A.keyword_totals_by_group_row(_docs_dict(spark, sf).facts)


def q_filetype_counts(spark, sf):
    return A.filetype_counts(corpus.docs(spark, sf))


def q_files_multi_group(spark, sf):
    return A.files_multi_group(_docs_bnd(spark, sf).facts)


def q_keyword_file_index(spark, sf):
    return A.keyword_file_index(_docs_bnd(spark, sf).facts)


def q_matched_size_gb(spark, sf):
    return A.matched_size_gb(_docs_bnd(spark, sf).facts)


def q_group_matched_size(spark, sf):
    return A.group_matched_size(_docs_bnd(spark, sf).facts)


def q_group_report(spark, sf):
    return A.group_report(_docs_bnd(spark, sf).facts)


def q_global_statistics(spark, sf):
    r = _docs_bnd(spark, sf)
    st = A.global_statistics(corpus.docs(spark, sf), r.facts)
    return st.select(*[F.to_json(c).alias(c) if c in ("Keyword_Groups", "Keywords", "FileTypes") else F.col(c)
                       for c in st.columns])


def q_run_totals(spark, sf):
    return A.run_totals(_docs_dict(spark, sf).files)


def q_matched_files(spark, sf):
    r = _docs_dict(spark, sf)
    m = A.matched_files(r.files, r.facts)
    return m.select("display_path", "copied_to", F.array_join("groups", ";").alias("groups"),
                    F.array_join("keywords", ";").alias("keywords"))


def q_run_summary(spark, sf):
    r = _docs_dict(spark, sf)
    return A.run_summary(1, r.files, r.facts).select(
        "run_id", F.to_json("files").alias("files"), F.to_json("groups").alias("groups"),
        F.to_json("keywords").alias("keywords"))


def q_scan_metrics(spark, sf):
    r = _docs_dict(spark, sf)
    return A.scan_metrics(r.files, r.facts)


def q_run_filter(spark, sf):
    r1 = _docs_dict(spark, sf)
    r2 = dictionary_scan(corpus.pages(spark, sf), DICT, run_id=2)
    both = r1.files.unionByName(r2.files)
    return A.run_filter(both, 2).select("run_id", "display_path", "bytes_read", "matched")


# ---------------------------------------------------------------- sinks
def q_manifest_jsonl(spark, sf):
    r = _docs_dict(spark, sf)
    rec = K.manifest_records(r.facts)
    return M.maps_as_text(rec)


def q_manifest_csv(spark, sf):
    r = _docs_dict(spark, sf)
    return K.manifest_csv_rows(r.facts)


def q_files_upsert(spark, sf):
    d = corpus.docs(spark, sf)
    v1 = boundary_scan(d, DICT).files.withColumn("seq", F.lit(1))
    v2 = dictionary_scan(d.where(F.col("file_type") == ".txt"), DICT).files.withColumn("seq", F.lit(2))
    latest = K.latest_per_key(v1.unionByName(v2), ["run_id", "source_path", "internal_path"])
    return latest.select("display_path", "matched", "bytes_read", "seq")


def q_file_keys(spark, sf):
    return K.file_keys(_docs_dict(spark, sf).files).select("display_path", "file_key")


def q_group_copy_plan(spark, sf):
    c = corpus.convs(spark, sf)
    f = match_boundary(c, DICT, keys=["display_path", "internal_path"])
    # names that clash: every third file is t.txt, others are t_<0 to 4>.txt, the rest keep their own
    h = F.conv(F.substring(F.md5("display_path"), 1, 6), 16, 10).cast("long")
    f = f.withColumn("name", F.when(h % 3 == 0, "t.txt").when(h % 3 == 1, F.concat(F.lit("t_"), h % 5, F.lit(".txt")))
                     .otherwise(F.col("internal_path")))
    return K.group_copy_plan(f, path_col="display_path", name_col="name", buckets=16)


def q_evidence_plan(spark, sf):
    d = _docs_dict(spark, sf).files.where("matched")
    c = dictionary_scan(corpus.convs(spark, sf).drop("unit_idx"), DICT).files.where("matched")
    return K.evidence_plan(d.unionByName(c))


# ---------------------------------------------------------------- incremental
def q_changed_files(spark, sf):
    old, new = corpus.snapshots(spark, sf)
    ch = I.changed_files(new, I.state_from_listing(old, DICT.fingerprint()), DICT.fingerprint())
    return ch.select("path", corpus.ntz_micros(F.col("mtime")).alias("mtime_us"), "size")


def q_next_scan_state(spark, sf):
    old, new = corpus.snapshots(spark, sf)
    fp = DICT.fingerprint()
    state = I.state_from_listing(old, fp)
    ch = I.changed_files(new, state, fp)
    nxt = I.next_state(state, ch, fp, new)
    return nxt.select("path", corpus.ntz_micros(F.col("mtime")).alias("mtime_us"), "size")


def _listings(spark, sf):
    """Four listings of one folder, from ``events``: both snapshots, the second with changes and losses, and that once more."""
    old, new = corpus.snapshots(spark, sf)
    user = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    third = (new.unionByName(old.join(new, "path", "left_anti").where(user % 2 == 0)).where(user % 13 != 0)
             .withColumn("size", F.col("size") + F.when(user % 9 == 0, 1).otherwise(0)))
    return [old, new, third, third]


def q_listing_changes(spark, sf):
    """I1 as keyed state: the stream sees one listing after the other, over restarts."""
    from quarry.streaming import listing as L
    base = _scratch(spark, "listings")
    schema = None
    for i, listing in enumerate(_listings(spark, sf), 1):
        at = F.timestamp_micros(F.lit(i * 1_000_000).cast("long"))
        rows = listing.select("path", F.col("path").alias("rel_path"), "size", F.timestamp_micros(corpus.ntz_micros(F.col("mtime"))).alias("mtime"),
                              F.lit("").alias("error"), at.alias("listed_at"))
        rows.write.parquet(f"{base}/in/listing={i}")
        schema = rows.schema
        stream = spark.readStream.schema(schema).parquet(f"{base}/in/listing=*")
        q = (L.listing_changes(stream, DICT.fingerprint()).writeStream.outputMode("update")
             .foreachBatch(lambda df, epoch: I.write_epoch(df, f"{base}/out", epoch))
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        (F.unix_micros("listed_at") / 1_000_000).cast("long").alias("listing"), "rel_path", "change", "size", F.unix_micros("mtime").alias("mtime_us"))


def q_range_scan(spark, sf):
    """S6 by byte ranges: the texts written as a few text files, hits counted by ranges that no line or character respects."""
    from quarry.operators.match import plan_spec
    from quarry.plans.scan import scan_ranges
    from quarry.sources import files as S
    base = _scratch(spark, "ranges")
    corpus.table(spark, sf, "documents").select("text").where("text is not null").write.text(f"{base}/texts")
    listing = S.list_files(spark, f"{base}/texts", glob="part-*").select(F.col("rel_path").alias("source_path"), "path", "size", "mtime")
    rows = scan_ranges(listing, plan_spec(DICT, "dictionary", False), "dictionary", False, 99_991, True, [])
    return (rows.where("row_kind = 'fact'").groupBy("keyword_group", "keyword").agg(F.sum("count").cast("bigint").alias("hits")))


def q_index_lookup(spark, sf):
    """A6 as a stored index: written bucketed by keyword, then asked for each keyword of the first group."""
    import uuid
    from functools import reduce
    from quarry.plans import index as N
    table = f"quarry_index_{uuid.uuid4().hex[:12]}"
    N.store_index(_docs_bnd(spark, sf).facts, table, _scratch(spark, "index"), buckets=16, chunk=100)
    first = DICT.entries[0][0]
    asked = dict.fromkeys(kw for g, kw in DICT.entries if g == first)
    return reduce(DataFrame.unionByName, [N.lookup(spark, table, kw) for kw in asked])


def q_match_keyword_table(spark, sf):
    """M2 for a keyword table: every word of ``benchmark`` (eight letters or more) against ``documents``, inside the JVM."""
    from quarry.operators.qgram import match_table
    words = S.dictionary_table_from_text(corpus.table(spark, sf, "benchmark")).where(F.length("keyword") >= 8)
    return match_table(corpus.docs(spark, sf), words.select("keyword_group", F.col("display").alias("keyword"), "norm"), keys=["display_path"])


def q_nested_rollup(spark, sf):
    """M9 to every ancestor: documents as members of containers in containers, hits rolled up to each of them."""
    d = corpus.table(spark, sf, "documents")
    outer = F.concat(F.coalesce("source", F.lit("none")), F.lit(".zip"))
    inner = F.concat(F.coalesce("lang", F.lit("none")), F.lit(".zip"))
    deep = F.concat(inner, F.lit("/box/"), F.pmod("doc_id", F.lit(10)).cast("string"), F.lit(".zip"))
    units = d.select(outer.alias("source_path"), F.concat(deep, F.lit("/"), F.col("doc_id").cast("string")).alias("internal_path"), "text")
    containers = d.select(outer.alias("source_path"), F.explode(F.array(F.lit(""), inner, deep)).alias("internal_path"))
    facts = match_dictionary(units, DICT, keys=["source_path", "internal_path"])
    return M.ancestor_rollup(facts, containers)


def _versions(spark, sf):
    """Four runs over ``documents``: all; every third with half its text; every fifth whole again; every seventh halved.  Every eleventh is gone."""
    docs = corpus.docs(spark, sf)
    half = docs.withColumn("text", F.expr("left(text, length(text) div 2)"))
    for run, (version, every) in enumerate([(docs, 1), (half, 3), (docs, 5), (half, 7)], 1):
        yield run, version.where(F.col("doc_id") % every == 0).withColumn("size", F.octet_length("text").cast("bigint"))


def q_merged_statistics(spark, sf):
    """A1, A2, A4, A5, A7 and A8 over four runs, from the bitmaps that each run left."""
    from quarry.operators import merged as B
    base = _scratch(spark, "merged")
    latest = None
    for run, units in _versions(spark, sf):
        r = boundary_scan(units, DICT, run_id=run)
        files = r.files.withColumn("text", F.when(F.col("bytes_read") > 0, F.lit("x")).otherwise(F.lit("")))
        B.write_run(files, r.facts, base, run)
        r.release()
        own = units.where("doc_id % 11 <> 0").select("source_path", F.lit(run).cast("bigint").alias("run_id"))
        latest = own if latest is None else latest.unionByName(own)
    latest = latest.groupBy("source_path").agg(F.max("run_id").alias("run_id"))
    return B.merged_rows(spark, base, latest).drop("hits")


# ---------------------------------------------------------------- streaming
def _scratch(spark, name):
    import uuid
    from quarry.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _docs_from_stream(batch):
    """The ``docs`` view over a micro-batch of ``documents`` rows."""
    ext = corpus.doc_extension(F.col("doc_id"))
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ext))
    return batch.select(path.alias("display_path"), "text")


def q_stream_scan(spark, sf):
    base = _scratch(spark, "stream-scan")
    q = I.stream_facts(I.table_stream(spark, sf, "documents"),
                       lambda b: match_dictionary(_docs_from_stream(b), DICT, keys=["display_path"]),
                       f"{base}/facts", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/facts").drop("epoch")


def q_stream_group_totals(spark, sf):
    base = _scratch(spark, "stream-totals")
    facts = match_dictionary(_docs_from_stream(I.table_stream(spark, sf, "documents")), DICT,
                             keys=["display_path"], spread=False)
    name = "quarry_group_totals_" + base.rsplit("-", 1)[-1]
    q = (I.stream_group_totals(facts).writeStream.outputMode("complete").format("memory")
         .queryName(name).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sources
    "file_inventory": q_file_inventory,
    "exclude_subtree": q_exclude_subtree,
    "file_type_of": q_file_type_of,
    "ext_filter": q_ext_filter,
    "format_class_counts": q_format_class_counts,
    "textual_sniff": q_textual_sniff,
    "utf8_text_units": q_utf8_text_units,
    "dictionary_table": q_bench_dictionary,
    "dictionary_norm": q_dictionary_norm,
    "html_strip": q_html_strip,
    "html_strip_simple": q_html_strip_simple,
    "unsafe_member_filter": q_unsafe_member_filter,
    "archive_dedup": q_archive_dedup,
    "scan_props_text": q_scan_props_text,
    # matching
    "match_boundary": q_match_boundary,
    "match_dictionary": q_match_dictionary,
    "match_case_sensitive": q_match_case_sensitive,
    "match_pages": q_match_pages,
    "match_unit_scope": q_match_unit_scope,
    "match_file_scope": q_match_file_scope,
    "match_file_scope_boundary": q_match_file_scope_boundary,
    "file_match_maps": q_file_match_maps,
    "files_with_flag": q_files_with_flag,
    "files_unmatched": q_files_unmatched,
    "bytes_read": q_bytes_read,
    "container_rollup": q_container_rollup,
    # containers
    "archive_members": q_archive_members,
    "archive_facts": q_archive_facts,
    "archive_files": q_archive_files,
    "archive_rollup": q_archive_rollup,
    "scan_errors": q_scan_errors,
    "ooxml_units": q_ooxml_units,
    "odf_units": q_odf_units,
    "eml_units": q_eml_units,
    "xml_units": q_xml_units,
    "container_facts": q_container_facts,
    # reports
    "files_per_group": q_files_per_group,
    "files_per_keyword": q_files_per_keyword,
    "keyword_totals": q_keyword_totals,
    "keyword_totals_by_group_row": q_keyword_totals_by_group_row,
    "filetype_counts": q_filetype_counts,
    "files_multi_group": q_files_multi_group,
    "keyword_file_index": q_keyword_file_index,
    "matched_size_gb": q_matched_size_gb,
    "group_matched_size": q_group_matched_size,
    "group_report": q_group_report,
    "global_statistics": q_global_statistics,
    "run_totals": q_run_totals,
    "matched_files": q_matched_files,
    "run_summary": q_run_summary,
    "scan_metrics": q_scan_metrics,
    "run_filter": q_run_filter,
    # sinks
    "manifest_jsonl": q_manifest_jsonl,
    "manifest_csv": q_manifest_csv,
    "files_upsert": q_files_upsert,
    "file_keys": q_file_keys,
    "group_copy_plan": q_group_copy_plan,
    "evidence_plan": q_evidence_plan,
    # incremental and streaming
    "stream_scan": q_stream_scan,
    "stream_group_totals": q_stream_group_totals,
    "changed_files": q_changed_files,
    "next_scan_state": q_next_scan_state,
    "listing_changes": q_listing_changes,
    "merged_statistics": q_merged_statistics,
    "index_lookup": q_index_lookup,
    "match_keyword_table": q_match_keyword_table,
    "range_scan": q_range_scan,
    "nested_rollup": q_nested_rollup,
}
