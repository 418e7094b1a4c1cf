"""One query per operator (``opN_<name>``) over the given tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.llm.oracle import ORACLE_SQL  # noqa: F401
from quarry.llm import (bm25, cross_parse, decontaminate, importance, jaccard_tree, licenses, line_dedup, linkgraph, mixing, prefix_trie, runs,
                        sharding, token_blocks)
from quarry.llm.common import WORD


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_mix_sources(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(d)


def op2_license_scan(spark, sf):
    out = licenses.scan(_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_jaccard_tree(spark, sf):
    return jaccard_tree.link_components(_table(spark, sf, "documents")).drop("th")


def op4_url_filter(spark, sf):
    out = linkgraph.judge(_table(spark, sf, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op5_byte_shards(spark, sf):
    text = F.coalesce("text", F.lit(""))
    d = _table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = sharding.shard_by_bytes(d, 8, order=("doc_id",), group="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_decontaminate(spark, sf):
    return decontaminate.find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op7_importance_classifier(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return importance.classify(docs, _table(spark, sf, "labels")).select("doc_id", "log_weight", "keep")


def op8_bm25_topk(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return bm25.search(docs, docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"))


TOKENIZER = "byte_bpe_50k.json"


def op9_token_blocks(spark, sf, tokenizer: str | None = None):
    import public_tokenizers
    with open(tokenizer or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        spec = f.read()
    return token_blocks.token_file(_table(spark, sf, "documents").select("doc_id", "text"), spec)


def op10_line_dedup(spark, sf):
    out = line_dedup.dedup_lines(_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op11_periodic_runs(spark, sf):
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    text = F.when(h % 10 == 0, F.when(F.size(words) > 0, F.concat_ws(" ", runs.repeated_in_place(words, h))).otherwise(F.col("text"))).otherwise(F.col("text"))
    found = runs.find_runs(_table(spark, sf, "documents").select("doc_id", text.alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return (found.withColumn("longest", longest)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"),
                    (-F.col("longest.period")).alias("period"), F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def op12_prefix_trie(spark, sf):
    paths = prefix_trie.turn_paths(_table(spark, sf, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_heads(paths))


def op13_language_id(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    out = cross_parse.predict_language(docs, docs.where(fold != 1).select("text", "lang"))
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_license_scan, op3_jaccard_tree, op4_url_filter, op5_byte_shards,
                                     op6_decontaminate, op7_importance_classifier, op8_bm25_topk, op9_token_blocks, op10_line_dedup,
                                   op11_periodic_runs, op12_prefix_trie, op13_language_id)}
