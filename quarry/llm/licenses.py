"""License scan: exact containment join of text blocks with license templates, plus phrase places."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fold

# What a word is here (a digit, a letter or anything beyond ASCII).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License notices, each with its label.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under a creative commons attribution license": "cc-by",
    "free and unencumbered software released into the public domain": "unlicense",
}
CONTAINMENT = 0.9
MOST_TOKENS = 20_000      # of all templates together; they travel in the plan


def words(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def _phrase_at(ws: list[str]):
    return lambda i: reduce(Column.__and__, [F.get("_scan_w", i + k) == w for k, w in enumerate(ws)])


def _ints(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _meets(own: list[int], need: int):
    """Whether a block meets a template: prefix, length and positional filters, then the exact count."""
    def test(block: Column) -> Column:
        first = F.array_min(F.array_intersect(block.tokens, _ints(own[:len(own) - need + 1])))
        left = F.least(F.lit(len(own)) - F.array_position(_ints(own), first),
                       F.size(block.tokens) - F.array_position(block.tokens, first)) + 1
        return ((F.size(block.tokens) >= need) & first.isNotNull() & (left >= need)
                & (F.size(F.array_intersect(block.tokens, _ints(own))) >= need))
    return test


def _match(own: list[int], label: str):
    return lambda block: F.struct(
        block.first_word.cast("long").alias("first_word"), F.lit(label).alias("label"),
        (F.size(F.array_intersect(block.tokens, _ints(own))) / len(own)).alias("share"))


def scan(rows: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
         containment: float = CONTAINMENT) -> DataFrame:
    """``rows`` without ``text`` plus ``n_words, n_base, first_word, last_word, base_labels, labels, score, blocks``.

    Phrases are counted at every place where their words stand in a row.
    Templates are joined by containment: a text is cut into blocks of twice the
    longest template, each half overlapping the next, so a notice lies wholly in
    one.  A block meets a template if it holds at least ``containment`` of its
    distinct tokens.  The join is exact: tokens are ordered by how often they
    occur in all rows, rarest first; a block that meets a template must hold one
    of the template's first ``n - need + 1`` tokens (prefix filter), at least
    ``need`` template tokens (length filter), and enough of both must be left
    after the first common one (positional filter); survivors are counted out.
    Templates are a parameter of bounded size (checked) and travel in the plan,
    so texts are neither shuffled nor joined.

    ``blocks`` lists the matches as ``first_word, label, share``; ``score`` is the
    best share (1 where a phrase occurs, 0 without any).  A null or empty text has
    no words, no labels and score 0; repeated rows and null ids are judged row by row; an
    empty table gives no rows.  Columns of the input that clash are replaced.
    """
    token_lists = {t: list(dict.fromkeys(t.split())) for t in templates}
    if sum(map(len, token_lists.values())) > MOST_TOKENS:
        raise ValueError(f"templates of more than {MOST_TOKENS} tokens")
    vocabulary = sorted({w for ws in token_lists.values() for w in ws})
    found = (rows.select(F.explode(F.filter(words(F.col(text)), lambda w: w.isin(vocabulary))).alias("w"))
             .groupBy("w").count())
    seen = {r.w: r["count"] for r in found.collect()}                  # one row per template token at most
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    ranked = F.create_map(*[F.lit(x) for w, i in order.items() for x in (w, i)]) if order else None
    longest = max((len(t.split()) for t in templates), default=1)

    out = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    kept = [c for c in rows.columns if c not in (*out, text)]
    df = rows.select(*kept, words(F.col(text)).alias("_scan_w")).withColumn("n_words", F.size("_scan_w").cast("long"))

    places, labelled = [], []
    for phrase, label in phrases.items():
        ws = phrase.split()
        there = F.lit(True)
        for w in sorted(ws, key=len, reverse=True):
            there = there & F.array_contains("_scan_w", w)
        starts = F.when(there & (F.size("_scan_w") >= len(ws)),
                        F.filter(F.sequence(F.lit(0), F.size("_scan_w") - len(ws)), _phrase_at(ws))).otherwise(F.array().cast("array<int>"))
        places.append(starts)
        labelled.append(label)
    df = df.withColumn("_scan_places", F.array(*places) if places else F.array().cast("array<array<int>>"))

    # blocks that hold a prefix token of some template
    need = {t: math.ceil(containment * len(ws) - 1e-9) for t, ws in token_lists.items()}
    in_order = {t: sorted(order[w] for w in ws) for t, ws in token_lists.items()}
    firsts = sorted({w for t, ws in token_lists.items() for w in ws if order[w] in in_order[t][:len(ws) - need[t] + 1]})
    hits = F.filter(F.transform("_scan_w", lambda w, i: F.when(w.isin(firsts), i)), lambda i: i.isNotNull())
    step = longest
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(
        hits, lambda i: F.array(F.floor(i / step).cast("int"), F.greatest(F.lit(0), F.floor(i / step).cast("int") - 1))))))
    df = df.withColumn("_scan_b", numbers if firsts else F.array().cast("array<int>"))
    tokens = lambda b: F.array_sort(F.array_distinct(F.transform(
        F.filter(F.slice("_scan_w", b * step + 1, 2 * step), lambda w: w.isin(vocabulary)), lambda w: F.element_at(ranked, w))))
    df = df.withColumn("_scan_blocks", F.transform("_scan_b", lambda b: F.struct((b * step).alias("first_word"), tokens(b).alias("tokens")))
                       if firsts else F.array().cast("array<struct<first_word:int,tokens:array<int>>>"))
    matches = [F.transform(F.filter("_scan_blocks", _meets(in_order[t], need[t])), _match(in_order[t], label))
               for t, label in templates.items()]
    empty = F.array().cast("array<struct<first_word:bigint,label:string,share:double>>")
    df = df.withColumn("blocks", F.array_sort(F.flatten(F.array(*matches))) if matches else empty)

    flat = F.flatten("_scan_places")
    base = F.filter(F.array(*[F.when(F.size(F.col("_scan_places")[i]) > 0, F.lit(v)) for i, v in enumerate(labelled)]),
                    lambda v: v.isNotNull()) if labelled else _strings([])
    return df.withColumn("_scan_base", base).select(
        *kept, "n_words", F.size(flat).cast("long").alias("n_base"), F.array_min(flat).cast("long").alias("first_word"),
        F.array_max(flat).cast("long").alias("last_word"), _joined(F.col("_scan_base")).alias("base_labels"),
        _joined(F.concat("_scan_base", F.transform("blocks", lambda b: b.label))).alias("labels"),
        F.when(F.size(flat) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b.share)), F.lit(0.0))).alias("score"),
        "blocks")
