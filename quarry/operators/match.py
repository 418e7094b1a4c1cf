"""Dictionary matching — the theta join of texts with keywords (M1–M5).

Two semantics:

* ``dictionary`` mode: case-folded (or exact) substring search, counting
  every overlapping occurrence; a normal form shared by several groups gives
  one fact row per group, all with the display spelling of the first entry.
* ``boundary`` mode: lower-cased whole-word search with Python's ``\\b``,
  existence only; one fact row per configured (group, keyword).

Two physical forms, same results:

* ``automaton`` (default): ``mapInArrow`` holding an Aho-Corasick automaton
  built once per Python worker from the dictionary shipped in the closure.
  One pass over each text whatever the dictionary size; no join at all.
* ``native``: one projection of ``contains`` prefilters with ``regexp_count``
  (empty look-ahead, so overlaps count) or ``rlike`` with look-around word
  borders, exploded into facts.  Stays in whole-stage codegen; its cost
  grows with the dictionary, so it is meant for small ones.

Scale: a text is normalised whole and walked once, in time linear in its
length, inside the map job; a task holds one text and its normal form beside the
Arrow batch.  Only a coarse input (fewer files than cores) is redistributed,
by row key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from typing import Iterable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.functions.batches import pieces
from quarry.functions.text import (boundary_regex, casefold_col, is_word_char,
                                   overlap_count_regex)
from quarry.sources.dictionary import KeywordDictionary

FACT_FIELDS = [
    T.StructField("keyword_group", T.StringType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("count", T.LongType(), False),
]

# The native form builds one expression per keyword; beyond this the automaton is used.
NATIVE_MAX_ENTRIES = 256

_AUTOMATA: dict = {}


def _automaton(key: str, words: Sequence[str]):
    """One automaton per Python worker and dictionary fingerprint."""
    a = _AUTOMATA.get(key)
    if a is None:
        import ahocorasick
        a = ahocorasick.Automaton()
        for i, w in enumerate(words):
            a.add_word(w, (i, len(w)))
        a.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = a
    return a


def _fact_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    fields = [df.schema[k] for k in keys]
    return T.StructType(fields + FACT_FIELDS)


def plan_spec(dictionary: KeywordDictionary, mode: str, case_sensitive: bool):
    """Driver-side, config-sized match spec shipped to tasks in the closure."""
    if mode == "dictionary":
        entries = dictionary.normalised(case_sensitive)
        words = [e.norm for e in entries]
        # per word: list of (group, display)
        emit = [[(g, e.display) for g in e.groups] for e in entries]
    elif mode == "boundary":
        words, emit, index = [], [], {}
        for g, kw, low in dictionary.boundary_entries():
            if low not in index:
                index[low] = len(words)
                words.append(low)
                emit.append([])
            emit[index[low]].append((g, kw))
    else:
        raise ValueError(f"unknown match mode {mode!r}")
    key = dictionary.fingerprint(case_sensitive, mode)
    return key, words, emit


def _normalise_text(mode: str, case_sensitive: bool, newline_fix: bool):
    if mode == "boundary":
        if newline_fix:
            return lambda s: s.replace("\r\n", "\n").replace("\r", "\n").lower()
        return str.lower
    return (lambda s: s) if case_sensitive else str.casefold


def hit_counter(spec, mode: str, case_sensitive: bool, newline_fix: bool = False):
    """``count(body, pre='', post='', cross=False) -> {word index: hits}`` for use inside tasks.

    Dictionary mode counts every overlapping occurrence; boundary mode
    gives 1 for a word with at least one occurrence bordered like Python's
    ``\\b``.  Only hits starting in ``body`` count (``pre``/``post`` are
    context); with ``cross`` only those reaching into ``post``, with
    ``within`` only those ending inside ``body``.
    """
    key, words, _ = spec
    norm = _normalise_text(mode, case_sensitive, newline_fix)
    boundary = mode == "boundary"
    first_word = [is_word_char(w[0]) for w in words]
    last_word = [is_word_char(w[-1]) for w in words]
    state = {}

    def count(body: str, pre: str = "", post: str = "", cross: bool = False, within: bool = False) -> dict:
        auto = state.get("a")
        if auto is None:
            auto = state["a"] = _automaton(key, words)
        if pre or post:
            # normalised in one piece (a letter's lower case may depend on its neighbours); lengths do not depend on them
            t = norm(pre + body + post)
            lo = len(norm(pre))
            hi = lo + len(norm(body))
        else:
            t = norm(body)
            lo, hi = 0, len(t)
        edge = hi if cross else 0
        last = hi - 1 if within else len(t)
        n = len(t)
        found: dict = {}
        for end, (w, ln) in auto.iter(t):
            start = end - ln + 1
            if start < lo or start >= hi or end + 1 <= edge or end > last:
                continue
            if boundary:
                before = t[start - 1] if start > 0 else " "
                after = t[end + 1] if end + 1 < n else " "
                if is_word_char(before) == first_word[w] or is_word_char(after) == last_word[w]:
                    continue
                found[w] = 1
            else:
                found[w] = found.get(w, 0) + 1
        return found

    return count


def _count_job(keys: Sequence[str], text_col: str, mode: str, case_sensitive: bool,
               spec, newline_fix: bool, windowed: bool, within: bool = False, totals: bool = False):
    """The per-partition function of the automaton form.

    Windowed rows (unit seams) carry ``_pre``/``_post`` context and a ``_cross`` flag: only
    hits that start inside the body count, and with ``_cross`` only those
    that also reach into ``_post`` (hits spanning a unit seam).  Consecutive
    rows with the same keys are summed before they are emitted, also across Arrow batches.  With ``totals`` every stretch of
    rows with the same keys, hits or not, has a row without a keyword as well: its UTF-8 bytes and number of hits.
    Arrow batches are taken and given in bounded pieces, so a task's memory does not grow with them.
    """
    emit = spec[2]
    count = hit_counter(spec, mode, case_sensitive, newline_fix)
    keys = list(keys)
    boundary = mode == "boundary"

    def values(column: pa.Array) -> list:
        out = column.to_pylist()
        if column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
            return [float("nan") if x is None else x for x in out]      # rows without a number are never the same row
        return out

    def frame(types, text_type, key_rows, groups, kws, counts, sizes):
        own = [pa.array([r[i] for r in key_rows], t, from_pandas=True) for i, t in enumerate(types)]
        own += [pa.array(groups, text_type), pa.array(kws, text_type), pa.array(counts, pa.int64())]
        own += [pa.array(sizes, pa.int64())] if totals else []
        return pa.RecordBatch.from_arrays(own, [*keys, "keyword_group", "keyword", "count", *(["bytes_read"] if totals else [])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        types, text_type = [], pa.string()
        cur_key, cur, cur_bytes = None, {}, 0
        key_rows, groups, kws, counts, sizes = [], [], [], [], []

        def row(g, kw, c, size=0):
            key_rows.append(cur_key)
            groups.append(g)
            kws.append(kw)
            counts.append(c)
            sizes.append(size)

        def flush():
            for w, c in cur.items():
                for g, kw in emit[w]:
                    row(g, kw, c)
            if totals and cur_key is not None:
                row(None, None, sum(cur.values()), cur_bytes)

        for batch in pieces(batches):
            types, text_type = [batch.column(k).type for k in keys], batch.column(text_col).type
            texts = batch.column(text_col).to_pylist()
            key_vals = list(zip(*[values(batch.column(k)) for k in keys])) if keys else [()] * len(texts)
            if windowed:
                pres = batch.column("_pre").to_pylist()
                posts = batch.column("_post").to_pylist()
                crosses = batch.column("_cross").to_pylist()
            for i, body in enumerate(texts):
                k = key_vals[i]
                if k != cur_key:
                    flush()
                    cur_key, cur, cur_bytes = k, {}, 0
                if not body:
                    continue
                cur_bytes += len(body.encode("utf-8", "surrogatepass")) if totals else 0
                found = (count(body, pres[i] or "", posts[i] or "", bool(crosses[i]), within) if windowed
                         else count(body))
                for w, c in found.items():
                    cur[w] = max(cur.get(w, 0), c) if boundary else cur.get(w, 0) + c
            # emit what is complete; the current row may continue in the next batch
            if groups:
                yield frame(types, text_type, key_rows, groups, kws, counts, sizes)
                key_rows, groups, kws, counts, sizes = [], [], [], [], []
        flush()
        if groups:
            yield frame(types, text_type, key_rows, groups, kws, counts, sizes)

    return run


SPREAD_MAX_BYTES_PER_CORE = 128 << 20
SPREAD_MIN_BYTES = 4 << 20   # below this one task is quicker than an extra shuffle stage


def _input_bytes(spark, paths) -> int:
    """Total size of the input files (file-system metadata only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        total += hp.getFileSystem(conf).getFileStatus(hp).getLen()
    return total


def spread_target(df: DataFrame) -> int:
    """Partitions to spread a CPU-heavy map over when the input is too coarse.

    Spreads (hash by row key) only when the input comes from fewer files
    than cores *and* is small — under 128 MiB per core — so the shuffle it
    adds is cheap; inputs under 4 MiB are left alone (a stage costs more).  At cluster scale (thousands of files, or files large
    enough to hold several row groups) it returns 0 and the bulk text is
    never shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    try:
        files = df.inputFiles()
    except Exception:  # pragma: no cover - non-file relations
        files = []
    if files:
        if len(files) >= cores:
            return 0
        try:
            size = _input_bytes(spark, files)
            if size > cores * SPREAD_MAX_BYTES_PER_CORE or size < SPREAD_MIN_BYTES:
                return 0
        except Exception:  # pragma: no cover - unknown file system
            pass
        return cores
    return cores if df.rdd.getNumPartitions() < cores else 0


def _reduce_facts(facts: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    agg = F.max("count") if mode == "boundary" else F.sum("count")
    return facts.groupBy(*keys, "keyword_group", "keyword").agg(agg.cast("bigint").alias("count"))


def match_units(units: DataFrame, dictionary: KeywordDictionary, *, keys: Sequence[str],
                text_col: str = "text", mode: str = "dictionary", case_sensitive: bool = False,
                method: str = "automaton", spread: bool | int = True, totals: bool = False) -> DataFrame:
    """Facts ``(keys..., keyword_group, keyword, count)`` for every row of ``units``.

    ``count`` is the overlapping hit count (dictionary mode) or 1 (boundary
    mode); rows without hits produce no facts.  Boundary mode reads texts with
    universal newlines, as a file opened as text is.  ``spread``
    (default: automatic, see :func:`spread_target`) hash-distributes the
    rows first when the input has fewer files than cores.  ``totals`` (automaton only) adds ``bytes_read`` and, for every
    row, one without a keyword: the text's bytes and number of hits, so that facts and files come from one read.
    """
    keys = list(keys)
    n_spread = spread_target(units) if spread is True else int(spread or 0)
    if method == "native" and len(dictionary.entries) > NATIVE_MAX_ENTRIES:
        method = "automaton"   # one projection per keyword stops paying off; same results
    if method == "native":
        if n_spread:
            units = units.select(*keys, text_col).repartition(n_spread, *keys)
        return _native(units, dictionary, keys, text_col, mode, case_sensitive)
    if method != "automaton":
        raise ValueError(f"unknown method {method!r}")

    spec = plan_spec(dictionary, mode, case_sensitive)
    schema = _fact_schema(units, keys)
    if totals:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema] + [T.StructField("bytes_read", T.LongType())])
    slim = units.select(*keys, text_col)
    if n_spread:
        slim = slim.repartition(n_spread, *keys)
    return slim.mapInArrow(_count_job(keys, text_col, mode, case_sensitive, spec, mode == "boundary", False, totals=totals), schema)


# ---------------------------------------------------------------- native form
def _native(units: DataFrame, dictionary: KeywordDictionary, keys: list, text_col: str,
            mode: str, case_sensitive: bool) -> DataFrame:
    if mode == "dictionary":
        entries = dictionary.normalised(case_sensitive)
        chars = set("".join(e.norm for e in entries))
        t = F.col(text_col) if case_sensitive else casefold_col(F.col(text_col), chars)
        staged = units.select(*keys, t.alias("_t"))
        cand = [F.when(F.instr("_t", e.norm) > 0,
                       F.struct(F.lit(list(e.groups)).alias("groups"),
                                F.lit(e.display).alias("keyword"),
                                F.regexp_count("_t", F.lit(overlap_count_regex(e.norm)))
                                .cast("bigint").alias("count")))
                for e in entries]
        hits = staged.select(*keys, F.explode(F.filter(F.array(*cand), lambda x: x.isNotNull())).alias("_m"))
        return hits.select(*keys, F.explode("_m.groups").alias("keyword_group"),
                           F.col("_m.keyword").alias("keyword"), F.col("_m.count").alias("count"))
    entries = dictionary.boundary_entries()
    staged = units.select(*keys, F.lower(F.regexp_replace(text_col, "\r\n?", "\n")).alias("_t"))
    cand = [F.when((F.instr("_t", low) > 0) & F.col("_t").rlike(boundary_regex(low)),
                   F.struct(F.lit(g).alias("keyword_group"), F.lit(kw).alias("keyword")))
            for g, kw, low in entries]
    hits = staged.select(*keys, F.explode(F.filter(F.array(*cand), lambda x: x.isNotNull())).alias("_m"))
    return hits.select(*keys, "_m.keyword_group", "_m.keyword", F.lit(1).cast("bigint").alias("count"))


# ---------------------------------------------------------------- public forms
def match_dictionary(units: DataFrame, dictionary: KeywordDictionary, *, keys: Sequence[str],
                     text_col: str = "text", case_sensitive: bool = False,
                     method: str = "automaton", **kw) -> DataFrame:
    """M2/M3: overlapping substring counts per row (case-folded unless ``case_sensitive``)."""
    return match_units(units, dictionary, keys=keys, text_col=text_col, mode="dictionary",
                       case_sensitive=case_sensitive, method=method, **kw)


def match_boundary(units: DataFrame, dictionary: KeywordDictionary, *, keys: Sequence[str],
                   text_col: str = "text", method: str = "automaton", **kw) -> DataFrame:
    """M1: lower-cased whole-word existence per row (count is 1)."""
    return match_units(units, dictionary, keys=keys, text_col=text_col, mode="boundary",
                       method=method, **kw)


def roll_up(facts: DataFrame, keys: Sequence[str], mode: str = "dictionary") -> DataFrame:
    """Unit facts to a coarser grain (unit scope, M5): sum counts, or any-hit."""
    return _reduce_facts(facts, list(keys), mode)


CHUNK = 1 << 16           # characters of unit ends that are matched at once


def _seam_job(file_keys: list, mode: str, case_sensitive: bool, spec, size: int):
    """Hits at unit borders from a file's unit ends, which arrive chunk by chunk, each in order.

    A chunk counts the hits that start in it: in dictionary mode those that reach over a border, in boundary mode also those
    that touch one (their neighbours are here), but none beside a cut, where the middle of a long unit is left out.
    """
    key, words, emit = spec
    norm = _normalise_text(mode, case_sensitive, False)
    boundary = mode == "boundary"
    first_word, last_word = [is_word_char(w[0]) for w in words], [is_word_char(w[-1]) for w in words]

    def hits(chunk: int, pieces: list) -> dict:
        begin = pieces[0][0]
        s = "".join(p[1] for p in pieces)
        at, marks, cuts = 0, [], []               # borders and cuts as places in the normalised text
        for _, text, border, cut in pieces:
            if border:
                marks.append(at)
            if cut:
                cuts.append(at)
            at += len(norm(text))
        lo = len(norm(s[:max(0, chunk * size - begin)]))
        hi = len(norm(s[:max(0, (chunk + 1) * size - begin)]))
        t, n = norm(s), at
        found: dict = {}
        for end, (w, ln) in _automaton(key, words).iter(t):
            start, end = end - ln + 1, end + 1
            if not lo <= start < hi:
                continue
            i = bisect_left(marks, start) if boundary else bisect_right(marks, start)
            if i == len(marks) or (marks[i] > end if boundary else marks[i] >= end):
                if not (boundary and end == n):   # the file's end is a border as well
                    continue
            j = bisect_left(cuts, start - 1)
            if j < len(cuts) and cuts[j] <= end:
                continue
            if boundary:
                before, after = t[start - 1] if start else " ", t[end] if end < n else " "
                if is_word_char(before) == first_word[w] or is_word_char(after) == last_word[w]:
                    continue
                found[w] = 1
            else:
                found[w] = found.get(w, 0) + 1
        return found

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        current, pieces = None, []

        def facts():
            return [(*current[:-1], g, kw, c) for w, c in hits(current[-1], pieces).items() for g, kw in emit[w]] if pieces else []

        for pdf in batches:
            out = []
            for row in zip(*[pdf[c] for c in [*file_keys, "_chunk", "_at", "_text", "_border", "_cut"]]):
                own = row[:len(file_keys) + 1]
                if own != current:
                    out += facts()
                    current, pieces = own, []
                pieces.append(row[len(file_keys) + 1:])
            if out:
                yield pd.DataFrame(out, columns=[*file_keys, "keyword_group", "keyword", "count"])
        if out := facts():
            yield pd.DataFrame(out, columns=[*file_keys, "keyword_group", "keyword", "count"])

    return run


def match_file_scope(units: DataFrame, dictionary: KeywordDictionary, *, file_keys: Sequence[str],
                     idx_col: str = "unit_idx", text_col: str = "text", mode: str = "dictionary",
                     case_sensitive: bool = False, **kw) -> DataFrame:
    """M5 file scope: units of a file matched as one text joined with ''.

    ``idx_col`` orders the units of a file; gaps and empty units do not matter.  Hits
    inside a unit come from a map over the units; hits at a border between units come from the units' ends: a short unit
    whole, of a long one as many characters as the longest keyword has, first and last.  The ends lie one after the other by
    a running sum of their lengths; one exchange deals them into overlapping chunks keyed (file, chunk), so the
    work is linear in the ends, whatever the longest keyword, and a file with many units is many tasks.
    Texts are read by the map only and never joined.  In boundary mode the map counts what
    touches no end of its unit, since a word border there depends on the next unit.
    """
    file_keys = list(file_keys)
    boundary = mode == "boundary"
    spec = plan_spec(dictionary, mode, case_sensitive)
    reach = max(len(w) for w in spec[1]) + 2
    size = max(CHUNK, 4 * reach)
    text = F.regexp_replace(text_col, "\r\n?", "\n") if boundary else F.col(text_col)
    base = units.select(*file_keys, idx_col, text.alias(text_col)).where(F.length(text_col) > 0)
    t = F.col(text_col)
    if boundary:
        rows = base.select(*file_keys, idx_col, F.left(t, F.lit(1)).alias("_pre"), F.expr(f"substring({text_col}, 2, length({text_col}) - 2)").alias(text_col),
                           F.right(t, F.lit(1)).alias("_post"), F.lit(False).alias("_cross")).where(F.length(text_col) > 0)
        inside = rows.mapInArrow(_count_job([*file_keys, idx_col], text_col, mode, case_sensitive, spec, False, True, within=True),
                                  _fact_schema(rows, [*file_keys, idx_col]))
    else:
        inside = match_units(base, dictionary, keys=[*file_keys, idx_col], text_col=text_col,
                             mode=mode, case_sensitive=case_sensitive, **kw)
    long = F.length(t) > 2 * reach
    ends = base.select(*file_keys, idx_col, F.when(long, F.left(t, F.lit(reach))).otherwise(t).alias("_head"),
                       F.when(long, F.right(t, F.lit(reach))).alias("_tail"))
    length = F.length("_head") + F.when(F.col("_tail").isNull(), 0).otherwise(F.length("_tail") + 1)
    w = Window.partitionBy(*file_keys).orderBy(idx_col).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*file_keys, "_head", "_tail", F.coalesce(F.sum(length.cast("long")).over(w), F.lit(0)).alias("_off"))
    piece = lambda at, text, border, cut: F.struct(at.alias("_at"), text.alias("_text"), F.lit(border).alias("_border"), F.lit(cut).alias("_cut"))
    after = F.col("_off") + F.length("_head")
    pieces = ends.select(*file_keys, F.explode(F.filter(F.array(
        piece(F.col("_off"), F.col("_head"), True, False),
        F.when(F.col("_tail").isNotNull(), piece(after, F.lit("\uffff"), False, True)),
        F.when(F.col("_tail").isNotNull(), piece(after + 1, F.col("_tail"), False, False))), lambda x: x.isNotNull())).alias("_p")).select(*file_keys, "_p.*")
    # a chunk needs the character before it and a keyword's length after it
    chunks = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_at") - reach) / size)), F.floor((F.col("_at") + F.length("_text")) / size))
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (pieces.select(*file_keys, F.explode(chunks).alias("_chunk"), "_at", "_text", "_border", "_cut")
             .repartition(n, *file_keys, "_chunk").sortWithinPartitions(*file_keys, "_chunk", "_at"))
    seams = dealt.mapInPandas(_seam_job(file_keys, mode, case_sensitive, spec, size), _fact_schema(dealt, file_keys))
    return roll_up(inside.select(*file_keys, "keyword_group", "keyword", "count").unionByName(seams), file_keys, mode)
