"""Figures merged from each run's bitmaps equal the full recomputation; roll-ups to every container; file scope by offsets."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry import KeywordDictionary
from quarry.operators import merged as B
from quarry.operators import reports as A
from quarry.operators.facts import ancestor_rollup
from quarry.operators.match import hit_counter, match_file_scope, plan_spec
from quarry.operators import match as M

FILES = "source_path string, file_type string, size long, text string"
FACTS = "source_path string, keyword_group string, keyword string, count long, size long"


def run_of(rng, paths):
    files = [(p, rng.choice([".txt", ".md", ""]), rng.choice([0, 1, rng.randrange(10**12)]), rng.choice(["x", ""])) for p in paths]
    facts = [(p, g, k, 1, s) for p, _, s, _ in files for g, k in {(rng.choice("abc"), rng.choice("uvw")) for _ in range(rng.randint(0, 4))}]
    return files, facts


def test_merged_figures_after_four_runs_and_losses(spark, tmp_path):
    rng, out = random.Random(4), str(tmp_path)
    last, files, facts = {}, {}, {}
    for run in range(1, 5):
        paths = [f"f{i}" for i in range(120) if run == 1 or rng.random() < 0.3] + [f"new{run}_{i}" for i in range(10)]
        fi, fa = run_of(rng, paths)
        files.update({r[0]: r for r in fi})
        for p in paths:
            last[p], facts[p] = run, [r for r in fa if r[0] == p]
        for p in rng.sample(sorted(last), 5):
            del last[p]
        B.write_run(spark.createDataFrame(fi, FILES), spark.createDataFrame(fa, FACTS), out, run)
        if run == 3:                                       # a run written again replaces itself
            B.write_run(spark.createDataFrame(fi, FILES), spark.createDataFrame(fa, FACTS), out, run)
    latest = spark.createDataFrame(sorted(last.items()), "source_path string, run_id long")
    got = {tuple(r[:4]): (r.files, r.bytes, r.multi) for r in B.merged_rows(spark, out, latest).collect()}
    now = spark.createDataFrame([r for p in last for r in facts[p]], FACTS).withColumn("display_path", F.col("source_path"))
    there = spark.createDataFrame([files[p] for p in last], FILES)
    full = A.statistics_rows(now, there).collect()
    sums = {r for r in (A.PER_GROUP, A.PER_RUN)}
    assert got == {tuple(r[:4]): (r.files, r.bytes if r.what in sums else None, r.multi if r.what == A.PER_RUN else None) for r in full}
    document = A.statistics_document(B.merged_rows(spark, out, latest)).first()
    assert document == A.global_statistics(there, now).first()


def test_merged_figures_of_nothing(spark, tmp_path):
    B.write_run(spark.createDataFrame([], FILES), spark.createDataFrame([], FACTS), str(tmp_path), 1)
    latest = spark.createDataFrame([], "source_path string, run_id long")
    assert tuple(A.statistics_document(B.merged_rows(spark, str(tmp_path), latest)).first()) == ({}, {}, {}, 0, 0.0)


def test_hits_roll_up_to_every_container(spark):
    facts = spark.createDataFrame([("a.zip", "b.zip/c", "g", "k", 2), ("a.zip", "b.zip/dir/d.zip/e", "g", "k", 3), ("a.zip", "f", "g", "k", 1),
                                   ("a.zip", "b.zip/c", "g", "l", 1), ("plain.txt", "", "g", "k", 5)],
                                  "source_path string, internal_path string, keyword_group string, keyword string, count long")
    containers = spark.createDataFrame([("a.zip", ""), ("a.zip", "b.zip"), ("a.zip", "b.zip/dir/d.zip"), ("a.zip", "b.zip/c"), ("plain.txt", "")],
                                       "source_path string, internal_path string")
    got = sorted(tuple(r) for r in ancestor_rollup(facts, containers).collect())
    assert got == [("a.zip", "", "g", "k", 6, 3), ("a.zip", "", "g", "l", 1, 1), ("a.zip", "b.zip", "g", "k", 5, 2), ("a.zip", "b.zip", "g", "l", 1, 1),
                   ("a.zip", "b.zip/dir/d.zip", "g", "k", 3, 1)]


@pytest.mark.parametrize("mode", ["dictionary", "boundary"])
@pytest.mark.parametrize("chunk", [1 << 16, 40])
def test_file_scope_equals_the_joined_text(spark, monkeypatch, mode, chunk):
    monkeypatch.setattr(M, "CHUNK", chunk)
    d = KeywordDictionary({"g": ["needle", "a b", "aa", "ß", "x"], "h": ["needle in a haystack", "-", "İ"]})
    rng = random.Random(chunk)
    marks = ["needle", " in a haystack", "a", " ", "b", "-", "x", "STRASSE", "ß", "İ", "", "z" * 70, "needle in a hay" + "y" * 60, "\n", ". "]
    rows, texts = [], {}
    for f in range(12):
        for i in range(rng.choice([1, 5, 60, 200])):
            t = "".join(rng.choice(marks) for _ in range(rng.randint(0, 3)))
            rows.append((f"f{f}", 3 * i, t))
            texts[f"f{f}"] = texts.get(f"f{f}", "") + t
    rng.shuffle(rows)
    units = spark.createDataFrame(rows, "path string, unit_idx int, text string")
    got = {(r.path, r.keyword_group, r.keyword): r["count"] for r in match_file_scope(units, d, file_keys=["path"], mode=mode).collect()}
    spec = plan_spec(d, mode, False)
    count = hit_counter(spec, mode, False)
    assert got == {(p, g, k): c for p, t in texts.items() for w, c in count(t).items() for g, k in spec[2][w]}


def test_file_scope_takes_as_long_for_long_keywords(spark):
    units = spark.range(20_000).selectExpr("'f' AS path", "id AS unit_idx", "concat('some unit of text ', id) AS text")
    took = []
    for n in (8, 300):
        d = KeywordDictionary({"g": ["unit", "q" * n]})
        for _ in range(2):
            start = time.time()
            (row,) = match_file_scope(units, d, file_keys=["path"], spread=False).collect()
        took.append(time.time() - start)
        assert row["count"] == 20_000
    assert took[1] < 2 * took[0] + 2
