"""Byte ranges: a file's text and hits are the same however many tasks read it."""

import random

import pytest
from pyspark.sql import functions as F

from quarry import KeywordDictionary
from quarry.operators.match import hit_counter, plan_spec
from quarry.plans.jobs import evidence_scan, keyword_report
from quarry.plans.scan import scan_tree
from quarry.sources import files as S
from quarry.sources import ranges as R

D = KeywordDictionary({"g1": ["needle", "straße", "a\nb"], "g2": ["needle", "ΟΔΟΣ", "中文字", "aa"]})


def mixed_bytes(seed: int, n: int = 4000) -> bytes:
    rng = random.Random(seed)
    parts = [b"needle", "Straße ".encode(), "ΟΔΟΣ ".encode(), "ΟΔΟΣΑ".encode(), "中文字".encode(), b"a\r\nb", b"a\nb", b"aaaa", b" ", b"\n",
             "\U0001F600é".encode(), b"\xff", b"\xe2\x82", b"\x80\x80\x80\x80\x80", b"\xf0\x9f", "ß".encode(), b"x" * 30]
    return b"".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("step", [1, 2, 3, 5, 7, 64, 1000, 10**9])
def test_pieces_make_up_the_text(tmp_path, monkeypatch, step):
    monkeypatch.setattr(R, "PIECE_BYTES", max(1, step // 2))
    data = mixed_bytes(1, 200)
    (tmp_path / "f.txt").write_bytes(data)
    whole, path = data.decode("utf-8", errors="ignore"), f"file://{tmp_path}/f.txt"
    at, texts = 0, []
    for o in range(0, len(data), step):
        for _, _, _, pre, text, post, error in R.pieces(path, len(data), o, min(step, len(data) - o), 5):
            assert not error and whole.startswith(text, at)
            assert pre == whole[max(0, at - 5):at] and post == whole[at + len(text):][:5]
            at += len(text)
            texts.append(text)
    assert "".join(texts) == whole


@pytest.mark.parametrize("mode", ["dictionary", "boundary"])
def test_hits_are_the_same_for_one_range_and_for_many(spark, tmp_path, mode):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    texts = {"big.txt": mixed_bytes(3), "sub/other.log": mixed_bytes(4, 1500), "no_suffix": mixed_bytes(5, 300), "e.txt": b"",
             "one.unknown": b"a needle of an unknown type " * 40, "bin.unknown": b"\0needle" * 400}
    for name, data in texts.items():
        (tmp_path / "in" / name).write_bytes(data)
    spec = plan_spec(D, mode, False)
    expected = {}
    for name, data in texts.items():
        if name == "bin.unknown":
            continue
        text = data.decode("utf-8", errors="ignore")
        for w, c in hit_counter(spec, mode, False, newline_fix=mode == "boundary")(text).items():
            expected.update({(name, g, kw): c for g, kw in spec[2][w]})
    assert len(expected) > 10
    listing = S.list_files(spark, str(tmp_path / "in"))
    named = listing.select(F.col("rel_path").alias("source_path"), "path", "size", "mtime")
    flags = None
    for split in (None, max(map(len, texts.values())) // 50, 37):
        r = scan_tree(named, D, mode=mode, split_text_bytes=split)
        assert {(x.source_path, x.keyword_group, x.keyword): x["count"] for x in r.facts.collect()} == expected
        own = {x.source_path: (x.size, x.bytes_read, x.matched, x.error, x.mtime) for x in r.files.collect()}
        assert flags is None or own == flags
        flags = own
        r.release()
    assert len(flags) == len(texts) and flags["bin.unknown"][1:4] == (0, False, "")


def test_data_source_reads_the_same_text(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for i, name in enumerate(["a.txt", ".hidden", "deep/_b.txt", "deep/er/c d.txt", "deep/empty"]):
        (tmp_path / name).write_bytes(b"" if name.endswith("empty") else mixed_bytes(i, 300))
    whole = {f.relative_to(tmp_path).as_posix(): f.read_bytes().decode("utf-8", errors="ignore") for f in tmp_path.rglob("*") if f.is_file()}
    for step in (10**9, 100):
        df = R.text_range_source(spark, str(tmp_path), step, 3)
        rows = sorted(df.collect(), key=lambda r: (r.path, r.offset))
        got = {}
        for r in rows:
            got[r.path] = got.get(r.path, "") + r.text
        assert {p.split(f"{tmp_path}/")[1]: t for p, t in got.items()} == whole
        assert df.rdd.getNumPartitions() >= (1 if step > 1000 else 20)
    one = R.text_range_source(spark, str(tmp_path / "a.txt")).collect()
    assert [(r.offset, r.pre, r.post, r.text) for r in one] == [(0, "", "", whole["a.txt"])]
    with pytest.raises(Exception, match="rangeBytes"):
        R.text_range_source(spark, str(tmp_path), 0).count()


def test_a_file_that_is_gone_is_an_error_row(spark, tmp_path):
    rows = spark.createDataFrame([(f"file://{tmp_path}/gone.txt", 10)], "path string, size long")
    (r,) = R.read_ranges(R.text_ranges(rows, 4)).where("offset = 0").collect()
    assert r.text is None and "FileNotFoundError" in r.error
    big = spark.createDataFrame([("gone.txt", f"file://{tmp_path}/gone.txt", 100)], "source_path string, path string, size long")
    (f,) = scan_tree(big, D, split_text_bytes=10).files.collect()
    assert f.source_path == "gone.txt" and "FileNotFoundError" in f.error and not f.matched


def test_links_are_listed_once_and_a_dangling_link_fails(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("a needle")
    (root / "sub" / "b.txt").write_text("a needle")
    (root / "loop").symlink_to(root)
    (root / "sub" / "up").symlink_to("..")
    (root / "c.txt").symlink_to(root / "a.txt")
    (root / "gone.txt").symlink_to(root / "nowhere")
    import os
    os.mkfifo(root / "pipe.txt")
    names = sorted(r.rel_path for r in S.list_files(spark, str(root)).collect())
    assert names == ["a.txt", "c.txt", "gone.txt", "pipe.txt", "sub/b.txt"]
    result = evidence_scan(spark, str(root), D, str(tmp_path / "out"))
    files = {r.source_path: r for r in result.result.files.collect()}
    assert sorted(files) == names and "FileNotFoundError" in files["gone.txt"].error and files["pipe.txt"].error
    assert {p for p, r in files.items() if r.matched} == {"a.txt", "c.txt", "sub/b.txt"} and result.metrics["failed"] == 2


def test_reports_agree_with_and_without_ranges(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.txt").write_bytes(mixed_bytes(8, 3000))
    keyword_report(spark, str(tmp_path / "in"), D, str(tmp_path / "one"))
    monkeypatch.setattr(R, "RANGE_BYTES", 500)
    keyword_report(spark, str(tmp_path / "in"), D, str(tmp_path / "many"))
    a, b = (sorted(r.keyword for r in spark.read.parquet(f"{tmp_path}/{o}/facts").collect()) for o in ("one", "many"))
    assert a == b and len(a) > 3
