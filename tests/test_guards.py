"""Size guards report instead of dropping: error rows, refusals, same-result fallbacks."""

import gzip
import io
import os
import tempfile
import zipfile

import pytest

from quarry.operators.match import NATIVE_MAX_ENTRIES, match_dictionary
from quarry.plans.scan import scan_tree
from quarry.sources import dictionary as D
from quarry.sources import files as S


def test_dictionary_size_guard(monkeypatch):
    monkeypatch.setattr(D, "MAX_KEYWORDS", 5)
    with pytest.raises(ValueError):
        D.KeywordDictionary({"G": [f"k{i}" for i in range(6)]})


def test_native_falls_back_for_large_dictionaries(spark):
    words = [f"w{i}x" for i in range(NATIVE_MAX_ENTRIES + 10)]
    d = D.KeywordDictionary({"G": words})
    df = spark.createDataFrame([(0, "w1x w2x w260x w2x"), (1, "none")], "id long, text string")
    a = sorted(map(tuple, match_dictionary(df, d, keys=["id"], method="native").collect()))
    b = sorted(map(tuple, match_dictionary(df, d, keys=["id"], method="automaton").collect()))
    assert a == b and len(a) == 3


def test_no_member_is_too_large(spark):
    big = b"token " * 100_000
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("small.txt", b"token")
        f.writestr("big.txt", big)
    blobs = spark.createDataFrame([("a.zip", z.getvalue()), ("b.txt.gz", gzip.compress(big))], "source_path string, content binary")
    r = scan_tree(blobs, D.KeywordDictionary({"G": ["token"]}))
    assert r.files.where("error <> ''").count() == 0
    facts = {(x["source_path"], x["internal_path"]): x["count"] for x in r.facts.collect()}
    assert facts == {("a.zip", "small.txt"): 1, ("a.zip", "big.txt"): 100_000, ("b.txt.gz", "b.txt"): 100_000}


def _nested(levels: int) -> bytes:
    """A Word file in a Word file, so many levels deep."""
    inner = None
    for i in range(levels):
        z = io.BytesIO()
        with zipfile.ZipFile(z, "w") as f:
            f.writestr("word/document.xml", f"<d>token {i}</d>")
            if inner:
                f.writestr("word/embeddings/in.docx", inner)
        inner = z.getvalue()
    return inner


@pytest.mark.parametrize("depth, read, limited", [(0, 1, 1), (3, 4, 1), (7, 8, 0), (9, 8, 0)])
def test_every_file_found_has_a_row(spark, depth, read, limited):
    blobs = spark.createDataFrame([("a.docx", _nested(8))], "source_path string, content binary")
    r = scan_tree(blobs, D.KeywordDictionary({"G": ["token"]}), max_depth=depth)
    errors = [x["error"] for x in r.files.collect()]
    assert (errors.count(""), errors.count("depth limit"), len(errors)) == (read, limited, read + limited)


def test_split_and_whole_archives_agree_at_every_depth(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for i in range(5):
            f.writestr(f"{i}.docx", _nested(4))
    blobs = spark.createDataFrame([("a.zip", z.getvalue())], "source_path string, content binary")
    for depth in (1, 2, 4):
        got = []
        for split in (1 << 40, 500):
            r = scan_tree(blobs, D.KeywordDictionary({"G": ["token"]}), max_depth=depth, split_zip_bytes=split)
            got.append(sorted((x["internal_path"], x["error"]) for x in r.files.collect()))
        assert got[0] == got[1]


def test_tar_by_content_bad_parts_and_equal_names(spark):
    import tarfile
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("in.txt")
        info.size = 5
        f.addfile(info, io.BytesIO(b"token"))
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/first.xml", "<a>lost token</a>")
        f.writestr("word/second.xml", "<a>a token</a>")
    bad = z.getvalue().replace(b"lost token", b"l0st t0ken")          # its checksum no longer fits
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "old token token")
        f.writestr("a.txt", "new token")
    blobs = spark.createDataFrame([("backup.gz", t.getvalue()), ("b.docx", bad), ("c.zip", z.getvalue())], "source_path string, content binary")
    r = scan_tree(blobs, D.KeywordDictionary({"G": ["token"]}))
    files = [(x["source_path"], x["internal_path"], x["error"][:10]) for x in r.files.collect()]
    assert sorted(files) == [("b.docx", "", ""), ("b.docx", "word/first.xml", "BadZipFile"), ("backup.gz", "in.txt", ""), ("c.zip", "a.txt", "")]
    assert {(x["source_path"], x["count"]) for x in r.facts.collect()} == {("backup.gz", 1), ("b.docx", 1), ("c.zip", 1)}


def test_first_program_reports_what_it_cannot_read(spark):
    blobs = spark.createDataFrame([("bad.docx", b"no zip"), ("x.pdf", b"%PDF"), ("ok.txt", b"token")], "source_path string, content binary")
    r = scan_tree(blobs, D.KeywordDictionary({"G": ["token"]}), mode="boundary", max_depth=0, flavor="v1")
    assert {x["source_path"]: bool(x["error"]) for x in r.files.collect()} == {"bad.docx": True, "x.pdf": True, "ok.txt": False}


def test_texts_are_read_run_by_run(spark, tmp_path, monkeypatch):
    """A file above the read size gives the same facts, also with keywords, line ends and characters over the seams."""
    import random
    from quarry.sources import containers as X
    rng = random.Random(3)
    text = "".join(rng.choice(["token", "tok", "en ", "ΟΣΑ", " ΟΣ", "é", "\r\n", "xx", "\n", "ab cd"]) for _ in range(4000))
    (tmp_path / "big.txt").write_text(text, encoding="utf-8", newline="")
    d = D.KeywordDictionary({"G": ["token", "ΟΣΑ", "d\ntok", "ab cdab", "ab"]})
    for mode in ("dictionary", "boundary"):
        got = []
        for size in (1 << 30, 50):
            from quarry.operators.match import plan_spec
            job = X._scan_job(plan_spec(d, mode, False), mode, False, 3)
            monkeypatch.setattr(X, "READ_BYTES", size)
            import pandas as pd
            row = pd.DataFrame([("big.txt", "", 0, None, "text", None, None, f"file://{tmp_path}/big.txt", 1)], columns=[
                "source_path", "internal_path", "depth", "mtime_us", "format_class", "member_range", "content", "path", "listed_size"])
            out = pd.concat(job([row]))
            got.append(sorted((k, c) for k, c in zip(out["keyword"], out["count"]) if isinstance(k, str)))
            assert out["bytes_read"].max() == len(text.encode())
        assert got[0] == got[1] and got[0]


def test_a_vanished_file_is_an_error_row(spark, tmp_path):
    (tmp_path / "a.txt").write_text("token")
    (tmp_path / "b.txt").write_text("token")
    listing = S.list_files(spark, str(tmp_path)).collect()
    df = spark.createDataFrame([(r.path, r.rel_path, r.size) for r in listing], "path string, source_path string, size long")
    os.remove(tmp_path / "b.txt")
    r = scan_tree(df, D.KeywordDictionary({"G": ["token"]}))
    assert {x["source_path"]: x["error"][:17] for x in r.files.collect()} == {"a.txt": "", "b.txt": "FileNotFoundError"}
    assert [(x.rel_path, x.content is None, bool(x.error)) for x in S.read_contents(
        df.withColumnRenamed("source_path", "rel_path")).orderBy("rel_path").collect()] == [("a.txt", False, False), ("b.txt", True, True)]


def test_names_with_dots_underscores_and_any_spelling_of_the_root(spark, tmp_path):
    for name in (".env", "_notes.txt", ".git/x.txt", "a.txt", "_d/_e/f g.txt", "out/skip.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("token")
    expected = {".env", "_notes.txt", ".git/x.txt", "a.txt", "_d/_e/f g.txt"}
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/", f"{tmp_path}/"):
        assert {r.rel_path for r in S.list_files(spark, root, exclude="out").collect()} == expected
    assert {r.rel_path for r in S.list_files(spark, str(tmp_path), glob="*.txt").collect()} >= {"a.txt", "out/skip.txt"}
    r = scan_tree(S.list_files(spark, f"file://{tmp_path}", exclude="out").withColumnRenamed("rel_path", "source_path"),
                  D.KeywordDictionary({"G": ["token"]}))
    assert {x["source_path"] for x in r.facts.collect()} == expected
    assert "Join" not in r.facts._jdf.queryExecution().optimizedPlan().toString()
