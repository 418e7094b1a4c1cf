"""Containers by path: archive counters at any depth, bounded frames, big zips read by member ranges."""

import io
import random
import zipfile

import pytest

from quarry import KeywordDictionary
from quarry.operators.match import plan_spec
from quarry.plans.jobs import evidence_scan
from quarry.sources import containers as X

D = KeywordDictionary({"g": ["needle"]})


def zipped(members: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives_and_members_are_counted_at_any_depth(spark, tmp_path):
    (tmp_path / "in").mkdir()
    inner = zipped({"x.txt": "a needle"})
    (tmp_path / "in" / "a.zip").write_bytes(zipped({"one.zip": inner, "two.zip": inner, "t.txt": "no"}))
    (tmp_path / "in" / "bad.zip").write_bytes(b"PK\x03\x04 not a zip")
    r = evidence_scan(spark, str(tmp_path / "in"), D, str(tmp_path / "out"))
    assert (r.metrics["archives"], r.metrics["members"], r.metrics["matched"], r.metrics["failed"]) == (3, 5, 2, 1)


def test_counters_of_a_zip_in_ranges_and_of_one_read_whole(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    members = {f"m{i}.txt": random.Random(i).randbytes(300).hex() + " needle" for i in range(30)}
    (tmp_path / "in" / "a.zip").write_bytes(zipped(members))
    whole = evidence_scan(spark, str(tmp_path / "in"), D, str(tmp_path / "one"))
    monkeypatch.setattr(X, "DEFAULT_SPLIT_ZIP_BYTES", 1000)
    split = evidence_scan(spark, str(tmp_path / "in"), D, str(tmp_path / "many"))
    for r in (whole, split):
        assert (r.metrics["archives"], r.metrics["members"], r.metrics["matched"]) == (1, 30, 30)


def listed(paths):
    import pandas as pd
    n = len(paths)
    return pd.DataFrame({"source_path": [p.name for p in paths], "internal_path": [""] * n, "depth": [0] * n, "mtime_us": [0] * n,
                         "format_class": ["archive"] * n, "member_range": [None] * n, "content": [None] * n,
                         "path": [f"file://{p}" for p in paths], "listed_size": [p.stat().st_size for p in paths]})


def test_frames_are_bounded_whatever_a_batch_holds(tmp_path, monkeypatch):
    monkeypatch.setattr(X, "FRAME_BYTES", 1 << 20)
    paths = []
    for i in range(6):
        paths.append(tmp_path / f"{i}.zip")
        paths[-1].write_bytes(zipped({f"{k}.bin": random.Random(k).randbytes(400_000) for k in range(5)}))
    run = X._scan_job(plan_spec(D, "dictionary", False), "dictionary", False, 3)
    frames = list(run(iter([listed(paths)])))
    sizes = [sum(len(c or b"") for c in f["content"]) for f in frames]
    assert sum(sizes) == 6 * 5 * 400_000 and max(sizes) < (1 << 20) + 400_001 and len(frames) >= 10


def test_a_big_zip_by_path_is_read_by_seeking(tmp_path, monkeypatch):
    path = tmp_path / "a.zip"
    path.write_bytes(zipped({f"{k}.bin": random.Random(k).randbytes(100_000) for k in range(20)}))
    opened = []

    class Counted(io.FileIO):
        read_bytes = 0

        def readinto(self, b):
            n = super().readinto(b)
            self.read_bytes += n
            return n

        def read(self, n=-1):
            data = super().read(n)
            self.read_bytes += len(data)
            return data

    def seekable(p):
        opened.append(Counted(p.removeprefix("file://")))
        return opened[-1]

    monkeypatch.setattr(X, "_open_seekable", seekable)
    job = X._scan_job(plan_spec(D, "dictionary", False), "dictionary", False, 3, split_zip_bytes=510_000)
    (ranges,) = job(iter([listed([path])]))
    assert list(ranges["part_name"]) == ["0:5", "5:10", "10:15", "15:20"] and set(ranges["row_kind"]) == {"member"}
    assert ranges["content"].isna().all() and set(ranges["text"]) == {f"file://{path}"} and opened[0].read_bytes < 100_000
    one = listed([path]).assign(member_range=["5:10"])
    (members,) = job(iter([one]))
    found = members[members["row_kind"] == "member"]
    assert sorted(found["internal_path"]) == [f"{k}.bin" for k in range(5, 10)] and opened[1].read_bytes < 800_000
    (counter,) = members[members["row_kind"] == "archive"].itertuples()
    assert counter.count == 5


def test_rounds_stop_when_nothing_was_found_inside(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(zipped({"x.txt": "a needle"}))
    (tmp_path / "in" / "b.txt").write_text("plain")
    rounds = []
    monkeypatch.setattr(X, "cut_lineage", lambda df, cut=X.cut_lineage: rounds.append(1) or cut(df))
    evidence_scan(spark, str(tmp_path / "in"), D, str(tmp_path / "out"))
    assert len(rounds) == 2


@pytest.mark.parametrize("doc, text", [
    (b"<r>a<b>x</b>t<c/></r>", "a\nx\nt\n"), (b"<r/>", ""), (b"<r>a<!-- c -->b<x>1<!-- d -->2</x>3<!-- e -->4</r>", "ab\n12\n34"),
    (b"<r><a/><b>&lt;z</b> &amp; t</r>", "\n\n<z\n & t"), (b"<r>" + b"<d>" * 5000 + b"deep" + b"</d>" * 5000 + b"</r>", "\n" * 5000 + "deep")])
def test_nested_xml_text(doc, text):
    assert X.xml_text_nested(doc) == text


@pytest.mark.parametrize("doc", [b"", b"<r>", b"no xml", b"<r></s>"])
def test_bad_nested_xml_raises(doc):
    with pytest.raises(Exception):
        X.xml_text_nested(doc)
