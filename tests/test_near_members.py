"""Small members scanned where they are found; packed mails as the email package writes them."""

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from quarry import KeywordDictionary
from quarry.operators.match import plan_spec
from quarry.plans.scan import scan_tree
from quarry.sources import containers as X
from quarry.sources import packing as P
from quarry.sources.files import ARCHIVE_EXTENSIONS, ARCHIVE_NAME_ENDINGS, ODF_EXTENSIONS, OOXML_EXTENSIONS, TEXT_EXTENSIONS

D = KeywordDictionary({"g": ["needle", "hay"]})


def zipped(members: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def nested() -> list:
    deep = zipped({"d.txt": "needle needle"})
    for i in range(4):
        deep = zipped({f"in{i}.zip": deep, f"t{i}.txt": "a needle", "../up.txt": "needle", "empty.txt": "", "long.txt": "hay " * 500})
    mail = P._eml(P._Row(5, "s", "a needle\nin the hay"))[1]
    return [("a.zip", deep), ("b.zip", zipped({"m.eml": mail, "bad.zip": b"PK\x03\x04", "x.docx": P._docx(P._Row(1, "s", "hay"))[1]})), ("c.eml", mail)]


def scanned(spark, monkeypatch, near, files):
    monkeypatch.setattr(X, "NEAR_BYTES", near)
    blobs = spark.createDataFrame(files, "source_path string, content binary")
    r = scan_tree(blobs, D)
    tables = [r.files.drop("mtime"), r.facts, r.archives]
    e = X.expand(blobs)
    tables += [e.files.drop("mtime"), e.units, e.members]
    return [sorted(map(str, t.collect())) for t in tables]


def test_small_members_are_scanned_where_they_are_found(spark, monkeypatch):
    files = nested()
    want = scanned(spark, monkeypatch, 0, files)
    assert all(want) and all(scanned(spark, monkeypatch, near, files) == want for near in (1000, X.NEAR_TOTAL))
    monkeypatch.setattr(X, "NEAR_BYTES", 4 << 20)
    rows = X.scan_rounds(spark.createDataFrame(files, "source_path string, content binary"), plan_spec(D, "dictionary", False),
                         mode="dictionary", case_sensitive=False, max_depth=3, cached=(kept := []))
    assert rows.count() and len(kept) == 1                   # one round, and no bytes of a member are kept
    assert kept[0].where("content is not null or row_kind = 'member'").count() == 0


def test_many_small_members_of_one_file_are_dealt_out():
    data = zipped({f"{i}.txt": b"needle " * 400_000 for i in range(30)})
    row = {"source_path": "a.zip", "internal_path": "", "depth": 0, "mtime_us": None, "format_class": "archive", "member_range": None,
           "content": data, "path": None, "listed_size": None}
    kinds = {"depth": pa.int32(), "mtime_us": pa.int64(), "content": pa.binary(), "listed_size": pa.int64()}
    batch = pa.RecordBatch.from_pydict({k: pa.array([v], kinds.get(k, pa.string())) for k, v in row.items()})
    job = X._scan_job(plan_spec(D, "dictionary", False), "dictionary", False, 3, near=4 << 20, arrow=True)
    got = pa.Table.from_batches(list(job(iter([batch])))).to_pylist()
    sizes = {kind: [r["size"] for r in got if r["row_kind"] == kind] for kind in ("file", "member")}
    assert len(sizes["file"]) + len(sizes["member"]) == 30 and sum(sizes["file"]) <= X.NEAR_TOTAL < sum(sizes["file"]) + 2_800_000
    assert all(r["content"] for r in got if r["row_kind"] == "member")


def test_the_class_of_a_member_is_that_of_a_listed_file(spark):
    exts = [*ARCHIVE_EXTENSIONS, *TEXT_EXTENSIONS, *OOXML_EXTENSIONS, *ODF_EXTENSIONS, ".pdf", ".xls", ".eml", ".msg", ".bin", ".", ""]
    names = [f"{base}{e}" for e in [*exts, *ARCHIVE_NAME_ENDINGS] for base in ("a", "", "d/", "d.zip/x", "A.B", ".x", "é/ü")]
    names += [n.upper() for n in names] + ["a.txt\n", "a.\nzip", "a.zip\n", "x.tar.GZ", "a..zip", "İ.ZİP", "a.d/..txt"]
    rows = spark.createDataFrame([(n,) for n in names], "internal_path string").withColumn("source_path", F.lit("s.bin"))
    got = X.classify(rows.where("internal_path <> ''")).select("internal_path", "format_class").collect()
    assert {r.internal_path: X._class_of(r.internal_path) for r in got} == {r.internal_path: r.format_class for r in got}


def mailed(row):
    from email.mime.application import MIMEApplication
    from email.mime.multipart import MIMEMultipart
    from email.mime.text import MIMEText
    from xml.sax.saxutils import escape
    m = MIMEMultipart("mixed")
    m["From"] = f"{row.source}@example.org"
    m["To"] = "archive@example.org"
    m["Subject"] = row.text.split("\n", 1)[0][:60].replace("\r", " ")
    alt = MIMEMultipart("alternative")
    alt.attach(MIMEText(row.text, "plain", "utf-8"))
    alt.attach(MIMEText(f"<html><body><p>{escape(row.text)}</p></body></html>", "html", "utf-8"))
    m.attach(alt)
    att = MIMEApplication(row.text.encode("utf-8"), "octet-stream")
    att.add_header("Content-Disposition", "attachment", filename=f"{row.doc_id}.txt")
    m.attach(att)
    return m.as_bytes()


def test_mails_are_packed_as_the_email_package_writes_them():
    plain = lambda b: re.sub(rb"={15}\d{19}==", b"", b)
    for text in ("", "\n", "a", "a\n", "x" * 57, "x" * 57 + "\n", "é\n\nü" * 40, "\r\nx & <y>", "a long subject " * 9, "ä ö " * 30, "--=\n", "=?utf-8?q?x?="):
        row = P._Row(-3, "sé", text)
        assert plain(P._eml(row)[1]) == plain(mailed(row))
