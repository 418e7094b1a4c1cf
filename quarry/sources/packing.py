"""Pack table rows into container files (zip, tar.gz, gz, docx, odt, eml).

Used to exercise the container readers on the given tables: every packed
file holds rows of ``documents`` (bounded groups of ``per_archive`` rows),
so unpacking and matching must give the facts of the rows themselves.
Some archives also carry a nested zip, an unsafe member name, or are
truncated on purpose, to exercise error rows.
"""

from __future__ import annotations

import email.policy
import gzip
import io
import tarfile
import zipfile
from binascii import b2a_base64, crc32
from collections import namedtuple
from typing import Iterable
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.batches import pieces

PACKED = T.StructType([
    T.StructField("source_path", T.StringType()),
    T.StructField("content", T.BinaryType()),
])


def _member_name(lang: str, doc_id: int) -> str:
    return f"{lang}/{doc_id}.txt"


def _pack_group(damage: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        bucket = int(pdf["bucket"].iloc[0])
        kind = "zip" if bucket % 2 == 0 else "tar"
        names = [_member_name(l, int(i)) for l, i in zip(pdf["lang"], pdf["doc_id"])]
        texts = [t.encode("utf-8") for t in pdf["text"]]
        bio = io.BytesIO()
        if kind == "zip":
            with zipfile.ZipFile(bio, "w", zipfile.ZIP_DEFLATED) as zf:
                half = len(names) // 2
                for n, t in zip(names[:half], texts[:half]):
                    zf.writestr(n, t)
                inner = io.BytesIO()
                with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z2:
                    for n, t in zip(names[half:], texts[half:]):
                        z2.writestr(n, t)
                zf.writestr("inner/nested.zip", inner.getvalue())
                if bucket % 4 == 0:
                    zf.writestr("../escape.txt", b"outside the root")
            data = bio.getvalue()
            if damage and bucket % 9 == 5:
                data = data[: len(data) // 2]   # truncated: an error row
            path = f"archives/{bucket}.zip"
        else:
            with tarfile.open(fileobj=bio, mode="w:gz") as tf:
                for n, t in zip(names, texts):
                    info = tarfile.TarInfo(n)
                    info.size = len(t)
                    tf.addfile(info, io.BytesIO(t))
            data = bio.getvalue()
            path = f"archives/{bucket}.tar.gz"
        return pd.DataFrame({"source_path": [path], "content": [data]})
    return pack


def _parts(df: DataFrame) -> int:
    s = df.sparkSession
    return max(int(s.conf.get("spark.sql.shuffle.partitions")), s.sparkContext.defaultParallelism)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table stored as too few files for the cores, spread by key before Python work."""
    from quarry.operators.match import spread_target
    n = spread_target(df)
    return df.repartition(max(n, _parts(df)), *keys) if n else df


def pack_archives(documents: DataFrame, per_archive: int = 8, damage: bool = False) -> DataFrame:
    """Documents packed ``per_archive`` at a time: even buckets as zip (half in a nested zip), odd as tar.gz.

    With ``damage`` every ninth bucket's zip is cut in half (for the error rows).

    Groups are bounded (``per_archive`` rows); the explicit repartition on
    the group key is what ``groupBy`` reuses, and keeps AQE from folding
    the small, CPU-heavy packing stage into one task.
    """
    d = documents.withColumn("bucket", F.floor(F.col("doc_id") / per_archive).cast("long"))
    d = d.repartition(_parts(d), "bucket")
    return d.groupBy("bucket").applyInPandas(_pack_group(damage), PACKED)


PACK_BYTES = 8 << 20      # of files after which a task hands out what it has


def _map_rows(*makers):
    """Every row (``doc_id, source, text``) as the file of each maker, in bounded batches."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        paths, blobs, held = [], [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(blobs, pa.binary())], PACKED.fieldNames())
        for batch in pieces(batches):
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                row = _Row(*values)
                for make in makers:
                    p, b = make(row)
                    paths.append(p)
                    blobs.append(b)
                    held += len(b) + 100
                if held >= PACK_BYTES:
                    yield done()
                    paths, blobs, held = [], [], 0
        if paths:
            yield done()
    return run


_Row = namedtuple("_Row", "doc_id source text")


def _docx(row):
    paras = "".join(f"<w:p><w:r><w:t xml:space=\"preserve\">{escape(line)}</w:t></w:r></w:p>"
                    for line in row.text.split("\n"))
    doc = ("<?xml version=\"1.0\" encoding=\"UTF-8\" standalone=\"yes\"?>"
           "<w:document xmlns:w=\"http://schemas.openxmlformats.org/wordprocessingml/2006/main\">"
           f"<w:body>{paras}</w:body></w:document>")
    rels = ("<?xml version=\"1.0\" encoding=\"UTF-8\"?>"
            "<Relationships xmlns=\"http://schemas.openxmlformats.org/package/2006/relationships\">"
            f"<Relationship Id=\"rId1\" Type=\"hyperlink\" Target=\"https://example.org/{row.doc_id}\"/>"
            "</Relationships>")
    bio = io.BytesIO()
    with zipfile.ZipFile(bio, "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("word/document.xml", doc)
        zf.writestr("word/_rels/document.xml.rels", rels)
        zf.writestr("word/embeddings/note.txt", row.text.encode("utf-8"))
    return f"office/{row.source}/{row.doc_id}.docx", bio.getvalue()


def _odt(row):
    ns = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    paras = "".join(f"<text:p>{escape(line)}</text:p>" for line in row.text.split("\n"))
    content = (f"<?xml version=\"1.0\" encoding=\"UTF-8\"?><office:document-content "
               f"xmlns:office=\"urn:oasis:names:tc:opendocument:xmlns:office:1.0\" xmlns:text=\"{ns}\">"
               f"<office:body><office:text>{paras}</office:text></office:body></office:document-content>")
    bio = io.BytesIO()
    with zipfile.ZipFile(bio, "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("mimetype", "application/vnd.oasis.opendocument.text")
        zf.writestr("content.xml", content)
    return f"office/{row.source}/{row.doc_id}.odt", bio.getvalue()


def _base64(data: bytes) -> bytes:
    """Lines of 76 characters, the last without an end."""
    b = b2a_base64(data, newline=False)
    return b"\n".join([b[i:i + 76] for i in range(0, len(b), 76)])


def _eml(row):
    """Bytes as the ``email`` package writes them (mixed: alternative of plain and HTML text, attachment), but for its random boundaries."""
    fold = email.policy.compat32.fold_binary
    subject = row.text.split("\n", 1)[0][:60].replace("\r", " ")
    text, html = row.text.encode("utf-8"), f"<html><body><p>{escape(row.text)}</p></body></html>".encode("utf-8")
    outer, inner = (b"=" * 15 + b"%019d==" % (2 * crc32(text) + i) for i in (0, 1))
    body = lambda kind: (b'Content-Type: text/%s; charset="utf-8"\nMIME-Version: 1.0\nContent-Transfer-Encoding: base64\n\n' % kind)
    end = lambda data: b"\n" if data else b""  # noqa: E731  - a text body ends its last line itself
    plain = _base64(text)
    return f"mail/{row.source}/{row.doc_id}.eml", b"".join([
        b'Content-Type: multipart/mixed; boundary="', outer, b'"\nMIME-Version: 1.0\n', fold("From", f"{row.source}@example.org"),
        b"To: archive@example.org\n", fold("Subject", subject), b"\n--", outer,
        b'\nContent-Type: multipart/alternative;\n boundary="', inner, b'"\nMIME-Version: 1.0\n\n--', inner, b"\n",
        body(b"plain"), plain, end(text), b"\n--", inner, b"\n", body(b"html"), _base64(html), b"\n\n--", inner, b"--\n\n--", outer,
        b"\nContent-Type: application/octet-stream\nMIME-Version: 1.0\nContent-Transfer-Encoding: base64\n"
        b'Content-Disposition: attachment; filename="%s.txt"\n\n' % str(row.doc_id).encode(),
        plain, end(text), b"\n--", outer, b"--\n"])


def pack_office(documents: DataFrame, kind: str) -> DataFrame:
    """One container per document row: ``docx``, ``odt`` or ``eml``."""
    fn = {"docx": _docx, "odt": _odt, "eml": _eml}[kind]
    return _spread(documents.select("doc_id", "source", "text"), "doc_id").mapInArrow(_map_rows(fn), PACKED)


def _gz(row):
    return f"gz/{row.source}/{row.doc_id}.txt.gz", gzip.compress(row.text.encode("utf-8"))


def pack_mixed(documents: DataFrame) -> DataFrame:
    """Each document as a .docx, an .odt, an .eml and a .txt.gz — one pass over the table."""
    return _spread(documents.select("doc_id", "source", "text"), "doc_id").mapInArrow(_map_rows(_docx, _odt, _eml, _gz), PACKED)


def pack_gz(documents: DataFrame) -> DataFrame:
    """One gzip file per document row."""
    return _spread(documents.select("doc_id", "source", "text"), "doc_id").mapInArrow(_map_rows(_gz), PACKED)


def pack_xml(documents: DataFrame) -> DataFrame:
    """One XML file per document row: ``<doc title=..><p>line</p>...</doc>``."""
    def one(row):
        body = "".join(f"<p>{escape(line)}</p>" for line in row.text.split("\n"))
        xml = f"<?xml version=\"1.0\" encoding=\"UTF-8\"?><doc title=\"{row.source}\">{body}</doc>"
        return f"xml/{row.source}/{row.doc_id}.xml", xml.encode("utf-8")
    return _spread(documents.select("doc_id", "source", "text"), "doc_id").mapInArrow(_map_rows(one), PACKED)
