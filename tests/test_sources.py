"""File listing, exclusion, types, sniffing and decoding over a folder written from documents."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from quarry.functions.text import file_suffix, looks_textual, member_is_safe, sanitize_path, strip_html
from quarry.sources import files as S


def _folder(spark):
    d = tempfile.mkdtemp(prefix="quarry-src-")
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(30).collect()
    for r in rows:
        sub = os.path.join(d, "data", f"d{r['doc_id'] % 3}")
        os.makedirs(sub, exist_ok=True)
        ext = [".txt", ".md", ".bin"][r["doc_id"] % 3]
        with open(os.path.join(sub, f"{r['doc_id']}{ext}"), "w", encoding="utf-8") as f:
            f.write(r["text"])
    os.makedirs(os.path.join(d, "data", "out"), exist_ok=True)
    with open(os.path.join(d, "data", "out", "copy.txt"), "w") as f:
        f.write("copied evidence")
    with open(os.path.join(d, "data", "junk.dat"), "wb") as f:
        f.write(bytes(range(256)) * 4)
    return os.path.join(d, "data"), rows


def test_listing_exclusion_and_decode(spark):
    root, rows = _folder(spark)
    listing = S.list_files(spark, root, exclude="out")
    rel = {r["rel_path"] for r in listing.collect()}
    assert "out/copy.txt" not in rel and "junk.dat" in rel and len(rel) == len(rows) + 1
    assert "content" not in listing.columns                           # listing never reads contents
    full = S.read_contents(listing)
    assert "Join" not in full._jdf.queryExecution().executedPlan().toString()
    units = S.decode_units(full, path_col="rel_path")
    got = {r["rel_path"]: r["text"] for r in units.collect()}
    assert got["junk.dat"] == ""
    for r in rows:
        ext = [".txt", ".md", ".bin"][r["doc_id"] % 3]
        assert got[f"d{r['doc_id'] % 3}/{r['doc_id']}{ext}"] == r["text"]


def test_suffix_and_member_safety(spark):
    df = spark.createDataFrame([("/x/.bashrc",), ("a/b.tar.GZ",), ("a.d/x",), ("a.",)], "p string")
    assert [r[0] for r in df.select(file_suffix(F.col("p"))).collect()] == ["", ".gz", "", ""]
    m = spark.createDataFrame([("/etc/x",), ("a/../b",), ("a\\..\\b",), ("a/b",)], "m string")
    assert [r[0] for r in m.select(member_is_safe(F.col("m"))).collect()] == [False, False, False, True]


def test_sniff(spark):
    ctl4 = b"a" * 100 + b"\x01" * 4
    ctl6 = b"a" * 100 + b"\x01" * 6
    df = spark.createDataFrame([(b"",), (b"ab\x00cd",), (ctl4,), (ctl6,)], "c binary")
    assert [r[0] for r in df.select(looks_textual(F.col("c"))).collect()] == [False, False, True, False]


def test_sanitize_and_html(spark):
    df = spark.createDataFrame([("..a/b\\c é?.txt. ",), ("...",)], "p string")
    got = [r[0] for r in df.select(F.array_join(F.transform(F.split(F.col("p"), "/"), lambda x: x), "/")).collect()]
    assert got
    from quarry.functions.text import sanitize_part
    parts = [r[0] for r in df.select(sanitize_part(F.col("p"))).collect()]
    assert parts == ["a_b_c _.txt", "unnamed"]
    assert [r[0] for r in df.select(sanitize_path(F.col("p"))).collect()][1] == "unnamed"
    h = spark.createDataFrame([("<SCRIPT x>a<b>\n</script>hi &amp; <b\n>yo</b> a<3",)], "h string")
    assert h.select(strip_html(F.col("h"))).first()[0] == " hi &  yo  a<3"
