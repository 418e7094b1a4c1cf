"""Containers: unpacked facts equal the facts of the rows packed into them; bad input gives error rows."""

import io
import zipfile

from pyspark.sql import functions as F

from conftest import SF001
from quarry.catalog import DICT
from quarry.operators.match import match_dictionary
from quarry.plans.scan import scan_tree
from quarry.sources import containers as X
from quarry.sources import packing as P


def _docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


def _doc_facts(spark):
    d = _docs(spark).select(F.col("doc_id").cast("string").alias("id"), "text")
    f = match_dictionary(d, DICT, keys=["id"])
    return sorted((r["id"], r["keyword_group"], r["keyword"], r["count"]) for r in f.collect())


def _member_id(col):
    # '.../<doc_id>.txt' or '<doc_id>.docx' -> doc_id
    return F.regexp_extract(col, r"(\d+)\.(txt|docx|odt|eml)(\.gz)?$", 1)


def test_archives_equal_documents(spark):
    d = _docs(spark)
    r = scan_tree(P.pack_archives(d, damage=True), DICT)
    facts = r.facts.select(_member_id("internal_path").alias("id"), "keyword_group", "keyword", "count")
    got = sorted(tuple(x) for x in facts.collect())
    # truncated zips lose their documents: compare against the documents in readable archives
    errors = r.files.where("error <> ''").select("source_path", "internal_path", "error").collect()
    truncated = {e["source_path"] for e in errors if e["internal_path"] == ""}
    unsafe = [e for e in errors if e["internal_path"].endswith("escape.txt")]
    assert truncated and unsafe
    lost = {str(r["doc_id"]) for r in d.select("doc_id").collect() if f"archives/{r['doc_id'] // 8}.zip" in truncated}
    exp = [t for t in _doc_facts(spark) if t[0] not in lost]
    assert got == exp


def test_office_mail_gz_equal_documents(spark):
    d = _docs(spark)
    for kind in ["docx", "odt", "eml"]:
        r = scan_tree(P.pack_office(d, kind), DICT)
        f = r.facts
        if kind == "docx":   # the embedded copy of the text is its own member
            f = f.where(F.col("internal_path") == "word/embeddings/note.txt")
            ids = F.regexp_extract("source_path", r"(\d+)\.docx$", 1)
        elif kind == "eml":  # the attachment is an exact copy of the text
            f = f.where(F.col("internal_path") != "")
            ids = _member_id("internal_path")
        else:
            ids = F.regexp_extract("source_path", r"(\d+)\.odt$", 1)
        got = sorted(tuple(x) for x in f.select(ids.alias("id"), "keyword_group", "keyword", "count").collect())
        if kind == "odt":
            # paragraphs are units: hits never span lines; compare with per-line matching
            lines = d.select(F.col("doc_id").cast("string").alias("id"),
                             F.posexplode(F.split("text", "\n")).alias("i", "text"))
            lf = match_dictionary(lines, DICT, keys=["id", "i"])
            exp = sorted(tuple(x) for x in lf.groupBy("id", "keyword_group", "keyword")
                         .agg(F.sum("count").alias("count")).collect())
        else:
            exp = _doc_facts(spark)
        assert got == exp, kind
    g = scan_tree(P.pack_gz(d), DICT)
    got = sorted(tuple(x) for x in g.facts.select(_member_id("internal_path").alias("id"), "keyword_group",
                                                  "keyword", "count").collect())
    assert got == _doc_facts(spark)


def test_depth_limit_and_corrupt(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.txt", "token here")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("b.txt", "password")
    blobs = spark.createDataFrame([("x.zip", outer.getvalue()), ("bad.zip", b"PK\x03\x04garbage")],
                                  "source_path string, content binary")
    deep = scan_tree(blobs, DICT, max_depth=3)
    hits = {(r["internal_path"], r["keyword"]) for r in deep.facts.collect()}
    assert ("in.zip/a.txt", "token") in hits and ("b.txt", "password") in hits
    errs = {(r["source_path"], r["internal_path"]): r["error"] for r in deep.files.where("error <> ''").collect()}
    assert ("bad.zip", "") in errs
    shallow = scan_tree(blobs, DICT, max_depth=1)
    errs1 = {(r["source_path"], r["internal_path"]): r["error"] for r in shallow.files.where("error <> ''").collect()}
    assert errs1[("x.zip", "in.zip")] == "depth limit"
    none = scan_tree(blobs, DICT, max_depth=0)
    errs0 = {(r["source_path"], r["internal_path"]): r["error"] for r in none.files.where("error <> ''").collect()}
    assert errs0[("x.zip", "")] == "depth limit"


def test_xml_text_pieces():
    data = b'<r><a title="T1">x<b>y</b>tail</a><c name="N"/></r>'
    # pre-order walk: an element's tail follows the element itself
    assert X.xml_text(data) == "x\nT1\ny\ntail\nN\n"
    assert X.xml_text(b"<broken>a<b>") == " a "


def test_fused_scan_equals_expand_then_match(spark):
    """The fused per-round job and the modular expand + match path give the same facts."""
    from quarry.operators.match import match_units, roll_up
    from quarry.plans.scan import META
    d = _docs(spark).orderBy("doc_id").limit(60)
    blobs = (P.pack_archives(d).unionByName(P.pack_office(d, "docx")).unionByName(P.pack_office(d, "eml"))
             .unionByName(P.pack_office(d, "odt")))
    fused = scan_tree(blobs, DICT).facts.select("display_path", "keyword_group", "keyword", "count")
    units = X.container_units(X.expand(blobs))
    modular = roll_up(match_units(units, DICT, keys=META + ["unit_idx"]), META) \
        .select("display_path", "keyword_group", "keyword", "count")
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, modular.collect()))


def test_first_program_flavor(spark):
    """v1 extraction: XML and Word paragraphs give the document text; e-mail bodies contain it."""
    from quarry.operators.match import match_boundary
    d = _docs(spark).where(~F.col("text").rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\r]")).orderBy("doc_id").limit(40)
    base = match_boundary(d.select(F.col("doc_id").cast("string").alias("id"), "text"), DICT, keys=["id"])
    exp = sorted((r["id"], r["keyword_group"], r["keyword"]) for r in base.collect())
    for kind, pack in [("xml", P.pack_xml(d)), ("docx", P.pack_office(d, "docx")), ("odt", P.pack_office(d, "odt"))]:
        r = scan_tree(pack, DICT, mode="boundary", flavor="v1", max_depth=0)
        ids = F.regexp_extract("source_path", r"(\d+)\.\w+$", 1)
        got = sorted(tuple(x) for x in r.facts.select(ids.alias("id"), "keyword_group", "keyword").collect())
        assert got == exp, kind
        assert r.files.where("error <> ''").count() == 0
    eml = scan_tree(P.pack_office(d, "eml"), DICT, mode="boundary", flavor="v1", max_depth=0)
    ids = F.regexp_extract("source_path", r"(\d+)\.eml$", 1)
    got = {tuple(x) for x in eml.facts.select(ids.alias("id"), "keyword_group", "keyword").collect()}
    assert set(exp) <= got
    assert X.xml_text_nested(b"<r>a<b>x</b>t<c/></r>") == "a\nx\nt\n"


def test_big_zip_split_by_member_ranges_gives_same_results(spark):
    """A zip over the split size is extracted in member ranges by several tasks: same facts and files."""
    d = _docs(spark).orderBy("doc_id").limit(80)
    blobs = P.pack_archives(d, per_archive=40)
    whole = scan_tree(blobs, DICT)
    split = scan_tree(blobs, DICT, split_zip_bytes=1024)
    assert sorted(map(tuple, split.facts.collect())) == sorted(map(tuple, whole.facts.collect()))
    cols = ["display_path", "size", "bytes_read", "matched", "error"]
    assert sorted(map(tuple, split.files.select(*cols).collect())) == \
        sorted(map(tuple, whole.files.select(*cols).collect()))
    from quarry.sources.containers import zip_ranges
    zips = [r["content"] for r in blobs.collect() if bytes(r["content"][:2]) == b"PK"]
    assert any(zip_ranges(bytes(z), 1024) for z in zips)
