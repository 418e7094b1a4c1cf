"""Dictionary source: validation, YAML, tables, normalisation."""

import os
import tempfile

import pytest

from quarry.sources.dictionary import KeywordDictionary, dictionary_norm


def test_validation():
    with pytest.raises(ValueError):
        KeywordDictionary({"G": "not a list"})
    with pytest.raises(ValueError):
        KeywordDictionary({"G": ["", ""]})
    with pytest.raises(ValueError):
        KeywordDictionary(["G"])
    d = KeywordDictionary({"G": ["a", "", 7], "H": []})
    assert d.entries == [("G", "a"), ("G", "7")]


def test_yaml_and_table(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "c.yaml")
    with open(p, "w", encoding="utf-8") as f:
        f.write("Keyword_Groups:\n  A: [Token, 'x@y.z']\n  B:\n    - token\n")
    kd = KeywordDictionary.from_yaml(p)
    assert kd.entries == [("A", "Token"), ("A", "x@y.z"), ("B", "token")]
    norm = kd.normalised()
    assert [(e.norm, e.display, e.groups) for e in norm] == [("token", "Token", ("A", "B")), ("x@y.z", "x@y.z", ("A",))]
    df = kd.to_frame(spark)
    back = KeywordDictionary.from_table(df, order_col="pos")
    assert back.entries == kd.entries
    rows = {r["norm"]: (r["groups"], r["display"]) for r in dictionary_norm(df).collect()}
    assert rows == {"token": (["A", "B"], "Token"), "x@y.z": (["A"], "x@y.z")}
    with open(os.path.join(d, "bad.yaml"), "w") as f:
        f.write("Other: 1\n")
    with pytest.raises(ValueError):
        KeywordDictionary.from_yaml(os.path.join(d, "bad.yaml"))


def test_casefold_native_equals_python(spark):
    from pyspark.sql import functions as F
    from quarry.functions.text import casefold_col
    words = ["Straße", "ſtraße", "ΣΊΣΥΦΟΣ", "ﬁnance", "İstanbul", "µ", "Ǆ", "ẞ", "plain"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(casefold_col(F.col("w"))).collect()]
    assert got == [w.casefold() for w in words]
