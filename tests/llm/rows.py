"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["size", "shard", "slot", "target", "taken", "n_words", "labels", "score", "keep", "log_weight", "component_id", "start",
         "similarity", "item_id", "rank", "id", "th", "removed", "host", "path", "rule", "verdict", "_p", "_w", "s", "n", "key"]

LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))

ROWS = [
    (1, "the cat sat on the mat and looked at the moon", "en", "b", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b\x0c\r ", "en", "a", 6),
    (5, "The Cat sat on the mat and looked at the moon", "en", "a", 10),
    (5, "The Cat sat on the mat and looked at the moon", "en", "a", 10),
    (None, "a row without an id", "en", "b", 5),
    (7, "one", "en", None, 3),
    (8, "one", "en", "", 3),
    (9, LONG, "en", "c", len(LONG)),
    (-4, "ÀÉ œuvre ² ½ it's 'tis  two  spaces <|endoftext|> 中文 \U0001F600", "fr", "é", 40),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})
