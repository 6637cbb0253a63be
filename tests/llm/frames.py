"""Awkward tables for the operators' tests: nulls everywhere, repeated rows, ties, long texts, clashing column names."""

import re

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHES = ("same", "row", "key", "size", "n", "fp", "label", "weight", "terms", "shard", "slot", "copies", "part", "rank", "spans", "segment", "start", "_doc", "_same", "copy")


def sentence(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))


SHARED = "the passage that many documents hold word for word\n" + sentence(3, 60)
ROWS = [
    (1, "Alpha beta gamma", "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\n\x0b ", "en", "b", 4),
    (5, SHARED, "en", "b", 5), (6, sentence(9, 30) + " " + SHARED + " " + sentence(8, 20), "en", "c", 6), (7, SHARED, "en", "c", 7),
    (8, SHARED + "\n" + SHARED, "de", None, 8), (9, "Über ÄÖ ünder " * 40, "de", "ä", 9), (9, "Über ÄÖ ünder " * 40, "de", "ä", 9), (9, "another text of the same id", "de", "ä", 9),
    (None, SHARED, "en", "a", 10), (None, None, None, None, None), (11, "x\ny\n\nz\n", "en", "a", 11), (12, sentence(1, 5000), "en", "a", 12),
    (13, sentence(1, 5000) + " tail", "en", "b", 13), (14, "idiot " * 60, "en", "b", 14), (15, "1 2 3", "en", "c", 15), (16, "A-b_c " + SHARED.upper(), "en", "c", 16),
]


def documents(spark, rows=None, clash=True):
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.select("*", *[F.lit("?").alias(c) for c in CLASHES]) if clash else df


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
