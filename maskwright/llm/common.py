"""What several operators share: reading tables, slim inputs, tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.session import cut_lineage, drop, fair_batches, settled

#: ASCII white space, the only kind that parts words: \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"
#: A word is a run of anything else (Java regex).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["LOWER", "SPACE", "UPPER", "WORD", "ascii_lower", "cut_lineage", "drop", "fair_batches", "is_training", "settled", "slim", "table", "word_count"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator works on, under its own names: whatever else the caller's table has cannot clash."""
    return df.select(*[df[theirs].alias(ours) for ours, theirs in columns.items()])


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Runs of non-space in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def is_training(doc_id: Column) -> Column:
    """Whether a label may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))
