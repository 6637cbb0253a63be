"""Line dedup (7): lines that many documents share stay in one of them.

Each line long enough to matter becomes a narrow row (128-bit hash of its key,
document, line number), written once. The rows are range-partitioned by
(hash, document) and sorted by document and position within, so a line held by
a third of all documents fills several ranges instead of one task; from each
range only one count per line goes on. What is returned per document is a
compressed bitmap (one 64-bit word for every 64 lines in which any line goes),
not text; :func:`kept_text` lays it over the documents.

Defined results: a null or empty text is one empty line; a null document id is
a document of its own, smaller than all others; rows with the same id are one
document when documents are counted, and each row has its own bitmap; repeats
of a line within the document that keeps it all stay; an empty table gives an
empty table; other columns of the caller are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import LOWER, SPACE, UPPER, ascii_lower, cut_lineage, slim, table
from maskwright.llm.registry import query

MIN_CHARS, MIN_DOCS = 40, 5


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text (empty for null) and a hash that tells rows with the same id apart."""
    return slim(docs, doc_id="doc_id", text="text").select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).withColumn("row", F.hash("text"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, row, line): the lines whose stripped, lower-cased key has ``min_chars`` code points."""
    lines = _rows(docs).select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    keys = lines.select("doc_id", "row", "line", F.btrim("content", F.lit(SPACE)).alias("key"))
    keys = keys.where(F.char_length("key") >= min_chars).withColumn("key", ascii_lower(F.col("key")))
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row", "line")


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, words, n_dropped) of the documents that lose lines; words: array of (word, bits), a set bit is a lost line."""
    hashes = cut_lineage(line_hashes(docs, min_chars))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = hashes.repartitionByRange(parts, "h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "line")
    first = ranged.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    shared = (
        first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs).drop("n_docs")
    )
    shared = cut_lineage(shared)  # a table of its own: broadcast where it is small, else a join whose hot lines Spark splits
    lost = hashes.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    words = lost.groupBy("doc_id", "row", F.floor(F.col("line") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, line % 64)")).alias("bits")
    )
    return words.groupBy("doc_id", "row").agg(
        F.collect_list(F.struct("word", "bits")).alias("words"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped")
    )


#: 64 lines at a time: those whose bit is not set in the word of their chunk.
_KEPT = """array_join(get(transform(array(struct(split(text, '\\n', -1) AS lines, map_from_entries(words) AS lost)), d ->
  flatten(transform(sequence(0, (size(d.lines) - 1) div 64), w ->
    get(transform(array(coalesce(element_at(d.lost, w), 0L)), bits ->
      filter(slice(d.lines, w * 64 + 1, 64), (l, i) -> (shiftrightunsigned(bits, i) & 1L) = 0)), 0)))), 0), '\\n')"""


def kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text, n_lines (before), n_dropped, kept (the text without its lost lines): one row per row of ``docs``."""
    rows = _rows(docs)
    maps = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "words", "n_dropped")
    joined = rows.join(maps, rows.doc_id.eqNullSafe(F.col("_doc")) & (rows.row == F.col("_row")), "left")
    kept = F.expr(f"CASE WHEN words IS NULL THEN text ELSE {_KEPT} END")
    return joined.select(
        "doc_id", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"),
    )


ORACLE = f"""
WITH l AS (
  SELECT doc_id, t.i AS i, t.line AS line, translate(trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, unnest(range(len(ls))) AS i) t
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), m AS (
  SELECT l.doc_id, l.i, l.line, (s.k IS NOT NULL AND l.doc_id <> s.keeper) AS lost FROM l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN lost THEN NULL ELSE line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op7_line_dedup", ORACLE)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = kept_text(docs, drop_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
