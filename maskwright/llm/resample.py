"""Target-distribution importance resampling (12): draw the documents that look most like a target text.

Features are all runs of one to three words. A text's separators are collapsed to single spaces; one regular
expression with lookarounds at its boundaries is run over it with ``overlapped=True``, so that a match, the longest
run, begins at every word. The spans of all runs are counted by the CRC of their bytes, modulo the number of buckets. The log ratio of the target's and the documents' smoothed bucket frequencies, in thousandths, is
a bucket's gain; a document's weight is the sum of the gains of its features. Gumbel noise from a hash of the id turns
the weights into a draw without replacement: the highest scores are taken.

Every text is scanned once: its sorted buckets are written to the shared folder, counted from there and weighed from
there. Ranks come from windows over ranges of scores, whose bounds are quantiles of all scores, shifted by the number
of rows in the ranges above: no task sorts the whole draw.

Defined results: a null or empty text, or one without words, has no features and weight 0; an empty target or an empty
table of documents counts as no features; each row is a document, also where ids repeat (rows with equal ids and
scores are told apart by their text); a null id draws noise as the text ``42:`` would and comes after all other ids
where scores tie; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import cut_lineage, fair_batches, slim, table
from maskwright.llm.registry import query

BUCKETS, SEED, MIN_WORDS, SHARE = 10_000, 42, 20, (5, 100)
#: Score ranges that ranks are counted in.
RANGES = 256

#: Bytes of words as they are, A-Z in lower case, every separator a space.
_PLAIN = bytes(i + 32 if 65 <= i < 91 else i if 48 <= i < 58 or 97 <= i < 123 or i >= 128 else 32 for i in range(256))
#: The longest run that begins at a word, between the spaces around it (the space before is a part of the match: the scan finds it fast).
_RUNS = regex.compile(rb" (?=[^ ])[^ ]+(?: [^ ]+){0,2}(?= )")


def features(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words, sorted bucket of every run of one to three words)."""
    line, crc = b" ".join([b"", *text.translate(_PLAIN).split(), b""]), zlib.crc32
    spans = list(map(regex.Match.span, _RUNS.finditer(line, overlapped=True)))
    starts = [a + 1 for a, _ in spans]
    three = [b for _, b in spans]
    one = [a - 1 for a in starts[1:]] + three[-1:]  # a run of one word ends before the next word, one of two before the next but one
    found = [crc(line[a:b]) for a, b in zip(starts, one)]  # noqa: B905
    found += [crc(line[a:b]) for a, b in zip(starts, one[1:])]  # noqa: B905
    found += [crc(line[a:b]) for a, b in zip(starts, three[:-2])]  # noqa: B905
    out = np.array(found, np.uint32) % np.uint32(buckets)
    out.sort()
    return len(starts), out


def _steps(ordered: np.ndarray) -> bytes:
    """Sorted buckets as steps from one to the next: mostly small numbers, which files compress."""
    return np.diff(ordered, prepend=np.uint32(0)).astype("<u4").tobytes()


def scanned(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, same, n_words, n_features, steps) per document; no shuffle."""
    fair_batches(docs.sparkSession)
    rows = slim(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("same"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or b"", buckets) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("same"), pa.array([w for w, _ in found], pa.int64()), pa.array([len(f) for _, f in found], pa.int64()), pa.array([_steps(f) for _, f in found], pa.binary())],
                ["doc_id", "same", "n_words", "n_features", "steps"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, same bigint, n_words bigint, n_features bigint, steps binary")


def bucket_counts(scan: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall in each bucket, over all rows: one dense count per task, added up by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for steps in batch.column("steps"):
                counts += np.bincount(np.cumsum(np.frombuffer(steps.as_py(), "<u4")), minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["bucket", "n"])

    summed = scan.select("steps").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # one row per bucket
    counts = np.zeros(buckets, np.int64)
    counts[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: floor of 1000 times the log of the target's smoothed frequency over the documents'."""
    n, whole_s, whole_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (whole_s + n) / ((s + 1) * (whole_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def importance(scan: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, same, n_words, n_features, weight)."""
    sent = scan.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(sent.value[np.cumsum(np.frombuffer(s.as_py(), "<u4"))].sum()) for s in batch.column("steps")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "same", "n_words", "n_features")], pa.array(weights, pa.int64())], ["doc_id", "same", "n_words", "n_features", "weight"])

    return scan.mapInArrow(run, f"doc_id {scan.schema['doc_id'].dataType.simpleString()}, same bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with rank: 1, 2, 3... for the drawn part of the rows with enough words, by falling score; null for all others."""
    part, whole = share
    can = scored.where(F.col("n_words") >= min_words)
    bounds = can.agg(F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)], 10_000).alias("bounds"))  # one row
    #: How many bounds lie above a score: never falls as the score falls, equal scores share a range.
    range_of = F.expr("CASE WHEN n_words >= %d THEN size(filter(bounds, x -> x > score)) END" % min_words)
    placed = scored.crossJoin(F.broadcast(bounds)).withColumn("range", range_of).drop("bounds")
    sizes = placed.where("range IS NOT NULL").groupBy("range").agg(F.count(F.lit(1)).alias("size"))  # at most RANGES rows
    above = sizes.selectExpr("range", "coalesce(sum(size) OVER (ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above", f"{part} * sum(size) OVER () div {whole} AS draw").where("above < draw")
    rank = "above + row_number() OVER (PARTITION BY range ORDER BY score DESC, doc_id ASC NULLS LAST, same)"
    near = placed.join(F.broadcast(above), "range").selectExpr(*scored.columns, f"{rank} AS rank", "draw")
    rest = placed.join(F.broadcast(above), "range", "left_anti").select(*scored.columns, F.lit(None).cast("bigint").alias("rank"))
    return near.selectExpr(*scored.columns, "CASE WHEN rank <= draw THEN rank END AS rank").unionAll(rest)


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, same, n_words, n_features, weight, score, rank. ``target``: a table with a column text."""
    scan = cut_lineage(scanned(docs, buckets))
    wanted = scanned(target.select(F.lit(None).cast("bigint").alias("doc_id"), target["text"].alias("text")), buckets)
    weighed = importance(scan, gains(bucket_counts(scan, buckets), bucket_counts(wanted, buckets)))
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return ranked(scored, share, min_words)


def drawn(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, and the rank of each as ``draw_rank``."""
    picked = resampled(docs, target, **settings).where("rank IS NOT NULL").groupBy("doc_id", "same").agg(F.min("rank").alias("draw_rank"))
    picked = picked.withColumnsRenamed({"doc_id": "__drawn_doc", "same": "__drawn_text"})
    met = docs.join(picked, docs["doc_id"].eqNullSafe(picked["__drawn_doc"]) & (F.xxhash64(docs["text"]) == picked["__drawn_text"]))
    return met.drop("__drawn_doc", "__drawn_text")


@query("op12_resample")
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
