"""SimHash near-dedup (6): fingerprints, linked through multi-index hashing.

A document's fingerprint has a bit set where over half of its shingles' hashes
have it. Documents with one fingerprint are one class from the start, so copies
never meet in pairs. Fingerprints within ``DISTANCE`` bits are found as follows:
of ``SEGMENTS`` segments, one differs in at most DISTANCE // SEGMENTS bits; each
fingerprint stands in a table under each of its segments, looks up the small
Hamming ball around each segment (at radius 1, of two neighbours the one with the 0 bit
asks, so no link is found twice by a flip), and every fetched pair is verified
on all 64 bits.

A table entry that very many fingerprints share would be fetched by each of
them. Such an entry (over ``HOT`` fingerprints with one segment equal) is opened
by its remaining bits: its fingerprints meet in shared points of the balls
around them (:func:`hub_links`), at a cost per fingerprint that does not depend
on the entry's size. No link is lost by it.

Components come from alternating large-star and small-star steps on the links,
each written to the shared folder.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; repeated rows and equal ids fall together; a null id joins a
component but never names one unless all its members are null; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import cut_lineage, fair_batches, settled, slim, table
from maskwright.llm.components import components
from maskwright.llm.jaccard import near_copies
from maskwright.llm.registry import query

SHINGLE, SEED, DISTANCE, SEGMENTS = 3, 42, 3, 2
#: Fingerprints with one equal segment beyond which their pairs are not fetched from it.
HOT = 256
#: Shingle hashes counted at a time: bounds memory for texts of any length.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text, as a signed integer."""
    words = text.lower().split()  # both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    edges = np.cumsum([0, *[len(w) + 1 for w in words]])
    n = max(1, len(words) - shingle + 1)
    begins, ends = edges[:n].tolist(), (edges[min(shingle, len(words)) :][:n] - 1).tolist()
    bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, same, fp): one row per document; ``same`` tells rows with one id apart. No shuffle."""
    fair_batches(docs.sparkSession)
    rows = slim(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("same"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(found, pa.int64())], ["doc_id", "same", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, same bigint, fp bigint")


def _ball(value: Column, bits: list[int], radius: int, up: bool = False) -> Column:
    """All values within ``radius`` flips of ``bits``; ``up``: only flips of zeros."""
    out = F.array(value)
    for _ in range(radius):
        flips = [F.lit(-(1 << 63) if b == 63 else 1 << b) for b in bits]
        out = F.array_distinct(F.flatten(F.transform(out, lambda v: F.concat(F.array(v), *[
            F.when((v.bitwiseAND(f) == 0) | F.lit(not up), F.array(v.bitwiseXOR(f))).otherwise(F.array().cast("array<bigint>")) for f in flips
        ]))))
    return out


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def hub_links(fps: DataFrame, bits: list[int], distance: int) -> DataFrame:
    """Links (a, b) that join all of (key, fp) within ``distance`` on ``bits``, without pairs.

    Two fingerprints are at most 2r apart exactly if the balls of radius r around them meet. Each point that
    balls meet in keeps its smallest member, and each other member is linked to that one. Where ``distance`` is odd,
    the larger ball of one meets the smaller ball of the other.
    """
    small, large = distance // 2, distance - distance // 2
    value = F.col("fp")
    near = fps.select("key", "fp", F.explode(_ball(value, bits, small)).alias("point"))
    centre = near.groupBy("key", "point").agg(F.min("fp").alias("least"))
    even = near.join(centre, ["key", "point"]).select(F.col("least").alias("a"), F.col("fp").alias("b"))
    if small == large:
        return even.where("a <> b").distinct()
    far = fps.select("key", "fp", F.explode(_ball(value, bits, large)).alias("point"))
    return even.unionAll(far.join(centre, ["key", "point"]).select(F.col("least").alias("a"), F.col("fp").alias("b"))).where("a <> b").distinct()


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """(a, b) over the different values ``fp``: verified links whose components are those of all links within ``distance``."""
    cuts = [64 * s // segments for s in range(segments + 1)]
    ranges = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    radius = distance // segments
    up = radius < 2  # two bits may differ one up and one down, which only the full ball meets
    own = F.array(*[F.struct(F.lit(s).alias("segment"), F.col("fp").bitwiseAND(F.lit(_mask(r))).alias("value")) for s, r in enumerate(ranges)])
    entries = cut_lineage(fps.select("fp", F.explode(own).alias("e")).select("fp", "e.segment", "e.value"))
    crowded = cut_lineage(entries.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).drop("n"))
    fetched = []
    if not crowded.isEmpty():
        # Entries of up to ``hot`` are fetched as they are, by whoever asks; a crowded one is opened by its other bits, for members and askers alike.
        asked = reduce(DataFrame.unionAll, [
            entries.where(F.col("segment") == s).select("segment", F.explode(_ball(F.col("value"), r, radius)).alias("value"), "fp") for s, r in enumerate(ranges)
        ]).join(crowded, ["segment", "value"], "left_semi")
        keyed = asked.withColumn("key", F.struct("segment", "value"))
        fetched = [hub_links(keyed.where(F.col("segment") == s).select("key", "fp"), list(range(64)), distance) for s in range(segments)]
    calm = entries.join(crowded, ["segment", "value"], "left_anti")
    for s, r in enumerate(ranges):
        table_of = calm.where(F.col("segment") == s).select("value", F.col("fp").alias("b"))
        asks = entries.where(F.col("segment") == s).select(F.explode(_ball(F.col("value"), r, radius, up=up)).alias("value"), F.col("fp").alias("a"), F.col("value").alias("self"))
        once = (F.col("self") != F.col("value")) | (F.col("a") < F.col("b")) if up else F.col("a") < F.col("b")
        met = asks.join(table_of, "value").where(once)
        fetched.append(met.select("a", "b"))
    every = reduce(DataFrame.unionAll, fetched)
    return every.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, same, fp, component_id (the smallest doc_id that links lead to, its own included)."""
    prints = cut_lineage(fingerprints(docs, shingle))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), distance))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = cut_lineage(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"))
    return prints.join(member, "fp").select("doc_id", "same", "fp", "component_id")


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def likely_pairs(docs: DataFrame, named: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): the classes of :mod:`jaccard` that fingerprints link, in the links of :func:`links` and within one fingerprint.

    ``named``: same (hash of a text), class. Each fingerprint stands for the least of its classes.
    """
    texts = fingerprints(docs, shingle).select("same", "fp").distinct()
    held = cut_lineage(texts.join(named, "same").select("fp", "class").distinct())
    least = cut_lineage(held.groupBy("fp").agg(F.min("class").alias("least")))
    own = held.join(least, "fp").select(F.col("least").alias("a"), F.col("class").alias("b"))
    sides = [least.select(F.col("fp").alias(s), F.col("least").alias(f"{s}_least")) for s in "ab"]
    other = links(least.select("fp"), distance).distinct().join(sides[0], "a").join(sides[1], "b").select(F.col("a_least").alias("a"), F.col("b_least").alias("b"))
    return own.unionAll(other).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that of the smallest id, null only where there is no other (of rows with that id, one text; of repeated rows, one).

    Fingerprints within ``DISTANCE`` bits make the groups first, each link checked on whole sets of five-word shingles. They
    miss most copies at four fifths of Jaccard (see README), so the Jaccard join links what they leave apart; texts
    without words are one group. Whole rows are shuffled once, by the hash of their text and their id.
    """
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "same")).alias("kept")
    kept = settled(spark, lambda: near_copies(docs, likely=lambda named: likely_pairs(docs, named)).groupBy("root").agg(least).select("kept"))
    named = lambda doc_id: F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")).alias("name")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(docs["text"]).alias("same"), named(docs["doc_id"]))
    met = rows.join(kept.select(F.col("kept.same").alias("same"), named(F.col("kept.doc_id"))), ["same", "name"], "left_semi")
    return met.dropDuplicates(["same", "name"]).select("row.*")
