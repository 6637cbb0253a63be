"""Mixing sources to target weights (5): entropy balancing.

Wanted are document rates as near as possible (in relative entropy) to one
copy each, such that every source's rated tokens meet its target and no rate
exceeds ``MAX_COPIES``. The convex dual has one multiplier for each source's
token constraint and gives exponentially tilted rates,
``min(MAX_COPIES, exp(multiplier * size / scale))``; it is solved for all
sources at once by distributed Newton steps, each held inside a bracket that
shrinks. Rates depend on a document only through its source and size, so the
steps run over a histogram (source, size, documents), summed before it is
shuffled: a source with a third of all rows costs no more than its number of
different sizes.

Rates become whole copies on the histogram too: the fractions are added up in
order of size and each whole step gives one more copy (an error of at most
about the largest document), then copies of some sizes are added or taken where
that brings a source nearer to its target. Last, a group's copies are dealt to its documents in
order of a hash of their ids.

Defined results: a null or empty text has size 0 and one copy; a null source is
a source of its own, last in order; a null id is a document like any other;
repeated rows share the copies of their group evenly; with no words at all
every target is 0; an empty table gives an empty table; other columns of the
caller come back from :func:`mixed` and are not read otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright.llm.common import cut_lineage, slim, table, word_count
from maskwright.llm.registry import query

WEIGHTS = (1, 2, 3)
#: A document is taken at most so often, and a source's target is at most so many times its size.
MAX_COPIES = 3
#: Newton steps end when every source is within this part of its target; the bracket halves at worst, so this many suffice.
TOLERANCE, MAX_STEPS = 1e-9, 100
#: Rounds in which copies of one size are added to or taken from a source, each time the size that brings it nearest.
REPAIRS = 8
#: Documents of one source and size are ranked in this many parts.
PARTS = 64


def source_key(source: Column) -> Column:
    """A source as text that is never null."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size, same): narrow rows; ``same`` tells rows with one id apart."""
    return slim(docs, doc_id="doc_id", text="text", source="source").select(
        "doc_id", "source", source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("same"),
    )


def histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n"))


def source_sizes(hist: DataFrame) -> DataFrame:
    """One row per source with its size and its place (from 0) in code point order, null last.

    Range partitions are numbered one by one, and one row a partition carries the count before it.
    """
    totals = hist.groupBy("key", "source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
        F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")).alias("squares"),
    )
    parts = int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        totals.repartitionByRange(parts, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id())
    )
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    at = F.row_number().over(W.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    return ranged.withColumn("at", at).join(F.broadcast(before), "part").select(
        "key", "source", "source_size", "least", F.try_divide("squares", "source_size").alias("scale"),
        (F.col("before") + F.col("at") - 1).alias("place"),
    )


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Each source's target in words: shares by weight of all words, stopped at ``MAX_COPIES`` times the source's size.

    What a stopped source leaves is shared among the others, again until none is above: the level (words per unit of
    weight) only rises. Only this one number comes to the driver, once a round.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = cut_lineage(sources.withColumn("weight", weight))
    most = F.col("source_size") * float(MAX_COPIES)
    level = 0.0
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    while True:
        above = F.col("weight") * level > most
        row = weighed.agg(F.sum(F.when(above, most)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if not row.free:
            break
        higher = (total - (row.held or 0.0)) / row.free
        if higher <= level:
            break
        level = higher
    return weighed.withColumn("target", F.least(most, F.col("weight") * level))


def _rate(multiplier: Column) -> Column:
    """The tilted rate of a document; a multiplier of infinity takes every word as often as it may be."""
    tilt = multiplier * F.col("size") / F.col("scale")
    return F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.when(tilt >= math.log(MAX_COPIES), F.lit(float(MAX_COPIES))).otherwise(F.exp(tilt)))


def multipliers(hist: DataFrame, sources: DataFrame) -> DataFrame:
    """The dual's solution: ``multiplier`` for each source."""
    ratio = F.col("target") / F.col("source_size")
    full = F.lit(math.log(MAX_COPIES)) * F.col("scale") / F.col("least")  # here even the shortest document is at the cap
    tilts = sources.where("source_size > 0").select(
        "key", "scale", "target", F.when(ratio >= MAX_COPIES * (1 - 1e-12), full).otherwise(F.lit(0.0)).alias("multiplier"),
        F.when(ratio < 1, F.ln(ratio) * F.col("scale") / F.col("least")).otherwise(F.lit(0.0)).alias("low"),
        F.when(ratio > 1, full).otherwise(F.lit(0.0)).alias("high"),
    )
    narrow = hist.where("size > 0").select("key", "size", "n")
    for _ in range(MAX_STEPS):
        words = F.col("n") * F.col("size")
        rate = _rate(F.col("multiplier"))
        sums = narrow.join(tilts.select("key", "scale", "multiplier"), "key").groupBy("key").agg(
            F.sum(words * rate).alias("got"),
            F.sum(F.when(rate < MAX_COPIES, words * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
        )
        off = F.col("got") - F.col("target")
        stepped = tilts.join(sums, "key").select(
            "key", "scale", "target", "multiplier", off.alias("off"), "slope",
            F.when(off < 0, F.col("multiplier")).otherwise(F.col("low")).alias("low"),
            F.when(off > 0, F.col("multiplier")).otherwise(F.col("high")).alias("high"),
        )
        newton = F.col("multiplier") - F.try_divide("off", "slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        met = F.abs("off") <= F.col("target") * TOLERANCE
        tilts = cut_lineage(stepped.select(
            "key", "scale", "target", "low", "high", (~met & (F.col("high") > F.col("low"))).alias("open"),
            F.when(met, F.col("multiplier")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2).alias("multiplier"),
        ))
        if tilts.where("open").isEmpty():
            break
    return tilts.select("key", F.round("multiplier", 9).alias("multiplier"))  # sums in another order give the same rates


def copies_by_size(hist: DataFrame, sources: DataFrame, tilts: DataFrame) -> DataFrame:
    """The histogram with ``copies``: how many copies all documents of a source and size get together."""
    rated = hist.join(sources.select("key", "scale", "target"), "key").join(tilts, "key", "left").withColumn(
        "rate", _rate(F.coalesce("multiplier", F.lit(0.0)))
    )
    upto = F.floor(F.sum(F.col("n") * (F.col("rate") - F.floor("rate"))).over(W.partitionBy("key").orderBy("size")) + 0.5)
    rounded = rated.withColumn("upto", upto).withColumn(
        "copies",
        F.col("n") * F.floor("rate") + F.col("upto") - F.coalesce(F.lag("upto").over(W.partitionBy("key").orderBy("size")), F.lit(0)),
    )
    groups = cut_lineage(rounded.select("key", "size", "n", "target", F.least("copies", F.col("n") * MAX_COPIES).cast("long").alias("copies")))
    for _ in range(REPAIRS):
        off = groups.groupBy("key").agg((F.sum(F.col("copies") * F.col("size")) - F.first("target")).alias("off"))
        room = F.when(F.col("off") > 0, F.col("copies")).otherwise(F.col("n") * MAX_COPIES - F.col("copies"))
        moved = F.least(room, F.greatest(F.lit(1), F.try_divide(F.abs("off"), "size").cast("long")))
        best = cut_lineage(
            groups.join(off, "key").where("size > 0").withColumn("moved", moved).withColumn("after", F.abs(F.abs("off") - F.col("moved") * F.col("size")))
            .where((F.col("moved") > 0) & (F.col("after") < F.abs("off")))
            .groupBy("key").agg(F.min_by(F.struct("size", (F.col("moved") * -F.signum("off")).cast("long").alias("step")), F.struct("after", "size")).alias("best"))
            .select("key", "best.size", "best.step")
        )
        if best.isEmpty():
            break
        groups = cut_lineage(groups.join(best, ["key", "size"], "left").select(
            "key", "size", "n", "target", (F.col("copies") + F.coalesce("step", F.lit(0))).alias("copies")
        ))
    return groups


def balanced(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of :func:`sized`, each with its ``copies``; and one row per source with its size and target."""
    rows = cut_lineage(rows)
    hist = cut_lineage(histogram(rows))
    sources = cut_lineage(with_targets(source_sizes(hist)))
    groups = copies_by_size(hist, sources, multipliers(hist, sources))
    parted = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    counts = parted.groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("here"))
    before = F.sum("here").over(W.partitionBy("key", "size").orderBy("part")) - F.col("here")
    dealt = counts.withColumn("before", before).join(groups, ["key", "size"]).select("key", "size", "part", "before", "n", "copies")
    rank = F.row_number().over(W.partitionBy("key", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id", "same"))
    ranked = parted.withColumn("rank", rank).join(dealt, ["key", "size", "part"])
    copies = F.expr("copies div n + IF(before + rank <= copies % n, 1, 0)").cast("int")
    return ranked.select(*rows.columns, copies.alias("copies")), sources


def mixed(docs: DataFrame, repeat: bool = True) -> DataFrame:
    """The documents that the mix takes, with all their columns: a row for each copy, or one row and ``copies``."""
    rows = sized(docs)
    copies, _ = balanced(rows)
    by = ["doc_id", "key", "same"]
    taken = copies.groupBy(*by).agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows")).where("_all > 0")
    taken = taken.select(*[F.col(c).alias(f"_{c}") for c in by], "_all", "_rows")
    whole = docs.select(  # the caller's columns travel as one, so their names cannot clash
        F.struct(*[docs[c] for c in docs.columns]).alias("whole"), docs["doc_id"].alias("doc_id"), source_key(docs["source"]).alias("key"), F.xxhash64(docs["text"]).alias("same")
    )
    joined = whole.join(taken, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key")) & (F.col("same") == F.col("_same")))
    at = F.row_number().over(W.partitionBy("_doc_id", "_key", "_same").orderBy(F.lit(0)))  # equal rows: any order will do
    own = joined.withColumn("at", at).withColumn("n", F.expr("_all div _rows + IF(at <= _all % _rows, 1, 0)").cast("int")).where("n > 0")
    if repeat:
        return own.select("whole", F.explode(F.sequence(F.lit(1), "n"))).select("whole.*")
    return own.select("whole.*", F.col("n").alias("copies"))


@query("op5_source_mix")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sources = balanced(sized(table(spark, sf_dir, "documents")))
    return rows.join(sources.select("key", "source_size", "target"), "key").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source in the proportions of ``WEIGHTS``: one row for each copy taken."""
    return mixed(docs)
