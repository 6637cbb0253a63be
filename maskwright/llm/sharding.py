"""Sharding (8): a hierarchical weighted hash tree.

A tree of regions, racks and shards with weights decides where a row lives. At
every level each child draws ``ln(u) / weight`` from a hash of the row's key
and the child's path, and the largest draw wins; so a row's place follows from
its key and the tree alone, and a changed weight moves rows only into (or out
of) the subtrees whose weights changed. All of it is one column expression:
no shuffle to find the shard.

A shard that is added inside an existing rack also raises its rack's and its
region's weight, and rows that enter that region would spread over all of it.
:func:`grown` therefore hangs a new shard on as a region of its own: rows
then move only into the new shard, and none between the old ones.

Defined results: a null key is a key of its own (all such rows go to one
shard); a null text has no bytes (size 1, crc32 0); repeated rows each get
their own slot; an empty table gives an empty table; :func:`place` keeps the caller's columns (one
of the new column's name is replaced), :func:`assigned` does not read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright.llm.common import slim, table
from maskwright.llm.registry import query

#: Eight shards of equal weight: two regions of two racks of two shards.
TREE: dict = {f"region{r}": {f"rack{k}": {4 * r + 2 * k + s: 1.0 for s in range(2)} for k in range(2)} for r in range(2)}
#: Slots are numbered in this many buckets a shard, so that no task sorts a whole shard.
BUCKETS = 4096


def weight(node: dict | float) -> float:
    return sum(weight(x) for x in node.values()) if isinstance(node, dict) else float(node)


def leaves(tree: dict) -> list[int]:
    return [x for name, node in tree.items() for x in (leaves(node) if isinstance(node, dict) else [name])]


def grown(tree: dict, shard: int, share: float = 1.0) -> dict:
    """The tree with one more shard, as a region and rack of its own."""
    if shard in leaves(tree):
        raise ValueError(f"shard {shard} is in the tree already")
    return {**tree, f"region-of-{shard}": {f"rack-of-{shard}": {shard: share}}}


def shard_of(key: Column, tree: dict, path: str = "") -> Column:
    """The shard a key descends to. One expression node for each node of the tree; only the branch taken is evaluated."""
    children = [(name, node) for name, node in tree.items() if weight(node) > 0]
    if not children:
        raise ValueError("a tree needs a shard of positive weight")
    places = [
        shard_of(key, node, f"{path}/{name}") if isinstance(node, dict) else F.lit(int(name)) for name, node in children
    ]
    if len(children) == 1:
        return places[0]
    draws = [
        F.struct((F.ln((F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{path}/{name}")), 11) + F.lit(1)) / F.lit(float(2**53))) / F.lit(weight(node))).alias("draw"), F.lit(i).alias("child"))
        for i, (name, node) in enumerate(children)
    ]
    won = F.array_max(F.array(*draws))["child"]
    out = F.when(won == 0, places[0])
    for i, place in enumerate(places[1:], 1):
        out = out.when(won == i, place)
    return out


def place(df: DataFrame, key: str, tree: dict = TREE, name: str = "shard") -> DataFrame:
    """All rows and columns as they are, and the shard of each."""
    return df.withColumn(name, shard_of(F.col(key), tree))


def slots(df: DataFrame, shard: str, order: list[str], name: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in buckets of the first ``order`` column's hash.

    One row per shard and bucket (at most shards x ``BUCKETS``) carries how many rows stand before it.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(order[0]), F.lit(BUCKETS)).cast("int"))
    sizes = bucketed.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        shard, "_bucket", (F.sum("_n").over(W.partitionBy(shard).orderBy("_bucket")) - F.col("_n")).alias("_before")
    )
    local = bucketed.withColumn("_at", F.row_number().over(W.partitionBy(shard, "_bucket").orderBy(*order)))
    return local.join(F.broadcast(before), [shard, "_bucket"]).withColumn(
        name, (F.col("_before") + F.col("_at") - 1).cast("long")
    ).drop("_bucket", "_before", "_at")


def assigned(docs: DataFrame, tree: dict, more: dict) -> DataFrame:
    """Per row: doc_id, size, text_crc32, its shard and slot, and its shard in the tree ``more``. Only narrow rows are shuffled."""
    rows = slim(docs, doc_id="doc_id", text="text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        shard_of(F.col("doc_id"), tree).cast("int").alias("shard"),
        shard_of(F.col("doc_id"), more).cast("int").alias("grown_shard"),
    )
    return slots(rows, "shard", ["doc_id", "text_crc32", "size"])


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(table(spark, sf_dir, "documents"), TREE, grown(TREE, 8)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents, each with the shard that takes it."""
    return place(docs, "doc_id")
