"""Connected components of links, by alternating large-star and small-star steps; each is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches. Large-star and small-star steps in turn until nothing changes."""
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        around = both(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut_lineage(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(down.select("a", F.col("m").alias("b"))).distinct()
        small = cut_lineage(small)
        if small.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = small
