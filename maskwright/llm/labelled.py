"""Labelled rows to learn from, chosen by id alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import is_training, slim


def training_sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label, weight): at most ``per_class`` documents of each label, those whose ids hash lowest.

    Only rows that may be learned from are read. A document with several labels has their majority, a tie counts
    as 1. ``weight``: how many labelled documents of its class a chosen one stands for.
    """
    rows = slim(labels, doc_id="doc_id", label=label).where(is_training(F.col("doc_id")) & F.col("label").isNotNull())
    each = rows.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    sizes = each.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    picked = None
    for value in (0, 1):
        some = each.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionAll(some)
    return picked.join(F.broadcast(sizes), "label").select(  # two rows
        "doc_id", "label", F.greatest(F.lit(1.0), F.col("n") / per_class).alias("weight")
    )
