"""From raw documents to shards: the stages of the training-data pipeline, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import decontaminate, mixing, sharding, simhash, toxicity
from maskwright.llm.common import cut_lineage, table

#: Each takes (spark, docs, sf_dir) and returns what it keeps; all but the last with the columns of documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("near duplicates", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("source mix", mixing.stage),
    ("sharding", sharding.stage),
]

#: Toxicity scores, fingerprints and the balanced mix cannot be written in SQL; tests/llm/test_pipeline.py checks run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written to the shared folder: the next reads files, not its lineage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
