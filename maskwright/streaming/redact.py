"""Redaction of a text stream against a vault that grows: a value keeps its token from batch to batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.functions.detectors import detect
from maskwright.functions.spans import replace_spans
from maskwright.functions.sql import once
from maskwright.functions.tokens import format_token
from maskwright.operators import vault as tokens
from maskwright.operators.skew import number_rows
from maskwright.session import cut_lineage

VAULT = "scope_id STRING, category STRING, value_key STRING, token STRING, number BIGINT, first_value STRING, uses BIGINT, batch BIGINT"


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """The secret table the stream keeps, one folder per batch."""
    return spark.read.schema(VAULT).parquet(path)


def _known(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The vault's rows of earlier batches. A vault that does not exist yet is begun with an empty folder."""
    try:
        return read_vault(spark, path).where(F.col("batch") < before)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # a vault that is there but cannot be read must not be numbered anew
            raise
        spark.createDataFrame([], VAULT).drop("batch").write.mode("ignore").parquet(f"{path}/batch=-1")
        return spark.createDataFrame([], VAULT)


def redact_batch(batch: DataFrame, number: int, vault_path: str, order: list[str]) -> DataFrame:
    """One micro-batch, redacted. Values already in the vault keep their token; new ones are numbered on from it.

    The batch's values are first reduced to distinct ones, so a scope that
    fills the stream is numbered in pieces, as in a batch job. New values go
    to a folder of their own batch, written whole or not at all: a batch run
    again after a lost executor overwrites just that.
    """
    spark = batch.sparkSession
    hits = cut_lineage(batch.select("text_id", "scope_id", *order, F.expr(once(detect("text"))).alias("spans")).where("size(spans) > 0"))
    found = hits.selectExpr("text_id", "scope_id", *order, tokens._SPAN_ROWS)
    keyed = tokens.value_key(found, "text")
    first = keyed.groupBy("scope_id", "category", "value_key").agg(
        F.expr(f"min(struct({', '.join([*order, 'start'])}, text))").alias("first"), F.count("*").alias("uses")
    )
    known = _known(spark, vault_path, number)
    fresh = first.join(known.select("scope_id", "category", "value_key"), ["scope_id", "category", "value_key"], "left_anti")
    counted = known.groupBy("scope_id", "category").agg(F.max("number").alias("_used"))
    ranked = number_rows(fresh, ["scope_id", "category"], "first", f"cast(floor(first.{order[0]} / {tokens.BUCKET_ROWS}) AS bigint)", "_n")
    numbered = ranked.join(counted, ["scope_id", "category"], "left").withColumn("number", F.expr("coalesce(_used, 0L) + _n"))
    rows = numbered.selectExpr(
        "scope_id", "category", "value_key", f"{format_token('category', 'number')} AS token", "cast(number AS bigint) AS number",
        "first.text AS first_value", "uses",
    )
    rows.write.mode("overwrite").parquet(f"{vault_path}/batch={number}")
    all_known = read_vault(spark, vault_path).where(F.col("batch") <= number)
    attached = tokens.attach_tokens(found, all_known, ["scope_id"], ["text_id", "start"])
    per_text = attached.groupBy("text_id").agg(F.expr("array_sort(collect_list(struct(start, end, token)))").alias("replacements"))
    return batch.join(per_text, "text_id", "left").selectExpr(
        "text_id", "scope_id", *order, f"if(replacements IS NULL, text, {replace_spans('text', 'replacements')}) AS redacted"
    )


def stream_redact(texts: DataFrame, vault_path: str, out_path: str, checkpoint: str, order: list[str], once: bool = True) -> StreamingQuery:
    """Start the stream: ``texts`` (text_id, scope_id, order columns, text) in, redacted rows out, one folder per batch."""

    def run(batch: DataFrame, number: int) -> None:
        redact_batch(batch, number, vault_path, order).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    writer = texts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def drop_scope(spark: SparkSession, vault_path: str, finished: DataFrame) -> DataFrame:
    """The vault without the scopes of finished tasks: what to keep when it is rewritten."""
    return read_vault(spark, vault_path).join(finished.select("scope_id").distinct(), "scope_id", "left_anti")
