"""Files in and out: ground truth, study results, the event feed, redacted tables, reports, audit documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.sql import lits
from maskwright.operators import leaks
from maskwright.session import cut_lineage

TRUTH = "page STRING, about STRING, pii ARRAY<STRUCT<category: STRING, value: STRING, `where`: STRING>>, notPii ARRAY<STRING>, faces VARIANT"
STUDY = (
    "provider STRING, model STRING, label STRING, repeats INT, date STRING, serverErrors MAP<STRING, BIGINT>, "
    "runs ARRAY<STRUCT<task: STRING, repeat: INT, passed: BOOLEAN, endedRight: BOOLEAN, overreach: BOOLEAN, refused: INT, leaked: INT, "
    "steps: INT, unverified: INT, rateLimitWaits: INT, errors: ARRAY<STRING>, seconds: DOUBLE, "
    "calls: ARRAY<STRUCT<latencyMs: DOUBLE, repairs: INT, promptTokens: BIGINT, completionTokens: BIGINT>>>>"
)
EVENT = (
    "sent_at STRING, task_id STRING, seq BIGINT, type STRING, step INT, elements INT, redactions MAP<STRING, BIGINT>, page STRING, "
    "action_type STRING, target_label STRING, model STRING, latency_ms DOUBLE, verified BOOLEAN, note STRING, outcome STRING, steps INT, "
    "message STRING, prompt_tokens BIGINT, completion_tokens BIGINT, stage_ms MAP<STRING, DOUBLE>, redacted_goal STRING"
)


def read_truth(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One JSON document per page: pages, items, look-alikes, and rejects (which rule, of which file)."""
    raw = spark.read.schema(TRUTH).option("multiLine", True).json(path)
    return truth_tables(raw.withColumn("file", F.col("_metadata.file_name")))


def truth_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """``file`` and the fields of a truth document to its tables. A document with any bad field is rejected whole."""
    rules = {
        "page": "coalesce(page, '') LIKE '%.html'",
        "about": "about IS NOT NULL",
        "lists": "pii IS NOT NULL AND notPii IS NOT NULL",
        "category": f"forall(pii, i -> coalesce(i.category IN ({lits(P.CATEGORIES)}), false))",
        "value": "forall(pii, i -> coalesce(i.value, '') <> '')",
        "place": f"forall(pii, i -> coalesce(i.`where` IN ({lits(P.PLACES)}), false))",
        "look-alikes": "forall(notPii, v -> coalesce(v, '') <> '')",
        "faces": "faces IS NULL OR schema_of_variant(faces) RLIKE '^(BIGINT|DOUBLE|DECIMAL)'",
    }
    checks = ", ".join(f"if(coalesce({rule}, false), NULL, '{name}')" for name, rule in rules.items())
    # Four tables come out of it: documents are parsed and judged once.
    judged = cut_lineage(raw.withColumn("issues", F.expr(f"array_compact(array({checks}))")))
    good = judged.where("size(issues) = 0")
    return {
        "pages": good.selectExpr("page", "about", "cast(faces AS double) AS faces"),
        "items": good.selectExpr("page", "posexplode(pii) AS (item_no, i)").selectExpr(
            "page", "item_no", "i.category AS category", "i.value AS value", "i.`where` AS place"
        ),
        "lookalikes": good.selectExpr("page", "posexplode(notPii) AS (miss_no, value)"),
        "rejects": judged.where("size(issues) > 0").selectExpr("file", "explode(issues) AS rule"),
    }


def read_studies(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Study result files: studies, their runs, and the calls of each run."""
    return study_tables(spark.read.schema(STUDY).option("multiLine", True).json(path))


def study_tables(raw: DataFrame) -> dict[str, DataFrame]:
    name = "concat(provider, ': ', model, if(coalesce(label, '') = '', '', concat(' (', label, ')')))"
    runs = raw.selectExpr(f"{name} AS study", "provider", "explode(runs) AS r").selectExpr(
        "study", "provider", "r.task AS task", "r.repeat AS repeat", "r.passed AS passed", "r.endedRight AS ended_right", "r.overreach AS overreach",
        "coalesce(r.refused, 0) AS refused", "r.leaked AS leaked", "r.steps AS steps", "r.unverified AS unverified",
        "r.rateLimitWaits AS rate_limit_waits", "r.errors AS errors", "r.seconds AS seconds", "r.calls AS calls",
    )
    calls = runs.selectExpr("study", "task", "repeat", "posexplode(calls) AS (call_no, c)").selectExpr(
        "study", "task", "repeat", "call_no", "c.latencyMs AS latency_ms", "c.repairs AS repairs", "c.promptTokens AS prompt_tokens",
        "c.completionTokens AS completion_tokens",
    )
    return {
        "studies": raw.selectExpr(f"{name} AS study", "provider", "model", "repeats", "date", "serverErrors AS server_errors"),
        "runs": runs.drop("calls"), "calls": calls,
    }


def stream_events(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """The event feed as a stream of JSON files; any other source with these columns will do."""
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(path)
    return raw.withColumn("sent_at", F.to_timestamp("sent_at"))


def write_redacted(redacted: DataFrame, path: str, by: list[str], columns: list[str]) -> None:
    """Redacted rows only, partitioned; anything the outbound scan still finds stops the write. The vault is never part of it."""
    leaks.assert_outbound_safe(redacted.select(*by, *columns), columns).write.partitionBy(*by).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Tidy report rows, one folder per section."""
    report.write.partitionBy("section").mode("overwrite").parquet(path)


def audit_rows(events: DataFrame, goals: DataFrame) -> DataFrame:
    """The audit of every task: one row for its redacted goal (seq -1), then one for each event. No group is ever gathered.

    ``events``: task_id, seq and the event's fields; ``goals``: task_id, redacted_goal.
    """
    fields = [c for c in events.columns if c != "task_id"]
    return goals.selectExpr("task_id", "-1L AS seq", "to_json(struct('goal' AS type, redacted_goal)) AS event").unionByName(
        events.selectExpr("task_id", "cast(seq AS bigint) AS seq", f"to_json(struct({', '.join(fields)})) AS event")
    )


def write_audit(rows: DataFrame, path: str, day: str = "current_date()") -> None:
    """One folder a day; within each file a task's rows stand in order, and a long task may fill several files."""
    ordered = rows.repartitionByRange("task_id", "seq").sortWithinPartitions("task_id", "seq")
    ordered.withColumn("day", F.expr(day)).write.partitionBy("day").mode("append").json(path)
