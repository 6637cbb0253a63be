"""Contracts: which rows are valid, and what is wrong with the rest, by rule name and never by value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.sql import lit, lits


def validate(df: DataFrame, contract: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects). ``contract`` maps a rule's name to the SQL that must hold; NULL counts as broken."""
    issues = ", ".join(f"if(coalesce({rule}, false), NULL, {lit(name)})" for name, rule in contract.items())
    checked = df.withColumn("issues", F.expr(f"array_compact(array({issues}))"))
    return checked.where("size(issues) = 0").drop("issues"), checked.where("size(issues) > 0")


def issue_counts(rejects: DataFrame) -> DataFrame:
    return rejects.selectExpr("explode(issues) AS rule").groupBy("rule").agg(F.count("*").alias("n"))


def optional(column: str, rule: str) -> str:
    """A field that may be absent."""
    return f"({column} IS NULL OR ({rule}))"


ELEMENT = {
    "id": r"id rlike '^e[0-9]+$'",
    "role": f"role IN ({lits(P.ROLES)})",
    "source": "source IN ('dom', 'vision', 'fused')",
    "state": optional("state", f"forall(state, s -> s IN ({lits(P.STATES)}))"),
    "confidence": optional("confidence", "confidence BETWEEN 0 AND 1"),
    "children": optional("children", "forall(children, c -> c rlike '^e[0-9]+$')"),
}
STEP = {"cycle": "cycle >= 0", "verified": "verified IS NOT NULL", "note": optional("note", "length(note) <= 200")}
EVENT = {
    "type": "type IN ('started', 'observed', 'planned', 'acted', 'heartbeat', 'warning', 'finished')",
    "sent_at": "sent_at IS NOT NULL",
    "task_id": "type <> 'started' OR task_id IS NOT NULL",
    "step": "type NOT IN ('observed', 'planned', 'acted') OR step >= 0",
    "elements": "type <> 'observed' OR elements >= 0",
    "redactions": optional("redactions", "forall(map_values(redactions), n -> n >= 0)"),
    "page": "type <> 'observed' OR page IS NOT NULL",
    "action_type": "type <> 'planned' OR action_type IS NOT NULL",
    "model": "type <> 'planned' OR model IS NOT NULL",
    "latency_ms": "type <> 'planned' OR latency_ms >= 0",
    "verified": "type <> 'acted' OR verified IS NOT NULL",
    "outcome": "type <> 'finished' OR outcome IN ('completed', 'failed', 'cancelled')",
    "steps": "type <> 'finished' OR steps >= 0",
    "message": "type <> 'warning' OR message IS NOT NULL",
}
TRUTH_ITEM = {
    "category": f"category IN ({lits(P.CATEGORIES)})",
    "value": "value <> ''",
    "place": f"place IN ({lits(P.PLACES)})",
}


def filter_allowed(steps: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(permitted, refused) steps. ``allowed``: one row per task, its array of at most eight verbs; none means all."""
    joined = steps.join(allowed.select("task_id", "allowed_actions"), "task_id", "left").withColumn(
        "_ok", F.expr("allowed_actions IS NULL OR array_contains(allowed_actions, action_type)")
    )
    return joined.where("_ok").select(*steps.columns), joined.where("NOT _ok").select(*steps.columns)
