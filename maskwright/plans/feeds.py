"""Queries of the event feed and of files: the finished-table twins of what runs on the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions.sql import once
from maskwright.functions.tokens import describe_counts
from maskwright.operators.study import study_report
from maskwright.plans.registry import query, spread, table
from maskwright.sources import files
from maskwright.streaming import feed

_EVENT = {
    "task_id": "cast(cast(floor(event_id / 20) AS bigint) AS string)", "seq": "event_id",
    "type": "CASE event_type WHEN 'view' THEN 'observed' WHEN 'click' THEN 'planned' WHEN 'signup' THEN 'acted' WHEN 'error' THEN 'warning' ELSE CASE WHEN user_id % 2 = 0 THEN 'heartbeat' ELSE 'finished' END END",
    "model": "CASE WHEN event_type = 'click' THEN 'm' || cast(user_id % 3 AS string) END",
    "latency_ms": "CASE WHEN event_type = 'click' THEN value END",
    "prompt_tokens": "CASE WHEN event_type = 'click' AND user_id % 5 > 0 THEN user_id END",
    "completion_tokens": "CASE WHEN event_type = 'click' AND user_id % 5 > 0 THEN user_id % 7 END",
    "page": "CASE WHEN event_type = 'view' THEN 'p' || cast(user_id AS string) END",
}
_EVENT_SQL = "(SELECT ts AS sent_at, " + ", ".join(f"{v} AS {k}" for k, v in _EVENT.items()) + ", user_id, value FROM events)"


def _events(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "cast(ts AS timestamp) AS sent_at", *[f"{v} AS {k}" for k, v in _EVENT.items()], "user_id", "value", "cast(NULL AS string) AS redacted_goal",
        "cast(user_id % 9 - 1 AS int) AS step", "cast(user_id AS int) AS elements", "map('EMAIL', user_id % 3, 'CARD', user_id % 2) AS redactions",
        "CASE WHEN event_type = 'click' THEN 'click' END AS action_type", "'Label' AS target_label", "user_id % 2 = 0 AS verified",
        "CASE WHEN user_id % 10 = 0 THEN 'mail to u' || cast(user_id AS string) || '@example.com' ELSE 'ok' END AS note", "'completed' AS outcome",
        "1 AS steps", "'m' AS message", "map('observe', value) AS stage_ms",
    )


@query(
    "task_feed",
    f"""WITH e AS {_EVENT_SQL}
SELECT task_id, CAST(count(*) FILTER (type <> 'heartbeat') AS BIGINT) AS events, CAST(count(*) FILTER (type = 'planned') AS BIGINT) AS steps,
 CAST(coalesce(sum(prompt_tokens) FILTER (type = 'planned'), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens) FILTER (type = 'planned'), 0) AS BIGINT) AS completion_tokens,
 arg_max(model, seq) AS last_model, arg_max(latency_ms, seq) AS last_latency, coalesce(arg_max(type = 'finished', seq) FILTER (type <> 'heartbeat'), false) AS finished, arg_max(page, seq) AS page
FROM e GROUP BY task_id""",
)
def task_feed(spark, folder):
    return feed.task_feed_batch(_events(spark, folder)).drop("redacted_goal")


@query(
    "liveness_gaps",
    """SELECT user_id, ts + INTERVAL 6 HOUR AS disconnected_at, nxt AS back_at FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events)
WHERE epoch_ms(coalesce(nxt, (SELECT max(ts) FROM events))) - epoch_ms(ts) > 21600000""",
)
def liveness_gaps(spark, folder):
    """Silences per user of over six hours (the feed's rule, on a slower clock), up to the last message of all; a hot user is cut by the day."""
    events = _events(spark, folder)
    last = events.agg(F.max("sent_at").alias("last_sent"))  # one row
    gaps = feed.liveness(events.crossJoin(F.broadcast(last)), "user_id", 6 * 3600 * 1000, "cast(floor(unix_seconds(sent_at) / 86400) AS bigint)", "last_sent")
    return gaps.selectExpr("user_id", "cast(disconnected_at AS timestamp_ntz) AS disconnected_at", "cast(back_at AS timestamp_ntz) AS back_at")


@query(
    "running_totals",
    f"""WITH e AS {_EVENT_SQL}
SELECT seq, CAST(count(*) FILTER (type = 'planned') OVER w AS BIGINT) AS total_steps, CAST(coalesce(sum(prompt_tokens) FILTER (type = 'planned') OVER w, 0) AS BIGINT) AS total_prompt,
 CAST(coalesce(sum(completion_tokens) FILTER (type = 'planned') OVER w, 0) AS BIGINT) AS total_completion, last_value(latency_ms IGNORE NULLS) OVER w AS latest_latency
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
)
def running_totals(spark, folder):
    """Running steps, tokens and latency per user; a hot user is cut every 512 events."""
    totals = feed.running_totals(_events(spark, folder), "user_id", "cast(floor(seq / 512) AS bigint)")
    return totals.select("seq", "total_steps", "total_prompt", "total_completion", "latest_latency")


@query(
    "projected_events",
    f"""WITH e AS {_EVENT_SQL}
SELECT seq, type, CASE WHEN type IN ('observed', 'planned', 'acted') THEN CAST(user_id % 9 - 1 AS BIGINT) END AS step, CASE WHEN type = 'observed' THEN page END AS page,
 CASE WHEN type = 'planned' THEN model END AS model, CASE WHEN type = 'acted' THEN user_id % 2 = 0 END AS verified, CASE WHEN type = 'observed' THEN round(value) END AS observe_ms FROM e WHERE type <> 'heartbeat'""",
)
def projected_events(spark, folder):
    return feed.event_projection(_events(spark, folder)).selectExpr(
        "seq", "type", "cast(step AS bigint) AS step", "page", "model", "verified", "element_at(stage_ms, 'observe') AS observe_ms"
    )


@query(
    "gated_events",
    f"""WITH e AS (SELECT *, type IN ('observed', 'planned', 'acted') AND user_id % 9 = 0 AS bad FROM {_EVENT_SQL})
SELECT type, CASE WHEN bad THEN 'invalid' WHEN user_id % 10 = 0 THEN 'private data' ELSE 'sent' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL""",
)
def gated_events(spark, folder):
    """Events sent, and those dropped as invalid or for what the scan found."""
    clean, dropped = feed.gated_feed(_events(spark, folder))
    both = clean.selectExpr("type", "'sent' AS verdict").unionByName(dropped.selectExpr("type", "reason AS verdict"))
    return both.groupBy("type", "verdict").agg(F.count("*").alias("n"))


@query(
    "resource_summary",
    f"""WITH e AS {_EVENT_SQL}
SELECT task_id, CAST(arg_max(user_id * 10 + 5, seq) AS BIGINT) AS footprint, coalesce(arg_max(model, seq), 'm0') AS model, coalesce(arg_max(model, seq) = 'm1', false) AS by_fallback,
 CASE WHEN coalesce(arg_max(model, seq) = 'm1', false) THEN 'nvidia (fallback)' ELSE 'groq' END AS provider, arg_max(value, seq) FILTER (type = 'observed') AS observe_ms FROM e GROUP BY task_id""",
)
def resource_summary(spark, folder):
    events = _events(spark, folder).selectExpr(
        "task_id", "seq", "type", "array(named_struct('name', 'a', 'size_bytes', user_id * 10), named_struct('name', 'b', 'size_bytes', 5L)) AS model_files",
        "'groq' AS planner_provider", "'m0' AS planner_model", "'nvidia' AS fallback_provider", "'m1' AS fallback_model", "model", "stage_ms",
    )
    return feed.resource_summary(events).selectExpr("task_id", "footprint", "model", "by_fallback", "provider", "element_at(stage_ms, 'observe') AS observe_ms")


@query(
    "described_counts",
    """SELECT event_id, array_to_string(list_filter([CASE user_id % 3 WHEN 1 THEN '1 email address' WHEN 2 THEN '2 email addresses' END, CASE WHEN user_id % 2 = 1 THEN '1 card number' END], lambda x: x IS NOT NULL), ', ') AS words FROM events""",
)
def described_counts(spark, folder):
    counts = table(spark, folder, "events").selectExpr("event_id", "map('EMAIL', user_id % 3, 'CARD', user_id % 2) AS c")
    return counts.selectExpr("event_id", f"{describe_counts('c')} AS words")


@query(
    "audit_rows",
    f"""WITH e AS {_EVENT_SQL}
SELECT task_id, CAST(seq AS BIGINT) AS seq, type, CAST(NULL AS VARCHAR) AS redacted_goal FROM e
UNION ALL SELECT DISTINCT task_id, CAST(-1 AS BIGINT), 'goal', 'goal of ' || task_id FROM e""",
)
def audit_rows(spark, folder):
    """Each task's redacted goal and its events, a row each."""
    events = _events(spark, folder).select("task_id", "seq", "type", "page")
    goals = events.select("task_id").distinct().selectExpr("task_id", "concat('goal of ', task_id) AS redacted_goal")
    return files.audit_rows(events, goals).selectExpr(
        "task_id", "seq", "get_json_object(event, '$.type') AS type", "get_json_object(event, '$.redacted_goal') AS redacted_goal"
    )


_TRUTH_JSON = (
    "'{\"page\":\"p' || cast(o_orderkey AS string) || CASE WHEN o_orderkey % 7 = 0 THEN '.htm' ELSE '.html' END || '\",\"about\":\"a\",\"pii\":[{\"category\":\"' || "
    "CASE WHEN o_orderkey % 5 = 0 THEN 'MAIL' ELSE 'EMAIL' END || '\",\"value\":\"v' || cast(o_custkey AS string) || '\",\"where\":\"text\"},"
    "{\"category\":\"CARD\",\"value\":\"w\",\"where\":\"field\"}],\"notPii\":[\"n' || cast(o_custkey AS string) || '\"],\"faces\":' || CASE WHEN o_orderkey % 11 = 0 THEN '\"1\"' ELSE '1' END || '}'"
)


@query(
    "truth_tables",
    """SELECT 'item' AS kind, 'p' || o_orderkey || '.html' AS page, CASE i WHEN 0 THEN 'EMAIL v' || o_custkey ELSE 'CARD w' END AS detail FROM orders, (SELECT unnest([0, 1]) AS i) WHERE o_orderkey % 7 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 11 > 0
UNION ALL SELECT 'look-alike', 'p' || o_orderkey || '.html', 'n' || o_custkey FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 11 > 0
UNION ALL SELECT 'reject', 'f' || o_orderkey, 'faces' FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT 'reject', 'f' || o_orderkey, 'page' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'reject', 'f' || o_orderkey, 'category' FROM orders WHERE o_orderkey % 5 = 0""",
)
def truth_tables(spark, folder):
    """Truth documents to items, look-alikes and rejects."""
    orders = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey"))
    raw = orders.selectExpr("concat('f', o_orderkey) AS file", once(f"from_json({_TRUTH_JSON}, '{files.TRUTH}')") + " AS d").selectExpr("file", "d.*")
    parts = files.truth_tables(raw)
    return (
        parts["items"].selectExpr("'item' AS kind", "page", "concat(category, ' ', value) AS detail")
        .unionByName(parts["lookalikes"].selectExpr("'look-alike' AS kind", "page", "value AS detail"))
        .unionByName(parts["rejects"].selectExpr("'reject' AS kind", "file AS page", "rule AS detail"))
    )


_STUDY_JSON = (
    "'{\"provider\":\"' || CASE c_nationkey % 2 WHEN 0 THEN 'groq' ELSE 'ollama' END || '\",\"model\":\"m' || cast(c_nationkey AS string) || '\",\"runs\":[{\"task\":\"t\",\"repeat\":1,\"passed\":' || "
    "CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END || ',\"endedRight\":true,\"overreach\":false,\"leaked\":0,\"steps\":' || cast(c_custkey % 9 AS string) || ',\"unverified\":0,\"rateLimitWaits\":0,\"errors\":[],"
    "\"calls\":[{\"latencyMs\":' || cast(c_custkey AS string) || ',\"repairs\":0},{\"latencyMs\":5,\"repairs\":1,\"promptTokens\":10,\"completionTokens\":2}]}]}'"
)


@query(
    "study_files",
    """SELECT CASE c_nationkey % 2 WHEN 0 THEN 'groq' ELSE 'ollama' END || ': m' || c_nationkey AS study, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (c_custkey % 3 = 0) AS BIGINT) AS passed,
 CAST(count(*) AS BIGINT) AS repairs, CAST(10 AS DOUBLE) AS prompt_tokens, round(coalesce(avg(c_custkey % 9) FILTER (c_custkey % 3 = 0), 0), 6) AS steps_when_passed FROM customer GROUP BY ALL""",
)
def study_files(spark, folder):
    """Nested study results to runs and calls, and on to the report."""
    raw = table(spark, folder, "customer").selectExpr(f"from_json({_STUDY_JSON}, '{files.STUDY}') AS d").selectExpr("d.*")
    parts = files.study_tables(raw)
    limits = spark.sql("SELECT 'groq' AS provider, 30D AS per_minute, 1000D AS per_day, 7000D AS input_tokens_per_minute, 8000D AS tokens_per_minute")
    done = study_report(parts["runs"], parts["calls"], limits)
    return done.selectExpr("study", "runs", "passed", "repairs", "prompt_tokens", "round(steps_when_passed, 6) AS steps_when_passed")
