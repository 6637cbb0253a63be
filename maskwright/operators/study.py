"""Study reports over runs and calls: exact ranks, rates against quotas, matrices, error lines, source rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.sql import lit

# A value's order-keeping bucket: about 1 % of its size. Values of one bucket are ranked together.
BUCKET = "cast(signum({v}) * floor(ln(1 + abs(cast({v} AS double))) * 128) AS bigint)"


def exact_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, str]) -> DataFrame:
    """Exact order statistics of groups of any size; no group is ever sorted or collected in one task.

    ``ranks`` maps a column to SQL for a 0-based rank in terms of ``n``, the
    group's size. Rows are first counted per distinct value; buckets of the
    value's size give the rank of each bucket's first value, and only values
    of one bucket are ordered together.
    """
    part = "".join(f"{k}, " for k in keys)
    values = df.where(f"{value} IS NOT NULL").groupBy(*keys, F.expr(value).alias("_v")).agg(F.count("*").alias("_c"))
    bucketed = values.withColumn("_b", F.expr(BUCKET.format(v="_v")))
    sizes = bucketed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bn"))
    over = f"PARTITION BY {part[:-2]} " if keys else ""
    base = sizes.selectExpr(
        *keys, "_b", f"coalesce(sum(_bn) OVER ({over}ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _base",
        f"sum(_bn) OVER ({over.strip()}) AS n",
    )
    placed = bucketed.join(base, [*keys, "_b"]).selectExpr(
        *keys, "_v", "n", "_c",
        f"_base + coalesce(sum(_c) OVER (PARTITION BY {part}_b ORDER BY _v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _from",
    )
    return placed.groupBy(*keys).agg(
        *[F.expr(f"max(if({rank} >= _from AND {rank} < _from + _c, _v, NULL))").alias(name) for name, rank in ranks.items()],
        F.max("n").alias("n"),
    )


def floor_rank(p: float) -> str:
    return f"least(n - 1, cast(floor({p}D * n) AS bigint))"


def percentile_floor(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The element at min(n - 1, floor(p n)) of the sorted values."""
    return exact_ranks(df, keys, value, {name: floor_rank(p) for name, p in shares.items()})


def median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The middle value, or the mean of the middle two."""
    ranked = exact_ranks(
        df, keys, value, {"_low": "cast(floor((n - 1) / 2) AS bigint)", "_high": "cast(floor(n / 2) AS bigint)"}
    )
    return ranked.selectExpr(*keys, f"(_low + _high) / 2 AS {name}", "n")


def study_report(runs: DataFrame, calls: DataFrame, limits: DataFrame) -> DataFrame:
    """Per study: outcomes, waste, latency, tokens, and what its quota allows. NULL rates mean no cap.

    ``runs``: study, provider, passed, ended_right, overreach, refused, leaked,
    steps, unverified, rate_limit_waits, errors. ``calls``: study, latency_ms,
    repairs, prompt_tokens, completion_tokens. ``limits``: one row per
    provider: per_minute, per_day, input_tokens_per_minute, tokens_per_minute.
    """
    r = runs.groupBy("study", "provider").agg(
        F.count("*").alias("runs"), F.expr("count_if(passed)").alias("passed"), F.expr("count_if(ended_right)").alias("ended_right"),
        F.expr("count_if(overreach)").alias("overreach"), F.expr("coalesce(sum(refused), 0)").alias("refused"),
        F.expr("coalesce(sum(leaked), 0)").alias("leaks"),
        F.expr("coalesce(avg(if(passed, steps, NULL)), 0D)").alias("steps_when_passed"),
        F.expr("coalesce(avg(unverified), 0D)").alias("wasted"), F.expr("coalesce(sum(size(errors)), 0)").alias("errors"),
        F.expr("coalesce(sum(rate_limit_waits), 0)").alias("waits"),
    )
    c = calls.groupBy("study").agg(
        F.count("*").alias("calls"), F.expr("coalesce(avg(prompt_tokens), 0D)").alias("prompt_tokens"),
        F.expr("coalesce(avg(if(prompt_tokens IS NULL, NULL, completion_tokens)), 0D)").alias("completion_tokens"),
        F.expr("coalesce(sum(repairs), 0)").alias("repairs"),
    )
    latency = percentile_floor(calls, ["study"], "latency_ms", {"p50": 0.5, "p90": 0.9})
    joined = (
        r.join(c, "study", "left").join(latency.drop("n"), "study", "left").join(F.broadcast(limits), "provider", "left")
        .na.fill(0, ["calls", "prompt_tokens", "completion_tokens", "repairs", "p50", "p90"])
    )
    per_minute = (
        "least(per_minute, if(prompt_tokens > 0, input_tokens_per_minute / prompt_tokens, NULL), "
        "if(prompt_tokens > 0, tokens_per_minute / (prompt_tokens + completion_tokens), NULL))"
    )
    per_task = "greatest(calls / runs, 1D)"
    return joined.withColumn("steps_per_minute", F.expr(per_minute)).selectExpr(
        "study", "runs", "passed", "ended_right", "overreach", "refused", "leaks", "steps_when_passed", "wasted",
        "p50 / 1000 AS p50", "p90 / 1000 AS p90", "prompt_tokens", "completion_tokens", "repairs", "errors", "waits",
        "steps_per_minute", f"per_day / {per_task} AS tasks_per_day",
        f"least(steps_per_minute * 60, 3600 / greatest(p50 / 1000, 0.1D)) / {per_task} AS tasks_per_hour",
    ).orderBy(F.expr("passed / runs").desc(), "study")


def passes_by_task(runs: DataFrame, tasks: list[str]) -> DataFrame:
    """Study by task: passed/total, '-' when never run. The tasks are a fixed, named list."""
    cell = "if(count(*) = 0, '-', concat(count_if(passed), '/', count(*)))"
    return runs.groupBy("study").pivot("task", tasks).agg(F.expr(cell)).na.fill("-")


def stage_summary(samples: DataFrame, latest: int = 500) -> DataFrame:
    """p50, p95 and count per stage over the latest samples; a top-k, so only ``latest`` rows are ever gathered."""
    ring = samples.orderBy(F.desc("at"), F.desc("seq")).limit(latest)
    ranked = percentile_floor(ring, ["stage"], "ms", {"p50": 0.5, "p95": 0.95})
    return ranked.selectExpr("stage", "round(p50, 2) AS p50", "round(p95, 2) AS p95", "n")


def error_counts(lines: DataFrame) -> DataFrame:
    """Distinct error lines per study, once times are stripped. ``lines``: study, line (server log lines)."""
    limit = r"on ([a-z ]+\([A-Z]+\)): Limit ([0-9]+)"
    failed = lines.where("startswith(line, '[plan]') AND contains(line, '->')").selectExpr(
        "study", f"regexp_replace(substring(line, locate('->', line) + 3), {lit(' after [0-9]+ ms')}, '') AS error"
    )
    named = lines.where(f"contains(line, 'provider said') AND line rlike {lit(limit)}").selectExpr(
        "study", f"concat('limit hit: ', regexp_extract(line, {lit(limit)}, 1), ', ', regexp_extract(line, {lit(limit)}, 2)) AS error"
    )
    waited = lines.where("contains(line, 'as it asked')").selectExpr("study", "'short rate limit, waited out by the server' AS error")
    return failed.unionByName(named).unionByName(waited).groupBy("study", "error").agg(F.count("*").alias("n"))


def run_records(events: DataFrame) -> DataFrame:
    """One row per run. ``events``: study, task, repeat, type, verified, wait_ms, error, ts (seconds)."""
    return events.groupBy("study", "task", "repeat").agg(
        F.expr("count_if(type = 'acted' AND NOT verified)").alias("unverified"),
        F.expr("count_if(type = 'rate_limited')").alias("rate_limit_waits"),
        F.expr("count_if(type = 'error')").alias("errors"),
        F.expr("max(ts) - min(ts) - coalesce(sum(wait_ms), 0) / 1000D").alias("seconds"),
    )


# (rule, files it holds for, what their lines may not hold): examples; give your own.
SOURCE_RULES = (
    ("no-persistence", r"^src/", r"\b(localStorage|sessionStorage|indexedDB|chrome\.storage|browser\.storage)\b"),
    ("no-raw-console", r"^src/(lib|ui)/", r"\bconsole\.(log|info|warn|error|debug|dir|table)\s*\("),
    ("no-telemetry", r"^src/", r"(?i)\b(google-analytics|gtag|mixpanel|posthog|amplitude|sentry|datadog)\b"),
)


def rule_scan(files: DataFrame, rules=SOURCE_RULES) -> DataFrame:
    """file, line, rule and the line's first 90 characters, after comments are stripped. ``files``: file, source."""
    bare = (
        f"regexp_replace(regexp_replace(source, {lit(r'/\*[\s\S]*?\*/')}, ''), {lit(r'(?m)(^|[^:])//.*$')}, '$1')"
    )
    lines = files.where("NOT endswith(file, '.test.ts')").selectExpr("file", f"posexplode(split({bare}, '\\n')) AS (pos, text)")
    hits = ", ".join(
        f"if(file rlike {lit(scope)} AND text rlike {lit(pattern)}, {lit(rule)}, NULL)" for rule, scope, pattern in rules
    )
    return lines.selectExpr("file", "pos + 1 AS line", f"explode(array_compact(array({hits}))) AS rule", "substring(trim(text), 1, 90) AS text")
