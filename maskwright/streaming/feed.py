"""The live event feed: per-task state, liveness, gating; and the same things over a finished table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwright.operators import contracts, leaks
from maskwright.operators.skew import ordered

# A beat every two seconds; silence of six means the other side is gone.
HEARTBEAT_MS = 2000
DISCONNECTED_MS = 6000

_STATE = (
    "events bigint, steps bigint, prompt_tokens bigint, completion_tokens bigint, last_model string, last_latency double, "
    "finished boolean, last_seen bigint, redacted_goal string, page string"
)
FEED = (
    "task_id string, events bigint, steps bigint, prompt_tokens bigint, completion_tokens bigint, last_model string, "
    "last_latency double, finished boolean, connected boolean, redacted_goal string, page string"
)


class TaskFeed(StatefulProcessor):
    """Keeps what is known of each task: the latest value of a field wins, an absent one keeps the old.

    One small row of state per task; its events are not kept. A timer marks
    the task disconnected once the feed's clock is six seconds past its last
    message, and lets a finished task's state go.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        old = self.task.get()
        events, steps, prompt, completion, model, latency, finished, seen, goal, page = old or (0, 0, 0, 0, None, None, False, 0, None, None)
        shown = batch[batch["type"] != "heartbeat"]
        if (batch["type"] == "started").any():
            # A start puts the totals back, as a task's own first event.
            begin = batch.index[batch["type"] == "started"][-1]
            position = batch.index.get_loc(begin)
            counted, steps, prompt, completion = batch.iloc[position:], 0, 0, 0
        else:
            counted = batch
        planned = counted[counted["type"] == "planned"]
        last = lambda column, was: next((v for v in reversed(shown[column].tolist()) if v is not None and v == v), was)
        events += len(shown)
        steps += len(planned)
        prompt += int(planned["prompt_tokens"].fillna(0).sum())
        completion += int(planned["completion_tokens"].fillna(0).sum())
        model, latency, goal, page = last("model", model), last("latency_ms", latency), last("redacted_goal", goal), last("page", page)
        if len(shown):
            finished = bool(shown["type"].iloc[-1] == "finished")
        seen = max(int(seen), int(batch["sent_at"].max().value // 1_000_000))
        self.task.update((events, steps, prompt, completion, model, latency, finished, seen, goal, page))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(seen + DISCONNECTED_MS)
        yield self._row(key, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, False)
        if self.task.get()[6]:
            self.task.clear()

    def _row(self, key, connected: bool) -> pd.DataFrame:
        events, steps, prompt, completion, model, latency, finished, _, goal, page = self.task.get()
        return pd.DataFrame(
            {
                "task_id": [key[0]], "events": [events], "steps": [steps], "prompt_tokens": [prompt], "completion_tokens": [completion],
                "last_model": [model], "last_latency": [latency], "finished": [finished], "connected": [connected],
                "redacted_goal": [goal], "page": [page],
            }
        )

    def close(self) -> None:
        pass


def task_feed(events: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """The state of each task after every batch that touches it (update mode). The feed's clock is ``sent_at``."""
    return events.withWatermark("sent_at", lateness).groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=TaskFeed(), outputStructType=FEED, outputMode="Update", timeMode="EventTime"
    )


def task_feed_batch(events: DataFrame) -> DataFrame:
    """The same state over a finished table: aggregates only, so a hot task is reduced where it lies."""
    starts = events.where("type = 'started'").groupBy("task_id").agg(F.max("seq").alias("_start"))
    since = events.join(starts, "task_id", "left").withColumn("_counted", F.expr("seq >= coalesce(_start, -1) AND type = 'planned'"))
    shown = "type <> 'heartbeat'"

    def last(column: str, name: str | None = None):
        return F.expr(f"max_by({column}, seq) FILTER (WHERE {shown} AND {column} IS NOT NULL)").alias(name or column)

    return since.groupBy("task_id").agg(
        F.expr(f"count_if({shown})").alias("events"), F.expr("count_if(_counted)").alias("steps"),
        F.expr("coalesce(sum(if(_counted, prompt_tokens, 0)), 0)").alias("prompt_tokens"),
        F.expr("coalesce(sum(if(_counted, completion_tokens, 0)), 0)").alias("completion_tokens"),
        last("model", "last_model"), last("latency_ms", "last_latency"),
        F.expr(f"coalesce(max_by(type = 'finished', seq) FILTER (WHERE {shown}), false)").alias("finished"),
        last("redacted_goal"), last("page"),
    )


def liveness(events: DataFrame, key: str = "task_id", silence_ms: int = DISCONNECTED_MS, bucket: str | None = None, until: str | None = None) -> DataFrame:
    """Gaps longer than the allowed silence between messages of one key; with ``until``, after its last one up to then too (never back).

    ``bucket`` rises with ``sent_at``.
    """
    seen = ordered(events, [key], "sent_at", {"_next": ("lead", "sent_at")}, bucket)
    gap = f"unix_millis({'_next' if until is None else f'coalesce(_next, {until})'}) - unix_millis(sent_at)"
    return seen.where(f"{gap} > {silence_ms}").selectExpr(key, f"sent_at + make_interval(0, 0, 0, 0, 0, 0, {silence_ms / 1000}) AS disconnected_at", "_next AS back_at")


def running_totals(events: DataFrame, key: str = "task_id", bucket: str | None = None) -> DataFrame:
    """Steps and tokens of a task so far, and its latest latency, at each event."""
    planned = "type = 'planned'"
    return ordered(
        events, [key], "seq",
        {
            "total_steps": ("sum", f"if({planned}, 1L, 0L)"), "total_prompt": ("sum", f"if({planned}, coalesce(prompt_tokens, 0L), 0L)"),
            "total_completion": ("sum", f"if({planned}, coalesce(completion_tokens, 0L), 0L)"), "latest_latency": ("last", f"if({planned}, latency_ms, NULL)"),
        },
        bucket,
    )


def event_projection(events: DataFrame) -> DataFrame:
    """What the feed shows of an event: no values, timings rounded, unknown types dropped."""
    return events.where("type IN ('started', 'observed', 'planned', 'acted', 'warning', 'finished')").selectExpr(
        "sent_at", "task_id", "seq", "type", "if(type IN ('observed', 'planned', 'acted'), step, NULL) AS step",
        "if(type = 'observed', elements, NULL) AS elements", "if(type IN ('observed', 'finished'), redactions, NULL) AS redactions",
        "if(type = 'observed', page, NULL) AS page", "if(type = 'planned', action_type, NULL) AS action_type",
        "if(type = 'planned', target_label, NULL) AS target_label", "if(type = 'planned', model, NULL) AS model",
        "if(type = 'planned', latency_ms, NULL) AS latency_ms", "if(type = 'acted', verified, NULL) AS verified",
        "if(type = 'acted', nullif(note, ''), NULL) AS note", "if(type = 'finished', outcome, NULL) AS outcome",
        "if(type = 'finished', steps, NULL) AS steps", "if(type IN ('acted', 'warning', 'finished'), nullif(message, ''), NULL) AS message",
        "if(type = 'observed', transform_values(stage_ms, (k, v) -> round(v)), NULL) AS stage_ms",
    )


def gated_feed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events that may go out, why each other was dropped). Works on a stream as on a table."""
    valid, broken = contracts.validate(events, {k: v for k, v in contracts.EVENT.items()})
    clean, held = leaks.outbound_split(valid)
    dropped = broken.selectExpr("type", "'invalid' AS reason", "size(issues) AS findings").unionByName(
        held.selectExpr("type", "'private data' AS reason", "size(findings) AS findings")
    )
    return clean, dropped


def resource_summary(events: DataFrame) -> DataFrame:
    """Per task: model file sizes, the planner in use, whether it is the fallback, the latest view's timings.

    ``events``: task_id, seq, type, model_files (array of name, size_bytes),
    planner_provider, planner_model, fallback_provider, fallback_model, model, stage_ms.
    """
    def last(column: str, where: str = "true"):
        return F.expr(f"max_by({column}, seq) FILTER (WHERE {column} IS NOT NULL AND {where})")

    latest = events.groupBy("task_id").agg(
        last("aggregate(model_files, 0L, (a, f) -> a + f.size_bytes)").alias("footprint"),
        last("struct(planner_provider AS provider, planner_model AS model, fallback_provider AS other, fallback_model AS other_model)", "planner_model IS NOT NULL").alias("p"),
        last("model").alias("last_model"), last("stage_ms", "type = 'observed'").alias("stage_ms"),
    )
    by_fallback = "coalesce(last_model = p.other_model, false)"
    return latest.selectExpr(
        "task_id", "coalesce(footprint, 0L) AS footprint", "coalesce(last_model, p.model, '') AS model", f"{by_fallback} AS by_fallback",
        f"if({by_fallback}, concat(p.other, ' (fallback)'), coalesce(p.provider, '')) AS provider", "stage_ms",
    )


def gated_sink(write: Callable[[DataFrame, int], Any], dropped: Callable[[dict[str, int], int], Any] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that only ever passes on rows the gate lets through.

    ``dropped`` is told, batch by batch, how many rows came, how many were invalid and how many held private data:
    counted by observed metrics while the batch is written, not by a second pass.
    """

    def run(batch: DataFrame, number: int) -> None:
        came, passed, valid = Observation(), Observation(), Observation()
        checked, _ = contracts.validate(batch.observe(came, F.count(F.lit(1)).alias("n")), contracts.EVENT)
        clean, _ = leaks.outbound_split(checked.observe(valid, F.count(F.lit(1)).alias("n")))
        write(clean.observe(passed, F.count(F.lit(1)).alias("n")), number)
        if dropped is not None:
            counts = [o.get["n"] for o in (came, valid, passed)]
            dropped({"came": counts[0], "invalid": counts[0] - counts[1], "private data": counts[1] - counts[2]}, number)

    return run
