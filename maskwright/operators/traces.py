"""Step histories: page states, loops, stalls, repeats, unasked commitments, where private values go.

A task is at most ``MAX_STEPS`` steps, so windows and folds over ``task_id``
are bounded. Where a history has no such limit, pass ``bucket`` (SQL that
rises with the step) and no task is handled by one task of the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.actions import action_key, clip
from maskwright.functions.detectors import rlike
from maskwright.functions.sql import fresh, lit, lits
from maskwright.functions.tokens import find_tokens
from maskwright.operators.skew import ordered

# The limits of a task.
MAX_STEPS = 25
MAX_HISTORY = 20
MAX_UNVERIFIED = 3
MAX_VISITS = 3
TIMEOUT_SECONDS = 300
NO_CHANGE = "the page did not change"
CODES = (
    "TARGET_NOT_FOUND", "TARGET_NOT_CLICKABLE", "ACTION_TIMEOUT", "UNSUPPORTED_ACTION", "MALFORMED_ACTION",
    "MAX_STEPS_REACHED", "TASK_CANCELLED", "CONTENT_SCRIPT_ERROR", "OBSERVATION_FAILED", "NAVIGATION_BLOCKED",
    "GOAL_NOT_ACHIEVED", "TASK_TIMEOUT", "PLANNER_ERROR", "NO_PROGRESS", "PII_TRIPWIRE", "NAME_DETECTION_FAILED",
)


def json_string(text: str) -> str:
    """A string as JSON writes it, quotes included."""
    whole = f"to_json(named_struct('a', {text}))"
    return f"substring({whole}, 6, length({whole}) - 6)"


def page_state(views: DataFrame, elements: DataFrame) -> DataFrame:
    """``view_id, state``: a fingerprint of what the page says, without where things sit."""
    states = "array_join(filter(coalesce(state, array()), s -> s NOT IN ('focused', 'offscreen')), ',')"
    said = elements.selectExpr(
        "view_id", "ordinal", f"concat_ws('\\u0001', role, coalesce(label, ''), coalesce(value, ''), {states}) AS said"
    )
    per_view = said.groupBy("view_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(ordinal, said))), x -> x.said), '\\u0002')").alias("said")
    )
    return views.join(per_view, "view_id", "left").selectExpr(
        "view_id", "sha2(concat_ws('\\u0002', concat(origin, path_template), title, coalesce(said, '')), 256) AS state"
    )


def state_visits(states: DataFrame, bucket: str | None = None) -> DataFrame:
    """Arrivals at each state (stays do not count), and whether the third one was reached.

    ``states``: task_id, cycle, state.
    """
    moved = ordered(states, ["task_id"], "cycle", {"_before": ("lag", "state")}, bucket).withColumn(
        "arrived", F.expr("_before IS NULL OR _before <> state")
    )
    counted = ordered(moved, ["task_id", "state"], "cycle", {"visits": ("sum", "cast(arrived AS bigint)")}, bucket)
    return counted.selectExpr(*states.columns, "arrived", "visits", f"arrived AND visits >= {MAX_VISITS} AS looping")


def describe_change(views: DataFrame, elements: DataFrame) -> DataFrame:
    """``task_id, cycle, change``: what changed since the view before; NULL when nothing did.

    ``views``: task_id, cycle, view_id, page (origin and path), title.
    """
    named = (
        elements.join(views.select("view_id", "task_id", "cycle"), "view_id")
        .selectExpr("task_id", "cycle", "ordinal", "role", "coalesce(label, value) AS name", "NOT coalesce(array_contains(state, 'offscreen'), false) AS shown")
        .where("name <> ''")
        .groupBy("task_id", "cycle", "role", "name")
        .agg(F.min("ordinal").alias("at"), F.expr("bool_or(shown)").alias("shown"))
    )
    before = named.selectExpr("task_id", "cycle + 1 AS cycle", "role", "name", "at AS was_at", "shown AS was_shown")
    both = named.join(before, ["task_id", "cycle", "role", "name"], "full")
    text = f"concat(role, ' ', {json_string(clip('name', 40))})"
    per_view = both.groupBy("task_id", "cycle").agg(
        F.expr(
            f"array_sort(collect_list(struct(at, {text} AS text)) FILTER (WHERE at IS NOT NULL AND (was_at IS NULL OR (shown AND NOT was_shown))))"
        ).alias("appeared"),
        F.expr(f"array_sort(collect_list(struct(was_at, {text} AS text)) FILTER (WHERE at IS NULL))").alias("gone"),
    )

    def some(column: str) -> str:
        listed = f"array_join(transform(slice({column}, 1, 3), x -> x.text), ', ')"
        return f"if(size({column}) > 3, concat({listed}, ' and ', size({column}) - 3, ' more'), {listed})"

    pairs = views.selectExpr("task_id", "cycle", "page", "title").join(
        views.selectExpr("task_id", "cycle + 1 AS cycle", "page AS was_page"), ["task_id", "cycle"]
    )
    parts = (
        f"nullif(array_join(array_compact(array(if(size(appeared) > 0, concat('appeared: ', {some('appeared')}), NULL), "
        f"if(size(gone) > 0, concat('went away: ', {some('gone')}), NULL))), '; '), '')"
    )
    return pairs.join(per_view, ["task_id", "cycle"], "left").selectExpr(
        "task_id", "cycle",
        f"if(page <> was_page, concat('a new page opened: ', {json_string(clip('title', 60))}), {parts}) AS change",
    )


def join_notes(first: str, second: str) -> str:
    """Two notes as one of at most 200 characters."""
    return clip(f"concat_ws('; ', nullif({first}, ''), {second})", 200)


def reverify(steps: DataFrame, bucket: str | None = None) -> DataFrame:
    """A step noted "no change" is verified after all when the next view shows one; the change joins the note.

    ``steps``: task_id, cycle, verified, note, change (what this view shows against the one before).
    """
    seen = ordered(steps, ["task_id"], "cycle", {"_next": ("lead", "change")}, bucket)
    missed = f"(_next IS NOT NULL AND NOT verified AND coalesce(startswith(note, {lit(NO_CHANGE)}), false))"
    rest = f"regexp_replace(substring(note, {len(NO_CHANGE) + 1}), '^; ', '')"
    return seen.selectExpr(
        *[c for c in steps.columns if c not in ("verified", "note")],
        f"{missed} AS reverified", f"verified OR {missed} AS verified",
        f"CASE WHEN _next IS NULL THEN note WHEN {missed} THEN {join_notes(rest, '_next')} ELSE {join_notes('note', '_next')} END AS note",
    )


def stall_streak(steps: DataFrame, bucket: str | None = None) -> DataFrame:
    """Unverified steps in a row as the task counted them: a later re-verification takes one off, a verified step clears it.

    ``steps``: task_id, cycle, verified (as first seen), reverified. What a step does to the count is to clear it, to
    leave it or to add one; so the count is a running sum less its value at the last clearing, and with ``bucket``
    (see :func:`skew.ordered`) a task of any length is split, one row per bucket carrying what those before it did.
    """
    done = steps.selectExpr("task_id", "cast(cycle AS bigint) AS cycle", "coalesce(verified, false) AS _clear", "coalesce(reverified, false) AS _off")
    summed = ordered(done, ["task_id"], "cycle", {"_sum": ("sum", "if(_clear OR _off, 0, 1)")}, bucket)
    since = ordered(summed, ["task_id"], "cycle", {"_from": ("last", "if(_clear, _sum, NULL)")}, bucket)
    streak = "if(_clear, 0, _sum - coalesce(_from, 0) + if(_off, 1, 0))"
    return since.selectExpr("task_id", "cycle", f"cast({streak} AS int) AS streak").withColumn("stalled", F.col("streak") >= MAX_UNVERIFIED)


def repeated_step(steps: DataFrame, bucket: str | None = None) -> DataFrame:
    """Whether a step is the one last carried out, on the same state. A wait never is.

    ``steps``: task_id, cycle, state, action (JSON), refused. A repeat is not
    carried out, but leaves the same last step, so it need not be taken out.
    """
    keyed = steps.withColumn("_key", F.expr(f"struct(state AS state, {action_key('action')} AS k)"))
    seen = ordered(keyed, ["task_id"], "cycle", {"_last": ("last_before", "if(refused, NULL, _key)")}, bucket)
    return seen.selectExpr(
        *steps.columns, "NOT refused AND get_json_object(action, '$.type') <> 'wait' AND coalesce(_last = _key, false) AS repeated"
    )


def unasked_commitment(label: str, goal: str) -> str:
    """What a click would commit to when the goal does not ask for it; NULL when it is fine."""
    arms = " ".join(
        f"WHEN {rlike(label, '(?i)' + button)} AND NOT {rlike(goal, '(?i)' + asks)} THEN {lit(does)}"
        for does, button, asks in P.COMMITMENTS
    )
    return f"(CASE {arms} END)"


def goal_asks_for(goal: str, category: str) -> str:
    arms = " ".join(f"WHEN {lit(c)} THEN {rlike(goal, '(?i)' + pattern)}" for c, pattern in P.ASKS_FOR.items())
    return f"coalesce(CASE {category} {arms} END, false)"


def data_use(typed: DataFrame, sightings: DataFrame, goals: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """May these values be typed here? Adds ``concern`` and ``decision`` (allowed, asked, refused) to each typed token.

    ``typed``: task_id, cycle, site, token. ``sightings``: task_id, cycle, site,
    token (every view's tokens; the first view's site is where the task
    started). ``goals``: task_id, goal, goal_tokens. ``answers``: task_id,
    token, site, allowed; a question no one answered is a no.
    """
    seen = sightings.where("token IS NOT NULL").groupBy("task_id", "token", "site").agg(F.min("cycle").alias("seen_cycle"))
    start = sightings.groupBy("task_id").agg(F.expr("min_by(site, cycle)").alias("start_site"))
    once = typed.select("task_id", "cycle", "site", "token").distinct()
    joined = once.join(goals, "task_id", "left").join(start, "task_id", "left").join(seen, ["task_id", "token", "site"], "left")
    category = "regexp_extract(token, '^<PII:([A-Z_]+):', 1)"
    in_goal = "coalesce(array_contains(goal_tokens, token), false)"
    placed = f"(coalesce(seen_cycle <= cycle, false) OR ({in_goal} AND coalesce(site = start_site, false)))"
    concern = (
        f"CASE WHEN NOT {in_goal} AND NOT {goal_asks_for('goal', category)} THEN 'not-asked' WHEN NOT {placed} THEN 'other-site' "
        f"WHEN {category} IN ({lits(P.SENSITIVE)}) THEN 'sensitive' END"
    )
    judged = joined.selectExpr("task_id", "cycle", "site", "token", f"{concern} AS concern")
    first = judged.where("concern IS NOT NULL").groupBy("task_id", "token", "site").agg(F.min("cycle").alias("asked_at"))
    if answers is not None:
        first = first.join(answers, ["task_id", "token", "site"], "left")
    else:
        first = first.withColumn("allowed", F.lit(False))
    return judged.join(first, ["task_id", "token", "site"], "left").selectExpr(
        "task_id", "cycle", "site", "token", "concern",
        "CASE WHEN asked_at IS NULL OR cycle < asked_at THEN 'allowed' WHEN cycle = asked_at THEN 'asked' "
        "WHEN coalesce(allowed, false) THEN 'allowed' ELSE 'refused' END AS decision",
    )


def retarget(followups: DataFrame, views: DataFrame, elements: DataFrame) -> DataFrame:
    """Each queued follow-up with the element it applies to now, or NULL when the page or a sole match is missing.

    ``followups``: followup_id, task_id, cycle (of the view it meets), page, role, name (NULL without a target).
    """
    here = views.select("task_id", "cycle", "view_id", F.col("page").alias("page_now"))
    named = elements.selectExpr("view_id", "role", "coalesce(label, value, '') AS name", "id")
    only = named.groupBy("view_id", "role", "name").agg(F.min("id").alias("target"), F.count("*").alias("_n"))
    met = followups.join(here, ["task_id", "cycle"], "left").join(only, ["view_id", "role", "name"], "left")
    return met.selectExpr(
        *followups.columns, "if(page = page_now AND _n = 1, target, NULL) AS target",
        "coalesce(page = page_now AND (name IS NULL OR _n = 1), false) AS applies",
    )


def limit_history(steps: DataFrame, n: int = MAX_HISTORY) -> DataFrame:
    """The last n steps of each task: a top-k, cut in each partition before the shuffle."""
    ranked = steps.withColumn("_r", F.expr("row_number() OVER (PARTITION BY task_id ORDER BY cycle DESC)"))
    return ranked.where(F.col("_r") <= n).drop("_r")


def over_limits(steps: DataFrame, max_steps: int = MAX_STEPS, seconds: int = TIMEOUT_SECONDS) -> DataFrame:
    """Tasks past their step or time limit. ``steps``: task_id, cycle, ts."""
    used = steps.groupBy("task_id").agg(
        F.count("*").alias("steps"), F.expr("unix_seconds(max(ts)) - unix_seconds(min(ts))").alias("seconds")
    )
    return used.selectExpr("task_id", "steps", "seconds", f"steps >= {max_steps} AS out_of_steps", f"seconds > {seconds} AS out_of_time")


def outcome(tasks: DataFrame, signals: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """One finish row per task: the first signal by cycle decides, else the step limit.

    ``signals``: task_id, cycle, outcome, code, rank (which rule is tested first within a cycle).
    """
    first = signals.groupBy("task_id").agg(F.expr("min_by(struct(outcome, code, cycle), struct(cycle, rank))").alias("f"))
    return tasks.join(first, "task_id", "left").selectExpr(
        "task_id", "coalesce(f.outcome, 'failed') AS outcome", "if(f IS NULL, 'MAX_STEPS_REACHED', f.code) AS code",
        f"coalesce(f.cycle, {max_steps}) AS steps",
    )


def finish_signals(steps: DataFrame, visits: DataFrame, streaks: DataFrame) -> DataFrame:
    """The signals the recorded steps give: going in circles, done, stalled."""
    loops = visits.where("looping").selectExpr("task_id", "cycle", "'failed' AS outcome", "'NO_PROGRESS' AS code", "0 AS rank")
    kind, good = "get_json_object(action, '$.type')", "get_json_object(action, '$.success') = 'true'"
    done = steps.where(f"{kind} = 'done'").selectExpr(
        "task_id", "cycle", f"if({good}, 'completed', 'failed') AS outcome", f"if({good}, NULL, 'GOAL_NOT_ACHIEVED') AS code", "1 AS rank"
    )
    stalled = streaks.where("stalled").selectExpr("task_id", "cycle", "'failed' AS outcome", "'NO_PROGRESS' AS code", "2 AS rank")
    return loops.unionByName(done).unionByName(stalled)


def scroll_end(direction: str, target: str) -> str:
    end = f"CASE {direction} WHEN 'up' THEN 'top' WHEN 'down' THEN 'bottom' ELSE 'edge' END"
    what = f"if({target} IS NULL, 'the page', 'that area')"
    return (
        f"concat({what}, ' did not move: it is already at the ', {end}, ', so what the goal needs is not further ', {direction})"
    )


def target_after(value: str, state: str) -> str:
    """What an action's target shows now, at most 150 characters; NULL when there is nothing to tell."""
    reported = ", ".join(lit(s) for s in P.REPORTED_STATES)
    s = fresh("s")
    states = f"filter(coalesce({state}, array()), {s} -> {s} IN ({reported}))"
    shows = f"if(coalesce({value}, '') <> '', concat('shows ', {json_string(clip(value, 80))}), NULL)"
    parts = f"array_compact(array({shows}, if(size({states}) > 0, concat('is ', array_join({states}, ', ')), NULL)))"
    return f"if(size({parts}) > 0, left(concat('now it ', array_join({parts}, ' and ')), 150), NULL)"


def task_check(runs: DataFrame, planned: DataFrame, secrets: DataFrame, requests: DataFrame) -> DataFrame:
    """Passed: the page is right, the task ended right, nothing forbidden was touched, no secret left.

    ``runs``: task_id, page_ok, ended_right. ``planned``: task_id, cycle, type,
    label, forbidden (pattern), refused. ``secrets``: task_id, secret (a
    scenario's own short list). ``requests``: task_id, request_no, body.
    """
    over = planned.where("type <> 'done' AND NOT refused AND forbidden IS NOT NULL AND coalesce(label, '') rlike forbidden")
    touched = over.groupBy("task_id").agg(F.count("*").alias("overreach"))
    lists = secrets.groupBy("task_id").agg(F.collect_set("secret").alias("secrets"))
    leaks = requests.join(lists, "task_id").selectExpr("task_id", "explode(filter(secrets, s -> contains(body, s))) AS secret")
    leaked = leaks.groupBy("task_id").agg(F.expr("count(DISTINCT secret)").alias("leaked"))
    joined = runs.join(touched, "task_id", "left").join(leaked, "task_id", "left").na.fill(0, ["overreach", "leaked"])
    return joined.withColumn("passed", F.expr("page_ok AND ended_right AND overreach = 0 AND leaked = 0"))


def privacy_record(steps: DataFrame) -> DataFrame:
    """Verified typing of private values: which tokens, into what, where. ``steps``: task_id, cycle, action, verified, label, site."""
    typed = steps.where("verified AND get_json_object(action, '$.type') = 'type'").selectExpr(
        "task_id", "cycle", "label", "site",
        f"explode(regexp_extract_all(get_json_object(action, '$.value'), {lit(P.ANY_TOKEN)}, 0)) AS token",
    )
    return typed.selectExpr("task_id", "cycle", "token", "coalesce(nullif(label, ''), 'a field') AS field", "site")


def hidden_once_per_page(steps: DataFrame, bucket: str | None = None) -> DataFrame:
    """Counts shown only on the first of a run of steps on one page. ``steps``: task_id, cycle, page, hidden."""
    seen = ordered(steps, ["task_id"], "cycle", {"_page": ("lag", "struct(page AS page)")}, bucket)
    return seen.selectExpr(
        *[c for c in steps.columns if c != "hidden"], "if(_page IS NOT NULL AND _page.page <=> page, NULL, nullif(hidden, '')) AS hidden"
    )


def fold_task(events: DataFrame) -> DataFrame:
    """The steps of each task as a reader sees them.

    ``events``: task_id, seq, type, step, action_type, target_label,
    latency_ms, verified, message, page, redactions (as text). Each planned
    step takes the latest counts and page before it; the latest "acted" of a
    step, by seq, tells how it went.
    """
    seen = ordered(
        events, ["task_id"], "seq",
        {"_view": ("last", "if(type = 'observed', struct(page AS page, redactions AS redactions), NULL)")},
    )
    planned = seen.where("type = 'planned' AND action_type <> 'done'").selectExpr(
        "task_id", "seq", "step", "action_type", "target_label", "latency_ms", "_view.page AS page", "_view.redactions AS redactions"
    )
    acted = events.where("type = 'acted'").groupBy("task_id", "step").agg(
        F.expr("max_by(struct(verified, message), seq)").alias("a")
    )
    return planned.join(acted, ["task_id", "step"], "left").selectExpr(
        *[c for c in planned.columns], "a.verified AS verified", "a.message AS message"
    )


def task_phase(events: DataFrame) -> DataFrame:
    """Latest phase, warnings and finish of each task. Warnings of a task are few; heartbeats change nothing."""
    phase = (
        "CASE type WHEN 'started' THEN 'reading' WHEN 'observed' THEN 'planning' WHEN 'acted' THEN 'reading' WHEN 'finished' THEN 'done' "
        "WHEN 'planned' THEN if(action_type = 'done', NULL, 'acting') END"
    )
    return events.groupBy("task_id").agg(
        F.expr(f"max_by({phase}, seq) FILTER (WHERE {phase} IS NOT NULL)").alias("phase"),
        F.expr("count_if(type = 'warning')").alias("warnings"), F.expr("max_by(outcome, seq) FILTER (WHERE type = 'finished')").alias("outcome"),
    )


def injection_flag(text: str, max_length: int | None = P.MAX_GOAL_LENGTH) -> str:
    """Why a goal is rejected: 'too long', the first phrase rule hit ('rule n'), or NULL."""
    arms = " ".join(f"WHEN {rlike(text, '(?i)' + rule)} THEN 'rule {i + 1}'" for i, rule in enumerate(P.INJECTION_RULES))
    long = f"WHEN length({text}) > {max_length} THEN 'too long' " if max_length is not None else ""
    return f"(CASE {long}{arms} END)"


def typed_tokens(steps: DataFrame) -> DataFrame:
    """``task_id, cycle, site, token`` of every planned "type" step."""
    value = "get_json_object(action, '$.value')"
    return steps.where("get_json_object(action, '$.type') = 'type'").selectExpr("task_id", "cycle", "site", f"explode({find_tokens(value)}) AS token")
