"""Model replies and provider logs: lenient parsing, usage, waits, and which provider was free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.actions import valid_action
from maskwright.functions.sql import fresh, let, lit

MAX_THEN = 6
DEFAULT_REST_MS = 60000
# What the model is told about a reply that cannot be used.
NOT_JSON = "No JSON could be read from this reply: send one action as a JSON object and nothing else."
NOT_ACTION = "The JSON in this reply is no known action: send it again, corrected, and nothing else."


def parse_output(raw: str) -> str:
    """action, then (follow-ups), error: what a reply means, whatever wraps it.

    Thinking is dropped; the text is parsed as it is or from its first { to
    its last }; a list, {"actions": [...]} and "then" all mean a plan.
    Follow-ups count in order up to the first bad one, at most six, never
    "done", and none after a first action that is done.
    """
    text = f"trim(BOTH FROM regexp_replace({raw}, {lit('(?is)<think>.*?</think>')}, ''))"
    a, x, k = fresh("a"), fresh("x"), fresh("k")

    def inner(t: str) -> str:
        return (
            f"if(locate('{{', {t}) > 0 AND length({t}) - locate('}}', reverse({t})) + 1 >= locate('{{', {t}) AND contains({t}, '}}'), "
            f"substring({t}, locate('{{', {t}), length({t}) - locate('}}', reverse({t})) + 2 - locate('{{', {t})), {t})"
        )

    def usable(t: str) -> str:
        return let(inner(t), lambda cut: f"if(try_parse_json({t}) IS NOT NULL, {t}, if(try_parse_json({cut}) IS NOT NULL, {cut}, NULL))")

    def elements(v: str, path: str) -> str:
        return f"transform(try_variant_get({v}, '{path}', 'array<variant>'), {x} -> to_json({x}))"

    def plan(json: str) -> str:
        def split(v: str) -> str:
            is_list = f"startswith(schema_of_variant({v}), 'ARRAY')"
            rest = f"filter(map_entries(try_variant_get({v}, '$', 'map<string,variant>')), {k} -> {k}.key <> 'then')"
            one = f"to_json(map_from_entries({rest}))"
            return (
                f"CASE WHEN {is_list} THEN {elements(v, '$')} "
                f"WHEN startswith(coalesce(schema_of_variant(try_variant_get({v}, '$.actions', 'variant')), ''), 'ARRAY') THEN {elements(v, '$.actions')} "
                f"WHEN startswith(coalesce(schema_of_variant(try_variant_get({v}, '$.then', 'variant')), ''), 'ARRAY') THEN concat(array({one}), {elements(v, '$.then')}) "
                f"ELSE array({json}) END"
            )

        return let(f"try_parse_json({json})", split)

    def judged(actions: str) -> str:
        first = f"get({actions}, 0)"
        kept = (
            f"aggregate(slice({actions}, 2, greatest(size({actions}) - 1, 0)), named_struct('go', true, 'out', cast(array() AS array<string>)), "
            f"({a}, {x}) -> if({a}.go AND size({a}.out) < {MAX_THEN} AND {valid_action(x)} AND get_json_object({x}, '$.type') <> 'done', "
            f"named_struct('go', true, 'out', concat({a}.out, array({x}))), named_struct('go', false, 'out', {a}.out)), {a} -> {a}.out)"
        )
        none = "cast(array() AS array<string>)"
        good = (
            f"named_struct('action', {first}, 'then', if(get_json_object({first}, '$.type') = 'done', {none}, {kept}), "
            "'error', cast(NULL AS string))"
        )
        return f"if(coalesce({valid_action(first)}, false), {good}, named_struct('action', cast(NULL AS string), 'then', {none}, 'error', {lit(NOT_ACTION)}))"

    broken = f"named_struct('action', cast(NULL AS string), 'then', cast(array() AS array<string>), 'error', {lit(NOT_JSON)})"
    return let(
        text,
        lambda t: let(usable(t), lambda j: f"if({j} IS NULL, {broken}, {let(plan(j), judged)})"),
    )


def usage_totals(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens over the turns of one step, and how many of them were repairs."""
    return turns.groupBy(*keys).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        (F.count("*") - 1).alias("repairs"),
    )


def retry_after_ms(header: str, body: str) -> str:
    """How long a refused call asks to wait: the header's seconds, else "try again in XmYs" in the body; NULL if neither."""
    said = lit(r"(?i)try again in (?:([0-9]+)m)?([0-9]+(?:\.[0-9]+)?)s")
    seconds = f"try_cast(trim({header}) AS double)"
    spoken = f"(coalesce(try_cast(regexp_extract({body}, {said}, 1) AS double), 0D) * 60 + cast(regexp_extract({body}, {said}, 2) AS double))"
    return (
        f"(CASE WHEN trim({header}) <> '' AND {seconds} IS NOT NULL AND abs({seconds}) < double('infinity') THEN cast(ceil({seconds} * 1000) AS bigint) "
        f"WHEN {body} rlike {said} THEN cast(ceil({spoken} * 1000) AS bigint) END)"
    )


def next_provider(calls: DataFrame, rests: DataFrame, chain: list[str]) -> DataFrame:
    """Which provider of an ordered chain a call would go to: the first not resting then, else the first of all.

    ``calls``: call_id, at_ms. ``rests``: provider, from_ms, retry_after_ms
    (NULL rests a minute). An as-of merge: both sides are put in one time
    order per provider and the latest rest is carried forward, hour by hour.
    """
    from maskwright.operators.skew import ordered

    hour = 3600000
    names = ", ".join(lit(p) for p in chain)
    asked = calls.selectExpr("call_id", "at_ms", f"posexplode(array({names})) AS (position, provider)")
    merged = asked.selectExpr("provider", "position", "call_id", "at_ms", "1 AS kind", "cast(NULL AS bigint) AS until").unionByName(
        rests.selectExpr(
            "provider", "cast(NULL AS int) AS position", "cast(NULL AS bigint) AS call_id", "from_ms AS at_ms", "0 AS kind",
            f"from_ms + coalesce(retry_after_ms, {DEFAULT_REST_MS}) AS until",
        )
    )
    carried = ordered(
        merged, ["provider"], "struct(at_ms, kind, coalesce(call_id, until))", {"resting_until": ("last", "until")},
        f"cast(floor(at_ms / {hour}) AS bigint)",
    )
    free = carried.where("kind = 1").groupBy("call_id").agg(
        F.expr("min_by(provider, position) FILTER (WHERE coalesce(resting_until, 0) <= at_ms)").alias("awake")
    )
    return free.selectExpr("call_id", f"coalesce(awake, {lit(chain[0])}) AS provider", "awake IS NULL AS all_resting")
