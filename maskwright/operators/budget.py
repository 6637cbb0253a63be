"""Requests fitted to a token budget, and their text form.

A request is one row: its elements and history are arrays of one page view
and one bounded history, so every stage is an expression over that row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.spans import find
from maskwright.functions.sql import fresh, let, lit, lits
from maskwright.operators.traces import json_string

# Fixed value: how a request names the hidden parts of images.
REGIONS = "Blacked-out image regions: "
# The line that tells a page was cut, and the numbers of notes kept.
SHORTENED = (
    'This page was too long to send whole: text ending in "…" is cut short, and some elements far from the view are left '
    "out. Open or scroll to an item to read it in full."
)
NOTES_KEPT = 3


def estimate_tokens(system_chars: str, user_chars: str) -> str:
    return f"(cast(ceil({system_chars} / 3.7D + {user_chars} / 2.8D) AS bigint) + 20)"


def cut_text(text: str, limit: int) -> str:
    """Cut at a word after 60 % of the limit, never inside a token, and marked with an ellipsis."""
    a, m = fresh("a"), fresh("m")

    def at_word(v: str) -> str:
        # The last space at or before the cut: found from the front of the reversed head.
        head = f"substring({v}.t, 1, {v}.e + 1)"
        back = f"locate(' ', reverse({head}))"
        space = f"(length({head}) - {back})"
        end = f"if({v}.e < length({v}.t) AND {back} > 0 AND {space} > {limit} * 0.6D, {space}, {v}.e)"
        return f"concat(regexp_replace(substring({v}.t, 1, {end}), {lit('[' + P.SPACE + ']+$')}, ''), '…')"

    end = (
        f"aggregate({find(text, lit(P.ANY_TOKEN), f'contains({text}, {lit(chr(60) + 'PII:')})')}, {limit}, "
        f"({a}, {m}) -> if({m}.start < {a} AND {m}.end > {a}, {m}.end, {a}))"
    )
    return f"if(length({text}) <= {limit}, {text}, {let(f'named_struct({chr(39)}t{chr(39)}, {text}, {chr(39)}e{chr(39)}, {end})', at_word)})"


def is_control(e: str) -> str:
    return f"({e}.role IN ({lits(P.CONTROL_ROLES)}) OR coalesce(array_contains({e}.state, 'editable'), false))"


def in_view(e: str, height: str) -> str:
    return f"({e}.bbox.y + {e}.bbox.h > 0 AND {e}.bbox.y < {height})"


def distance_from_view(e: str, height: str) -> str:
    return (
        f"(CASE WHEN {e}.bbox.y + {e}.bbox.h <= 0 THEN -({e}.bbox.y + {e}.bbox.h) "
        f"WHEN {e}.bbox.y >= {height} THEN {e}.bbox.y - {height} ELSE 0D END)"
    )


def _number(value: str) -> str:
    return f"if({value} = floor({value}), cast(cast({value} AS bigint) AS string), cast({value} AS string))"


def _box(b: str) -> str:
    """x,y,w,h; a missing side is left out."""
    sides = [f"{b}.{side}" for side in "xywh"]
    numbers = [_number(side) for side in sides]
    return f"if(isnull({' + '.join(sides)}), concat_ws(',', {', '.join(numbers)}), concat({", ',', ".join(numbers)}))"


def render_element(e: str) -> str:
    """One line per element: id, role, name, value, hint, box, states."""
    return (
        f"concat({e}.id, ' ', {e}.role, if(coalesce({e}.label, '') <> '', concat(' ', {json_string(e + '.label')}), ''), "
        f"if(coalesce({e}.value, '') <> '' AND NOT {e}.value <=> {e}.label, concat(' = ', {json_string(e + '.value')}), ''), "
        f"if(coalesce({e}.hint, '') <> '', concat(' hint ', {json_string(e + '.hint')}), ''), "
        f"' [', {_box(e + '.bbox')}, ']', if(size({e}.state) > 0, concat(' (', array_join({e}.state, ', '), ')'), ''), "
        f"if({e}.source = 'vision', ' {{vision}}', ''))"
    )


def without_reason(action: str) -> str:
    """An action's JSON without its reason: what was done, not why."""
    member = r'(?<!\\)"reason"\s*:\s*"(?:[^"\\]|\\.)*"'
    bare = f"regexp_replace(regexp_replace({action}, {lit(member + r'\s*,\s*')}, ''), {lit(r',?\s*' + member)}, '')"
    return f"if(contains({action}, {lit(chr(34) + 'reason' + chr(34))}), {bare}, {action})"


def render_step(s: str, number: str) -> str:
    return (
        f"concat({number}, '. ', {without_reason(s + '.action')}, ' -> ', if({s}.verified, 'verified', 'NOT verified'), "
        f"if(coalesce({s}.note, '') <> '', concat(': ', {s}.note), ''))"
    )


def _not_listed(above: str, below: str) -> str:
    return (
        f"if({above} + {below} > 0, concat('Not listed: ', {above}, ' more elements above the view and ', {below}, "
        "' below. Scroll to reach them.\\n'), '')"
    )


def render_regions(regions: str) -> str:
    """The line on hidden parts of images. ``regions``: array of category and bbox (x, y, w, h)."""
    r = fresh("r")
    each = f"concat({r}.category, ' at [', {_box(r + '.bbox')}, ']')"
    return f"if(size({regions}) > 0, concat({lit(REGIONS)}, array_join(transform({regions}, {r} -> {each}), '; '), '\\n'), '')"


def render_request(shortened: str = "false", regions: str | None = None, elements: str = "elements") -> str:
    """The whole request as text (its fixed words are the format, and stand here in the order they come in), from a row of goal, title, origin, path_template, has_query, vw, vh, elements, above,
    below, tokens (array), known_values (map), history (array of action, verified, note)."""
    e, s, i, k = fresh("e"), fresh("s"), fresh("i"), fresh("k")
    lines = f"if(size({elements}) = 0, '(none found)\\n', array_join(transform({elements}, {e} -> concat({render_element(e)}, '\\n')), ''))"
    values = (
        f"if(size(known_values) > 0, concat('\\nKnown values:\\n', array_join(transform(array_sort(map_entries(known_values)), {k} -> concat({k}.key, ' = ', "
        f"{json_string(k + '.value')}, '\\n')), '')), '')"
    )
    steps = (
        f"if(size(history) = 0, '(nothing yet, this is the first step)\\n', "
        f"array_join(transform(history, ({s}, {i}) -> concat({render_step(s, f'({i} + 1)')}, '\\n')), ''))"
    )
    return (
        f"concat('Goal: ', goal, '\\n\\nPage: ', {json_string('title')}, ' at ', origin, path_template, if(has_query, '?...', ''), "
        f"'\\nViewport: ', {_number('vw')}, 'x', {_number('vh')}, '\\nElements:\\n', {lines}, {_not_listed('above', 'below')}, "
        f"if({shortened}, {lit(SHORTENED + chr(10))}, ''), {render_regions(regions) if regions else lit('')}, "
        f"if(size(tokens) > 0, concat('Tokens on this page: ', array_join(tokens, ' '), '\\n'), ''), {values}, "
        f"'\\nHistory, oldest first (element ids refer to the page as it was then):\\n', {steps}, "
        "'\\nReply with the next action as one JSON object.')"
    )


def fit(requests: DataFrame, budget: str = "budget", system_chars: str = "system_chars") -> DataFrame:
    """Each request within its budget, with counts of texts shortened, elements left out and notes dropped.

    A request that fits is unchanged (``trimmed`` is false). Otherwise stages
    run in order until one fits: text to 160; text out of view dropped,
    farthest first; old notes dropped; text to 100, then 60; controls out of
    view dropped, farthest first; text to 30. Controls in view always stay.
    """
    e, r, a, s, i, x = fresh("e"), fresh("r"), fresh("a"), fresh("s"), fresh("i"), fresh("x")
    own = f"{r}.e"

    # An element travels with the length of its line, so that only what a stage changes is written out again.
    def measured(v: str) -> str:
        return f"named_struct('e', {v}, 'n', length({render_element(v)}) + 1)"

    def line_chars(rows: str) -> str:
        n = fresh("n")
        return f"aggregate({rows}, 0, ({a}, {n}) -> {a} + {n}.n)"

    def step_chars(history: str) -> str:
        n = fresh("n")
        return f"aggregate({history}, 0, ({a}, {n}) -> {a} + if(coalesce({n}.note, '') <> '', length({n}.note) + 2, 0))"

    def total(lines: str, count: str, above: str, below: str, notes: str) -> str:
        return f"(_fixed + {lines} + if({count} = 0, 13, 0) + length({_not_listed(above, below)}) + {notes})"

    def fits(chars: str) -> str:
        return f"({estimate_tokens('_sys', chars)} <= _budget)"

    plain = f"({line_chars('_rows')} + if(size(_rows) = 0, 13, 0))"
    start = requests.withColumns(
        {
            "_budget": F.expr(budget), "_sys": F.expr(system_chars), "_rows": F.expr(f"transform(elements, {e} -> {measured(e)})"),
            "_bare": F.expr(f"length({render_request(elements='slice(elements, 1, 0)')}) - 13"),
        }
    ).withColumn("_user", F.expr(f"_bare + {plain}"))
    df = start.withColumns(
        {
            "trimmed": F.expr(f"NOT {fits('_user')}"), "_fixed": F.expr(f"_bare - length({_not_listed('above', 'below')}) - {step_chars('history')} + {len(SHORTENED) + 1}"),
            "_cut": F.expr("cast(array() AS array<string>)"), "left_out": F.lit(0), "notes_dropped": F.lit(0),
        }
    ).drop("elements", "_bare", "_user")
    df = df.withColumn("_ok", F.expr("NOT trimmed"))

    def remeasure(frame: DataFrame) -> DataFrame:
        chars = total(line_chars("_rows"), "size(_rows)", "above", "below", step_chars("history"))
        return frame.withColumn("_ok", F.expr(f"_ok OR {fits(chars)}"))

    def cap(frame: DataFrame, limit: int, everything: bool) -> DataFrame:
        long = f"(length(coalesce({own}.label, '')) > {limit} OR length(coalesce({own}.value, '')) > {limit})"
        chosen = long if everything else f"({long} AND NOT {is_control(own)})"
        new = (
            f"named_struct('id', {own}.id, 'role', {own}.role, 'label', {cut_text(own + '.label', limit)}, "
            f"'value', {cut_text(own + '.value', limit)}, 'hint', {own}.hint, 'bbox', {own}.bbox, 'state', {own}.state, 'source', {own}.source)"
        )
        return frame.withColumns(
            {
                "_cut": F.expr(f"if(_ok, _cut, array_union(_cut, transform(filter(_rows, {r} -> {chosen}), {r} -> {own}.id)))"),
                "_rows": F.expr(f"if(_ok, _rows, transform(_rows, {r} -> if({chosen}, {let(new, measured)}, {r})))"),
            }
        )

    def leave_out(frame: DataFrame, keep: str) -> DataFrame:
        far = (
            f"array_sort(transform(filter(transform(_rows, ({r}, {i}) -> named_struct('i', {i}, 'r', {r})), {e} -> NOT ({keep.replace('@', e + '.r.e')})), "
            f"{e} -> named_struct('d', -{distance_from_view(e + '.r.e', 'vh')}, 'i', {e}.i, 'chars', {e}.r.n, "
            f"'up', {e}.r.e.bbox.y < 0)))"
        )
        now = total(f"{s}.chars", f"{s}.n", f"{s}.above", f"{s}.below", f"{s}.notes")
        dropped = (
            f"aggregate({far}, named_struct('chars', {line_chars('_rows')}, 'n', size(_rows), 'above', cast(above AS bigint), 'below', cast(below AS bigint), "
            f"'notes', {step_chars('history')}, 'gone', cast(array() AS array<int>)), ({s}, {x}) -> if({fits(now)}, {s}, named_struct("
            f"'chars', {s}.chars - {x}.chars, 'n', {s}.n - 1, 'above', {s}.above + if({x}.up, 1, 0), 'below', {s}.below + if({x}.up, 0, 1), "
            f"'notes', {s}.notes, 'gone', concat({s}.gone, array({x}.i)))))"
        )
        out = frame.withColumn("_drop", F.expr(f"if(_ok, NULL, {dropped})"))
        return out.withColumns(
            {
                "_rows": F.expr(f"if(_drop IS NULL, _rows, filter(_rows, ({r}, {i}) -> NOT array_contains(_drop.gone, {i})))"),
                "above": F.expr("coalesce(_drop.above, above)"), "below": F.expr("coalesce(_drop.below, below)"),
                "left_out": F.expr("left_out + coalesce(size(_drop.gone), 0)"),
            }
        ).drop("_drop")

    height = "vh"
    df = remeasure(cap(df, 160, True))
    df = remeasure(leave_out(df, f"{is_control('@')} OR {in_view('@', height)}"))
    old = f"{i} < size(history) - {NOTES_KEPT} AND coalesce({s}.note, '') <> ''"
    df = df.withColumns(
        {
            "notes_dropped": F.expr(f"if(_ok, 0, size(filter(history, ({s}, {i}) -> {old})))"),
            "history": F.expr(
                f"if(_ok, history, transform(history, ({s}, {i}) -> if({old}, named_struct('action', {s}.action, 'verified', {s}.verified, 'note', cast(NULL AS string)), {s})))"
            ),
        }
    )
    df = remeasure(cap(remeasure(df), 100, False))
    df = remeasure(cap(df, 60, False))
    df = remeasure(leave_out(df, in_view("@", height)))
    df = cap(df, 30, False)
    kept = f"size(array_intersect(_cut, transform(_rows, {r} -> {own}.id)))"
    done = df.withColumns({"elements": F.expr(f"transform(_rows, {r} -> {own})"), "shortened": F.expr(kept)})
    return done.select(*requests.columns, "trimmed", "left_out", "notes_dropped", "shortened")
