"""Action expressions: validity, canonical key, plain wording. SQL text over one wide struct per action."""

from __future__ import annotations


from maskwright.functions.sql import fresh, let, lit

# One wide struct, ``type`` tells which fields count. Numbers stay as text until checked.
ACTION_DDL = (
    "type STRING, target STRING, value STRING, submit STRING, direction STRING, amount STRING, `to` STRING, `as` STRING, "
    "ms STRING, summary STRING, success STRING, reason STRING"
)


def _raw(json: str, field: str) -> str:
    return f"get_json_object({json}, '$.{field}')"


def _kind(v: str, field: str) -> str:
    """The JSON type of a field: STRING, BIGINT, BOOLEAN, ... or NULL when absent."""
    return f"schema_of_variant(variant_get({v}, '$.{field}'))"


def valid_action(json: str) -> str:
    """Whether a JSON object is one of the eight actions with the fields it needs, of the right types and sizes."""
    element = lit(r"^e[0-9]+\z")

    def rules(v: str) -> str:
        def text(field: str) -> str:
            return f"coalesce({_kind(v, field)} = 'STRING', false)"

        def number(field: str) -> str:
            return f"coalesce({_kind(v, field)} IN ('BIGINT', 'DOUBLE') OR {_kind(v, field)} LIKE 'DECIMAL%', false)"

        def absent(field: str) -> str:
            return f"(variant_get({v}, '$.{field}') IS NULL)"

        target = f"({text('target')} AND coalesce(try_variant_get({v}, '$.target', 'string') rlike {element}, false))"
        boolean = f"coalesce({_kind(v, 'success')} = 'BOOLEAN', false)"
        submit = f"({absent('submit')} OR coalesce({_kind(v, 'submit')} = 'BOOLEAN', false))"
        direction = f"coalesce(try_variant_get({v}, '$.direction', 'string') IN ('up', 'down', 'left', 'right'), false)"
        ms = f"try_variant_get({v}, '$.ms', 'double')"
        whole_ms = f"({number('ms')} AND coalesce({ms} = floor({ms}) AND {ms} BETWEEN 0 AND 10000, false))"
        reason = f"({absent('reason')} OR ({text('reason')} AND length(try_variant_get({v}, '$.reason', 'string')) <= 200))"
        kind = f"try_variant_get({v}, '$.type', 'string')"
        return (
            f"coalesce({reason} AND CASE {kind} WHEN 'click' THEN {target} WHEN 'type' THEN {target} AND {text('value')} AND {submit} "
            f"WHEN 'scroll' THEN {direction} AND ({absent('amount')} OR {number('amount')}) AND ({absent('target')} OR {target}) "
            f"WHEN 'select' THEN {target} AND {text('value')} WHEN 'navigate' THEN {text('to')} "
            f"WHEN 'extract' THEN {target} AND {text('as')} WHEN 'wait' THEN {whole_ms} "
            f"WHEN 'done' THEN {text('summary')} AND {boolean} ELSE false END, false)"
        )

    return let(f"try_parse_json({json})", lambda v: f"coalesce({v} IS NOT NULL AND {rules(v)}, false)")


def action_key(json: str) -> str:
    """The action without its reason, fields in name order: the same however the model wrote it."""
    f = fresh("f")
    fields = ("amount", "as", "direction", "ms", "submit", "success", "summary", "target", "to", "type", "value")
    parts = ", ".join(f"named_struct('k', '{name}', 'v', {_raw(json, name)})" for name in fields)
    return f"array_join(transform(filter(array({parts}), {f} -> {f}.v IS NOT NULL), {f} -> concat({f}.k, '=', {f}.v)), {lit(chr(2))})"


def clip(text: str, size: int, mark: str = "...") -> str:
    return f"if(length({text}) > {size}, concat(left({text}, {size - 3}), '{mark}'), {text})"


def quote(text: str) -> str:
    return f"if(coalesce({text}, '') = '', NULL, concat('“', {clip(text, 60, '…')}, '”'))"


def describe_action(json: str, label: str) -> str:
    """One line of plain words for an action."""

    def field(name: str) -> str:
        return _raw(json, name)

    target = f"coalesce({quote(label)}, if({field('target')} IS NOT NULL, concat('element ', {field('target')}), 'the page'))"
    return (
        f"CASE {field('type')} WHEN 'click' THEN concat('Click ', {target}) "
        f"WHEN 'type' THEN concat('Type ', {field('value')}, ' into ', {target}, if({field('submit')} = 'true', ' and press Enter', '')) "
        f"WHEN 'select' THEN concat('Choose ', coalesce({quote(field('value'))}, ''), ' in ', {target}) "
        f"WHEN 'scroll' THEN concat('Scroll ', {field('direction')}, if({field('target')} IS NOT NULL, concat(' in ', {target}), '')) "
        f"WHEN 'navigate' THEN if({field('to')} = 'back', 'Go back', concat('Open ', {field('to')})) "
        f"WHEN 'extract' THEN concat('Read ', {target}) "
        f"WHEN 'wait' THEN concat('Wait ', format_number(cast({field('ms')} AS double) / 1000, '0.0'), ' s') WHEN 'done' THEN 'Finish' END"
    )


