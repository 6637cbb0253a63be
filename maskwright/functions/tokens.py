"""Token expressions: find, parse, format, cut a text into literal and token pieces."""

from __future__ import annotations

from maskwright.functions import patterns as P
from maskwright.functions.spans import pieces
from maskwright.functions.sql import fresh, lit


def find_tokens(text: str) -> str:
    """Every token of a known category, in order."""
    return f"regexp_extract_all({text}, {lit(P.TOKEN)}, 0)"


def parse_token(token: str) -> str:
    """Category and number; NULL when the whole string is not one token."""
    whole = lit("^" + P.TOKEN + r"\z")
    return (
        f"if({token} rlike {whole}, named_struct('category', regexp_extract({token}, {whole}, 1), "
        f"'index', try_cast(regexp_extract({token}, {whole}, 2) AS bigint)), NULL)"
    )


def format_token(category: str, number: str) -> str:
    """The only place a token is built. NULL for a negative number or an unknown category (replacing a span by it fails loudly)."""
    known = ", ".join(lit(c) for c in P.CATEGORIES)
    return f"if({number} >= 0 AND {category} IN ({known}), concat('<PII:', {category}, ':', {number}, '>'), NULL)"


def segments(text: str) -> str:
    """Literal and token pieces in order: array of text, category (NULL for literals)."""
    p, i = fresh("p"), fresh("i")
    cut = pieces(text, lit(P.TOKEN))
    return (
        f"filter(transform({cut}, ({p}, {i}) -> named_struct('text', {p}, 'category', "
        f"if({i} % 2 = 1, regexp_extract({p}, {lit(P.TOKEN)}, 1), NULL))), {p} -> {p}.text <> '')"
    )


def missing_answers(summary: str, extracted: str) -> str:
    """The summary with token-bearing extracted values it does not mention, joined by a middle dot."""
    v, t, x = fresh("v"), fresh("t"), fresh("x")
    missing = (
        f"filter(map_values({extracted}), {v} -> size({find_tokens(v)}) > 0 AND "
        f"NOT exists({find_tokens(v)}, {t} -> contains({summary}, {t})))"
    )
    trimmed = f"regexp_replace({summary}, {lit('^[' + P.SPACE + ']+|[' + P.SPACE + ']+' + chr(92) + 'z')}, '')"
    joined = f"array_join(filter(concat(array({trimmed}), {x}), {t} -> {t} <> ''), ' · ')"
    return f"get(transform(array({missing}), {x} -> if(size({x}) = 0, {summary}, {joined})), 0)"


def describe_counts(counts: str) -> str:
    """A map of category to count in plain words, zeroes skipped."""
    e = fresh("e")
    arms = " ".join(
        f"WHEN {lit(c)} THEN if({e}.value = 1, {lit(one)}, {lit(many)})" for c, (one, many) in P.CATEGORY_WORDS.items()
    )
    return (
        f"array_join(transform(filter(map_entries({counts}), {e} -> {e}.value > 0), "
        f"{e} -> concat({e}.value, ' ', CASE {e}.key {arms} END)), ', ')"
    )

