"""Tokens: one stable token per value, redaction, and the way back.

The vault is a secret table. Nothing here writes it but to the shared folder,
as a table in between; keep it apart from the redacted output.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import patterns as P
from maskwright.functions.spans import NO_SPANS, pieces, replace_spans
from maskwright.functions.sql import lit, once
from maskwright.functions.tokens import find_tokens, format_token
from maskwright.operators.skew import join_hot, number_rows, shuffled
from maskwright.session import cut_lineage

# Rows of one order column value span that are numbered together.
BUCKET_ROWS = 65536
_SPAN_ROWS = (
    "inline(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'category', s.category, 'text', s.text, 'span', s)))"
)


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def value_key(df: DataFrame, column: str = "text", unicode_values: bool = True, name: str = "value_key") -> DataFrame:
    """The spelling-free key of a value: NFKC, lower case, without spaces and - ( ) . ,

    Spark has no NFKC. Pattern detectors only match ASCII and white space, for
    which it changes nothing that is not stripped anyway, so
    ``unicode_values=False`` skips the Arrow step for their spans.
    """
    value = F.col(column)
    if unicode_values:
        value = F.coalesce(_nfkc(F.when(F.col(column).rlike(r"[^\x00-\x7f]"), F.col(column))), F.col(column))
    return df.withColumn(name, F.regexp_replace(F.lower(value), "[" + P.SPACE + r"\-().,]+", ""))


def assign_tokens(
    spans: DataFrame, scope: list[str], order: list[str], unicode_values: bool = True, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """The vault: per scope and category, values numbered from 1 by first appearance; the first spelling is kept.

    ``order`` are the columns that place a span within its scope; the first
    must be a whole number. Occurrences are reduced to distinct values before
    anything is ordered, and no scope is ever numbered by one task.
    """
    keyed = value_key(spans, "text", unicode_values)
    columns = ", ".join(order)
    distinct = keyed.groupBy(*scope, "category", "value_key").agg(
        F.count("*").alias("uses"), F.expr(f"min(struct({columns}, text))").alias("first")
    )
    numbered = number_rows(
        distinct, [*scope, "category"], "first", f"cast(floor(first.{order[0]} / {bucket_rows}) AS bigint)", "number",
        "least(uses, 1L)",
    )
    return numbered.selectExpr(
        *scope, "category", "value_key", f"{format_token('category', 'number')} AS token",
        "first.text AS first_value", *[f"first.{c} AS first_{c}" for c in order], "uses",
    )


def attach_tokens(
    spans: DataFrame, vault: DataFrame, scope: list[str], spread: list[str], unicode_values: bool = True
) -> DataFrame:
    """Each span with its token. A value that fills a third of all rows is met by a bounded broadcast."""
    keyed = value_key(spans, "text", unicode_values)
    return join_hot(keyed, vault, [*scope, "category", "value_key"], ["token"], "uses", spread)


def _found(texts: DataFrame, scope: list[str], order: list[str], id_column: str) -> DataFrame:
    keys = [id_column, *[c for c in dict.fromkeys([*scope, *order]) if c != id_column]]
    hits = cut_lineage(texts.select(*keys, F.expr(once("spans")).alias("spans")).where("size(spans) > 0"))
    return hits.selectExpr(*keys, _SPAN_ROWS)


def vault_of(
    texts: DataFrame, scope: list[str], order: list[str], unicode_values: bool = True, id_column: str = "text_id",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The vault of :func:`redact` alone, for callers that leave the texts as they are: no more of it is worked out than they read."""
    return assign_tokens(_found(texts, scope, order, id_column), scope, [*order, "start"], unicode_values, bucket_rows)


def redact(
    texts: DataFrame, scope: list[str], order: list[str], unicode_values: bool = True, id_column: str = "text_id",
    bucket_rows: int = BUCKET_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(redacted texts, vault). ``texts`` holds ``text`` and its resolved ``spans``.

    The detectors run once: what they find is kept in the shared folder as
    narrow rows (spans, no texts) of the texts that have any. The texts are
    read a second time without their ``spans``, so no detection is part of
    that plan, and meet what replaces their spans; a text that is not among
    those rows is clean.
    """
    found = _found(texts, scope, order, id_column)
    # Read for its hottest values, for all others, and by the caller: numbered once, in the shared folder.
    vault = cut_lineage(assign_tokens(found, scope, [*order, "start"], unicode_values, bucket_rows))
    tokens = attach_tokens(found, vault, scope, [id_column, "start"], unicode_values)
    # The spans come along only where the caller reads them; the tables need not meet again for them.
    attached = tokens.groupBy(id_column).agg(
        F.expr("array_sort(collect_list(struct(start, end, token)))").alias("replacements"),
        F.expr("transform(array_sort(collect_list(struct(start, span))), x -> x.span)").alias("spans"),
    )
    none = "cast(array() AS array<struct<start:int,end:int,token:string>>)"
    redacted = texts.drop("spans").join(shuffled(attached), id_column, "left").selectExpr(
        *[f"coalesce(spans, {NO_SPANS}) AS spans" if c == "spans" else f"`{c}`" for c in texts.columns],
        f"coalesce(replacements, {none}) AS replacements",
        f"if(replacements IS NULL, text, {replace_spans('text', 'replacements')}) AS redacted",
    )
    return redacted, vault


def redaction_counts(texts: DataFrame, by: list[str]) -> DataFrame:
    """Replaced spans per category: occurrences, not distinct values."""
    return texts.selectExpr(*by, _SPAN_ROWS).groupBy(*by, "category").agg(F.count("*").alias("n"))


def tokens_in_play(texts: DataFrame, by: list[str], order: list[str], text: str = "redacted") -> DataFrame:
    """Distinct tokens of a view in order of first sight. ``by`` must name views, which are bounded."""
    seen = texts.selectExpr(*by, f"struct({', '.join(order)}) AS at", f"posexplode({find_tokens(text)}) AS (i, token)")
    first = seen.groupBy(*by, "token").agg(F.expr("min(struct(at, i))").alias("first"))
    return first.groupBy(*by).agg(
        F.expr("transform(array_sort(collect_list(struct(first, token))), x -> x.token)").alias("tokens")
    )


def vault_stats(vault: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct values per category."""
    return vault.groupBy(*scope, "category").agg(F.count("*").alias("values"))


def vault_stats_wide(vault: DataFrame, scope: list[str]) -> DataFrame:
    return vault.groupBy(*scope).pivot("category", list(P.CATEGORIES)).agg(F.count("*")).na.fill(0)


def resolve_tokens(
    texts: DataFrame, vault: DataFrame, scope: list[str], text: str = "redacted", id_column: str = "text_id"
) -> tuple[DataFrame, DataFrame]:
    """(resolved, rejected). A text holding any token its scope does not know fails, and lists the unknown ones."""
    pattern = lit(P.TOKEN)
    with_tokens = texts.where(f"{text} rlike {pattern}")
    used = with_tokens.selectExpr(id_column, *[c for c in scope if c != id_column], f"explode(array_distinct({find_tokens(text)})) AS token")
    # The hottest tokens are those these texts use most, whatever the texts that filled the vault used.
    wanted = used.groupBy(*scope, "token").agg(F.count("*").alias("_here"))
    asked = cut_lineage(vault.select(*scope, "token", "first_value").join(shuffled(wanted), [*scope, "token"]))
    known = join_hot(used, asked, [*scope, "token"], ["first_value"], "_here", [id_column])
    per_text = known.groupBy(id_column).agg(
        F.expr("map_from_entries(collect_list(struct(token, first_value)) FILTER (WHERE first_value IS NOT NULL))").alias("values"),
        F.expr("array_sort(collect_list(token) FILTER (WHERE first_value IS NULL))").alias("unknown"),
    )
    joined = with_tokens.join(shuffled(per_text), id_column)
    rebuilt = f"array_join(transform({pieces(text, pattern)}, (p, i) -> if(i % 2 = 1, element_at(values, p), p)), '')"
    resolved = joined.where("size(unknown) = 0").selectExpr(*texts.columns, f"{rebuilt} AS resolved")
    plain = texts.where(f"NOT {text} rlike {pattern}").selectExpr("*", f"{text} AS resolved")
    rejected = joined.where("size(unknown) > 0").selectExpr(*texts.columns, "unknown")
    return resolved.unionByName(plain), rejected


def round_trip_check(redacted: DataFrame, vault: DataFrame, scope: list[str], unicode_values: bool = True) -> DataFrame:
    """Per scope: spans replaced, and how many of their tokens give back the same value (compared by key)."""
    replaced = redacted.selectExpr("text_id", *[c for c in scope if c != "text_id"], "text", "inline(replacements)").selectExpr(
        "text_id", *[c for c in scope if c != "text_id"], "start", "token",
        "substring(text, start + 1, end - start) AS was",
    )
    keyed = value_key(replaced, "was", unicode_values)
    back = join_hot(
        keyed.withColumnRenamed("value_key", "was_key"), vault, [*scope, "token"], ["value_key"], "uses",
        ["text_id", "start"],
    )
    return back.groupBy(*scope).agg(
        F.count("*").alias("replaced"), F.expr("count_if(was_key = value_key)").alias("returned"),
        F.expr("bool_and(coalesce(was_key = value_key, false))").alias("ok"),
    )
