"""Texts and tables Spark derives from the given tables, for detectors that have no natural data in them.

The expressions use only functions both engines share, so the checks build
the very same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.operators.skew import dealt
from maskwright.plans.registry import spread, table


def pad(value: str, width: int) -> str:
    return f"lpad(cast({value} AS string), {width}, '0')"


# One record per order: every kind of labelled and unlabelled value, and numbers that are not private.
RECORD_TEXT = (
    f"'Account number ' || {pad('(o_orderkey * 7919 + 12345678) % 10000000000', 10)}"
    f" || '. Order 9' || {pad('o_orderkey', 9)}"
    " || '. Date of birth ' || cast(cast(o_orderdate AS date) AS string)"
    " || ', shipped ' || cast(cast(o_orderdate AS date) AS string)"
    f" || '. Phone 80' || {pad('o_custkey', 8)}"
    f" || '. Call +91 98' || {pad('o_custkey', 8)}"
    f" || '. Aadhaar 2' || {pad('o_orderkey % 1000', 3)} || ' ' || {pad('o_custkey % 10000', 4)}"
    f" || ' ' || {pad('o_orderkey % 10000', 4)}"
    f" || '. Passport K' || {pad('o_orderkey % 10000000', 7)}"
    " || '. Policy no. AB-' || cast(o_orderkey AS string)"
    f" || '. PAN ABCDE' || {pad('o_orderkey % 10000', 4)} || 'F, IFSC HDFC0' || {pad('o_custkey % 1000000', 6)}"
    " || '. Pay user' || cast(o_custkey AS string) || '@okaxis. Mail c' || cast(o_custkey AS string) || '@example.com'"
    f" || '. Mobile or 9' || {pad('o_custkey', 9)} || ' today.'"
)
RECORDS_SQL = (
    f"(SELECT o_orderkey AS text_id, o_custkey AS scope_id, o_orderkey AS seq, {RECORD_TEXT} AS text FROM orders)"
)
DOCUMENTS_SQL = "(SELECT doc_id AS text_id, source AS scope_id, doc_id AS seq, text FROM documents)"


def records(spark: SparkSession, folder: str) -> DataFrame:
    narrow = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    return narrow.selectExpr(
        "o_orderkey AS text_id", "o_custkey AS scope_id", "o_orderkey AS seq", f"{RECORD_TEXT} AS text"
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in scopes of one source each."""
    return table(spark, folder, "documents").selectExpr(
        "doc_id AS text_id", "source AS scope_id", "doc_id AS seq", "text"
    )


def select(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    return frame.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def as_sql(columns: dict[str, str], source: str) -> str:
    return "(SELECT " + ", ".join(f'{sql} AS "{name}"' for name, sql in columns.items()) + f" FROM {source})"


# Steps: twenty consecutive events are one task, so a task is bounded whatever the data.
STEP = {
    "task_id": "cast(floor(event_id / 20) AS bigint)",
    "cycle": "event_id % 20",
    "ts": "ts",
    "kind": "event_type",
    "state": "event_type",
    "site": "'https://s' || cast(user_id % 3 AS string) || '.example'",
    "page": "'https://s' || cast(user_id % 3 AS string) || '.example/p'",
    "verified": "user_id % 3 <> 0",
    "note": "CASE WHEN user_id % 3 <> 0 THEN 'now it is checked' ELSE 'the page did not change; was so' END",
    "change": "CASE WHEN user_id % 4 = 1 AND event_id % 20 > 0 THEN 'appeared: text' END",
    "refused": "user_id % 7 = 0",
    "action": (
        "CASE WHEN event_type = 'view' THEN '{\"type\":\"wait\",\"ms\":500}' "
        "WHEN event_type = 'signup' THEN '{\"type\":\"type\",\"target\":\"e1\",\"value\":\"<PII:' || "
        "CASE user_id % 4 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'CARD' WHEN 2 THEN 'NAME' ELSE 'PHONE' END || ':' || cast(user_id % 2 + 1 AS string) || '>\"}' "
        "ELSE '{\"target\":\"e' || cast(user_id % 2 + 1 AS string) || '\",\"reason\":\"r' || cast(event_id AS string) || '\",\"type\":\"click\"}' END"
    ),
    "label": "CASE WHEN user_id % 5 = 0 THEN '' ELSE 'Field ' || cast(user_id % 5 AS string) END",
}
STEPS_SQL = as_sql(STEP, "events")


def steps(spark: SparkSession, folder: str) -> DataFrame:
    return select(table(spark, folder, "events"), STEP)


# Views and elements: an order is a view of its lines; twenty orders are one task.
VIEW = {
    "view_id": "o_orderkey",
    "task_id": "cast(floor(o_orderkey / 20) AS bigint)",
    "cycle": "o_orderkey % 20",
    "page": "'https://shop.example/' || o_orderstatus",
    "origin": "'https://shop.example'",
    "path_template": "'/' || o_orderstatus",
    "title": "'Orders ' || o_orderpriority",
    "vh": "cast(600 AS double)",
}
ORDINAL = "cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS bigint)"
LINE = {
    "view_id": "l_orderkey",
    "ordinal": ORDINAL,
    "role": "CASE l_returnflag WHEN 'A' THEN 'button' WHEN 'N' THEN 'text' ELSE 'image' END",
    "label": "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE 'Item ' || cast(l_partkey % 5 AS string) || CASE WHEN l_suppkey % 9 = 0 THEN ' with a name far too long to be a label' ELSE '' END END",
    "value": "CASE WHEN l_suppkey % 3 = 0 THEN 'Qty ' || cast(cast(l_quantity AS bigint) AS string) END",
    "offscreen": "l_linestatus = 'F'",
    "source": "CASE WHEN l_partkey % 4 = 0 THEN 'vision' ELSE 'dom' END",
    "x": "cast(cast(l_quantity AS bigint) * 10 AS double)",
    "y": "cast(l_partkey % 1800 - 600 AS double)",
    "w": "cast(l_suppkey % 40 * 10 AS double)",
    "h": "cast(l_partkey % 20 * 10 AS double)",
}
VIEWS_SQL = as_sql(VIEW, "orders")
LINES_SQL = as_sql(LINE, "lineitem")


def views(spark: SparkSession, folder: str) -> DataFrame:
    return select(table(spark, folder, "orders"), VIEW)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Element rows with their boxes."""
    return lines_of(table(spark, folder, "lineitem"))


def lines_of(rows: DataFrame) -> DataFrame:
    """:func:`lines` of these rows of lineitem; they hold all of an order or none."""
    return select(dealt(rows, "l_orderkey", rows.count()), LINE).selectExpr(
        "*", "named_struct('x', x, 'y', y, 'w', w, 'h', h) AS bbox", "if(offscreen, array('offscreen'), array()) AS state",
        "concat('e', ordinal + 1) AS id",
    )
