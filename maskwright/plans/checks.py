"""Plain SQL twins of the span expressions, for the DuckDB checks."""

from __future__ import annotations

from maskwright.functions import patterns as P
from maskwright.functions import detectors as D


def sq(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return sq(P.re2(pattern))


# The look-aheads RE2 lacks: a handle is taken with what may follow it, an id is filtered afterwards.
_UPI = "(?i)(" + P.UPI_CORE + r")([^a-z0-9.-]|\.[^a-z0-9]|\.\z|\z)"


def find(source: str, ids: str, pattern: str, core: bool = False) -> str:
    """Rows of ids, start, end, text, label for every match in ``source`` (which has the ids and ``text``)."""
    mark = r"chr(1)||'\1'||chr(1)||'\2'" if core else r"chr(1)||'\0'||chr(1)"
    return f"""
SELECT {ids}, start, start + length(piece) AS "end", piece AS text,
       regexp_replace(substr(whole, greatest(start - 48, 0) + 1, least(start, 48)), '(?s)^.*[0-9]', '') AS label
FROM (SELECT {ids}, whole, i, piece,
             CAST(coalesce(sum(length(piece)) OVER (PARTITION BY {ids} ORDER BY i
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM (SELECT {ids}, whole, unnest(a) AS piece, unnest(range(len(a))) AS i
            FROM (SELECT {ids}, text AS whole,
                         string_split(regexp_replace(text, {sq(P.re2(pattern))}, {mark}, 'g'), chr(1)) AS a
                  FROM {source} WHERE text IS NOT NULL)))
WHERE i % 2 = 1"""


def luhn(digits: str) -> str:
    d = f"CAST(substr({digits}, CAST(length({digits}) - k AS BIGINT), 1) AS BIGINT)"
    doubled = f"CASE WHEN k % 2 = 0 THEN {d} WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END"
    return f"list_sum(list_transform(range(length({digits})), lambda k: {doubled})) % 10 = 0"


def is_card(text: str) -> str:
    digits = f"regexp_replace({text}, '[^0-9]', '', 'g')"
    return (
        f"({luhn(digits)} AND NOT starts_with({digits}, '0') "
        f"AND NOT (length({digits}) = 13 AND regexp_matches({digits}, '^97[89]')))"
    )


CONTEXT = {
    "aadhaar": P.AADHAAR_CONTEXT, "passport": P.PASSPORT_CONTEXT, "account_number": P.ACCOUNT_CONTEXT,
    "other_id": P.OTHER_ID_CONTEXT, "dob": P.DOB_CONTEXT, "labelled_phone": P.PHONE_CONTEXT,
}


def candidates_of(detector: D.Detector, source: str, ids: str, priority: int) -> str:
    pattern, core = detector.pattern, False
    if detector.name == "upi":
        pattern, core = _UPI, True
    if detector.name == "other_id":
        pattern = P.OTHER_ID_PLAIN
    keep = "true"
    if detector.name == "card":
        keep = is_card("text")
    if detector.name in CONTEXT:
        keep = f"regexp_matches(label, {re2(CONTEXT[detector.name])})"
    if detector.name == "other_id":
        keep += " AND regexp_matches(text, '[0-9]')"
    if detector.name == "local_mobile":
        keep = f"NOT regexp_matches(label, {re2(P.NOT_A_PHONE)})"
    return (
        f"SELECT {ids}, start, \"end\", {sq(detector.category)} AS category, {priority} AS priority, text "
        f"FROM ({find(source, ids, pattern, core)}) WHERE {keep}"
    )


def candidates(source: str, ids: str, detectors=D.ALL) -> str:
    return "\nUNION ALL\n".join(candidates_of(d, source, ids, i) for i, d in enumerate(detectors))


def resolved(source: str, ids: str, detectors=D.ALL) -> str:
    """Rows of ids, start, end, category, text: the greedy choice, as a reduce over the sorted candidates."""
    return resolve(candidates(source, ids, detectors), ids)


def resolve(candidate_sql: str, ids: str) -> str:
    return f"""
SELECT {ids}, s.start AS start, s."end" AS "end", s.category AS category, s.text AS text
FROM (SELECT {ids}, unnest(list_reduce(
        list(list_value(struct_pack(start := start, "end" := "end", category := category, text := text))
             ORDER BY start, "end" DESC, priority),
        lambda a, x: CASE WHEN x[1].start < a[-1]."end" THEN a ELSE list_concat(a, x) END)) AS s
      FROM ({candidate_sql}) GROUP BY {ids})"""


VALUE_KEY = "regexp_replace(lower(text), " + sq("[" + P.SPACE + r"\-().,]+") + ", '', 'g')"


def vault(spans: str, scope: str, order: str) -> str:
    """Rows of scope, category, value_key, token, first_value from a relation of spans."""
    return f"""
SELECT {scope}, category, value_key,
       '<PII:' || category || ':' || row_number() OVER (PARTITION BY {scope}, category ORDER BY {order}) || '>' AS token,
       text AS first_value
FROM (SELECT *, row_number() OVER (PARTITION BY {scope}, category, value_key ORDER BY {order}) AS seen
      FROM (SELECT *, {VALUE_KEY} AS value_key FROM {spans}))
WHERE seen = 1"""


def redacted(spans_with_tokens: str, source: str, id_column: str) -> str:
    """Rows of id, redacted: the text cut around its spans."""
    return f"""
SELECT d.{id_column}, CASE WHEN r.parts IS NULL THEN d.text
       ELSE array_to_string(r.parts, '') || substr(d.text, r.last + 1) END AS redacted
FROM {source} d LEFT JOIN (
  SELECT {id_column}, list(substr(text, before + 1, start - before) || token ORDER BY start) AS parts, max("end") AS last
  FROM (SELECT s.{id_column}, s.start, s."end", s.token, w.text,
               coalesce(lag(s."end") OVER (PARTITION BY s.{id_column} ORDER BY s.start), 0) AS before
        FROM {spans_with_tokens} s JOIN {source} w ON w.{id_column} = s.{id_column})
  GROUP BY {id_column}) r ON r.{id_column} = d.{id_column}"""
