"""Queries of scoring: our own redaction of the documents against truth derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import detectors as D
from maskwright.functions.spans import find
from maskwright.functions.sql import lit, once
from maskwright.operators import score, vault
from maskwright.functions.detectors import detect
from maskwright.plans import checks as C
from maskwright.plans.derived import DOCUMENTS_SQL, documents
from maskwright.plans.redaction import _cte
from maskwright.plans.registry import query
from maskwright.session import cut_lineage

# Truth by plain patterns of its own: addresses, long digit runs (cards or not), numbers in the US way.
TRUTH = (
    # Only some addresses are in the truth: the others that are hidden are false positives.
    ("EMAIL", r"[a-z]+\.[0-9]*[1-9]@[a-z0-9.]+", "text"),
    ("CARD", r"[0-9]{13,19}", "field"),
    ("PHONE", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", "text"),
)
LOOKALIKE = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


def truth_items(docs):
    found = None
    for category, pattern, place in TRUTH:
        part = docs.selectExpr("text_id AS page", f"explode({once(find('text', lit(pattern)))}) AS m").selectExpr(
            "page", f"'{category}' AS category", "m.text AS value", f"'{place}' AS place"
        )
        found = part if found is None else found.unionByName(part)
    distinct = found.distinct()
    return distinct.withColumn(
        "item_no", F.expr("row_number() OVER (PARTITION BY page ORDER BY category, value) - 1")
    )


def lookalikes(docs):
    found = docs.selectExpr("text_id AS page", f"explode({once(find('text', lit(LOOKALIKE)))}) AS m").selectExpr("page", "m.text AS value")
    return found.distinct().withColumn("miss_no", F.expr("row_number() OVER (PARTITION BY page ORDER BY value) - 1"))


def scored_inputs(spark, folder):
    docs = documents(spark, folder)
    done, _ = vault.redact(docs.withColumn("spans", F.expr(detect("text"))), ["scope_id"], ["seq"], unicode_values=False)
    texts = score.with_hidden(done.selectExpr("text_id AS page", "text_id", "text AS raw", "redacted"))
    return cut_lineage(texts), cut_lineage(truth_items(docs)), lookalikes(docs)


_TRUTH_SQL = " UNION ALL ".join(
    f"SELECT text_id AS page, '{c}' AS category, text AS value, '{p}' AS place, start, \"end\" FROM ({C.find('src', 'text_id', pat)})"
    for c, pat, p in TRUTH
)
# Hidden spans: adjacent tokens share one, and are all of one kind in these texts.
_SCORE = _cte(DOCUMENTS_SQL) + f""", hid AS (SELECT text_id AS page, min(start) AS start, max("end") AS "end", list(category ORDER BY start) AS cats, any_value(whole) AS whole FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY text_id ORDER BY start) AS grp FROM (
   SELECT s.text_id, s.start, s."end", s.category, d.text AS whole,
    CASE WHEN lag(s."end") OVER (PARTITION BY s.text_id ORDER BY s.start) = s.start THEN 0 ELSE 1 END AS fresh
   FROM spans s JOIN src d ON d.text_id = s.text_id)) GROUP BY text_id, grp),
found AS ({_TRUTH_SQL}),
items AS (SELECT page, category, value, place, row_number() OVER (PARTITION BY page ORDER BY category, value) - 1 AS item_no
          FROM (SELECT DISTINCT page, category, value, place FROM found)),
occ AS (SELECT i.page, i.item_no, i.category, i.value, k - 1 AS start, k - 1 + length(i.value) AS "end"
        FROM items i JOIN src d ON d.text_id = i.page, LATERAL (SELECT unnest(list_filter(range(1, length(d.text) + 1), lambda k: substr(d.text, k, length(i.value)) = i.value)) AS k)),
cov AS (SELECT o.*, sum(CASE WHEN h.page IS NULL THEN 0 ELSE least(h."end", o."end") - greatest(h.start, o.start) END) AS covered,
        coalesce(bool_or(list_contains(h.cats, o.category)), false) AS rt,
        sum(CASE WHEN h.page IS NULL THEN 0 ELSE least(h."end", o."end") - greatest(h.start, o.start) END) / (greatest(max(coalesce(h."end", o."end")), o."end") - least(min(coalesce(h.start, o.start)), o.start)) AS iou
        FROM occ o LEFT JOIN hid h ON h.page = o.page AND h.start < o."end" AND o.start < h."end"
        GROUP BY o.page, o.item_no, o.category, o.value, o.start, o."end"),
scored AS (SELECT i.page, i.item_no, i.category, i.value, i.place, c.page IS NOT NULL AS seen, coalesce(w, false) AS caught,
        coalesce(s AND NOT w, false) AS partial, coalesce(w AND r, false) AS category_right, coalesce(c.iou, 0) AS iou
        FROM items i LEFT JOIN (SELECT page, item_no, bool_and(covered >= "end" - start) AS w, bool_or(covered > 0) AS s, bool_and(rt) AS r, avg(iou) AS iou
                                FROM cov GROUP BY page, item_no) c ON c.page = i.page AND c.item_no = i.item_no),
fp AS (SELECT page, start, "end", array_to_string(cats, '+') AS cats, substr(whole, start + 1, "end" - start) AS text FROM hid h
       WHERE NOT EXISTS (SELECT 1 FROM occ o WHERE o.page = h.page AND h.start < o."end" AND o.start < h."end")),
isl AS (SELECT page, min(start) AS start, max("end") AS "end" FROM (
   SELECT *, sum(CASE WHEN start <= prev THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY start, "end") AS g FROM (
     SELECT page, start, "end", max("end") OVER (PARTITION BY page ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM occ)) GROUP BY page, g),
over_ AS (SELECT d.text_id AS page, length(d.text) - coalesce((SELECT sum("end" - start) FROM isl WHERE page = d.text_id), 0) AS outside_chars,
   coalesce((SELECT sum("end" - start) FROM hid WHERE page = d.text_id), 0)
   - coalesce((SELECT sum(least(h."end", i."end") - greatest(h.start, i.start)) FROM hid h JOIN isl i ON i.page = h.page AND h.start < i."end" AND i.start < h."end" WHERE h.page = d.text_id), 0) AS over_redacted,
   (SELECT count(*) FROM hid WHERE page = d.text_id) AS hidden_spans FROM src d),
lk AS (SELECT page, value, row_number() OVER (PARTITION BY page ORDER BY value) - 1 AS miss_no FROM (
   SELECT DISTINCT text_id AS page, text AS value FROM ({C.find('src', 'text_id', LOOKALIKE)}))),
miss AS (SELECT l.page, l.miss_no, l.value, true AS seen, EXISTS (SELECT 1 FROM hid h, (SELECT unnest(list_filter(range(1, length(d.text) + 1), lambda k: substr(d.text, k, length(l.value)) = l.value)) AS k) o
   WHERE h.page = l.page AND h.start < o.k - 1 + length(l.value) AND o.k - 1 < h."end") AS hidden FROM lk l JOIN src d ON d.text_id = l.page)
"""


@query("hidden_spans", _SCORE + 'SELECT page, start, "end", array_to_string(cats, \'+\') AS categories FROM hid')
def hidden_spans(spark, folder):
    """What the redacted documents hide, recovered from the two texts alone."""
    texts, _, _ = scored_inputs(spark, folder)
    return texts.selectExpr("page", "inline(hidden)").selectExpr(
        "page", "cast(start AS bigint) AS start", "cast(`end` AS bigint) AS `end`", "array_join(categories, '+') AS categories"
    )


@query("item_scores", _SCORE + "SELECT page, CAST(item_no AS BIGINT) AS item_no, category, value, place, seen, caught, partial, category_right, round(iou, 6) AS iou FROM scored")
def item_scores(spark, folder):
    texts, items, _ = scored_inputs(spark, folder)
    scored = score.score_items(items, score.item_occurrences(texts, items))
    return scored.withColumns({"iou": F.round("iou", 6), "item_no": F.col("item_no").cast("bigint")})


@query("false_positives", _SCORE + 'SELECT page, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", cats AS categories, text FROM fp')
def false_positives(spark, folder):
    texts, items, _ = scored_inputs(spark, folder)
    rows = score.text_scores(texts, score.item_occurrences(texts, items))
    return score.false_positives(rows).selectExpr(
        "page", "cast(start AS bigint) AS start", "cast(`end` AS bigint) AS `end`", "array_join(categories, '+') AS categories", "text"
    )


@query("over_redaction", _SCORE + "SELECT page, CAST(hidden_spans AS BIGINT) AS hidden_spans, CAST(outside_chars AS BIGINT) AS outside_chars, CAST(over_redacted AS BIGINT) AS over_redacted FROM over_")
def over_redaction(spark, folder):
    texts, items, _ = scored_inputs(spark, folder)
    rows = score.text_scores(texts, score.item_occurrences(texts, items))
    return rows.selectExpr("page", *[f"cast({c} AS bigint) AS {c}" for c in ("hidden_spans", "outside_chars", "over_redacted")])


@query("near_misses", _SCORE + "SELECT page, CAST(miss_no AS BIGINT) AS miss_no, value, seen, hidden FROM miss")
def near_misses(spark, folder):
    texts, _, misses = scored_inputs(spark, folder)
    return score.near_misses(texts, misses).withColumn("miss_no", F.col("miss_no").cast("bigint"))


def _frames(spark, folder):
    texts, items, misses = scored_inputs(spark, folder)
    places = cut_lineage(score.item_occurrences(texts, items))
    return score.score_items(items, places), score.text_scores(texts, places), score.near_misses(texts, misses)


def _faces(spark, folder):
    return documents(spark, folder).where("text_id % 4 = 0").selectExpr("text_id AS page", "text_id % 3 AS faces_expected", "text_id % 2 + 1 AS faces_found")


@query(
    "score_totals",
    _SCORE + """SELECT CAST((SELECT count(*) FROM src) AS BIGINT) AS pages, CAST(i.pii AS BIGINT) AS pii, CAST(i.seen AS BIGINT) AS seen, CAST(i.caught AS BIGINT) AS caught,
 CAST(i.partial AS BIGINT) AS partial, CAST(i.cr AS BIGINT) AS category_right, round(i.caught / i.pii, 6) AS recall, round(i.caught / i.seen, 6) AS recall_in_text,
 round((h.n - f.n) / h.n, 6) AS precision, round(i.iou, 6) AS iou, CAST(h.n AS BIGINT) AS spans, CAST(f.n AS BIGINT) AS false_positives,
 CAST(m.n AS BIGINT) AS near_misses, CAST(m.h AS BIGINT) AS near_misses_hidden, round(o.o / o.c, 6) AS over_redaction, CAST(0 AS BIGINT) AS unaligned,
 (SELECT CAST(sum(text_id % 3) AS BIGINT) FROM src WHERE text_id % 4 = 0) AS faces_expected, (SELECT CAST(sum(text_id % 2 + 1) AS BIGINT) FROM src WHERE text_id % 4 = 0) AS faces_found
FROM (SELECT count(*) AS pii, count(*) FILTER (seen) AS seen, count(*) FILTER (caught) AS caught, count(*) FILTER (partial) AS partial, count(*) FILTER (category_right) AS cr, avg(iou) FILTER (seen) AS iou FROM scored) i,
 (SELECT count(*) AS n FROM hid) h, (SELECT count(*) AS n FROM fp) f, (SELECT count(*) AS n, count(*) FILTER (hidden) AS h FROM miss) m, (SELECT sum(over_redacted) AS o, sum(outside_chars) AS c FROM over_) o""",
)
def score_totals(spark, folder):
    totals = score.totals(*_frames(spark, folder), _faces(spark, folder))
    return totals.withColumns({c: F.round(c, 6) for c in ("recall", "recall_in_text", "precision", "iou", "over_redaction")})


@query(
    "by_category_and_place",
    _SCORE + """SELECT CASE WHEN grouping(category) = 0 THEN 'category' ELSE 'place' END AS section, coalesce(category, place) AS key,
 CAST(count(*) AS BIGINT) AS pii, CAST(count(*) FILTER (caught) AS BIGINT) AS caught FROM scored GROUP BY GROUPING SETS ((category), (place))""",
)
def by_category_and_place(spark, folder):
    texts, items, _ = scored_inputs(spark, folder)
    return score.by_category_and_place(score.score_items(items, score.item_occurrences(texts, items)))


@query(
    "score_report",
    _SCORE + """SELECT 'missed' AS section, page, category || ' #' || item_no AS metric, CASE WHEN NOT seen THEN 'not in the text (' || place || ')' WHEN partial THEN 'partly hidden' ELSE 'readable' END AS value FROM scored WHERE NOT caught
UNION ALL SELECT 'hidden but not private', page, cats, text FROM fp
UNION ALL SELECT 'hidden but not private', page, 'look-alike', value FROM miss WHERE hidden
UNION ALL SELECT 'per page', d.text_id, m.metric, CAST(CASE m.metric WHEN 'caught' THEN (SELECT count(*) FROM scored WHERE page = d.text_id AND caught) WHEN 'pii' THEN (SELECT count(*) FROM scored WHERE page = d.text_id)
  ELSE (SELECT count(*) FROM fp WHERE page = d.text_id) END AS VARCHAR) FROM src d, (SELECT unnest(['caught', 'pii', 'false positives']) AS metric) m""",
)
def score_report(spark, folder):
    items, texts, misses = _frames(spark, folder)
    return score.report(items, texts, misses).withColumnRenamed("key", "page")


_COUNTS = (
    ("pages", "(SELECT count(*) FROM src)"), ("pii", "i.pii"), ("seen", "i.seen"), ("caught", "i.caught"), ("partial", "i.partial"),
    ("category_right", "i.cr"), ("spans", "h.n"), ("false_positives", "f.n"), ("near_misses", "m.n"), ("near_misses_hidden", "m.h"),
    ("faces_expected", "faces.expected"), ("faces_found", "faces.found"),
)
_RATIOS = (
    ("recall", "i.caught / i.pii"), ("recall_in_text", "i.caught / i.seen"), ("precision", "(h.n - f.n) / h.n"), ("iou", "i.iou"),
    ("over_redaction", "o.o / o.c"),
)


@query(
    "report_summary",
    _SCORE + """SELECT 'metrics' AS section, 'all' AS key, unnest(r).metric AS metric, unnest(r).value AS value FROM (SELECT [@rows] AS r
FROM (SELECT count(*) AS pii, count(*) FILTER (seen) AS seen, count(*) FILTER (caught) AS caught, count(*) FILTER (partial) AS partial, count(*) FILTER (category_right) AS cr, avg(iou) FILTER (seen) AS iou FROM scored) i,
 (SELECT count(*) AS n FROM hid) h, (SELECT count(*) AS n FROM fp) f, (SELECT count(*) AS n, count(*) FILTER (hidden) AS h FROM miss) m, (SELECT sum(over_redacted) AS o, sum(outside_chars) AS c FROM over_) o,
 (SELECT CAST(sum(text_id % 3) AS BIGINT) AS expected, CAST(sum(text_id % 2 + 1) AS BIGINT) AS found FROM src WHERE text_id % 4 = 0) faces) t
UNION ALL SELECT section, key, metric, CAST(CASE metric WHEN 'pii' THEN pii ELSE caught END AS VARCHAR) FROM (
 SELECT CASE WHEN grouping(category) = 0 THEN 'by category' ELSE 'by place' END AS section, coalesce(category, place) AS key, count(*) AS pii, count(*) FILTER (caught) AS caught
 FROM scored GROUP BY GROUPING SETS ((category), (place))) g, (SELECT unnest(['caught', 'pii']) AS metric) n""".replace("@rows", ", ".join(
        [f"{{'metric': '{name}', 'value': CAST({value} AS VARCHAR)}}" for name, value in _COUNTS]
        + [f"{{'metric': '{name}', 'value': CAST(CAST(round({value}, 4) AS DECIMAL(9,4)) AS VARCHAR)}}" for name, value in _RATIOS]
    )),
)
def report_summary(spark, folder):
    """The report's first sections: metrics, by category, by place."""
    items, texts, misses = _frames(spark, folder)
    return score.summary_sections(items, score.totals(items, texts, misses, _faces(spark, folder)))


@query(
    "compared_runs",
    _SCORE + """SELECT m.metric, CASE m.metric WHEN 'caught' THEN (SELECT count(*) FROM scored WHERE caught) WHEN 'pii' THEN (SELECT count(*) FROM scored) ELSE (SELECT count(*) FROM hid) END::DOUBLE AS all_kinds,
 CASE m.metric WHEN 'caught' THEN (SELECT count(*) FROM scored WHERE caught AND category = 'EMAIL') WHEN 'pii' THEN (SELECT count(*) FROM scored)
  ELSE (SELECT count(*) FROM hid WHERE list_contains(cats, 'EMAIL')) END::DOUBLE AS email_only FROM (SELECT unnest(['caught', 'pii', 'spans']) AS metric) m""",
)
def compared_runs(spark, folder):
    """The same truth against two detector banks, side by side."""
    docs = documents(spark, folder)
    items, misses = cut_lineage(truth_items(docs)), cut_lineage(lookalikes(docs))  # the same for every bank
    parts = []
    for config, bank in (("all_kinds", D.ALL), ("email_only", (D.EMAIL,))):
        done, _ = vault.redact(docs.withColumn("spans", F.expr(detect("text", bank))), ["scope_id"], ["seq"], unicode_values=False)
        texts = cut_lineage(score.with_hidden(done.selectExpr("text_id AS page", "text_id", "text AS raw", "redacted")))
        places = cut_lineage(score.item_occurrences(texts, items))
        parts.append(
            score.totals(score.score_items(items, places), score.text_scores(texts, places), score.near_misses(texts, misses)).withColumn(
                "config", F.lit(config)
            )
        )
    return score.compare_runs(parts[0].unionByName(parts[1]), "config", ["caught", "pii", "spans"])


CUTOFFS = [0.2, 0.4, 0.6, 0.8, 1.1]
# A score for each hidden span, as a model would give one.
_SPAN_SCORE = "cast((span.end - span.start) * 7 % 11 AS double) / 10"
_SCORED_SPANS = _SCORE + """, sc AS (SELECT page, start, "end", CAST(("end" - start) * 7 % 11 AS DOUBLE) / 10 AS score FROM hid),
pr AS (SELECT s.*, EXISTS (SELECT 1 FROM occ o WHERE o.page = s.page AND s.start < o."end" AND o.start < s."end") AS private FROM sc s),
pl AS (SELECT o.page, o.item_no, o.start, max(s.score) AS best FROM occ o LEFT JOIN sc s ON s.page = o.page AND s.start <= o.start AND s."end" >= o."end" GROUP BY ALL),
lv AS (SELECT i.page, i.item_no, CASE WHEN count(p.page) > 0 AND count(p.best) = count(*) THEN min(p.best) END AS level FROM items i LEFT JOIN pl p ON p.page = i.page AND p.item_no = i.item_no GROUP BY ALL),
cnt AS (SELECT c.score, (SELECT count(*) FROM pr WHERE pr.score >= c.score) AS spans, (SELECT count(*) FROM pr WHERE private AND pr.score >= c.score) AS rt,
  (SELECT count(*) FROM lv WHERE level >= c.score) AS caught, (SELECT count(*) FROM items) AS pii FROM (@cutoffs) c)
SELECT score, CAST(spans AS BIGINT) AS spans, CAST(rt AS BIGINT) AS "right", CAST(caught AS BIGINT) AS caught, CAST(pii AS BIGINT) AS pii,
  round(CASE WHEN spans > 0 THEN rt / spans ELSE 1 END, 6) AS precision, round(CASE WHEN pii > 0 THEN caught / pii ELSE 1 END, 6) AS recall FROM cnt"""


def _swept(spark, folder, cutoffs):
    texts, items, _ = scored_inputs(spark, folder)
    places = cut_lineage(score.item_occurrences(texts, items))
    touched = places.selectExpr("page", "inline(touching)").select("page", "start", F.lit(True).alias("private")).distinct()
    hidden = texts.selectExpr("page", "explode(hidden) AS span").selectExpr("page", "span.start AS start", f"{_SPAN_SCORE} AS score")
    levels = items.select("page", "item_no").join(score.item_levels(places, _SPAN_SCORE), ["page", "item_no"], "left")
    table = score.cutoff_sweep(hidden.join(touched, ["page", "start"], "left"), levels, [], cutoffs)
    return table.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("cutoff_table", _SCORED_SPANS.replace("@cutoffs", "SELECT unnest([" + ", ".join(map(str, CUTOFFS)) + "])::DOUBLE AS score"))
def cutoff_table(spark, folder):
    """What each of a few cutoffs on the span score would keep, right and wrong."""
    return _swept(spark, folder, CUTOFFS)


@query("cutoff_curve", _SCORED_SPANS.replace("@cutoffs", "SELECT score FROM sc UNION SELECT level FROM lv WHERE level IS NOT NULL"))
def cutoff_curve(spark, folder):
    """The same at every score that occurs."""
    return _swept(spark, folder, None)
