"""Queries of pages, views, entities and private names."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.detectors import detect_in_context
from maskwright.functions.spans import find
from maskwright.functions.sql import lit, once
from maskwright.operators import entities, names, views as view_ops
from maskwright.plans import checks as C
from maskwright.plans.derived import LINES_SQL, VIEWS_SQL, as_sql, documents, lines, select, views
from maskwright.plans.registry import query, spread, table
from maskwright.sources import html

# --- pages to elements ---------------------------------------------------------

_BARE = "regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_TAGS = (("link", "<a[ >]"), ("listitem", "<li[ >]"), ("list", "<(ul|ol)[ >]"), ("region", "<(nav|main|section|aside)[ >]"), ("heading", "<h[1-6][ >]"))


def _pages(spark, folder):
    return spread(table(spark, folder, "pages").selectExpr("page_id AS view_id", "html"))


@query("page_elements")
def page_elements(spark, folder):
    """Every kept element of every page, described. HTML parsing has no SQL twin; see element_roles and the tests."""
    found = html.html_elements(_pages(spark, folder))
    return found.selectExpr("view_id", "ordinal", "id", "role", "label", "value", "hint", "array_join(state, ',') AS state", "parent_id")


@query(
    "element_roles",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT page_id AS view_id, '{role}' AS role, CAST(len(regexp_extract_all({_BARE}, {C.sq('(?i)' + tag)})) AS BIGINT) AS n FROM pages" for role, tag in _TAGS
    ) + ") WHERE n > 0",
)
def element_roles(spark, folder):
    found = html.html_elements(_pages(spark, folder))
    roles = ", ".join(f"'{role}'" for role, _ in _TAGS)
    return found.where(f"role IN ({roles})").groupBy("view_id", "role").agg(F.count("*").alias("n"))


@query("list_children", f"SELECT page_id AS view_id, CAST(len(regexp_extract_all({_BARE}, '(?i)<li[ >]')) AS BIGINT) AS children FROM pages WHERE regexp_matches({_BARE}, '(?i)<ul[ >]')")
def list_children(spark, folder):
    """How many items each page's list holds, by nearest kept ancestor."""
    kids = html.with_children(html.html_elements(_pages(spark, folder)))
    return kids.where("role = 'list'").groupBy("view_id").agg(F.expr("sum(cast(size(children) AS bigint))").alias("children"))


@query("page_texts", f"""SELECT DISTINCT text FROM (SELECT label AS text FROM {LINES_SQL} UNION ALL SELECT value FROM {LINES_SQL} UNION ALL SELECT title FROM {VIEWS_SQL}) WHERE text <> ''""")
def page_texts(spark, folder):
    """The distinct texts of all views: what a name finder reads, once each."""
    elements = lines(spark, folder).withColumn("hint", F.lit(None).cast("string"))
    return view_ops.distinct_texts(view_ops.page_texts(views(spark, folder), elements))


_PLACED = f"""(SELECT e.*, v.vh, CASE WHEN y + h < -0.25 * 600 THEN 'above' WHEN y > 750 THEN 'below' END AS side,
 CASE WHEN y + h < 0 THEN -(y + h) WHEN y > 600 THEN y - 600 ELSE 0 END AS dist FROM {LINES_SQL} e JOIN {VIEWS_SQL} v ON v.view_id = e.view_id WHERE w > 0 AND h > 0)"""


@query(
    "nearest_elements",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY dist, ordinal) AS rank FROM {_PLACED} WHERE side IS NULL)
SELECT view_id, ordinal FROM r WHERE rank <= 3""",
)
def nearest_elements(spark, folder):
    near, _ = view_ops.nearest_to_view(_placed(spark, folder), k=3)
    return near.select("view_id", "ordinal")


def _placed(spark, folder):
    return lines(spark, folder).join(views(spark, folder).select("view_id", "vh"), "view_id")


@query(
    "beyond_view",
    f"""WITH p AS {_PLACED}, r AS (SELECT *, CASE WHEN side IS NULL THEN row_number() OVER (PARTITION BY view_id, side IS NULL ORDER BY dist, ordinal) END AS rank FROM p)
SELECT view_id, CAST(count(*) FILTER (side = 'above' OR (side IS NULL AND rank > 3 AND y + h < 0)) AS BIGINT) AS above,
 CAST(count(*) FILTER (side = 'below' OR (side IS NULL AND rank > 3 AND NOT y + h < 0)) AS BIGINT) AS below FROM r GROUP BY view_id""",
)
def beyond_view(spark, folder):
    _, counts = view_ops.nearest_to_view(_placed(spark, folder), k=3)
    return counts


_NEAR = f"""(SELECT *, CASE WHEN coalesce(label, '') <> '' AND length(label) <= 40 AND length(near) <= 40 THEN near END AS neighbour FROM (
 SELECT *, coalesce(nullif(lag(label, 1) OVER w, ''), nullif(lag(label, 2) OVER w, '')) AS near FROM {LINES_SQL} WINDOW w AS (PARTITION BY view_id ORDER BY ordinal)))"""


@query("neighbour_labels", f"SELECT view_id, ordinal, neighbour FROM {_NEAR}")
def neighbour_labels(spark, folder):
    return view_ops.neighbour_label(lines(spark, folder)).select("view_id", "ordinal", "neighbour")


@query(
    "pixel_contexts",
    f"""WITH n AS {_NEAR}, b AS (SELECT *, last_value(CASE WHEN source <> 'vision' THEN [label] END IGNORE NULLS) OVER (PARTITION BY view_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)[1] AS behind FROM n)
SELECT view_id, ordinal, CASE WHEN source <> 'vision' THEN neighbour ELSE nullif(concat_ws(' ', neighbour, CASE WHEN behind IS DISTINCT FROM neighbour THEN nullif(behind, '') END), '') END AS context FROM b""",
)
def pixel_contexts(spark, folder):
    """What labels each element; for text read from pixels also what it was read from."""
    return view_ops.pixel_context(lines(spark, folder)).select("view_id", "ordinal", "context")


_CTX = {
    "text_id": "o_orderkey",
    "context": "CASE o_orderkey % 4 WHEN 0 THEN 'Date of birth' WHEN 1 THEN 'Account number 12345678' WHEN 2 THEN 'Account' END",
    "text": "cast(cast(o_orderdate AS date) AS string) || ' or ' || lpad(cast(o_orderkey * 131 AS string), 9, '0') || ' by c' || cast(o_custkey AS string) || '@example.com'",
}
_CTX_SQL = as_sql(_CTX, "orders")
_SHIFTED = f"(SELECT text_id, CASE WHEN context IS NULL THEN text ELSE context || ': ' || text END AS text, CASE WHEN context IS NULL THEN 0 ELSE length(context) + 2 END AS shift FROM {_CTX_SQL})"


@query(
    "context_spans",
    "SELECT text_id, start, \"end\", category, text FROM (" + C.resolve(
        f"SELECT text_id, start - shift AS start, \"end\" - shift AS \"end\", category, priority, text FROM ({C.candidates(_SHIFTED, 'text_id, shift')}) WHERE start >= shift", "text_id"
    ) + ")",
)
def context_spans(spark, folder):
    """Values that are private only after the label of the element before them."""
    texts = select(table(spark, folder, "orders"), _CTX)
    found = texts.selectExpr("text_id", f"explode({once(detect_in_context('text', 'context'))}) AS s")
    return found.selectExpr("text_id", "cast(s.start AS bigint) AS start", "cast(s.end AS bigint) AS `end`", "s.category AS category", "s.text AS text")


_FORM = (
    (0, "'text'", "'Date of birth'", "NULL", "NULL", "NULL"),
    (1, "'text'", "cast(cast(o_orderdate AS date) AS string)", "NULL", "NULL", "NULL"),
    (2, "'textbox'", "'Full name'", "'Customer ' || cast(o_custkey AS string)", "'text'", "'name'"),
    (3, "'textbox'", "'Total'", "cast(cast(floor(o_totalprice) AS bigint) AS string)", "'text'", "NULL"),
)
_FORM_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey AS view_id, {n} AS ordinal, {role} AS role, {label} AS label, {value} AS value FROM orders" for n, role, label, value, _, _ in _FORM
)
_FORM_SPANS = """spans AS (SELECT o_custkey AS task_id, o_orderkey AS view_id, o_orderkey AS cycle, 1 AS ordinal, 0 AS part, 'DOB' AS category, cast(cast(o_orderdate AS date) AS string) AS text FROM orders
 UNION ALL SELECT o_custkey, o_orderkey, o_orderkey, 2, 1, 'NAME', 'Customer ' || cast(o_custkey AS string) FROM orders
 UNION ALL SELECT o_custkey, o_orderkey, o_orderkey, 2147483647, 0, 'EMAIL', 'c' || cast(o_custkey AS string) || '@example.com' FROM orders)"""
_FORM_VAULT = f"vault AS ({C.vault('spans', 'task_id', 'cycle, ordinal, part')})"


def _forms(spark, folder):
    orders = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
    shown = orders.selectExpr(
        "o_orderkey AS view_id", "o_custkey AS task_id", "o_orderkey AS cycle", "'Mail of c' || cast(o_custkey AS string) || '@example.com' AS title",
        "'https://shop.example/order/' || cast(o_orderkey + 1000 AS string) AS url",
    )
    rows = ", ".join(
        f"named_struct('ordinal', {n}, 'role', {role}, 'label', {label}, 'value', cast({value} AS string), 'hint', cast(NULL AS string), 'input_type', cast({kind} AS string), 'autocomplete', cast({auto} AS string))"
        for n, role, label, value, kind, auto in _FORM
    )
    elements = orders.selectExpr("o_orderkey AS view_id", f"inline(array({rows}))").withColumn("source", F.lit("dom"))
    return shown, elements


@query(
    "redacted_views",
    f"""WITH {_FORM_SPANS}, {_FORM_VAULT}, t AS (SELECT s.view_id, s.ordinal, v.token FROM (SELECT *, {C.VALUE_KEY} AS value_key FROM spans) s
  JOIN vault v ON v.task_id = s.task_id AND v.category = s.category AND v.value_key = s.value_key), f AS ({_FORM_SQL})
SELECT f.view_id, CAST(f.ordinal AS BIGINT) AS ordinal, CASE WHEN f.ordinal = 1 THEN t.token ELSE f.label END AS label, CASE WHEN f.ordinal = 2 THEN t.token ELSE f.value END AS value
FROM f LEFT JOIN t ON t.view_id = f.view_id AND t.ordinal = f.ordinal
UNION ALL SELECT view_id, -1, 'Mail of ' || token, 'https://shop.example/order/{{id}}' FROM t WHERE ordinal = 2147483647""".replace("{{", "{").replace("}}", "}"),
)
def redacted_views(spark, folder):
    """Whole views: labelled values, trusted fields, title and address; tokens last over a customer's views."""
    elements, done, _ = view_ops.redact_view(*_forms(spark, folder))
    return elements.selectExpr("view_id", "cast(ordinal AS bigint) AS ordinal", "label", "value").unionByName(
        done.selectExpr("view_id", "-1L AS ordinal", "title AS label", "concat(origin, path_template) AS value")
    )


@query(
    "merged_views",
    """SELECT user_id AS page, arg_min(props, event_id) AS title, bool_or(value > 50) AS personal, arg_min(event_id % 7, event_id) AS above, arg_max(event_id % 11, event_id) AS below,
 round(sum(value), 3) AS observe_ms, CASE WHEN bool_or(event_type = 'view') THEN 'on' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'off' END AS name_model FROM events GROUP BY user_id""",
)
def merged_views(spark, folder):
    readings = table(spark, folder, "events").selectExpr(
        "user_id AS page", "event_id AS view_seq", "props AS title", "value > 50 AS personal", "event_id % 7 AS above", "event_id % 11 AS below", "value AS observe_ms",
        "0D AS vision_ms", "0D AS names_ms", "0D AS redact_ms", "CASE event_type WHEN 'view' THEN 'on' WHEN 'error' THEN 'failed' ELSE 'off' END AS name_model",
    )
    merged = view_ops.merge_views(readings)
    return merged.select("page", "title", "personal", "above", "below", F.round("observe_ms", 3).alias("observe_ms"), "name_model")


# --- entities ---------------------------------------------------------------------

_WORDS = f"regexp_extract_all(text, {C.re2(P.WORD)})"


@query(
    "word_chunks",
    f"""SELECT doc_id AS text_id, CAST(c AS BIGINT) AS chunk, CAST(least(256, n - c * 256) AS BIGINT) AS words, md5(array_to_string(w[c * 256 + 1:c * 256 + 256], ' ')) AS digest
FROM (SELECT doc_id, w, len(w) AS n, unnest(range((len(w) + 255) // 256)) AS c FROM (SELECT doc_id, {_WORDS} AS w FROM documents))""",
)
def word_chunks(spark, folder):
    """Whole documents in pieces of 256 words."""
    chunks = entities.chunk_words(documents(spark, folder))
    return chunks.selectExpr(
        "text_id", "cast(chunk AS bigint) AS chunk", "cast(size(words) AS bigint) AS words", "md5(array_join(transform(words, w -> w.text), ' ')) AS digest"
    )


_SCORES = {
    "text_id": "l_orderkey", "word_no": "cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS int)",
    "a": "(l_quantity - 20) / cast(9 AS double)", "z": "(l_partkey % 50 - 20) / cast(9 AS double)",
    "i": "(l_suppkey % 40 - 5) / cast(9 AS double)",
}
_SIG = "1 / (1 + exp(-{}))"
_SCORES_SQL = f"""(SELECT text_id, word_no, 'person' AS label, {_SIG.format('a')} AS a, {_SIG.format('z')} AS z, {_SIG.format('i')} AS i FROM {as_sql(_SCORES, 'lineitem')}
 UNION ALL SELECT text_id, word_no, 'address', {_SIG.format('z')}, {_SIG.format('a')}, {_SIG.format('i')} FROM {as_sql(_SCORES, 'lineitem')})"""


@query(
    "decoded_entities",
    f"""WITH w AS {_SCORES_SQL},
c AS (SELECT s.text_id, s.label, s.word_no AS s, e.word_no AS e, least(min(m.i), s.a, e.z) AS score FROM w s JOIN w e ON e.text_id = s.text_id AND e.label = s.label AND e.word_no >= s.word_no
  JOIN w m ON m.text_id = s.text_id AND m.label = s.label AND m.word_no BETWEEN s.word_no AND e.word_no WHERE s.a > 0.6 AND e.z > 0.6
  GROUP BY s.text_id, s.label, s.word_no, e.word_no, s.a, e.z HAVING min(m.i) >= 0.6)
SELECT text_id, k.label AS label, CAST(k.s AS BIGINT) AS start_word, CAST(k.e AS BIGINT) AS end_word, round(k.score, 6) AS score FROM (SELECT text_id, unnest(list_reduce(
   list(list_value(struct_pack(s := s, e := e, label := label, score := score)) ORDER BY score DESC, CASE label WHEN 'person' THEN 0 ELSE 1 END, s, e),
   lambda a, x: CASE WHEN len(list_filter(a, lambda k: x[1].s <= k.e AND x[1].e >= k.s)) > 0 THEN a ELSE list_concat(a, x) END)) AS k FROM c GROUP BY text_id)""",
)
def decoded_entities(spark, folder):
    """Word scores of a model, turned into spans: best first, no overlap across labels."""
    raw = select(table(spark, folder, "lineitem"), _SCORES)
    scores = raw.selectExpr(
        "text_id", "word_no", "inline(array(named_struct('label', 'person', 's_start', a, 's_end', cast(z AS double)), named_struct('label', 'address', 's_start', cast(z AS double), 's_end', a)))",
        "cast(i AS double) AS s_inside",
    )
    found = entities.decode_word_scores(scores, 0.6, ["text_id"])
    return found.selectExpr("text_id", "label", "cast(start_word AS bigint) AS start_word", "cast(end_word AS bigint) AS end_word", "round(score, 6) AS score")


_PLACE = {
    "text_id": "c_custkey",
    "text": (
        "CASE c_custkey % 6 WHEN 0 THEN 'Flat 4B, Lake View Apartments, Koramangala' WHEN 1 THEN 'Apollo Clinic, Koramangala' WHEN 2 THEN 'See 12. Koramangala' "
        "WHEN 3 THEN 'Aadhaar Koramangala' WHEN 4 THEN 'near City Hospital, Koramangala' ELSE 'Bank Street, Koramangala' END"
    ),
}
_PLACE_SQL = as_sql(_PLACE, "customer")


@query(
    "name_candidates",
    f"""SELECT text_id, CASE text_id % 6 WHEN 3 THEN CAST(8 AS BIGINT) WHEN 0 THEN CAST(0 AS BIGINT) WHEN 4 THEN CAST(0 AS BIGINT) WHEN 5 THEN CAST(0 AS BIGINT) ELSE CAST(instr(text, 'Kora') - 1 AS BIGINT) END AS start,
 CASE text_id % 6 WHEN 0 THEN text WHEN 4 THEN text WHEN 5 THEN text ELSE 'Koramangala' END AS text, 'ADDRESS' AS category FROM {_PLACE_SQL}""",
)
def name_candidates(spark, folder):
    """Entities filtered, resolved and grown to whole addresses; a clinic's name and a document word stay readable."""
    texts = select(table(spark, folder, "customer"), _PLACE)
    at = "locate('Kora', text) - 1"
    found = (
        f"array(named_struct('start', {at}, 'end', {at} + 11, 'label', 'Address', 'score', 0.8D, 'text', 'Koramangala'), "
        f"named_struct('start', {at} + 4, 'end', {at} + 11, 'label', 'person', 'score', 0.7D, 'text', 'mangala'), "
        f"named_struct('start', {at}, 'end', {at} + 11, 'label', 'location', 'score', 0.5D, 'text', 'Koramangala'), "
        "named_struct('start', 0, 'end', 7, 'label', 'name', 'score', 0.9D, 'text', if(startswith(text, 'Aadhaar'), 'Aadhaar', 'x')))"
    )
    spans = texts.selectExpr("text_id", "text", f"{entities.entity_candidates(found)} AS spans")
    grown = spans.selectExpr("text_id", f"explode({entities.extend_address('text', 'spans')}) AS s")
    return grown.selectExpr("text_id", "cast(s.start AS bigint) AS start", "s.text AS text", "s.category AS category")


def _number_finder():
    """A stand-in finder: customer numbers are people."""
    import re

    number = re.compile(r"Customer#[0-9]+")

    def find(texts, labels, threshold):
        return [[(m.start(), m.end(), labels[0], 0.9) for m in number.finditer(t)] for t in texts]

    return find


@query(
    "model_entities",
    "SELECT 'Bill to ' || c_name AS source_text, CAST(8 AS BIGINT) AS start, c_name AS text, 'person' AS label FROM customer",
)
def model_entities(spark, folder):
    """Entities from a plugged-in finder, once per distinct text."""
    texts = table(spark, folder, "customer").selectExpr("'Bill to ' || c_name AS text")
    return entities.ner_entities(texts, _number_finder).selectExpr("source_text", "cast(start AS bigint) AS start", "text", "label")


# --- private names ------------------------------------------------------------------

# One customer is one task, one order one view of it; each customer has a name of their own.
_WHO = "translate(cast(o_custkey AS string), '0123456789', 'abcdefghij')"
_NAMES = {
    "task_id": "o_custkey", "view_seq": "o_orderkey", "view_id": "o_orderkey", "text_id": "o_orderkey", "text_order": "0",
    "text": (
        f"CASE o_orderkey % 5 WHEN 0 THEN 'Welcome back, Q' || {_WHO} || ' Rao' WHEN 1 THEN 'Invoice for q' || {_WHO} || '  RAO due' "
        f"WHEN 2 THEN 'Signed in as Q' || {_WHO} || ' Rao, 12 Lake View Road' WHEN 3 THEN 'Reach q' || {_WHO} || '.rao@example.com' ELSE 'Read about Alan Turing' END"
    ),
    "path": f"'/users/q' || {_WHO} || '-rao/orders'",
}
_NAMES_SQL = as_sql(_NAMES, "orders")


def _named(spark, folder):
    return select(spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey")), _NAMES)


@query("cue_texts", f"SELECT DISTINCT text FROM {_NAMES_SQL} WHERE view_id % 5 IN (0, 2)")
def cue_texts(spark, folder):
    """The texts worth a model call when every page is public."""
    return names.ner_candidates(_named(spark, folder).selectExpr("text", "false AS personal"))


@query("personal_pages", f"SELECT view_id, view_id % 5 = 3 AS personal FROM {_NAMES_SQL}")
def personal_pages(spark, folder):
    texts = _named(spark, folder)
    elements = texts.selectExpr("view_id", "0 AS ordinal", "text AS label", "cast(NULL AS string) AS value", "cast(NULL AS string) AS input_type", "cast(NULL AS string) AS autocomplete")
    return names.personal_views(texts, elements)


@query(
    "email_names",
    "SELECT text_id, replace(regexp_extract(text, '[a-z]+[._-][a-z]+'), '.', ' ') AS value FROM " + _NAMES_SQL + " WHERE view_id % 5 = 3",
)
def email_names(spark, folder):
    return names.email_names(_named(spark, folder), ["text_id"]).select("text_id", "value")


_LEARNED = f"""WITH t AS {_NAMES_SQL}, k AS (SELECT task_id, min(view_seq) AS known_from, 'q' || any_value({_WHO.replace('o_custkey', 'task_id')}) || ' rao' AS key FROM t WHERE view_id % 5 IN (0, 2, 3) GROUP BY task_id)
"""


def _policy(spark, folder):
    texts = _named(spark, folder)
    found = texts.selectExpr("text_id", f"{entities.entity_candidates(entities.rule_entities('text'))} AS found")
    personal = texts.selectExpr("view_id", "view_id % 5 = 3 AS personal")
    extra = names.email_names(texts, ["task_id", "view_seq"]).selectExpr("task_id", "view_seq", "0L AS learn_order", "value", "category")
    return names.policy(texts.drop("path"), personal, found, extra)


@query(
    "private_names",
    _LEARNED + """SELECT t.text_id, 'NAME' AS category, CASE t.view_id % 5 WHEN 1 THEN regexp_extract(t.text, 'q[a-j]+  RAO') ELSE regexp_extract(t.text, 'Q[a-j]+ Rao') END AS text
FROM t JOIN k ON k.task_id = t.task_id WHERE t.view_id % 5 IN (0, 2) OR (t.view_id % 5 = 1 AND k.known_from <= t.view_seq)
UNION ALL SELECT text_id, 'ADDRESS', '12 Lake View Road' FROM t WHERE view_id % 5 = 2""",
)
def private_names(spark, folder):
    """Names hidden on each view: after cues, and any a task learned in the same or an earlier view."""
    hidden = _policy(spark, folder).selectExpr("text_id", "explode(names) AS s")
    return hidden.selectExpr("text_id", "s.category AS category", "s.text AS text")


def _known(spark, folder):
    texts = _named(spark, folder)
    chosen = texts.selectExpr("task_id", "view_seq", "1L AS learn_order", f"explode({names.after_cues('text', entities.entity_candidates(entities.rule_entities('text')))}) AS s").selectExpr(
        "task_id", "view_seq", "learn_order", "s.text AS value", "s.category AS category"
    )
    mails = names.email_names(texts, ["task_id", "view_seq"]).selectExpr("task_id", "view_seq", "0L AS learn_order", "value", "category")
    return names.learn_names(chosen.unionByName(mails))


@query(
    "learned_names",
    _LEARNED + "SELECT task_id, key, 'NAME' AS category, known_from FROM k UNION ALL SELECT task_id, '12 lake view road', 'ADDRESS', min(view_seq) FROM t WHERE view_id % 5 = 2 GROUP BY task_id",
)
def learned_names(spark, folder):
    return _known(spark, folder)


@query(
    "hidden_paths",
    _LEARNED + "SELECT t.text_id AS url_id, CASE WHEN k.known_from <= t.view_seq THEN '/users/{name}/orders' ELSE t.path END AS path FROM t LEFT JOIN k ON k.task_id = t.task_id",
)
def hidden_paths(spark, folder):
    """Addresses with the names a task knows taken out of their paths."""
    urls = _named(spark, folder).selectExpr("text_id AS url_id", "task_id", "view_seq", "path AS path_template")
    return names.hide_names_in_path(urls, _known(spark, folder))


# Everything that leaves for a task: a goal for every second customer, each order's view, and what is said after it.
_GOAL = f"CASE WHEN task_id % 2 = 0 THEN 'Order tea for Q' || {_WHO.replace('o_custkey', 'task_id')} || ' Rao' ELSE 'Read the news' END"
_AFTER = f"'now it shows Q' || {_WHO} || ' Rao'"


@query(
    "private_views",
    f"""WITH t AS {_NAMES_SQL},
k AS (SELECT task_id, min(CASE WHEN task_id % 2 = 0 THEN -1 WHEN view_id % 5 IN (0, 2, 3) THEN view_seq END) AS known_from FROM t GROUP BY task_id),
x AS (SELECT DISTINCT 'goal|' || task_id AS view_id, 'goal' AS part, task_id, CAST(-1 AS BIGINT) AS view_seq, {_GOAL} AS x FROM t
 UNION ALL SELECT CAST(view_id AS VARCHAR), 'label', task_id, view_seq, text FROM t
 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'after', o_custkey, o_orderkey, {_AFTER} FROM orders)
SELECT view_id, part, CASE WHEN part = 'label' AND regexp_matches(x, '@') THEN regexp_replace(x, 'q[a-j]+[.]rao@example[.]com', '<PII:EMAIL:1>') ELSE
 CASE WHEN k.known_from <= x.view_seq THEN replace(regexp_replace(x, 'Q[a-j]+ Rao|q[a-j]+  RAO', '<PII:NAME:1>'), '12 Lake View Road', '<PII:ADDRESS:1>') ELSE x END END AS redacted
FROM x LEFT JOIN k ON k.task_id = x.task_id
UNION ALL SELECT CAST(t.view_id AS VARCHAR), 'path', CASE WHEN k.known_from <= t.view_seq THEN '/users/{{name}}/orders' ELSE t.path END FROM t LEFT JOIN k ON k.task_id = t.task_id""".replace("{{", "{").replace("}}", "}"),
)
def private_views(spark, folder):
    """Goals, views and later texts under the whole name policy, redacted with one vault; names out of the paths too."""
    raw = _named(spark, folder)
    shown = raw.selectExpr("view_id", "task_id", "view_seq", "cast(NULL AS string) AS title", "concat('https://shop.example', path) AS url")
    nothing = [f"cast(NULL AS string) AS {c}" for c in ("value", "hint", "input_type", "autocomplete")]
    elements = raw.selectExpr("view_id", "0 AS ordinal", "'text' AS role", "text AS label", *nothing, "'dom' AS source")
    goals = raw.select("task_id").distinct().selectExpr("task_id", f"{_GOAL} AS text")
    late = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey")).selectExpr("o_orderkey AS view_id", "'after' AS part", f"{_AFTER} AS text")
    def finder(t):
        people = find(t, lit("Q[a-j]+ Rao"))
        person = "m -> named_struct('start', m.start, 'end', m.end, 'label', 'person', 'score', 0.9D, 'text', m.text)"
        return entities.entity_candidates(f"cast(concat({entities.rule_entities(t)}, transform({people}, {person})) AS {entities.ENTITY_TYPE})")

    done, paths, _ = names.redact_private(shown, elements, goals, late, finder)
    return done.select("view_id", "part", "redacted").unionByName(paths.selectExpr("view_id", "'path' AS part", "path AS redacted"))


@query(
    "held_back",
    "SELECT o_custkey AS task_id, CAST(count(*) AS BIGINT) AS held FROM orders WHERE o_custkey % 9 = 0 GROUP BY 1",
)
def held_back(spark, folder):
    """Rows of tasks whose name finder failed: none leaves."""
    rows = _named(spark, folder).select("task_id", "text_id")
    status = rows.select("task_id").distinct().selectExpr("task_id", "if(task_id % 9 = 0, 'failed', 'on') AS names_status")
    _, held = names.fail_closed(rows, status)
    return held
