"""Page views as tables: which elements count, what labels what, and the redaction of a whole view.

A view is one page as seen once: bounded by its page, so windows over
``view_id`` never meet an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.batches import with_candidates_in_context
from maskwright.functions.detectors import field_spans, normalize_ocr
from maskwright.functions.spans import SPAN_TYPE, resolve_overlaps
from maskwright.functions.sql import let, once
from maskwright.functions.urls import url_template
from maskwright.operators import vault as tokens
from maskwright.operators.skew import shuffled
from maskwright.session import cut_lineage

# Elements farther than this share of the view past its edges are only counted, and at most this many are listed.
VIEW_MARGIN = 0.25
MAX_ELEMENTS = 120


def nearest_to_view(elements: DataFrame, margin: float = VIEW_MARGIN, k: int = MAX_ELEMENTS) -> tuple[DataFrame, DataFrame]:
    """(elements in or near the view, per-view counts of those left out above and below).

    ``elements`` holds view_id, ordinal, bbox and the view height ``vh``. The
    k nearest by distance, then order, are a top-k per view: each partition
    cuts its own rows to k before the shuffle.
    """
    bottom = "(bbox.y + bbox.h)"
    placed = elements.where("bbox.w > 0 AND bbox.h > 0").withColumns(
        {
            "_side": F.expr(f"CASE WHEN {bottom} < -{margin} * vh THEN 'above' WHEN bbox.y > (1 + {margin}) * vh THEN 'below' END"),
            "_distance": F.expr(f"CASE WHEN {bottom} < 0 THEN -{bottom} WHEN bbox.y > vh THEN bbox.y - vh ELSE 0D END"),
        }
    )
    near = placed.where("_side IS NULL")
    listed = near.withColumn(
        "_rank", F.expr("row_number() OVER (PARTITION BY view_id ORDER BY _distance, ordinal)")
    ).where(F.col("_rank") <= k)
    totals = placed.groupBy("view_id").agg(
        F.expr("count_if(_side = 'above')").alias("far_above"), F.expr("count_if(_side = 'below')").alias("far_below"),
        F.expr(f"count_if(_side IS NULL AND {bottom} < 0)").alias("near_above"),
        F.expr(f"count_if(_side IS NULL AND NOT {bottom} < 0)").alias("near_rest"),
    )
    kept = listed.groupBy("view_id").agg(
        F.expr(f"count_if({bottom} < 0)").alias("kept_above"), F.expr(f"count_if(NOT {bottom} < 0)").alias("kept_rest")
    )
    counts = totals.join(kept, "view_id", "left").selectExpr(
        "view_id", "far_above + near_above - coalesce(kept_above, 0) AS above",
        "far_below + near_rest - coalesce(kept_rest, 0) AS below",
    )
    return listed.drop("_side", "_distance", "_rank"), counts


PARTS = ("label", "value", "hint")
_NO = "cast(NULL AS string)"


def _part(part: str, order: int, text: str, context: str | None = None, kind: str = _NO, autocomplete: str = _NO) -> str:
    described = "" if context is None else f", 'context', {context}, 'input_type', {kind}, 'autocomplete', {autocomplete}"
    return f"named_struct('part', '{part}', 'part_order', {order}, 'text', {text}{described})"


def page_texts(views: DataFrame, elements: DataFrame) -> DataFrame:
    """Title, label, value and hint as rows. ``part_order`` puts the title after every element, as tokens are numbered."""
    parts = elements.selectExpr(
        "view_id", "ordinal",
        "inline(array(" + ", ".join(_part(p, i, p) for i, p in enumerate(PARTS)) + "))",
    )
    titles = views.selectExpr("view_id", "2147483647 AS ordinal", "'title' AS part", "0 AS part_order", "title AS text")
    return parts.unionByName(titles).where("text <> ''")


def distinct_texts(texts: DataFrame) -> DataFrame:
    """Each text once: what a name finder has to read."""
    return texts.select("text").distinct()


def neighbour_label(elements: DataFrame, name: str = "neighbour") -> DataFrame:
    """The label of the nearest labelled of the two elements before, when both it and the element's own are short."""
    over = "OVER (PARTITION BY view_id ORDER BY ordinal)"
    nearest = f"coalesce(nullif(lag(label, 1) {over}, ''), nullif(lag(label, 2) {over}, ''))"
    return elements.selectExpr("*", f"{nearest} AS _near").withColumn(
        name,
        F.expr(
            f"if(coalesce(label, '') <> '' AND length(label) <= {P.SHORT_TEXT} AND length(_near) <= {P.SHORT_TEXT}, _near, NULL)"
        ),
    ).drop("_near")


def pixel_context(elements: DataFrame, name: str = "context") -> DataFrame:
    """What labels an element: its neighbour and, for text read from pixels, what the pixels belong to (last)."""
    with_near = neighbour_label(elements, "_neighbour")
    source = (
        "last(if(source <> 'vision', struct(label AS label), NULL), true) "
        "OVER (PARTITION BY view_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    both = "nullif(array_join(array_distinct(filter(array(_neighbour, _behind.label), x -> coalesce(x, '') <> '')), ' '), '')"
    return (
        with_near.selectExpr("*", f"{source} AS _behind")
        .withColumn(name, F.expr(f"if(source = 'vision', {both}, _neighbour)"))
        .drop("_neighbour", "_behind")
    )


def view_texts(views: DataFrame, elements: DataFrame) -> DataFrame:
    """The texts of a view with what labels each and what its field says it holds."""
    labelled = pixel_context(elements)
    label = f"if(source = 'vision', {normalize_ocr('label')}, label)"
    parts = labelled.selectExpr(
        "view_id", "ordinal",
        "inline(array("
        + ", ".join(
            (
                _part("label", 0, label, "context", _NO, _NO),
                _part("value", 1, "value", label, "input_type", "autocomplete"),
                _part("hint", 2, "hint", _NO, _NO, _NO),
            )
        )
        + "))",
    )
    titles = views.selectExpr(
        "view_id", "2147483647 AS ordinal", "'title' AS part", "0 AS part_order", "title AS text",
        f"{_NO} AS context", f"{_NO} AS input_type", f"{_NO} AS autocomplete",
    )
    return parts.unionByName(titles).where("text IS NOT NULL")


def detect_view_texts(texts: DataFrame, names: str | None = None) -> DataFrame:
    """Resolved spans of each text: the field's own word first, else patterns in context, with names if given."""
    from maskwright.operators.entities import extend_address

    patterns = "_patterns"
    if names:
        patterns = f"concat({patterns}, coalesce({names}, cast(array() AS {SPAN_TYPE})))"
    found = let(resolve_overlaps(patterns), lambda v: extend_address("text", v)) if names else resolve_overlaps(patterns)
    read = with_candidates_in_context(texts, name="_patterns")
    return read.withColumn("spans", F.expr(once(f"coalesce({field_spans('text', 'input_type', 'autocomplete')}, {found})"))).drop("_patterns")


def redact_view(
    views: DataFrame, elements: DataFrame, scope: str = "task_id", order: str = "cycle"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(redacted elements, redacted views with URL template and counts, vault).

    ``views`` holds view_id, the scope and order columns, title and url.
    Tokens of a view are numbered element by element (label, value, hint),
    the title last.
    """
    texts = detect_view_texts(view_texts(views, elements)).join(shuffled(views.select("view_id", scope, order)), "view_id")
    # Redaction reads the texts twice: neither their windows nor the join are to run again for it.
    keyed = cut_lineage(texts.withColumn("text_id", F.expr("concat_ws('|', view_id, ordinal, part)")))
    done, vault = tokens.redact(keyed, [scope], [order, "ordinal", "part_order"], bucket_rows=1)  # each cycle is numbered by itself
    wide = done.where("part <> 'title'").groupBy("view_id", "ordinal").agg(
        *[F.expr(f"any_value(redacted) FILTER (WHERE part = '{p}')").alias(f"_{p}") for p in ("label", "value", "hint")]
    )
    others = [c for c in elements.columns if c not in ("view_id", "ordinal", "label", "value", "hint")]
    redacted_elements = elements.join(shuffled(wide), ["view_id", "ordinal"], "left").selectExpr(
        "view_id", "ordinal", *others, "_label AS label", "_value AS value", "_hint AS hint"
    )
    per_category = done.selectExpr("view_id", "explode(spans) AS s").groupBy("view_id", "s.category").agg(F.count("*").alias("n"))
    counts = per_category.groupBy("view_id").agg(
        F.expr("map_from_entries(array_sort(collect_list(struct(category, n))))").alias("redactions")
    )
    titles = done.where("part = 'title'").selectExpr("view_id", "redacted AS title")
    redacted_views = (
        views.drop("title").join(shuffled(titles), "view_id", "left").join(shuffled(counts), "view_id", "left")
        .withColumn("_u", F.expr(url_template("url")))
        .selectExpr(
            "view_id", scope, order, "_u.origin AS origin", "_u.path_template AS path_template", "_u.has_query AS has_query",
            "coalesce(title, '') AS title", "coalesce(redactions, map()) AS redactions",
        )
    )
    return redacted_elements, redacted_views, vault


def merge_views(readings: DataFrame) -> DataFrame:
    """Several scroll positions of one page as one reading.

    ``readings``: page, view_seq, title, personal, above, below, observe_ms,
    vision_ms, names_ms, redact_ms, name_model. The texts stay rows, ordered
    by view_seq; faces are not carried.
    """
    return readings.groupBy("page").agg(
        F.expr("min_by(title, view_seq)").alias("title"),
        F.expr("bool_or(personal)").alias("personal"),
        F.expr("min_by(above, view_seq)").alias("above"),
        F.expr("max_by(below, view_seq)").alias("below"),
        *[F.sum(c).alias(c) for c in ("observe_ms", "vision_ms", "names_ms", "redact_ms")],
        F.expr(
            "CASE WHEN bool_or(name_model = 'on') THEN 'on' WHEN bool_or(name_model = 'failed') THEN 'failed' ELSE 'off' END"
        ).alias("name_model"),
    )
