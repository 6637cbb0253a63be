"""Pixels as tables: which regions to read, boxes matched to elements, lines inserted, faces counted.

Boxes meet elements within one view. Where a view has many of them, they meet by grid cell instead of all with all.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import boxes as B
from maskwright.functions.patterns import SPACE
from maskwright.functions.sql import fresh, lit
from maskwright.operators.skew import dealt
from maskwright.session import cut_lineage

MATCH_ABOVE = 0.3
TEXT_MATCH = 0.8
MIN_LINE_CONFIDENCE = 0.5
MAX_TARGETS = 4
#: Over so many boxes of a role (or texts) in a view, only those of neighbouring cells are compared.
CROWD = 32
#: Levels of widths are so far apart in the key of a grid that levels of heights fit between.
LEVELS = 10000
CELL = ["_level", "_cx", "_cy"]


def needs_pixels(elements: DataFrame) -> DataFrame:
    """Elements the page cannot describe, with the reason."""
    reason = (
        "CASE WHEN role IN ('canvas', 'iframe', 'video') THEN role WHEN role = 'image' AND "
        f"NOT coalesce(label, '') rlike {lit('[^' + SPACE + ']')} THEN 'unlabelled-image' "
        "WHEN role = 'image' AND bbox.w >= 200 AND bbox.h >= 100 THEN 'large-image' END"
    )
    return elements.withColumn("reason", F.expr(reason)).where("reason IS NOT NULL")


def pixel_targets(elements: DataFrame, k: int = MAX_TARGETS) -> DataFrame:
    """The k largest regions worth reading per view: a top-k, cut in each partition before the shuffle."""
    worth = needs_pixels(elements).where(
        "reason <> 'video' AND NOT coalesce(array_contains(state, 'offscreen'), false) AND bbox.w >= 60 AND bbox.h >= 20"
    )
    ranked = worth.withColumn(
        "rank", F.expr("row_number() OVER (PARTITION BY view_id ORDER BY bbox.w * bbox.h DESC, ordinal)")
    )
    return ranked.where(F.col("rank") <= k)


def _text(column: str) -> str:
    spaces = lit("[" + SPACE + "]+")
    return f"coalesce(lower(trim(regexp_replace({column}, {spaces}, ' '))), '')"


def _level(b: str, base: float) -> str:
    return f"cast(floor(ln(greatest({b}.w, {b}.h)) / {math.log(base)!r}D) AS int)"


def _cell(x: str, y: str, level: str, base: float, dx: str = "0", dy: str = "0") -> str:
    """The cell of a point in the grid of a level, whose cells are as wide as the largest side of the level."""
    size = f"pow({base!r}D, {level} + 1)"
    return (
        f"named_struct('_level', {level}, '_cx', cast(floor({x} / {size}) AS bigint) + {dx}, "
        f"'_cy', cast(floor({y} / {size}) AS bigint) + {dy})"
    )


def _celled(frame: DataFrame, crowds: DataFrame, keys: list[str], cells: str) -> DataFrame:
    """Rows of crowded keys, once for each of their cells."""
    return frame.join(crowds, keys).selectExpr(*frame.columns, f"inline({cells})")


def _crowds(frame: DataFrame, keys: list[str], crowd: int) -> DataFrame | None:
    """The keys of over ``crowd`` rows; None without any, so that rows which need no cells do not pass through them."""
    crowds = cut_lineage(frame.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select(*keys))
    return None if crowds.isEmpty() else crowds


def box_pairs(elements: DataFrame, boxes: DataFrame, above: float = MATCH_ABOVE, crowd: int = CROWD) -> DataFrame:
    """Elements (a) beside the boxes (b) of their view and role that can score above ``above``.

    An IoU above t needs the same of the intervals on either axis alone: widths and heights each within 1 / t of each
    other, and centres nearer, on each axis, than (1 - t) / (1 + t) of the mean side. So widths and heights are cut in
    levels of that ratio, and a pair meets once: in the grid of its larger width and its larger height, whose cells are
    twice that distance. An element is repeated 16 times for it at most and a box 4 times, whatever the view holds.
    """
    keys = ["view_id", "role"]
    left = elements.select(*keys, "ordinal", F.col("bbox").alias("a"))
    right = boxes.select(*keys, "box_no", F.col("bbox").alias("b"), F.col("confidence").alias("box_confidence"))
    if not 0.1 <= above < 1:  # close centres alone can be enough
        return left.join(right, keys)
    base, reach = 1.001 / above, 1.001 * (1 - above) / (1 + above)  # a little more, so that rounding parts no pair
    l, i, u, v = fresh("l"), fresh("i"), fresh("u"), fresh("v")
    far = f"({reach!r}D * pow({base!r}D, {l} + 1))"

    def level(side: str) -> str:
        return f"cast(floor(ln({side}) / {math.log(base)!r}D) AS int)"

    def along(box: str, at: str, side: str, about: bool) -> str:
        centre, own = f"({box}.{at} + {box}.{side} / 2)", level(f"{box}.{side}")
        first, last = ((f"{centre} - {far}", f"{centre} + {far}") if about else (centre, centre))
        cells = f"sequence(cast(floor(({first}) / (2.001D * {far})) AS bigint), cast(floor(({last}) / (2.001D * {far})) AS bigint))"
        return f"flatten(transform(array({own}, {own} + 1), {l} -> transform({cells}, {i} -> named_struct('l', {l}, 'c', {i}))))"

    def grid(box: str, about: bool) -> str:
        cell = f"named_struct('_level', {u}.l * {LEVELS} + {v}.l, '_cx', {u}.c, '_cy', {v}.c)"
        return f"flatten(transform({along(box, 'x', 'w', about)}, {u} -> transform({along(box, 'y', 'h', about)}, {v} -> {cell})))"

    crowds = _crowds(boxes, keys, crowd)
    if crowds is None:
        return left.join(right, keys)
    own = {f"_{b}{side}": F.expr(level(f"{b}.{side}")) for b in "ab" for side in "wh"}
    asked = _celled(left.withColumns({k: e for k, e in own.items() if k[1] == "a"}), crowds, keys, grid("a", True))
    held = _celled(right.withColumns({k: e for k, e in own.items() if k[1] == "b"}), crowds, keys, grid("b", False))
    met = asked.join(held, [*keys, *CELL])
    crowded = met.where(f"_level = greatest(_aw, _bw) * {LEVELS} + greatest(_ah, _bh)").drop(*CELL, *own)
    return left.join(crowds, keys, "left_anti").join(right, keys).unionByName(crowded)


def best_boxes(elements: DataFrame, boxes: DataFrame, above: float = MATCH_ABOVE, crowd: int = CROWD) -> DataFrame:
    """Per element the best box of its role, scored strictly above the threshold; ties to the first box.

    The best is kept while aggregating, so the pairs of a view are never held together.
    """
    scored = box_pairs(elements, boxes, above, crowd).withColumn("score", F.expr(B.match_score("a", "b"))).where(F.col("score") > above)
    return scored.groupBy("view_id", "ordinal").agg(
        F.expr("max_by(struct(box_no, box_confidence), struct(score, -box_no))").alias("box")
    )


def text_pairs(elements: DataFrame, regions: DataFrame, threshold: float = TEXT_MATCH, crowd: int = CROWD) -> DataFrame:
    """Labelled elements (own, a) beside the text regions (read, b) of their view that can match.

    Equal texts meet by text. A text that only contains the other must have over half of its region in the element, so
    the region's centre is in it: the element stands in the few cells of its own size that it covers, the centre in its
    cell of every size.
    """
    labelled = elements.selectExpr("view_id", "ordinal", f"{_text('label')} AS own", "bbox AS a").where("own <> ''")
    read = regions.selectExpr("view_id", "region_no", f"{_text('text')} AS read", "bbox AS b", "confidence AS region_confidence").where("read <> ''")
    if threshold < 0.78:  # less than half may be enough
        return labelled.join(read, "view_id")
    l, i, j = fresh("l"), fresh("i"), fresh("j")
    size = f"pow(2D, {l} + 1)"
    first, last = (f"cast(floor({{0}} / {size}) AS bigint)", f"cast(floor(({{0}} + {{1}}) / {size}) AS bigint)")
    columns, rows = (f"sequence({first.format(p)}, {last.format(p, q)})" for p, q in (("a.x", "a.w"), ("a.y", "a.h")))
    covered = f"flatten(transform({columns}, {i} -> transform({rows}, {j} -> named_struct('_level', {l}, '_cx', {i}, '_cy', {j}))))"
    crowds = _crowds(read, ["view_id"], crowd)
    alike = "(contains(own, read) OR contains(read, own))"
    calm = labelled if crowds is None else labelled.join(crowds, ["view_id"], "left_anti")
    near = calm.join(read, "view_id").where(f"own = read OR (a.w > 0 AND a.h > 0 AND {alike})")
    if crowds is None:
        return near
    busy = labelled.join(crowds, ["view_id"], "left_semi")
    asked = _celled(busy.where("a.w > 0 AND a.h > 0"), crowds, ["view_id"], f"flatten(transform(array({_level('a', 2.0)}), {l} -> {covered}))")
    sizes = busy.where("a.w > 0 AND a.h > 0").groupBy("view_id").agg(F.expr(f"collect_set({_level('a', 2.0)})").alias("_sizes"))
    centres = read.join(sizes, "view_id")
    held = _celled(centres, crowds, ["view_id"], f"transform(_sizes, {l} -> {_cell('(b.x + b.w / 2)', '(b.y + b.h / 2)', l, 2.0)})").drop("_sizes")
    inside = asked.join(held, ["view_id", *CELL]).where(f"own <> read AND {alike}").drop(*CELL)
    same = busy.join(read.withColumn("own", F.col("read")), ["view_id", "own"])
    return near.select(*inside.columns).unionByName(inside).unionByName(same)


def best_regions(elements: DataFrame, regions: DataFrame, threshold: float = TEXT_MATCH, crowd: int = CROWD) -> DataFrame:
    """Per labelled element the best text region: same or containing text, and some overlap."""
    alike = "CASE WHEN own = read THEN 1D WHEN contains(own, read) OR contains(read, own) THEN 0.9D ELSE 0D END"
    scored = text_pairs(elements, regions, threshold, crowd).withColumns({"_alike": F.expr(alike), "_where": F.expr(B.text_score("a", "b"))}).where(
        f"_alike >= {threshold} AND _where > 0"
    ).withColumn("score", F.expr("_alike * 0.7D + _where * 0.3D")).where(F.col("score") > threshold)
    return scored.groupBy("view_id", "ordinal").agg(
        F.expr("max_by(struct(region_no, region_confidence), struct(score, -region_no))").alias("region")
    )


def fuse(elements: DataFrame, boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Elements with what vision agrees on; boxes matched by none become elements of their own with fresh ids."""
    box, region = best_boxes(elements, boxes), best_regions(elements, regions)
    joined = elements.join(box, ["view_id", "ordinal"], "left").join(region, ["view_id", "ordinal"], "left")
    fused = joined.withColumns(
        {
            "source": F.expr("if(box IS NULL AND region IS NULL, source, 'fused')"),
            "confidence": F.expr("coalesce(box.box_confidence, region.region_confidence, confidence)"),
        }
    ).select(*elements.columns)
    matched = box.selectExpr("view_id", "box.box_no AS box_no").distinct()
    alone = boxes.join(matched, ["view_id", "box_no"], "left_anti")
    ends = elements.groupBy("view_id").agg(
        F.expr("max(ordinal)").alias("_last"), F.expr("max(cast(substring(id, 2) AS int))").alias("_top"), F.count("*").alias("_n")
    )
    # A new id is the next free number after both the count and the highest id in use.
    placed = alone.join(ends, "view_id", "left").withColumn(
        "_k", F.expr("row_number() OVER (PARTITION BY view_id ORDER BY box_no)")
    )
    added = placed.selectExpr(
        "view_id", "cast(coalesce(_last, -1) + _k AS int) AS ordinal",
        "concat('e', greatest(coalesce(_top, 0), coalesce(_n, 0)) + _k) AS id", "role", "bbox", "'vision' AS source", "confidence",
    )
    return fused.unionByName(added, allowMissingColumns=True)


def suppress(boxes: DataFrame, conf: float = 0.15, overlap: float = 0.45) -> DataFrame:
    """Non-maximum suppression per image: best confidence first, drop what overlaps a kept one too much.

    ``boxes``: image_id, box_no, bbox, confidence, and optionally image_w and
    image_h, the size beyond which a box's centre drops it. An image's boxes
    are a detector's output for one screen: a bounded array.
    """
    good = boxes.where(F.col("confidence") > conf)
    if "image_w" in boxes.columns:
        cx, cy = "(bbox.x + bbox.w / 2)", "(bbox.y + bbox.h / 2)"
        good = good.where(f"{cx} >= 0 AND {cx} < image_w AND {cy} >= 0 AND {cy} < image_h")
    a, x, k = fresh("a"), fresh("x"), fresh("k")
    per_image = good.groupBy("image_id").agg(
        F.expr("array_sort(collect_list(struct(-confidence AS worst, box_no AS box_no, bbox AS bbox)))").alias("found")
    )
    kept = (
        f"aggregate(found, slice(found, 1, 0), ({a}, {x}) -> if(exists({a}, {k} -> {B.iou(x + '.bbox', k + '.bbox')} > {overlap}), "
        f"{a}, concat({a}, array({x}))))"
    )
    return per_image.selectExpr("image_id", f"inline({kept})").selectExpr("image_id", "box_no", "bbox", "-worst AS confidence")


def insert_lines(elements: DataFrame, lines: DataFrame, min_confidence: float = MIN_LINE_CONFIDENCE, rows: int = 0) -> DataFrame:
    """Lines read from pixels as text elements after the element they were read from, under new ids.

    Ids are unique within a view. Elements and lines are shuffled once, together, by view; ``rows``: how many there are
    about, so that large tables go to more tasks (see :func:`skew.dealt`).
    """
    good = lines.where((F.col("confidence") >= min_confidence) & F.col("target_id").isNotNull()).selectExpr(
        "view_id", "target_id AS id", "line_no AS _line", "'text' AS role", "text AS label", "bbox", "'vision' AS source",
        "round(confidence, 2) AS confidence", "true AS _read",
    )
    own = elements.withColumns({"_at": F.col("ordinal"), "_line": F.lit(-1), "_read": F.lit(False)}).drop("ordinal")
    both = dealt(own.unionByName(good, allowMissingColumns=True), "view_id", rows)
    placed = both.withColumns({
        "_top": F.expr("max(if(_read, NULL, coalesce(try_cast(substring(id, 2) AS int), 0))) OVER (PARTITION BY view_id)"),
        "_at": F.expr("if(_read, max(_at) OVER (PARTITION BY view_id, id), _at)"),
    }).where("NOT _read OR _at IS NOT NULL")
    numbered = placed.withColumns({
        "_k": F.expr("sum(cast(_read AS int)) OVER (PARTITION BY view_id ORDER BY _at, _line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
        "ordinal": F.expr("cast(row_number() OVER (PARTITION BY view_id ORDER BY _at, _line) - 1 AS int)"),
    })
    return numbered.withColumn("id", F.expr("if(_read, concat('e', _top + _k), id)")).drop("_at", "_line", "_read", "_top", "_k")


def face_counts(faces: DataFrame) -> DataFrame:
    """Faces per view, from regions of at least 32 by 32 pixels."""
    return faces.where("region_w >= 32 AND region_h >= 32").groupBy("view_id").agg(F.count("*").alias("faces"))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Corner boxes to sizes, confidence to 0..1, white space collapsed, blanks dropped."""
    spaces = lit("[" + SPACE + "]+")
    return words.selectExpr(
        *[c for c in words.columns if c not in ("x0", "y0", "x1", "y1", "text", "confidence")],
        "named_struct('x', cast(x0 AS double), 'y', cast(y0 AS double), 'w', cast(x1 - x0 AS double), 'h', cast(y1 - y0 AS double)) AS bbox",
        f"trim(regexp_replace(text, {spaces}, ' ')) AS text", "confidence / 100D AS confidence",
    ).where("text <> ''")


def redacted_regions(faces: DataFrame, pixel_spans: DataFrame) -> DataFrame:
    """Manifest rows per view: what was found in pixels, where and how surely. Rows, not one array per view."""
    return faces.selectExpr("view_id", "bbox", "'FACE' AS category", "'vision' AS source", "confidence").unionByName(
        pixel_spans.select("view_id", "bbox", "category", "source", "confidence")
    )


def frame_changed(frames: DataFrame, bucket: str | None = None) -> DataFrame:
    """Frames with a signature, whether it differs from the source's previous frame, and whether to capture it.

    ``frames``: source_id, at (timestamp, unique per source), content, mutations. ``bucket``
    (SQL that rises with ``at``) splits a source that holds most of the frames.
    """
    from maskwright.operators.skew import ordered

    signed = frames.withColumn("signature", F.xxhash64("content"))
    seen = ordered(
        signed, ["source_id"], "at", {"_before": ("lag", "struct(signature AS signature, at AS at)")}, bucket
    )
    return seen.selectExpr(
        *signed.columns, "_before IS NULL OR _before.signature <> signature AS changed",
        "mutations > 0 OR _before IS NULL OR unix_micros(at) - unix_micros(_before.at) >= 1000000 AS capture",
    )
