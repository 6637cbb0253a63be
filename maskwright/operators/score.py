"""Scoring a redaction against ground truth.

Tables: ``texts`` (page, text_id, raw, redacted), ``items`` (page, item_no,
category, value, place), ``lookalikes`` (page, miss_no, value). All joins are
equi-joins on page or text; positions are compared inside one text's row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.spans import MARK, find, in_blocks, pieces, running_lengths
from maskwright.functions.sql import fresh, let, lit, lits
from maskwright.operators.skew import join_salted, ordered

HIDDEN_TYPE = "array<struct<start:int,end:int,categories:array<string>>>"
# Truth items of one page that travel in one row; a page with more takes more rows.
ITEMS_PER_ROW = 128


def hidden_spans(raw: str, redacted: str) -> str:
    """What redaction hid: the gaps between the literal parts, found in order; NULL when they do not line up."""
    empty = f"cast(array() AS {HIDDEN_TYPE})"
    runs = lit(f"(?:{P.ANY_TOKEN})+")
    i, a, t = fresh("i"), fresh("a"), fresh("t")

    def aligned(v: str) -> str:
        count = f"cast((size({v}.p) - 1) / 2 AS int)"
        cats = f"regexp_extract_all(get({v}.p, 2 * {i} - 1), {lit(P.ANY_TOKEN)}, 1)"
        literal = f"get({v}.p, 2 * {i})"

        def middle(at: str) -> str:
            return (
                f"if({at} = 0, named_struct('ok', false, 'open', 0, 'out', {a}.out), "
                f"named_struct('ok', true, 'open', {at} - 1 + length({literal}), 'out', concat({a}.out, "
                f"array(named_struct('start', {a}.open, 'end', {at} - 1, 'categories', {cats})))))"
            )

        tail_at = f"(length({v}.r) - length({literal}))"
        last = (
            f"if(endswith({v}.r, {literal}) AND {tail_at} > {a}.open, named_struct('ok', true, 'open', 0, 'out', "
            f"concat({a}.out, array(named_struct('start', {a}.open, 'end', {tail_at}, 'categories', {cats})))), "
            f"named_struct('ok', false, 'open', 0, 'out', {a}.out))"
        )
        step = f"CASE WHEN NOT {a}.ok THEN {a} WHEN {i} = {count} THEN {last} ELSE {let(f'locate({literal}, {v}.r, {a}.open + 2)', middle)} END"
        head = f"get({v}.p, 0)"
        folded = (
            f"aggregate(sequence(1, greatest({count}, 1)), named_struct('ok', startswith({v}.r, {head}), 'open', length({head}), "
            f"'out', {empty}), ({a}, {i}) -> {step}, {a} -> if({a}.ok, {a}.out, NULL))"
        )
        return f"if(size({v}.p) < 3, if({v}.r = {head}, {empty}, NULL), {folded})"

    return let(f"named_struct('p', {pieces(redacted, runs)}, 'r', {raw})", aligned)


def text_pairs(raw: DataFrame, redacted: DataFrame, keys: list[str]) -> DataFrame:
    """Raw texts with their redacted twin (empty when missing) and hidden spans; what cannot be aligned is all hidden."""
    both = raw.where("text <> ''").withColumnRenamed("text", "raw").join(
        redacted.select(*keys, F.col("text").alias("redacted")), keys, "left"
    )
    return with_hidden(both.withColumn("redacted", F.coalesce("redacted", F.lit(""))))


def with_hidden(pairs: DataFrame) -> DataFrame:
    found = pairs.withColumn("_h", F.expr(hidden_spans("raw", "redacted")))
    whole = f"cast(array(named_struct('start', 0, 'end', length(raw), 'categories', array('?'))) AS {HIDDEN_TYPE})"
    return found.withColumns({"unaligned": F.expr("_h IS NULL"), "hidden": F.expr(f"coalesce(_h, {whole})")}).drop("_h")


def occurrences(text: str, value: str, from_pixels: str = "false") -> str:
    """Every place ``value`` stands in ``text``, self-overlaps included; loosely around separators when read from pixels."""
    quoted = f"concat('(?=', {lit(chr(92) + 'Q')}, replace({value}, {lit(chr(92) + 'E')}, {lit(chr(92) * 2 + 'E' + chr(92) + 'Q')}), {lit(chr(92) + 'E')}, ')')"
    n, s, m, c = fresh("n"), fresh("s"), fresh("m"), fresh("c")
    cut = f"split(regexp_replace({text}, {quoted}, {lit(MARK)}), {lit(MARK)}, -1)"

    def exact(p: str) -> str:
        # Marks stand between characters, so the running lengths of the pieces are offsets in the text.
        starts = running_lengths(f"transform({p}, {n} -> length({n}))")
        return (
            f"if(size({p}) < 2, cast(array() AS array<struct<start:int,end:int>>), "
            f"transform(slice({starts}, 2, size({p}) - 1), {s} -> named_struct('start', {s}, 'end', {s} + length({value}))))"
        )

    loose_gap = lit("[.," + P.SPACE + "-]{0,2}")
    loose = (
        f"concat('(?iu)', array_join(transform(split({value}, ''), {c} -> if({c} rlike {lit('[.,' + P.SPACE + '-]')}, {loose_gap}, "
        f"concat({lit(chr(92) + 'Q')}, {c}, {lit(chr(92) + 'E')}))), ''))"
    )
    from_image = (
        f"transform(filter({find(text, loose)}, {m} -> {m}.end > {m}.start), "
        f"{m} -> named_struct('start', {m}.start, 'end', {m}.end))"
    )
    return (
        f"if({from_pixels}, if(length({value}) > 0, {from_image}, cast(array() AS array<struct<start:int,end:int>>)), "
        f"if(contains({text}, {value}), {let(cut, exact)}, cast(array() AS array<struct<start:int,end:int>>)))"
    )


def _packed(items: DataFrame, fields: list[str]) -> DataFrame:
    """Rows per page packed in bounded arrays."""
    number = fields[0]
    return items.groupBy("page", F.expr(f"cast(floor({number} / {ITEMS_PER_ROW}) AS bigint)").alias("_block")).agg(
        F.expr(f"collect_list(struct({', '.join(fields)}))").alias("_items")
    ).drop("_block")


def item_occurrences(texts: DataFrame, items: DataFrame) -> DataFrame:
    """One row per place an item stands in a text, with the hidden spans that touch it."""
    packed = _packed(items, ["item_no", "category", "value", "place"])
    met = join_salted(texts.select("page", "text_id", "raw", "hidden"), packed, ["page"], ["text_id"])
    x, o, h = fresh("x"), fresh("o"), fresh("h")
    pixels = f"{x}.place IN ({lits(P.PIXEL_PLACES)})"
    touching = f"filter(hidden, {h} -> {h}.start < {o}.end AND {o}.start < {h}.end)"
    per_item = (
        f"transform({occurrences('raw', x + '.value', pixels)}, {o} -> named_struct('item_no', {x}.item_no, "
        f"'category', {x}.category, 'start', {o}.start, 'end', {o}.end, 'touching', {touching}))"
    )
    return met.selectExpr("page", "text_id", f"inline(flatten(transform(_items, {x} -> {per_item})))")


def score_items(items: DataFrame, places: DataFrame) -> DataFrame:
    """Per item: seen, caught, partial, category_right, iou."""
    h, a = fresh("h"), fresh("a")
    covered = f"aggregate(touching, 0, ({a}, {h}) -> {a} + least({h}.end, `end`) - greatest({h}.start, start))"
    low = f"aggregate(touching, start, ({a}, {h}) -> least({a}, {h}.start))"
    high = f"aggregate(touching, `end`, ({a}, {h}) -> greatest({a}, {h}.end))"
    each = places.selectExpr(
        "page", "item_no", f"{covered} AS covered", "`end` - start AS size",
        f"exists(touching, {h} -> array_contains({h}.categories, category)) AS right_here",
        f"{covered} / ({high} - {low}) AS iou",
    )
    per_item = each.groupBy("page", "item_no").agg(
        F.expr("bool_and(covered >= size)").alias("_whole"), F.expr("bool_or(covered > 0)").alias("_some"),
        F.expr("bool_and(right_here)").alias("_right"), F.avg("iou").alias("iou"),
    )
    return items.join(per_item, ["page", "item_no"], "left").selectExpr(
        "page", "item_no", "category", "value", "place", "_whole IS NOT NULL AS seen", "coalesce(_whole, false) AS caught",
        "coalesce(_some AND NOT _whole, false) AS partial", "coalesce(_whole AND _right, false) AS category_right",
        "coalesce(iou, 0D) AS iou",
    )


def _union_ranges(ranges: str) -> str:
    """Sorted, merged ranges (touching ones join)."""

    def step(f: str, r: str) -> str:
        grown = f"named_struct('start', {f}.state.start, 'end', greatest({f}.state.end, {r}.end))"
        closed = f"if({f}.state.start < 0, {f}.kept, concat({f}.kept, array({f}.state)))"
        return (
            f"if({r}.start <= {f}.state.end, named_struct('state', {grown}, 'kept', {f}.kept), "
            f"named_struct('state', named_struct('start', {r}.start, 'end', {r}.end), 'kept', {closed}))"
        )

    return in_blocks(
        f"array_sort({ranges})", "named_struct('start', -1, 'end', -1)", "array<struct<start:int,end:int>>", step,
        lambda state: f"if({state}.start < 0, cast(array() AS array<struct<start:int,end:int>>), array({state}))",
    )


def text_scores(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Per text: hidden spans, those that touch no true range (with their text), characters outside truth, and hidden ones of them."""
    truth = places.groupBy("page", "text_id").agg(F.expr("collect_list(struct(start, `end`))").alias("truth"))
    joined = texts.join(truth, ["page", "text_id"], "left").withColumn(
        "truth", F.expr("coalesce(truth, cast(array() AS array<struct<start:int,end:int>>))")
    )
    h, t, a, b = fresh("h"), fresh("t"), fresh("a"), fresh("b")
    merged = joined.withColumn("truth", F.expr(_union_ranges("truth")))
    total = f"aggregate(truth, 0, ({a}, {t}) -> {a} + {t}.end - {t}.start)"
    inside = (
        f"aggregate(hidden, 0, ({a}, {h}) -> {a} + aggregate(truth, 0, ({b}, {t}) -> {b} + "
        f"greatest(0, least({h}.end, {t}.end) - greatest({h}.start, {t}.start))))"
    )
    hidden = f"aggregate(hidden, 0, ({a}, {h}) -> {a} + {h}.end - {h}.start)"
    wrong = (
        f"transform(filter(hidden, {h} -> NOT exists(truth, {t} -> {t}.start < {h}.end AND {h}.start < {t}.end)), "
        f"{h} -> named_struct('start', {h}.start, 'end', {h}.end, 'categories', {h}.categories, "
        f"'text', substring(raw, {h}.start + 1, {h}.end - {h}.start)))"
    )
    return merged.selectExpr(
        "page", "text_id", "unaligned", "size(hidden) AS hidden_spans", f"{wrong} AS false_positives",
        f"length(raw) - {total} AS outside_chars", f"{hidden} - {inside} AS over_redacted",
    )


def false_positives(text_rows: DataFrame) -> DataFrame:
    return text_rows.selectExpr("page", "text_id", "inline(false_positives)")


def near_misses(texts: DataFrame, lookalikes: DataFrame) -> DataFrame:
    """Per look-alike: found in the texts, and hidden anywhere (even in part)."""
    met = join_salted(
        texts.select("page", "text_id", "raw", "hidden"), _packed(lookalikes, ["miss_no", "value"]), ["page"], ["text_id"]
    )
    x, o, h = fresh("x"), fresh("o"), fresh("h")
    hit = f"exists({occurrences('raw', x + '.value')}, {o} -> exists(hidden, {h} -> {h}.start < {o}.end AND {o}.start < {h}.end))"
    found = met.selectExpr(
        "page",
        f"inline(transform(filter(_items, {x} -> contains(raw, {x}.value)), {x} -> named_struct('miss_no', {x}.miss_no, 'hit', {hit})))",
    )
    per_miss = found.groupBy("page", "miss_no").agg(F.expr("bool_or(hit)").alias("hidden"))
    return lookalikes.join(per_miss, ["page", "miss_no"], "left").selectExpr(
        "page", "miss_no", "value", "hidden IS NOT NULL AS seen", "coalesce(hidden, false) AS hidden"
    )


def _ratio(part: str, whole: str) -> str:
    return f"if({whole} = 0, 1D, {part} / {whole})"


def totals(items: DataFrame, texts: DataFrame, misses: DataFrame, pages: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """The summary row: recall, precision, iou, near-misses, over-redaction. An empty denominator gives 1.

    ``items``, ``texts`` and ``misses`` are the outputs of score_items,
    text_scores and near_misses; with ``by`` they carry those columns and one
    row per group comes out, for comparing runs. ``pages``: page, faces_expected,
    faces_found of the pages that say so; gives the two sums.
    """
    keys = by or []

    def grouped(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys)

    i = grouped(items).agg(
        F.count("*").alias("pii"), F.expr("count_if(seen)").alias("seen"), F.expr("count_if(caught)").alias("caught"),
        F.expr("count_if(partial)").alias("partial"), F.expr("count_if(category_right)").alias("category_right"),
        F.expr("coalesce(avg(iou) FILTER (WHERE seen), 1D)").alias("iou"),
    )
    t = grouped(texts).agg(
        F.countDistinct("page").alias("pages"), F.sum("hidden_spans").alias("spans"),
        F.expr("sum(size(false_positives))").alias("false_positives"), F.sum("over_redacted").alias("_over"),
        F.sum("outside_chars").alias("_outside"), F.expr("count_if(unaligned)").alias("unaligned"),
    )
    m = grouped(misses).agg(
        F.expr("count_if(seen)").alias("near_misses"), F.expr("count_if(seen AND hidden)").alias("near_misses_hidden")
    )
    # One row each (or one per compared run).
    joined = i.join(t, keys).join(m, keys) if keys else i.join(F.broadcast(t), F.lit(True)).join(F.broadcast(m), F.lit(True))
    faces = []
    if pages is not None:
        faces = [f"coalesce({c}, 0L) AS {c}" for c in ("faces_expected", "faces_found")]
        seen = grouped(pages).agg(F.sum(F.expr("cast(faces_expected AS bigint)")).alias("faces_expected"), F.sum(F.expr("cast(faces_found AS bigint)")).alias("faces_found"))
        joined = joined.join(seen, keys, "left") if keys else joined.join(F.broadcast(seen), F.lit(True))
    return joined.selectExpr(
        *keys, "pages", "pii", "seen", "caught", "partial", "category_right", f"{_ratio('caught', 'pii')} AS recall",
        f"{_ratio('caught', 'seen')} AS recall_in_text", f"{_ratio('(spans - false_positives)', 'spans')} AS precision", "iou",
        "spans", "false_positives", "near_misses", "near_misses_hidden", "_over / greatest(1, _outside) AS over_redaction", "unaligned", *faces,
    )


def by_category_and_place(items: DataFrame) -> DataFrame:
    """Items and caught ones per category and per place, in one pass."""
    sets = items.groupingSets([["category"], ["place"]], "category", "place")
    return sets.agg(
        F.expr("if(grouping(category) = 0, 'category', 'place')").alias("section"), F.count("*").alias("pii"),
        F.expr("count_if(caught)").alias("caught"),
    ).selectExpr("section", "coalesce(category, place) AS key", "pii", "caught")


def median_timings(readings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Median of each stage: the mean of the middle two when even. See study.exact_ranks for unbounded groups."""
    stages = ("observe_ms", "vision_ms", "names_ms", "redact_ms")
    return readings.groupBy(*(by or [])).agg(*[F.expr(f"coalesce(percentile({s}, 0.5), 0D)").alias(s) for s in stages])


def report(items: DataFrame, texts: DataFrame, misses: DataFrame) -> DataFrame:
    """The report as tidy rows (section, key, metric, value): per page, missed, hidden but not private, truth not found."""
    per_page = items.groupBy("page").agg(F.expr("count_if(caught)").alias("caught"), F.count("*").alias("pii"))
    wrong = texts.groupBy("page").agg(F.expr("sum(size(false_positives))").alias("wrong"))
    pages = per_page.join(wrong, "page", "full").selectExpr(
        "'per page' AS section", "page AS key",
        "inline(array(named_struct('metric', 'caught', 'value', cast(coalesce(caught, 0) AS string)), "
        "named_struct('metric', 'pii', 'value', cast(coalesce(pii, 0) AS string)), "
        "named_struct('metric', 'false positives', 'value', cast(coalesce(wrong, 0) AS string))))",
    )
    missed = items.where("NOT caught").selectExpr(
        "'missed' AS section", "page AS key", "concat(category, ' #', item_no) AS metric",
        "CASE WHEN NOT seen THEN concat('not in the text (', place, ')') WHEN partial THEN 'partly hidden' ELSE 'readable' END AS value",
    )
    hidden = texts.selectExpr("page", "inline(false_positives)").selectExpr(
        "'hidden but not private' AS section", "page AS key", "array_join(categories, '+') AS metric", "text AS value"
    )
    wrongly = misses.where("seen AND hidden").selectExpr("'hidden but not private' AS section", "page AS key", "'look-alike' AS metric", "value")
    unseen = misses.where("NOT seen").selectExpr("'truth not found' AS section", "page AS key", "'look-alike' AS metric", "value")
    rows = pages
    for part in (missed, hidden, wrongly, unseen):
        rows = rows.unionByName(part)
    return rows


def summary_sections(items: DataFrame, summary: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """What a report begins with, as rows (section, key, metric, value): the metrics, then caught items by category and by place.

    ``summary``: the one row of :func:`totals`; ``timings``: the one row of :func:`median_timings`. Counts are whole
    numbers, ratios have four places; unaligned texts and faces are named only where there are any.
    """
    def entry(metric: str, value: str, given: str = "true") -> str:
        return f"if({given}, named_struct('metric', '{metric}', 'value', cast({value} AS string)), NULL)"

    counts = ("pages", "pii", "seen", "caught", "partial", "category_right", "spans", "false_positives", "near_misses", "near_misses_hidden")
    ratios = ("recall", "recall_in_text", "precision", "iou", "over_redaction")
    entries = [entry(c, c) for c in counts] + [entry(c, f"cast(round({c}, 4) AS decimal(9,4))") for c in ratios]
    entries.append(entry("unaligned", "unaligned", "unaligned > 0"))
    if "faces_expected" in summary.columns:
        entries += [entry(c, c, "faces_expected > 0") for c in ("faces_expected", "faces_found")]

    def metrics(one: DataFrame, key: str, rows: list[str]) -> DataFrame:
        return one.selectExpr("'metrics' AS section", f"'{key}' AS key", f"inline(array_compact(array({', '.join(rows)})))")

    rows = metrics(summary, "all", entries)
    if timings is not None:
        rows = rows.unionByName(metrics(timings, "median ms", [entry(c.removesuffix("_ms"), f"round({c})") for c in timings.columns]))
    parts = by_category_and_place(items).selectExpr(
        "concat('by ', section) AS section", "key",
        f"inline(array({entry('caught', 'caught')}, {entry('pii', 'pii')}))",
    )
    return rows.unionByName(parts)


def full_report(items: DataFrame, texts: DataFrame, misses: DataFrame, pages: DataFrame | None = None, timings: DataFrame | None = None) -> DataFrame:
    """All sections of the report in one table, keys as text."""
    head = summary_sections(items, totals(items, texts, misses, pages), timings)
    return head.unionByName(report(items, texts, misses).withColumn("key", F.expr("cast(key AS string)")))


def compare_runs(summary: DataFrame, config: str, metrics: list[str]) -> DataFrame:
    """One column per run, one row per metric. The runs compared are few and named."""
    tall = summary.selectExpr(
        config, "inline(array(" + ", ".join(f"named_struct('metric', '{m}', 'value', cast({m} AS double))" for m in metrics) + "))"
    )
    return tall.groupBy("metric").pivot(config).agg(F.first("value"))


def item_levels(places: DataFrame, span_score: str) -> DataFrame:
    """Per item that stands somewhere: ``level``, the highest cutoff at which every place of it lies whole in one kept span; NULL if one never does.

    ``places`` as :func:`item_occurrences` gives them; ``span_score``: SQL of a span's score, with the span as ``span``.
    """
    h = fresh("h")
    whole = f"filter(touching, {h} -> {h}.start <= start AND {h}.end >= `end`)"
    scores = f"array_max(transform({whole}, span -> {span_score}))"
    each = places.selectExpr("page", "item_no", f"{scores} AS _score")
    return each.groupBy("page", "item_no").agg(F.expr("if(count(*) = count(_score), min(_score), NULL)").alias("level"))


def cutoff_sweep(spans: DataFrame, items: DataFrame, keys: list[str], cutoffs: list[float] | None = None, bucket: str = "floor(-score * 1000)") -> DataFrame:
    """``keys, score, spans, right, caught, pii, precision, recall``: what each cutoff on the score would keep, all in one pass.

    ``spans``: keys, score, private (whether it hides something of the truth). ``items``: keys, level (the highest
    cutoff at which the item is still hidden, NULL for never). Rows are counted per distinct score first; running
    counts from the highest score down are then what a run at each score finds, and only ``bucket`` of scores is in one
    task. Without ``cutoffs`` every score that occurs is one. A ratio without rows is 1; rows with a null score count nowhere.
    """
    rows = spans.where("score IS NOT NULL").selectExpr(*keys, "cast(score AS double) AS score", "1L AS spans", "cast(coalesce(private, false) AS bigint) AS right", "0L AS caught")
    hits = items.where("level IS NOT NULL").selectExpr(*keys, "cast(level AS double) AS score", "0L AS spans", "0L AS right", "1L AS caught")
    sums = ("spans", "right", "caught")
    counted = rows.unionByName(hits).groupBy(*keys, "score").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    one = counted.withColumn("_all", F.lit(1))  # a key even where the caller names none
    running = ordered(one, [*keys, "_all"], "-score", {c: ("sum", f"_{c}") for c in sums}, bucket).select(*keys, "score", *sums)
    if cutoffs is not None:
        asked = "array(" + ", ".join(f"{float(c)!r}D" for c in cutoffs) + ")"
        c = fresh("c")
        # Counts rise as the score falls: what a cutoff keeps is the most that any score from it on has counted.
        reached = running.selectExpr(*keys, f"explode(filter({asked}, {c} -> score >= {c})) AS cutoff", *sums).groupBy(*keys, "cutoff").agg(*[F.max(s).alias(s) for s in sums])
        configs = spans.select(*keys).unionByName(items.select(*keys)).distinct() if keys else spans.sparkSession.range(1).select()
        grid = configs.selectExpr(*keys, f"explode({asked}) AS cutoff")
        running = grid.join(reached, [*keys, "cutoff"], "left").selectExpr(*keys, "cutoff AS score", *[f"coalesce({s}, 0L) AS {s}" for s in sums])
    if keys:
        sized = running.join(items.groupBy(*keys).agg(F.count("*").alias("pii")), keys, "left")
    else:
        sized = running.crossJoin(items.agg(F.count("*").alias("pii")))  # one row
    return sized.selectExpr(
        *keys, "score", "spans", "right", "caught", "coalesce(pii, 0L) AS pii", "if(spans > 0, right / spans, 1D) AS precision",
        "if(coalesce(pii, 0L) > 0, caught / pii, 1D) AS recall",
    )
