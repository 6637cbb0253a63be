"""Queries of boxes, study reports, model output and token budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import boxes as B
from maskwright.operators import boxes, budget, outputs, study
from maskwright.operators.skew import in_turns
from maskwright.plans import checks as C
from maskwright.plans.derived import LINES_SQL, lines, lines_of
from maskwright.plans.registry import query, table
from maskwright.session import cut_lineage

# --- boxes -----------------------------------------------------------------

_WHY = (
    "CASE WHEN role = 'image' AND trim(coalesce(label, '')) = '' THEN 'unlabelled-image' WHEN role = 'image' AND w >= 200 AND h >= 100 THEN 'large-image' END"
)


@query("pixel_reasons", f"SELECT * FROM (SELECT view_id, ordinal, {_WHY} AS reason FROM {LINES_SQL}) WHERE reason IS NOT NULL")
def pixel_reasons(spark, folder):
    return boxes.needs_pixels(lines(spark, folder)).select("view_id", "ordinal", "reason")


@query(
    "pixel_targets",
    f"""SELECT view_id, ordinal, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY w * h DESC, ordinal) AS rank
 FROM (SELECT *, {_WHY} AS reason FROM {LINES_SQL}) WHERE reason IS NOT NULL AND NOT offscreen AND w >= 60 AND h >= 20) WHERE rank <= 2""",
)
def pixel_targets(spark, folder):
    """The two largest regions worth reading on each view."""
    return boxes.pixel_targets(lines(spark, folder), 2).selectExpr("view_id", "ordinal", "cast(rank AS bigint) AS rank")


_INTER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_PAIR_SQL = f"""(SELECT a.view_id, a.ordinal AS a_no, b.ordinal AS b_no, a.role AS a_role, b.role AS b_role, {_INTER} AS inter, a.w * a.h AS area_a, b.w * b.h AS area_b,
 sqrt((a.x + a.w / 2 - b.x - b.w / 2) ** 2 + (a.y + a.h / 2 - b.y - b.h / 2) ** 2) AS dist, greatest(least(a.w, a.h), least(b.w, b.h), 1) AS scale
 FROM e a JOIN d b ON a.view_id = b.view_id)"""
# What a detector saw: every other element, a little moved.
_SEEN_SQL = f"(SELECT view_id, ordinal, role, x + 3 AS x, y + ordinal % 7 AS y, w, h, cast(0.5 + ordinal * 0.05 AS DOUBLE) AS confidence FROM {LINES_SQL} WHERE NOT offscreen)"


def _seen(frame):
    return frame.where("NOT offscreen").selectExpr(
        "view_id", "ordinal AS box_no", "role", "named_struct('x', x + 3, 'y', y + ordinal % 7, 'w', w, 'h', h) AS bbox",
        "cast(0.5 + ordinal * 0.05 AS double) AS confidence",
    )


@query(
    "box_matches",
    f"""WITH e AS {LINES_SQL}, d AS {_SEEN_SQL},
s AS (SELECT *, CASE WHEN inter > 0 AND area_a + area_b - inter > 0 THEN inter / (area_a + area_b - inter) WHEN dist <= scale * 0.75 THEN 0.1 ELSE 0 END AS score FROM {_PAIR_SQL} WHERE a_role = b_role)
SELECT view_id, a_no AS ordinal, arg_max(b_no, (score, -b_no)) AS box_no FROM s WHERE score > 0.3 GROUP BY view_id, a_no""",
)
def box_matches(spark, folder):
    """The best box of each element's own role."""
    frame = lines(spark, folder)
    return boxes.best_boxes(frame, _seen(frame)).selectExpr("view_id", "ordinal", "box.box_no AS box_no")


# Boards: the lines of two thousand orders on one large surface, so a view holds thousands of boxes.
_BOARD = {
    "view_id": "cast(floor(view_id / 2000) AS bigint)", "ordinal": "view_id * 100 + ordinal", "role": "role", "label": "label",
    "x": "x * 4 + view_id % 2000", "y": "y * 4", "w": "w / 4", "h": "h / 4",
}
_BOARD_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _BOARD.items()) + f" FROM {LINES_SQL} WHERE NOT offscreen)"


# Lines of a turn. They meet by cells some ten times over, so most of a turn is shuffle files.
BOARD_ROWS = 16_000_000


@query(
    "board_matches",
    f"""WITH e AS {_BOARD_SQL}, d AS (SELECT * REPLACE (x + 1 AS x, y + ordinal % 5 AS y) FROM {_BOARD_SQL}),
s AS (SELECT *, CASE WHEN inter > 0 AND area_a + area_b - inter > 0 THEN inter / (area_a + area_b - inter) ELSE 0 END AS score FROM {_PAIR_SQL} WHERE a_role = b_role)
SELECT view_id, a_no AS ordinal, arg_max(b_no, (score, -b_no)) AS box_no FROM s WHERE score > 0.3 GROUP BY view_id, a_no""",
)
def board_matches(spark, folder):
    """Boxes matched on crowded views: by grid cells."""
    def matched(rows):
        # Read for elements, boxes and crowds: numbered once.
        board = cut_lineage(lines_of(rows).where("NOT offscreen").selectExpr(*[f"{e} AS {c}" for c, e in _BOARD.items() if c != "label"]))
        elements = board.selectExpr("view_id", "ordinal", "role", "named_struct('x', x, 'y', y, 'w', w, 'h', h) AS bbox")
        seen = board.selectExpr("view_id", "ordinal AS box_no", "role", "named_struct('x', x + 1, 'y', y + ordinal % 5, 'w', w, 'h', h) AS bbox", "0.5D AS confidence")
        return boxes.best_boxes(elements, seen).selectExpr("view_id", "ordinal", "box.box_no AS box_no")

    return in_turns(table(spark, folder, "lineitem"), [_BOARD["view_id"].replace("view_id", "l_orderkey")], matched, BOARD_ROWS)


@query(
    "fused_elements",
    f"""WITH e AS {LINES_SQL}, d AS {_SEEN_SQL},
s AS (SELECT *, CASE WHEN inter > 0 AND area_a + area_b - inter > 0 THEN inter / (area_a + area_b - inter) WHEN dist <= scale * 0.75 THEN 0.1 ELSE 0 END AS score FROM {_PAIR_SQL} WHERE a_role = b_role),
m AS (SELECT view_id, a_no, arg_max(b_no, (score, -b_no)) AS b_no FROM s WHERE score > 0.3 GROUP BY ALL),
t AS (SELECT a.view_id, a.ordinal AS a_no, b.ordinal AS b_no, lower(a.label) AS own, lower(b.value) AS rd,
   {_INTER} AS inter, b.w * b.h AS area_b, a.w * a.h AS area_a FROM e a JOIN e b ON b.view_id = a.view_id WHERE a.label IS NOT NULL AND b.value IS NOT NULL),
u AS (SELECT *, CASE WHEN own = rd THEN 1 WHEN contains(own, rd) OR contains(rd, own) THEN 0.9 ELSE 0 END AS alike,
   CASE WHEN inter <= 0 OR area_b <= 0 THEN 0 WHEN inter / area_b >= 0.5 THEN inter / area_b ELSE inter / (area_a + area_b - inter) END AS wh FROM t),
r AS (SELECT view_id, a_no, arg_max(b_no, (alike * 0.7 + wh * 0.3, -b_no)) AS b_no FROM u WHERE alike >= 0.8 AND wh > 0 AND alike * 0.7 + wh * 0.3 > 0.8 GROUP BY ALL),
n AS (SELECT view_id, count(*) AS n FROM e GROUP BY 1),
al AS (SELECT d.*, row_number() OVER (PARTITION BY d.view_id ORDER BY d.ordinal) AS k FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.view_id = d.view_id AND m.b_no = d.ordinal))
SELECT e.view_id, 'e' || (e.ordinal + 1) AS id, e.role, CASE WHEN m.b_no IS NULL AND r.b_no IS NULL THEN e.source ELSE 'fused' END AS source,
  round(coalesce(0.5 + m.b_no * 0.05, CASE WHEN r.b_no IS NOT NULL THEN 0.7 END)::DOUBLE, 6) AS confidence
FROM e LEFT JOIN m ON m.view_id = e.view_id AND m.a_no = e.ordinal LEFT JOIN r ON r.view_id = e.view_id AND r.a_no = e.ordinal
UNION ALL SELECT al.view_id, 'e' || (n.n + al.k), al.role, 'vision', round(al.confidence, 6) FROM al JOIN n ON n.view_id = al.view_id""",
)
def fused_elements(spark, folder):
    frame = lines(spark, folder)
    regions = frame.where("value IS NOT NULL").selectExpr("view_id", "ordinal AS region_no", "value AS text", "bbox", "0.7D AS confidence")
    elements = frame.select("view_id", "ordinal", "id", "role", "label", "bbox", "source").withColumn("confidence", F.lit(None).cast("double"))
    fused = boxes.fuse(elements, _seen(frame), regions)
    return fused.select("view_id", "id", "role", "source", F.round("confidence", 6).alias("confidence"))


_NMS_IOU = "(greatest(0, least(x.x + x.w, k.x + k.w) - greatest(x.x, k.x)) * greatest(0, least(x.y + x.h, k.y + k.h) - greatest(x.y, k.y)))"


@query(
    "suppressed_boxes",
    f"""SELECT view_id AS image_id, s.no AS box_no FROM (SELECT view_id, unnest(list_reduce(
   list(list_value(struct_pack(no := ordinal, x := x, y := y, w := w, h := h)) ORDER BY confidence DESC, ordinal),
   lambda a, c: CASE WHEN len(list_filter(a, lambda k: CASE WHEN c[1].w * c[1].h + k.w * k.h - {_NMS_IOU.replace('x.x', 'c[1].x').replace('x.y', 'c[1].y').replace('x.w', 'c[1].w').replace('x.h', 'c[1].h')} > 0
     THEN {_NMS_IOU.replace('x.x', 'c[1].x').replace('x.y', 'c[1].y').replace('x.w', 'c[1].w').replace('x.h', 'c[1].h')} / (c[1].w * c[1].h + k.w * k.h - {_NMS_IOU.replace('x.x', 'c[1].x').replace('x.y', 'c[1].y').replace('x.w', 'c[1].w').replace('x.h', 'c[1].h')}) ELSE 0 END > 0.2)) > 0
     THEN a ELSE list_concat(a, c) END)) AS s
 FROM (SELECT *, cast((ordinal * 37 % 11) / 11.0 AS DOUBLE) AS confidence FROM {LINES_SQL}) WHERE confidence > 0.15 GROUP BY view_id)""",
)
def suppressed_boxes(spark, folder):
    found = lines(spark, folder).selectExpr("view_id AS image_id", "ordinal AS box_no", "bbox", "cast((ordinal * 37 % 11) / 11.0 AS double) AS confidence")
    return boxes.suppress(found, overlap=0.2).select("image_id", "box_no")


@query(
    "inserted_lines",
    f"""WITH e AS {LINES_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY ordinal) AS k FROM e WHERE value IS NOT NULL AND source = 'dom'),
n AS (SELECT view_id, count(*) AS n FROM e GROUP BY 1),
b AS (SELECT view_id, 'e' || (ordinal + 1) AS id, ordinal AS at_, -1 AS ln, label FROM e UNION ALL SELECT g.view_id, 'e' || (n.n + k), g.ordinal, 0, g.value FROM g JOIN n ON n.view_id = g.view_id)
SELECT view_id, id, label, CAST(row_number() OVER (PARTITION BY view_id ORDER BY at_, ln) - 1 AS BIGINT) AS ordinal FROM b""",
)
def inserted_lines(spark, folder):
    """Lines read from pixels, put after the element they were read from."""
    frame = lines(spark, folder)
    read = frame.where("value IS NOT NULL AND source = 'dom'").selectExpr("view_id", "id AS target_id", "0 AS line_no", "value AS text", "bbox", "0.8D AS confidence")
    both = boxes.insert_lines(frame.select("view_id", "ordinal", "id", "role", "label", "bbox", "source"), read, rows=2 * table(spark, folder, "lineitem").count())
    return both.selectExpr("view_id", "id", "label", "cast(ordinal AS bigint) AS ordinal")


@query(
    "face_counts",
    f"SELECT view_id, CAST(count(*) AS BIGINT) AS faces FROM {LINES_SQL} WHERE role = 'image' AND w >= 32 AND h >= 32 GROUP BY view_id",
)
def face_counts(spark, folder):
    return boxes.face_counts(lines(spark, folder).where("role = 'image'").selectExpr("view_id", "w AS region_w", "h AS region_h"))


@query(
    "read_lines",
    f"SELECT view_id, ordinal, 'line ' || coalesce(label, '') AS text, w, h, ordinal / 100 AS confidence FROM {LINES_SQL}".replace("'line ' || coalesce(label, '')", "trim('line ' || coalesce(label, ''))"),
)
def read_lines(spark, folder):
    words = lines(spark, folder).selectExpr(
        "view_id", "ordinal", "x AS x0", "y AS y0", "x + w AS x1", "y + h AS y1", "concat(' line  ', coalesce(label, '')) AS text", "ordinal AS confidence"
    )
    return boxes.ocr_lines(words).selectExpr("view_id", "ordinal", "text", "bbox.w AS w", "bbox.h AS h", "confidence")


@query(
    "redacted_regions",
    f"""SELECT view_id, category, CAST(count(*) AS BIGINT) AS n, round(sum(w * h), 3) AS area FROM (
 SELECT view_id, 'FACE' AS category, w, h FROM {LINES_SQL} WHERE role = 'image' UNION ALL SELECT view_id, 'OTHER', w, h FROM {LINES_SQL} WHERE source = 'vision') GROUP BY ALL""",
)
def redacted_regions(spark, folder):
    frame = lines(spark, folder)
    faces = frame.where("role = 'image'").selectExpr("view_id", "bbox", "0.9D AS confidence")
    spans = frame.where("source = 'vision'").selectExpr("view_id", "bbox", "'OTHER' AS category", "'vision' AS source", "0.5D AS confidence")
    return boxes.redacted_regions(faces, spans).groupBy("view_id", "category").agg(
        F.count("*").alias("n"), F.expr("round(sum(bbox.w * bbox.h), 3)").alias("area")
    )


@query(
    "changed_frames",
    """SELECT event_id, coalesce(props <> lag(props) OVER (PARTITION BY event_type ORDER BY ts), true) AS changed,
 user_id % 3 = 0 OR coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) >= 1000000, true) AS capture FROM events""",
)
def changed_frames(spark, folder):
    """Frames per source (five sources hold everything), cut by the hour so no source is one task."""
    frames = table(spark, folder, "events").selectExpr(
        "event_id", "event_type AS source_id", "cast(ts AS timestamp) AS at", "props AS content", "if(user_id % 3 = 0, 1, 0) AS mutations"
    )
    return boxes.frame_changed(frames, "cast(floor(unix_seconds(at) / 3600) AS bigint)").select("event_id", "changed", "capture")


@query(
    "box_maths",
    f"""WITH e AS {LINES_SQL}, d AS {_SEEN_SQL}
SELECT view_id, a_no, round(max(CASE WHEN area_a + area_b - inter > 0 THEN inter / (area_a + area_b - inter) ELSE 0 END), 6) AS best_iou, round(min(dist), 6) AS nearest FROM {_PAIR_SQL} WHERE a_role = b_role GROUP BY view_id, a_no""",
)
def box_maths(spark, folder):
    frame = lines(spark, folder)
    pairs = frame.selectExpr("view_id", "ordinal AS a_no", "role", "bbox AS a").join(
        _seen(frame).selectExpr("view_id", "role", "bbox AS b"), ["view_id", "role"]
    )
    return pairs.groupBy("view_id", "a_no").agg(
        F.expr(f"round(max({B.iou('a', 'b')}), 6)").alias("best_iou"), F.expr(f"round(min({B.centre_distance('a', 'b')}), 6)").alias("nearest")
    )


# --- study -------------------------------------------------------------------

@query(
    "floor_percentiles",
    """SELECT event_type AS model, v[1 + least(len(v) - 1, floor(0.5 * len(v)))::BIGINT] AS p50, v[1 + least(len(v) - 1, floor(0.9 * len(v)))::BIGINT] AS p90, CAST(len(v) AS BIGINT) AS n
FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY 1)""",
)
def floor_percentiles(spark, folder):
    """p50 and p90 per model: five groups hold everything, none is ever gathered."""
    calls = table(spark, folder, "events").selectExpr("event_type AS model", "value")
    return study.percentile_floor(calls, ["model"], "value", {"p50": 0.5, "p90": 0.9})


@query("median_timings", "SELECT event_type AS stage, round(median(value), 6) AS median, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def median_timings(spark, folder):
    samples = table(spark, folder, "events").selectExpr("event_type AS stage", "value")
    return study.median(samples, ["stage"], "value").withColumn("median", F.round("median", 6))


_RUN = {
    "study": "event_type", "provider": "CASE WHEN event_type IN ('view', 'click') THEN 'groq' WHEN event_type = 'error' THEN 'nvidia' ELSE 'ollama' END",
    "task": "'t' || cast(user_id % 6 AS string)", "passed": "user_id % 3 <> 0", "ended_right": "user_id % 4 <> 0", "overreach": "user_id % 11 = 0",
    "refused": "user_id % 2", "leaked": "CASE WHEN user_id % 50 = 0 THEN 1 ELSE 0 END", "steps": "user_id % 9 + 1", "unverified": "user_id % 4", "rate_limit_waits": "user_id % 3",
}
_RUN_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in _RUN.items()) + ", value AS latency_ms, CASE WHEN event_id % 10 > 0 THEN 1000 + user_id END AS prompt_tokens, CASE WHEN event_id % 10 > 0 THEN user_id END AS completion_tokens FROM events)"


def _runs(spark, folder):
    return table(spark, folder, "events").selectExpr(*[f"{v} AS {k}" for k, v in _RUN.items()], "if(user_id % 5 = 0, array('x'), array()) AS errors")


@query(
    "study_report",
    f"""WITH r AS {_RUN_SQL},
a AS (SELECT study, any_value(provider) AS provider, count(*) AS runs, count(*) FILTER (passed) AS passed, count(*) FILTER (ended_right) AS ended_right, count(*) FILTER (overreach) AS overreach,
  sum(refused) AS refused, sum(leaked) AS leaks, avg(steps) FILTER (passed) AS steps_when_passed, avg(unverified) AS wasted, sum(rate_limit_waits) AS waits,
  avg(prompt_tokens) AS pt, avg(completion_tokens) AS ct, list(latency_ms ORDER BY latency_ms) AS v FROM r GROUP BY study),
l AS (SELECT 'groq' AS provider, 30.0 AS pm, 1000.0 AS pd, 7000.0 AS itpm, 8000.0 AS tpm UNION ALL SELECT 'nvidia', 40.0, NULL, NULL, NULL UNION ALL SELECT 'ollama', NULL, NULL, NULL, NULL),
j AS (SELECT a.*, CASE WHEN a.provider = 'ollama' THEN NULL ELSE least(pm, itpm / pt, tpm / (pt + ct)) END AS spm, pd FROM a JOIN l ON l.provider = a.provider)
SELECT study, CAST(runs AS BIGINT) AS runs, CAST(passed AS BIGINT) AS passed, CAST(ended_right AS BIGINT) AS ended_right, CAST(overreach AS BIGINT) AS overreach, CAST(refused AS BIGINT) AS refused, CAST(leaks AS BIGINT) AS leaks,
 round(steps_when_passed, 6) AS steps_when_passed, round(wasted, 6) AS wasted, round(v[1 + least(runs - 1, floor(0.5 * runs))::BIGINT] / 1000, 6) AS p50, round(v[1 + least(runs - 1, floor(0.9 * runs))::BIGINT] / 1000, 6) AS p90,
 round(pt, 6) AS prompt_tokens, round(ct, 6) AS completion_tokens, CAST(waits AS BIGINT) AS waits, round(spm, 6) AS steps_per_minute, round(pd::DOUBLE, 6) AS tasks_per_day,
 round(least(spm * 60, 3600 / greatest(v[1 + least(runs - 1, floor(0.5 * runs))::BIGINT] / 1000, 0.1)), 6) AS tasks_per_hour FROM j""",
)
def study_report(spark, folder):
    events = table(spark, folder, "events")
    calls = events.selectExpr(
        "event_type AS study", "value AS latency_ms", "0 AS repairs", "if(event_id % 10 > 0, 1000 + user_id, NULL) AS prompt_tokens",
        "if(event_id % 10 > 0, user_id, NULL) AS completion_tokens",
    )
    # What each provider's free tier allows.
    limits = spark.sql(
        "SELECT * FROM VALUES ('groq', 30D, 1000D, 7000D, 8000D), ('nvidia', 40D, NULL, NULL, NULL), ('ollama', NULL, NULL, NULL, NULL) "
        "AS t(provider, per_minute, per_day, input_tokens_per_minute, tokens_per_minute)"
    )
    done = study.study_report(_runs(spark, folder), calls, limits).drop("repairs", "errors")
    decimals = ("steps_when_passed", "wasted", "p50", "p90", "prompt_tokens", "completion_tokens", "steps_per_minute", "tasks_per_day", "tasks_per_hour")
    return done.withColumns({c: F.round(c, 6) for c in decimals})


_TASKS = [f"t{i}" for i in range(7)]


@query(
    "passes_by_task",
    "SELECT study, " + ", ".join(
        f"CASE WHEN count(*) FILTER (task = '{t}') = 0 THEN '-' ELSE count(*) FILTER (task = '{t}' AND passed) || '/' || count(*) FILTER (task = '{t}') END AS {t}" for t in _TASKS
    ) + f" FROM {_RUN_SQL} GROUP BY study",
)
def passes_by_task(spark, folder):
    return study.passes_by_task(_runs(spark, folder), _TASKS)


@query(
    "stage_summary",
    """WITH r AS (SELECT event_type AS stage, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)
SELECT stage, round(v[1 + least(len(v) - 1, floor(0.5 * len(v)))::BIGINT], 2) AS p50, round(v[1 + least(len(v) - 1, floor(0.95 * len(v)))::BIGINT], 2) AS p95, CAST(len(v) AS BIGINT) AS n
FROM (SELECT stage, list(value ORDER BY value) AS v FROM r GROUP BY 1)""",
)
def stage_summary(spark, folder):
    """The latest 500 samples, per stage."""
    return study.stage_summary(table(spark, folder, "events").selectExpr("event_type AS stage", "value AS ms", "ts AS at", "event_id AS seq"))


_LOG_LINE = (
    "CASE user_id % 4 WHEN 0 THEN '[plan] x -> provider_error after ' || cast(event_id AS string) || ' ms: No reply' "
    "WHEN 1 THEN 'provider said: on tokens per day (TPD): Limit 200000, used ' || cast(event_id AS string) WHEN 2 THEN 'waiting 2 s as it asked' ELSE 'fine' END"
)


@query(
    "error_counts",
    """SELECT event_type AS study, CASE user_id % 4 WHEN 0 THEN 'provider_error: No reply' WHEN 1 THEN 'limit hit: tokens per day (TPD), 200000' ELSE 'short rate limit, waited out by the server' END AS error,
 CAST(count(*) AS BIGINT) AS n FROM events WHERE user_id % 4 < 3 GROUP BY ALL""",
)
def error_counts(spark, folder):
    return study.error_counts(table(spark, folder, "events").selectExpr("event_type AS study", f"{_LOG_LINE} AS line"))


@query(
    "run_records",
    """SELECT event_type AS study, user_id % 6 AS task, user_id % 5 AS repeat, CAST(count(*) FILTER (event_id % 3 = 0 AND user_id % 2 = 0) AS BIGINT) AS unverified,
 CAST(count(*) FILTER (event_id % 3 = 1) AS BIGINT) AS rate_limit_waits, CAST(count(*) FILTER (event_id % 3 = 2) AS BIGINT) AS errors,
 round(max(epoch_us(ts)) / 1000000.0 - min(epoch_us(ts)) / 1000000.0 - sum(CASE WHEN event_id % 3 = 1 THEN 15000 ELSE 0 END) / 1000.0, 3) AS seconds FROM events GROUP BY ALL""",
)
def run_records(spark, folder):
    seen = table(spark, folder, "events").selectExpr(
        "event_type AS study", "user_id % 6 AS task", "user_id % 5 AS repeat",
        "CASE event_id % 3 WHEN 0 THEN 'acted' WHEN 1 THEN 'rate_limited' ELSE 'error' END AS type", "user_id % 2 = 1 AS verified",
        "if(event_id % 3 = 1, 15000, NULL) AS wait_ms", "unix_micros(cast(ts AS timestamp)) / 1000000 AS ts",
    )
    return study.run_records(seen).withColumn("seconds", F.round("seconds", 3))


_SOURCE = (
    "'const a = 1; // localStorage' || chr(10) || '/* sentry' || chr(10) || 'gtag */ ' || CASE WHEN doc_id % 2 = 0 THEN 'console.log(' || cast(doc_id AS string) || ')' ELSE 'log.info()' END "
    "|| chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'localStorage.x = \"https://h.example\"' ELSE '' END || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'import posthog' ELSE '' END || chr(10) || coalesce(text, '')"
)
# A rule of its own for what real texts hold.
_TEXT_RULES = (*study.SOURCE_RULES, ("no-address", "^src/", r"[A-Za-z0-9]@[A-Za-z0-9]"))


@query(
    "rule_hits",
    f"""WITH f AS (SELECT doc_id, string_split(regexp_replace(regexp_replace({_SOURCE}, '/\\*[\\s\\S]*?\\*/', '', 'g'), '(?m)(^|[^:])//.*$', '\\1', 'g'), chr(10)) AS ls FROM documents),
 l AS (SELECT doc_id, unnest(ls) AS t, unnest(range(1, len(ls) + 1)) AS line FROM f)
 SELECT 'src/lib/f' || doc_id || '.ts' AS file, CAST(line AS BIGINT) AS line, r.rule FROM l
 JOIN (VALUES {', '.join(f"('{n}', {C.sq(p)})" for n, _, p in _TEXT_RULES)}) r(rule, pattern) ON regexp_matches(l.t, r.pattern)""",
)
def rule_hits(spark, folder):
    """Source rules over one file per document with its whole text in it, comments stripped first."""
    files = table(spark, folder, "documents").selectExpr("'src/lib/f' || cast(doc_id AS string) || '.ts' AS file", f"{_SOURCE} AS source")
    return study.rule_scan(files, _TEXT_RULES).selectExpr("file", "cast(line AS bigint) AS line", "rule")


# --- model output ------------------------------------------------------------

_ONE = "'{\"type\":\"click\",\"target\":\"e' || cast(user_id AS string) || '\"}'"
_REPLY = (
    f"CASE event_id % 8 WHEN 0 THEN {_ONE} WHEN 1 THEN '<think>{{\"x\"' || chr(10) || '}}</think> Sure: ' || {_ONE} || ' ok?' "
    f"WHEN 2 THEN '[' || {_ONE} || ',{{\"type\":\"wait\",\"ms\":5}},{{\"type\":\"wait\",\"ms\":\"no\"}},{{\"type\":\"wait\",\"ms\":6}}]' "
    f"WHEN 3 THEN '{{\"actions\":[{{\"type\":\"wait\",\"ms\":1}},' || {_ONE} || ',{{\"type\":\"done\",\"summary\":\"s\",\"success\":true}},' || {_ONE} || ']}}' "
    f"WHEN 4 THEN '{{\"type\":\"wait\",\"ms\":1,\"then\":[' || {_ONE} || ',' || {_ONE} || ',' || {_ONE} || ',' || {_ONE} || ',' || {_ONE} || ',' || {_ONE} || ',' || {_ONE} || ']}}' "
    f"WHEN 5 THEN '{{\"type\":\"done\",\"summary\":\"s\",\"success\":true,\"then\":[' || {_ONE} || ']}}' WHEN 6 THEN 'no json here' ELSE '{{\"type\":\"fly\"}}' END"
).replace("{{", "{").replace("}}", "}")


@query(
    "parsed_replies",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'click' WHEN 1 THEN 'click' WHEN 2 THEN 'click' WHEN 3 THEN 'wait' WHEN 4 THEN 'wait' WHEN 5 THEN 'done' END AS action_type,
 CASE WHEN event_id % 8 IN (0, 1, 2) THEN 'e' || user_id END AS target, CAST(CASE event_id % 8 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 6 ELSE 0 END AS BIGINT) AS followups,
 CASE event_id % 8 WHEN 6 THEN 'No JSON' WHEN 7 THEN 'The JSON' END AS error FROM events""",
)
def parsed_replies(spark, folder):
    """Replies as models write them: bare, wrapped in prose or thinking, as lists, with good and bad follow-ups."""
    replies = table(spark, folder, "events").selectExpr("event_id", f"{_REPLY} AS raw").selectExpr("event_id", f"{outputs.parse_output('raw')} AS p")
    return replies.selectExpr(
        "event_id", "get_json_object(p.action, '$.type') AS action_type", "get_json_object(p.action, '$.target') AS target",
        "cast(size(p.then) AS bigint) AS followups", "regexp_extract(p.error, '^(No|The) JSON', 0) AS error",
    )


@query(
    "rendered_steps",
    """SELECT event_id, CAST(event_id % 20 + 1 AS VARCHAR) || '. ' || CASE event_type WHEN 'view' THEN '{"type":"wait"}' WHEN 'signup' THEN '{"type":"click","target":"e1"}' ELSE '{"note":"no \\"reason\\":\\"x\\"","type":"go"}' END
 || ' -> ' || CASE WHEN user_id % 2 = 0 THEN 'verified' ELSE 'NOT verified: n' END AS step,
 CASE WHEN user_id % 3 = 0 THEN '' ELSE 'Blacked-out image regions: ' || array_to_string(list_transform(range(user_id % 3), lambda i: CASE WHEN i = 0 THEN 'FACE' ELSE 'CARD' END || ' at [' || (user_id + i) || ',2,3.5,4]'), '; ') || chr(10) END AS regions FROM events""",
)
def rendered_steps(spark, folder):
    """History lines without the reasons of their actions, and the line on hidden image regions."""
    action = """CASE event_type WHEN 'view' THEN '{"reason":"why \\\\"so\\\\"","type":"wait"}' WHEN 'signup' THEN '{"type":"click","reason":"r","target":"e1"}' ELSE '{"note":"no \\\\"reason\\\\":\\\\"x\\\\"","type":"go","reason":"last"}' END"""
    steps = table(spark, folder, "events").selectExpr(
        "event_id", f"named_struct('action', {action}, 'verified', user_id % 2 = 0, 'note', if(user_id % 2 = 0, NULL, 'n')) AS s",
        "transform(slice(array(0, 1), 1, cast(user_id % 3 AS int)), i -> named_struct('category', if(i = 0, 'FACE', 'CARD'), 'bbox', named_struct('x', cast(user_id + i AS double), 'y', 2D, 'w', 3.5D, 'h', 4D))) AS regions",
    )
    return steps.selectExpr("event_id", budget.render_step("s", "cast(event_id % 20 + 1 AS string)") + " AS step", budget.render_regions("regions") + " AS regions")


@query(
    "usage_totals",
    "SELECT cast(floor(event_id / 3) AS BIGINT) AS step_id, CAST(sum(user_id) AS BIGINT) AS prompt_tokens, CAST(sum(user_id % 7) AS BIGINT) AS completion_tokens, CAST(count(*) - 1 AS BIGINT) AS repairs FROM events GROUP BY 1",
)
def usage_totals(spark, folder):
    turns = table(spark, folder, "events").selectExpr("cast(floor(event_id / 3) AS bigint) AS step_id", "user_id AS prompt_tokens", "user_id % 7 AS completion_tokens")
    return outputs.usage_totals(turns, ["step_id"])


_HEADER = "CASE user_id % 4 WHEN 0 THEN cast(user_id AS string) || '.5' WHEN 1 THEN ' ' WHEN 2 THEN 'soon' END"
_BODY = "CASE event_id % 3 WHEN 0 THEN 'Please Try again in ' || cast(user_id AS string) || 'm2.25s.' WHEN 1 THEN 'try again in 7.5s' ELSE 'later' END"


@query(
    "retry_waits",
    f"""SELECT event_id, CAST(CASE WHEN user_id % 4 = 0 THEN user_id * 1000 + 500 WHEN event_id % 3 = 0 THEN user_id * 60000 + 2250 WHEN event_id % 3 = 1 THEN 7500 END AS BIGINT) AS wait_ms FROM events""",
)
def retry_waits(spark, folder):
    calls = table(spark, folder, "events").selectExpr("event_id", f"{_HEADER} AS header", f"{_BODY} AS body")
    return calls.selectExpr("event_id", f"{outputs.retry_after_ms('header', 'body')} AS wait_ms")


@query(
    "next_providers",
    """WITH r AS (SELECT CASE user_id % 2 WHEN 0 THEN 'groq' ELSE 'nvidia' END AS provider, epoch_ms(ts) AS from_ms, epoch_ms(ts) + coalesce(CASE WHEN user_id % 3 > 0 THEN 900000 END, 60000) AS until FROM events WHERE event_type = 'error'),
c AS (SELECT event_id AS call_id, epoch_ms(ts) AS at_ms FROM events WHERE event_type <> 'error'),
m AS (SELECT c.call_id, p.provider, p.position, coalesce((SELECT arg_max(until, (from_ms, until)) FROM r WHERE r.provider = p.provider AND r.from_ms <= c.at_ms), 0) <= c.at_ms AS awake
      FROM c, (SELECT unnest(['groq', 'nvidia', 'ollama']) AS provider, unnest([0, 1, 2]) AS position) p WHERE p.provider <> 'ollama'),
f AS (SELECT call_id, arg_min(provider, position) FILTER (awake) AS provider FROM m GROUP BY 1)
SELECT call_id, coalesce(provider, 'groq') AS provider, provider IS NULL AS all_resting FROM f""",
)
def next_providers(spark, folder):
    """Which of two providers each call would go to, given who was resting then."""
    events = table(spark, folder, "events")
    at = "unix_millis(cast(ts AS timestamp))"
    rests = events.where("event_type = 'error'").selectExpr(
        "if(user_id % 2 = 0, 'groq', 'nvidia') AS provider", f"{at} AS from_ms", "if(user_id % 3 > 0, 900000, NULL) AS retry_after_ms"
    )
    calls = events.where("event_type <> 'error'").selectExpr("event_id AS call_id", f"{at} AS at_ms")
    return outputs.next_provider(calls, rests, ["groq", "nvidia"])


# --- budgets -------------------------------------------------------------------

@query("estimated_tokens", "SELECT doc_id, CAST(ceil(200 / 3.7 + length(text) / 2.8) AS BIGINT) + 20 AS tokens FROM documents")
def estimated_tokens(spark, folder):
    return table(spark, folder, "documents").selectExpr("doc_id", f"{budget.estimate_tokens('200', 'length(text)')} AS tokens")


_CUT = "CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 55) || '<PII:EMAIL:12>' || text ELSE text END"


@query(
    "cut_texts",
    f"""WITH s AS (SELECT doc_id, {_CUT} AS t FROM documents),
e AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND length(t) > 60 AND instr(t, '<PII:EMAIL:12>') - 1 < 60 AND instr(t, '<PII:EMAIL:12>') + 13 > 60 THEN instr(t, '<PII:EMAIL:12>') + 13 ELSE 60 END AS e FROM s),
p AS (SELECT *, substr(t, 1, e + 1) AS head FROM e),
q AS (SELECT *, CASE WHEN e < length(t) AND contains(head, ' ') AND length(head) - instr(reverse(head), ' ') > 36 THEN length(head) - instr(reverse(head), ' ') ELSE e END AS stop FROM p)
SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE regexp_replace(substr(t, 1, stop), '[ \\n\\t\\r]+\\z', '') || '…' END AS cut FROM q""",
)
def cut_texts(spark, folder):
    """Texts cut to about 60 characters, at a word and never inside a token."""
    texts = table(spark, folder, "documents").selectExpr("doc_id", f"{_CUT} AS t")
    return texts.selectExpr("doc_id", f"{budget.cut_text('t', 60)} AS cut")


def _requests(spark, folder):
    """One request per order: its lines are the elements; sizes and budgets vary with the order."""
    packed = lines(spark, folder).groupBy("view_id").agg(
        F.expr(
            "transform(array_sort(collect_list(struct(ordinal, id, role, label, value, bbox, state, source))), x -> named_struct('id', x.id, 'role', x.role, "
            "'label', repeat(x.label, 9), 'value', x.value, 'hint', cast(NULL AS string), 'bbox', x.bbox, 'state', x.state, 'source', x.source))"
        ).alias("elements")
    )
    return packed.selectExpr(
        "view_id", "'Find order ' || cast(view_id AS string) AS goal", "'Orders \"all\"' AS title", "'https://shop.example' AS origin", "'/o/{id}' AS path_template",
        "view_id % 2 = 0 AS has_query", "800D AS vw", "600D AS vh", "elements", "0 AS above", "0 AS below", "array('<PII:NAME:1>') AS tokens",
        "map('total', 'x' || cast(view_id AS string)) AS known_values",
        "transform(sequence(1, 5), i -> named_struct('action', '{\"type\":\"wait\",\"ms\":' || cast(i AS string) || '}', 'verified', i % 2 = 0, 'note', if(i = 3, NULL, repeat('changed ', i)))) AS history",
        "cast(200 + view_id % 5 * 80 AS bigint) AS budget", "100 AS system_chars",
    )


@query("fitted_requests")
def fitted_requests(spark, folder):
    """Requests within their budgets; tested against a plain one-at-a-time trimming in the tests."""
    fitted = budget.fit(_requests(spark, folder))
    return fitted.selectExpr(
        "view_id", "trimmed", "shortened", "left_out", "notes_dropped", "size(elements) AS elements", "above", "below",
        f"length({budget.render_request('trimmed')}) AS chars",
    )


@query(
    "rendered_elements",
    f"""SELECT view_id, ordinal, 'e' || (ordinal + 1) || ' ' || role || coalesce(' "' || label || '"', '') || CASE WHEN value IS NOT NULL AND value IS DISTINCT FROM label THEN ' = "' || value || '"' ELSE '' END
 || ' [' || CAST(x AS BIGINT) || ',' || CAST(y AS BIGINT) || ',' || CAST(w AS BIGINT) || ',' || CAST(h AS BIGINT) || ']' || CASE WHEN offscreen THEN ' (offscreen)' ELSE '' END || CASE WHEN source = 'vision' THEN ' {{vision}}' ELSE '' END AS line FROM {LINES_SQL}""",
)
def rendered_elements(spark, folder):
    rows = lines(spark, folder).selectExpr(
        "view_id", "ordinal", "named_struct('id', id, 'role', role, 'label', label, 'value', value, 'hint', cast(NULL AS string), 'bbox', bbox, 'state', state, 'source', source) AS e"
    )
    return rows.selectExpr("view_id", "ordinal", f"{budget.render_element('e')} AS line")


@query(
    "view_distances",
    f"""SELECT view_id, ordinal, role = 'button' AS control, y + h > 0 AND y < 600 AS in_view, CASE WHEN y + h <= 0 THEN -(y + h) WHEN y >= 600 THEN y - 600 ELSE 0 END AS distance FROM {LINES_SQL}""",
)
def view_distances(spark, folder):
    rows = lines(spark, folder).selectExpr("view_id", "ordinal", "named_struct('role', role, 'state', state, 'bbox', bbox) AS e")
    return rows.selectExpr(
        "view_id", "ordinal", f"{budget.is_control('e')} AS control", f"{budget.in_view('e', '600')} AS in_view", f"{budget.distance_from_view('e', '600')} AS distance"
    )
