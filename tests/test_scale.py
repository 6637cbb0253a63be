"""Operators at sizes where their plain form would not do, against that form."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from maskwright.functions import boxes as B
from maskwright.operators import boxes, score, traces


def _boxes(draw, n, number, **more):
    sizes = [(draw.choice([4, 9, 30, 31, 100, 333, 1000]), draw.choice([4, 10, 33, 90])) for _ in range(n)]
    return [
        {"view_id": draw.choice(["v", "v", "w"]), number: k, "role": draw.choice(["link", "button"]), "confidence": 0.5,
         "bbox": {"x": draw.uniform(-20, 900), "y": draw.uniform(-20, 900), "w": float(w * draw.uniform(0.8, 1.2)), "h": float(h)}} | {c: v(k) for c, v in more.items()}
        for k, (w, h) in enumerate(sizes)
    ]


BOX = "bbox struct<x:double,y:double,w:double,h:double>"


def test_grid_cells_lose_no_match(spark):
    draw = random.Random(4)
    words = ["total", "total due", "due", "pay", "pay now", ""]
    held = _boxes(draw, 700, "box_no", text=lambda k: draw.choice(words))
    moved = [r | {"ordinal": r["box_no"], "label": draw.choice(words), "bbox": {c: v + draw.uniform(-3, 3) for c, v in r["bbox"].items()}} for r in held]
    moved += _boxes(draw, 300, "ordinal", label=lambda k: draw.choice(words))
    moved = [r | {"ordinal": k} for k, r in enumerate(moved)]
    elements = spark.createDataFrame(moved, f"view_id string, ordinal int, role string, label string, {BOX}")
    seen = spark.createDataFrame(held, f"view_id string, box_no int, role string, confidence double, {BOX}")
    read = spark.createDataFrame([r | {"region_no": r["box_no"]} for r in held], f"view_id string, region_no int, text string, confidence double, {BOX}")
    rows = lambda f: sorted(map(tuple, f.collect()), key=repr)
    for above in (0.1, 0.3, 0.7):
        plain = elements.withColumnRenamed("bbox", "a").join(seen.withColumnRenamed("bbox", "b"), ["view_id", "role"])
        want = plain.withColumn("s", F.expr(B.match_score("a", "b"))).where(F.col("s") > above).groupBy("view_id", "ordinal").agg(F.expr("max_by(box_no, struct(s, -box_no))").alias("box_no"))
        got = boxes.best_boxes(elements, seen, above).selectExpr("view_id", "ordinal", "box.box_no AS box_no")
        assert rows(got) == rows(want) and want.count() > 100
    assert rows(boxes.best_regions(elements, read)) == rows(boxes.best_regions(elements, read, crowd=10_000))
    assert boxes.best_regions(elements, read).count() > 50


def test_a_crowded_view_compares_neighbours_only(spark):
    grid = spark.range(10_000).selectExpr(
        "'v' AS view_id", "cast(id AS int) AS ordinal", "cast(id AS int) AS box_no", "'link' AS role", "concat('row ', id) AS label", "0.5D AS confidence",
        "named_struct('x', (id % 100) * 20D, 'y', floor(id / 100) * 20D, 'w', 18D, 'h', 18D) AS bbox",
    )
    assert boxes.box_pairs(grid, grid).count() < 10_000 * 50
    assert boxes.best_boxes(grid, grid).where("box.box_no = ordinal").count() == 10_000
    read = grid.selectExpr("view_id", "box_no AS region_no", "concat(label, '!') AS text", "bbox", "confidence")
    assert boxes.best_regions(grid, read).where("region.region_no = ordinal").count() == 10_000


def test_flat_boxes_meet_by_their_height_too(spark):
    rows = spark.range(4000).selectExpr(
        "'v' AS view_id", "cast(id AS int) AS ordinal", "cast(id AS int) AS box_no", "'link' AS role", "0.5D AS confidence",
        "named_struct('x', 0D, 'y', id * 3D, 'w', 120D, 'h', 2D) AS bbox",
    )
    assert boxes.box_pairs(rows, rows).count() < 4000 * 10
    assert boxes.best_boxes(rows, rows).where("box.box_no = ordinal").count() == 4000


def test_stall_streaks_of_one_long_task(spark):
    draw = random.Random(5)
    steps = [("t", k, draw.random() < 0.2, draw.random() < 0.3) for k in range(3000)]
    steps = [(t, k, v, r and not v) for t, k, v, r in steps] + [("u", 0, None, None), ("u", 1, False, True)]
    want, count = [], {}
    for task, cycle, verified, again in steps:
        streak = 0 if verified else count.get(task, 0) + 1
        count[task] = max(streak - 1, 0) if again else streak
        want.append((task, cycle, streak, streak >= 3))
    frame = spark.createDataFrame(steps, "task_id string, cycle int, verified boolean, reverified boolean")
    for bucket in (None, "floor(cycle / 64)"):
        assert sorted(map(tuple, traces.stall_streak(frame, bucket).collect())) == sorted(want)


def test_a_sweep_is_one_run_per_cutoff(spark):
    draw = random.Random(6)
    spans = [(draw.choice("ab"), draw.choice([None, *(k / 20 for k in range(21))]), draw.random() < 0.6) for _ in range(400)]
    items = [(draw.choice("ab"), draw.choice([None, *(k / 20 for k in range(21))])) for _ in range(150)] + [("only items", 0.3)]
    cuts = [0.0, 0.35, 0.5, 0.99, 2.0]
    frames = spark.createDataFrame(spans, "config string, score double, private boolean"), spark.createDataFrame(items, "config string, level double")

    def run(config, cut):
        kept = [p for c, s, p in spans if c in config and s is not None and s >= cut]
        pii = [v for c, v in items if c in config]
        caught = sum(v is not None and v >= cut for v in pii)
        return (cut, len(kept), sum(kept), caught, len(pii), sum(kept) / len(kept) if kept else 1.0, caught / len(pii))

    got = score.cutoff_sweep(*frames, ["config"], cuts).collect()
    assert sorted(map(tuple, got)) == sorted((c, *run([c], cut)) for c in ("a", "b", "only items") for cut in cuts)
    every = score.cutoff_sweep(frames[0], frames[1], []).collect()
    scores = {s for _, s, _ in spans if s is not None} | {v for _, v in items if v is not None}
    assert sorted(map(tuple, every)) == sorted(run(["a", "b", "only items"], s) for s in scores)
    assert score.cutoff_sweep(frames[0].limit(0), frames[1].limit(0), [], [0.5]).collect() == [(0.5, 0, 0, 0, 0, 1.0, 1.0)]


def test_truth_documents_are_parsed_once(spark):
    from maskwright.plans import catalog

    plan = catalog.QUERIES["truth_tables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "schema_of_variant" not in plan


def test_pages_are_parsed_once_for_children(spark):
    from maskwright.plans import catalog

    plan = catalog.QUERIES["list_children"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan


def test_fitting_writes_out_only_changed_lines(spark):
    from maskwright.operators import budget
    from maskwright.plans import measures

    # Each stage that wrote all lines again held the line expression with its boxes once or more.
    plan = budget.fit(measures._requests(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(" {vision}") <= 6


def test_views_without_crowds_need_no_cells(spark):
    from maskwright.plans import catalog

    plan = catalog.QUERIES["fused_elements"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "inline" not in plan


def test_names_are_learned_once(spark):
    from maskwright.operators import names
    from maskwright.plans import catalog

    for name in ("hidden_paths", "private_names"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "min_by" not in plan
    urls = spark.createDataFrame([("a|1", "t", 2, "/u/jo-ray/x/jo.ray"), (None, "t", 2, "/jo_ray"), ("b", "t", 0, "/jo-ray"), ("c", "t", 2, None), ("", "v", 2, "")], "url_id string, task_id string, view_seq int, path_template string")
    known = spark.createDataFrame([("t", "jo ray", "NAME", 1)], "task_id string, key string, category string, known_from int")
    got = {r.url_id: r.path for r in names.hide_names_in_path(urls, known).collect()}
    assert got == {"a|1": "/u/{name}/x/{name}", None: "/{name}", "b": "/jo-ray", "": ""}


def test_truth_items_are_found_once(spark):
    from maskwright.plans import catalog

    for name in ("item_scores", "compared_runs"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan


def test_more_rows_get_more_tasks(spark, monkeypatch):
    from maskwright.operators import skew
    from maskwright.plans import catalog
    from maskwright.plans.derived import lines

    folder = "/root/testdata/sf0.001"
    want = sorted(map(tuple, catalog.QUERIES["inserted_lines"](spark, folder).collect()))
    monkeypatch.setattr(skew, "TASK_ROWS", 200)
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert lines(spark, folder).rdd.getNumPartitions() == -(-rows // 200)
    got = catalog.QUERIES["inserted_lines"](spark, folder)
    assert got.rdd.getNumPartitions() == -(-2 * rows // 200)
    assert sorted(map(tuple, got.collect())) == want


def _broadcasts(monkeypatch, *modules):
    """What is broadcast in the tables that these modules write on the way: for a given last one, lines of all plans."""
    plans = []
    for module in modules:
        def cut(df, f=module.cut_lineage):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return f(df)

        monkeypatch.setattr(module, "cut_lineage", cut)

    def grown(last):
        lines = "\n".join([*plans, last._jdf.queryExecution().executedPlan().toString()]).split("\n")
        # The hottest keys are broadcast, at most 512 of them.
        return sum("BroadcastExchange" in x for x in lines) - sum("TakeOrderedAndProject" in x for x in lines)

    return grown


def test_texts_and_tokens_are_not_broadcast(spark, monkeypatch):
    from maskwright.operators import vault
    from maskwright.plans import catalog

    grown = _broadcasts(monkeypatch, vault)
    for name in ("round_trip", "redacted_records", "resolved_values"):
        assert grown(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")) == 0


def test_names_and_views_are_not_broadcast(spark, monkeypatch):
    from maskwright.operators import names, vault
    from maskwright.plans import catalog

    grown = _broadcasts(monkeypatch, names, vault)
    for name in ("hidden_paths", "private_names", "private_views"):
        assert grown(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")) == 0, name


TURNS = ["leaks_after_redaction", "redacted_records", "tokens_in_play", "board_matches", "resolved_values", "round_trip"]


@pytest.mark.parametrize("name", TURNS)
def test_large_tables_take_turns_on_disk(spark, monkeypatch, name):
    from maskwright.operators import skew
    from maskwright.plans import catalog, measures
    from maskwright.session import shared_folder

    def run():
        before = {*Path(shared_folder(spark)).glob("maskwright-*")}
        return catalog.QUERIES[name](spark, "/root/testdata/sf0.001"), lambda: len({*Path(shared_folder(spark)).glob("maskwright-*")} - before)

    def rows(f):
        return sorted(map(tuple, f.collect()), key=repr)

    whole, _ = run()
    monkeypatch.setattr(skew, "TURN_ROWS", 700)
    monkeypatch.setattr(measures, "BOARD_ROWS", 3000)
    turned, left = run()
    assert left() == turned._jdf.queryExecution().optimizedPlan().toString().count("Relation [") > 1  # results of turns alone
    assert turned.dtypes == whole.dtypes and rows(turned) == rows(whole)


def test_a_turn_reads_and_detects_its_own_rows_alone(spark, monkeypatch):
    from maskwright.operators import skew, vault
    from maskwright.plans import catalog
    from maskwright import session

    plans = []
    for module in (session, vault):
        monkeypatch.setattr(module, "cut_lineage", lambda df, f=module.cut_lineage: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    monkeypatch.setattr(skew, "TURN_ROWS", 1000)
    catalog.QUERIES["redacted_records"](spark, "/root/testdata/sf0.001")
    detecting = [p for p in plans if "ArrowEvalPython" in p]
    assert len(detecting) == 2 and len(plans) == 6
    for plan in detecting:
        assert plan.index("ArrowEvalPython") < plan.index("pmod")


def test_values_are_counted_and_numbered_in_one_shuffle(spark, monkeypatch):
    from maskwright.operators import vault
    from maskwright.plans import catalog

    tables = []
    monkeypatch.setattr(vault, "cut_lineage", lambda df, f=vault.cut_lineage: tables.append(df) or f(df))
    catalog.QUERIES["redacted_records"](spark, "/root/testdata/sf0.001")
    tables[1].collect()
    plan = tables[1]._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


def test_a_turn_of_boards_takes_its_own_lines_alone(spark, monkeypatch):
    from maskwright.plans import catalog, measures

    plans = []
    monkeypatch.setattr(measures, "cut_lineage", lambda df, f=measures.cut_lineage: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    monkeypatch.setattr(measures, "BOARD_ROWS", 3000)
    catalog.QUERIES["board_matches"](spark, "/root/testdata/sf0.001")
    assert len(plans) > 1
    for plan in plans:
        assert plan.index("Window") < plan.index("pmod")
