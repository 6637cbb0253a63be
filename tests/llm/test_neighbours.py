import numpy as np
import pandas as pd
import pytest

from maskwright.llm import neighbours as op
from maskwright.llm.catalog import QUERIES
from tests.llm import frames

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string, id string"


def run(spark, rows, sample=op.SAMPLE, every=1):
    ready = op.usable(spark.createDataFrame([(i, v, 0, "?", "?") for i, v in rows], SCHEMA))
    index = op.fit(ready, sample)
    got = op.search(op.build(ready, index), index, ready.where(f"id % {every} = 0"))
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got.collect())


def plain(rows, every=1):
    out = []
    x = {i: np.array(np.array(v, np.float32), float) for i, v in rows}
    for q in (i for i in x if i % every == 0):
        near = sorted((-round(float(x[q] @ v / np.sqrt((x[q] @ x[q]) * (v @ v))), 9), i) for i, v in x.items() if i != q)
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near[:5])]
    return sorted(out)


def test_few_vectors_are_compared_with_all(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [2.0, 0.0]), (4, [-1.0, 0.0])]
    odd = [(5, None), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 1.0, 1.0]), (11, []), (None, [1.0, 0.0])]
    assert run(spark, rows + odd) == plain(rows)
    assert run(spark, rows[:1]) == [] and run(spark, odd[:2]) == [] and run(spark, []) == []


def test_ties_go_to_smaller_ids(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(100 + i, draw.normal(size=4).tolist()) for i in range(60)]
    assert [r for r in run(spark, rows) if r[0] < 40] == [r for r in plain(rows) if r[0] < 40]


def test_repeated_rows_take_one_place(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(8)]
    near = (100, rows[0][1])
    assert run(spark, [*rows, *[near] * 6], every=100) == plain([*rows, near], 100)
    assert run(spark, [*rows, *[rows[1]] * 6]) == plain(rows)
    ids, scores = op._best(np.array([1] * 6 + [2, 3]), np.array([0.9] * 3 + [0.5] * 3 + [0.4, 0.3]), 3)
    assert (ids.tolist(), scores.tolist()) == ([1, 2, 3], [0.9, 0.4, 0.3])


def test_recall(spark):
    folder = "/root/testdata/sf0.01"
    table = pd.read_parquet(f"{folder}/embeddings.parquet")
    rows = list(zip(table.vec_id.tolist(), table.embedding))
    want = {r[:1] + r[2:3] for r in plain(rows, 50)}
    got = {(r.query_id, r.vec_id) for r in QUERIES["op10_neighbours"](spark, folder).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_overlap_is_the_footrule():
    index = op.Index(np.random.default_rng(1).normal(size=(200, 8)), pivots=32, prefix=8)
    unit = op._unit(np.random.default_rng(2).normal(size=(50, 8)))
    prefixes = index.prefixes(unit)
    shared = index.overlap(prefixes[0], *index.posted(prefixes), 50)
    place = lambda p: {x: k for k, x in enumerate(p)}
    for k in range(50):
        a, b = place(prefixes[0]), place(prefixes[k])
        assert index.prefix * (index.prefix + 1) - 2 * shared[k] == pytest.approx(sum(abs(a.get(x, 8) - b.get(x, 8)) for x in {*a, *b}))


def test_empty_table(spark):
    assert op.usable(frames.empty(spark, SCHEMA)).count() == 0
