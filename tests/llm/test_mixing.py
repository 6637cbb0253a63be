import math

from maskwright.llm import mixing as op
from tests.llm import frames


def plain_targets(sizes):
    """``sizes``: source to size, in order."""
    total, level, held = sum(sizes.values()), 0.0, set()
    weights = {s: op.WEIGHTS[i % 3] for i, s in enumerate(sizes)}
    while True:
        free = [s for s in sizes if s not in held]
        level = (total - sum(3 * sizes[s] for s in held)) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in held else weights[s] * level for s in sizes}
        held |= over


def plain_multiplier(sizes, target):
    scale = sum(s * s for s in sizes) / sum(sizes)
    low, high = -2000.0, 2000.0
    for _ in range(300):
        mid = (low + high) / 2
        if sum(s * min(3.0, math.exp(min(50, mid * s / scale))) for s in sizes) > target:
            high = mid
        else:
            low = mid
    return low


def test_targets_rates_and_copies(spark):
    rows = [(i, frames.sentence(i, 1 + (i * 37) % 90), None, ["b", "a", None, "ä", "tiny"][0 if i % 3 == 0 else i % 4 + (i == 997)], 0) for i in range(1200)] + frames.ROWS
    docs = frames.documents(spark, rows)
    out, sources = op.balanced(op.sized(docs))
    got = out.collect()
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=repr) == sorted(((i, s, len(frames.words(t))) for i, t, _, s, _ in rows), key=repr)
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes.setdefault(source, []).append(len(frames.words(text)))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = plain_targets({s: sum(sizes[s]) for s in order})
    for row in sources.collect():
        assert abs(row.target - want[row.source]) < 1e-6 * (1 + row.target)
        taken = sum(r.copies * r["size"] for r in got if r.source == row.source)
        assert abs(taken - row.target) <= max(2, 0.001 * row.target, min(s for s in sizes[row.source] if s)), (row, taken)
    assert {r.copies for r in got} <= {0, 1, 2, 3}
    hist = op.histogram(op.sized(docs))
    solved = {r.key: r.multiplier for r in op.multipliers(hist, op.with_targets(op.source_sizes(hist))).collect()}
    for source in order:
        if 0 < want[source] < 3 * sum(sizes[source]):
            key = "-" if source is None else "+" + source
            assert abs(solved[key] - plain_multiplier([s for s in sizes[source] if s], want[source])) < 1e-5
    again, _ = op.balanced(op.sized(docs.repartition(7)))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))


def test_mixed_repeats_rows_with_all_columns(spark):
    docs = frames.documents(spark)
    copies, _ = op.balanced(op.sized(docs))
    taken = op.mixed(docs)
    assert taken.columns == docs.columns
    assert taken.count() == copies.selectExpr("sum(copies)").first()[0]


def test_empty_and_wordless_tables(spark):
    assert op.balanced(op.sized(frames.empty(spark)))[0].count() == 0
    assert op.mixed(frames.empty(spark)).count() == 0
    out, sources = op.balanced(op.sized(frames.documents(spark, [(1, None, None, "a", 0), (2, "", None, None, 0)])))
    assert {r.target for r in sources.collect()} == {0.0} and {r.copies for r in out.collect()} == {1}
