import math
from collections import Counter

import pytest
import xxhash

from maskwright.llm import sharding as op
from tests.llm import frames


def plain_shard(key, tree, path=""):
    """The descent, one row at a time."""
    def draw(name, node):
        seed = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42) if key is not None else 42
        u = ((xxhash.xxh64_intdigest(f"{path}/{name}".encode(), seed) >> 11) + 1) / 2**53
        return math.log(u) / op.weight(node)

    nodes = [(n, x) for n, x in tree.items() if op.weight(x) > 0]
    name, node = max(nodes, key=lambda n: draw(*n)) if len(nodes) > 1 else nodes[0]
    return plain_shard(key, node, f"{path}/{name}") if isinstance(node, dict) else name


def test_places_slots_and_growth(spark):
    rows = frames.ROWS + [(i, f"text {i % 5}", None, None, 0) for i in range(1000, 4000)]
    more = op.grown(op.TREE, 8)
    out = op.assigned(frames.documents(spark, rows), op.TREE, more).collect()
    assert len(out) == len(rows)
    assert all(r.shard == plain_shard(r.doc_id, op.TREE) and r.grown_shard == plain_shard(r.doc_id, more) for r in out)
    assert all(r.grown_shard in (r.shard, 8) for r in out) and any(r.grown_shard == 8 for r in out)
    for shard in range(8):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots))) and abs(len(slots) / len(out) - 1 / 8) < 0.03
    assert {r["size"] for r in out if r.doc_id == 2} == {1} and {r.text_crc32 for r in out if r.doc_id == 2} == {0}


def test_a_heavier_shard_draws_only_into_its_region(spark):
    heavy = {"region0": op.TREE["region0"], "region1": {"rack0": {4: 2.0, 5: 1.0}, "rack1": op.TREE["region1"]["rack1"]}}
    ids = spark.range(20000)
    moved = op.place(op.place(ids, "id", op.TREE, "a"), "id", heavy, "b").where("a <> b").collect()
    assert moved and all(r.b >= 4 for r in moved)
    assert {r.b for r in moved if r.a >= 6} == {4, 5}  # from the other rack into the heavier one
    assert {r.b for r in moved if r.a in (4, 5)} == {4}  # within it only to the heavier shard


def test_weights_are_shares_and_zero_takes_nothing(spark):
    tree = {"r": {"k": {0: 1.0, 1: 3.0, 2: 0.0}}}
    n = Counter(r.shard for r in op.place(spark.range(8000), "id", tree).collect())
    assert set(n) == {0, 1} and abs(n[1] / 8000 - 0.75) < 0.03
    with pytest.raises(ValueError):
        op.grown(op.TREE, 3)


def test_place_keeps_the_table_and_empty_is_empty(spark):
    docs = frames.documents(spark, clash=False)
    assert op.place(docs, "doc_id").columns == [*docs.columns, "shard"]
    assert op.assigned(frames.empty(spark), op.TREE, op.TREE).count() == 0
