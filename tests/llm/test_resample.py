import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from maskwright.llm import resample as op
from tests.llm import frames


def plain_features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, tests, part=5):
    docs = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(b for *_, f in docs for b in f), Counter(b for x in tests for b in plain_features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in range(10000)]
    out = []
    for i, w, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, w, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(enough[: part * len(enough) // 100])}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in out), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_tables_match_the_plain_way(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    tests = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert found(op.op12_resample(spark, folder)) == plain(rows, tests)


def test_awkward_documents(spark):
    target = frames.documents(spark, [(1, "alpha BETA gamma", None, None, 0), (2, None, None, None, 0), (3, frames.SHARED, None, None, 0)])
    got = op.resampled(frames.documents(spark), target, share=(60, 100))
    assert found(got) == plain([(r[0], r[1]) for r in frames.ROWS], ["alpha BETA gamma", None, frames.SHARED], part=60)
    assert op.resampled(frames.empty(spark), target).count() == 0
    none = found(op.resampled(frames.documents(spark), frames.empty(spark)))
    assert none == plain([(r[0], r[1]) for r in frames.ROWS], [])
    docs = frames.documents(spark)
    rows = op.drawn(docs, target, share=(60, 100))
    assert rows.columns == [*docs.columns, "draw_rank"] and sorted(r.draw_rank for r in rows.collect())[0] == 1


def test_ties_go_to_smaller_ids_over_range_borders(spark):
    rows = spark.createDataFrame([(k, k, 30, 1, 0, score) for k, score in enumerate([5, 5, 5, 9, 9, 1, 5, 7, 5, 5] * 30)], "doc_id bigint, same bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    got = {r.doc_id: r["rank"] for r in op.ranked(rows, share=(50, 100)).collect()}
    want = sorted(((-r.score, r.doc_id) for r in rows.collect()))[:150]
    assert {d: k for d, k in got.items() if k} == {d: k + 1 for k, (_, d) in enumerate(want)}
    assert {r.doc_id for r in op.ranked(rows.withColumn("n_words", rows["doc_id"] % 40), share=(100, 100)).collect() if r["rank"]} == {k for k in range(300) if k % 40 >= 20}
