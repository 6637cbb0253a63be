import numpy as np
import pandas as pd
import pytest

from maskwright.llm import quality, toxicity
from maskwright.llm.catalog import QUERIES
from tests.llm import frames

FOLDER = "/root/testdata/sf0.1"
LABELS = "doc_id bigint, toxic int, quality int"


def test_block_max_is_exact():
    draw = np.random.default_rng(5)
    vectors = []
    for _ in range(300):
        t = np.sort(draw.choice(60, draw.integers(1, 6), replace=False))
        w = draw.integers(1, 4, len(t)).astype(float)  # many ties
        vectors.append((t, w / np.sqrt(w @ w)))
    vectors += vectors[:20]
    index = toxicity.BlockMax(vectors, 60, block=8)
    dense = np.zeros((len(vectors), 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(len(vectors)):
        likeness = np.round(dense @ dense[q], 12)
        likeness[q] = -1
        want = [i for i in np.lexsort((np.arange(len(vectors)), -likeness)) if likeness[i] > 0][:7]
        got, cosine = index.nearest(*vectors[q], 7, but=q)
        assert got.tolist() == want and np.allclose(cosine, likeness[want])


@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity", "toxic", 0.97), ("op3_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    found = QUERIES[name](spark, FOLDER).toPandas().merge(pd.read_parquet(f"{FOLDER}/labels.parquet"), on="doc_id")
    assert found.score.between(0, 1).all()
    held = found[found.held_out]
    assert len(held) > 1000 and (held.predicted == held[label]).mean() >= least
    ones = held[held[label] == 1]
    assert ones.predicted.mean() >= 0.9


@pytest.mark.parametrize("op", [toxicity, quality])
def test_awkward_tables(spark, op):
    docs = frames.documents(spark)
    label = spark.createDataFrame([(i, int(i == 14), int(i != 14)) for i in range(1, 17)] + [(None, 1, 1), (14, 1, None), (5, None, 0)], LABELS)
    scores = op.scored(docs, label).collect()
    assert len(scores) == len(frames.ROWS) and all(0 <= r.score <= 1 for r in scores)
    assert len({r.score for r in scores if r.doc_id == 9}) <= 2  # equal rows score alike
    none = frames.empty(spark, LABELS)
    assert {r.score for r in op.scored(docs, none).collect()} == {0.5}
    assert op.scored(frames.empty(spark), label).count() == 0
    one = spark.createDataFrame([(i, 1, 1) for i in range(1, 17)], LABELS)
    assert all(r.score > 0.5 for r in op.scored(docs, one).collect())


def test_evidence_names_the_nearest_examples(spark):
    docs = frames.documents(spark, [(i, (f"plain words here n{i} " * 3 + ("idiot scum " if i % 3 == 0 else "")), None, None, 0) for i in range(90)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(90)], LABELS)
    for r in toxicity.scored(docs, labels).collect():
        assert (r.score >= toxicity.THRESHOLD) == (r.doc_id % 3 == 0)
        assert all(e.label == 1 and e.cosine > 0.999 for e in r.evidence) and bool(r.evidence) == (r.doc_id % 3 == 0)


def test_word_vectors_match_the_plain_way(spark):
    texts = ["A b c", "b C! d 7", None, "", "a"]
    docs = frames.documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    places, signs = quality.index_vectors()
    want, times = np.zeros((2 * quality.BUCKETS, quality.DIMENSIONS)), np.zeros(2 * quality.BUCKETS)
    memo = quality._Buckets()
    for text in texts:
        both = [memo[w] for w in (text or "").split()]
        for stream in ([b // quality.BUCKETS for b in both], [b % quality.BUCKETS + quality.BUCKETS for b in both]):
            for i, w in enumerate(stream):
                times[w] += 1
                for k in range(max(0, i - 2), min(len(stream), i + 3)):
                    if k != i:
                        for p, s in zip(places[stream[k]], signs[stream[k]]):
                            want[w, p] += s
    got = {r[0]: r for r in quality.context_sums(docs).collect()}
    assert set(got) == set(np.flatnonzero(times))
    assert all(r[1] == times[b] and list(r[2:]) == want[b].tolist() for b, r in got.items())
