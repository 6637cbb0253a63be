"""The whole pipeline, stage by stage, against each stage's plain version."""

from collections import Counter

import pandas as pd

import corpus_pipeline
from maskwright.llm import decontaminate, mixing, sharding, simhash, toxicity
from tests.llm import frames, test_decontaminate, test_mixing, test_sharding, test_simhash

FOLDER = "/root/testdata/sf0.001"


def test_run_is_the_plain_pipeline(spark):
    got = corpus_pipeline.run(spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    toxic = {r.doc_id for r in toxicity.scored(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect() if r.score >= toxicity.THRESHOLD}
    rows = [r for r in rows if r[0] not in toxic]
    rows.sort()
    roots = test_simhash.plain_copies([r[1] for r in rows])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    deduped = simhash.stage(spark, docs.where(~docs["doc_id"].isin(list(toxic))), FOLDER)
    assert sorted(r.doc_id for r in deduped.collect()) == [r[0] for r in rows]
    tests = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    bad = {r[0] for r in test_decontaminate.plain(rows, list(zip(tests.item_id, tests.text)), 13) if r[4]}
    rows = {r[0]: r for r in rows if r[0] not in bad}
    clean = decontaminate.stage(spark, deduped, FOLDER)
    assert {r.doc_id for r in clean.collect()} == set(rows)
    copies = Counter(got.doc_id)
    assert set(copies) <= set(rows) and max(copies.values()) <= mixing.MAX_COPIES
    size = {i: len(frames.words(r[1])) for i, r in rows.items()}
    sources = sorted({r[3] for r in rows.values()})
    target = test_mixing.plain_targets({s: sum(size[i] for i, r in rows.items() if r[3] == s) for s in sources})
    for source in sources:
        own = [i for i, r in rows.items() if r[3] == source]
        assert abs(sum(copies[i] * size[i] for i in own) - target[source]) <= max(size[i] for i in own)
    for r in got.itertuples():
        assert (r.text, r.source, r.lang) == (rows[r.doc_id][1], rows[r.doc_id][3], rows[r.doc_id][2])
        assert r.shard == test_sharding.plain_shard(r.doc_id, sharding.TREE)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame(frames.ROWS, frames.SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
