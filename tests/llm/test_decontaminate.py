import re

import pytest

from maskwright.llm import decontaminate as op
from tests.llm import frames

TESTS = [(1, frames.sentence(3, 60)), (2, None), (None, "Alpha, BETA! gamma"), (4, ""), (5, "idiot"), (5, "ünder über"), (7, frames.sentence(1, 14)), (7, frames.sentence(1, 14)), (10, "never there")]


def plain_words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def plain(rows, tests, window):
    phrases = {}
    for item, text in tests:
        w = plain_words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text, *_ in rows:
        w, hit, items = plain_words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if found := phrases.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        out.append((doc_id, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()], key=repr)


def test_matches_the_plain_way(spark):
    tests = spark.createDataFrame([(i, t, 1) for i, t in TESTS], "item_id bigint, text string, words int")
    assert got(op.contamination(frames.documents(spark), tests)) == plain(frames.ROWS, TESTS, op.WINDOW)


def test_blocks_and_a_whole_index_give_the_same(spark):
    tests = spark.createDataFrame(TESTS, "item_id bigint, text string")
    docs = frames.documents(spark)
    phrases, _ = op.phrases_of(tests)
    whole = op.build_index(docs, segment_words=500)
    assert whole.count() > 5
    one = {(r.doc_id, r.same, r.n_hit) for r in op.search(whole, phrases).collect()}
    many = {(r.doc_id, r.same, r.n_hit) for r in op.search(whole, phrases, block=10).collect()}
    assert one == many == {(r.doc_id, r.same, r.n_hit) for r in op.contamination(docs, tests).collect()}


def test_near_finds_words_in_any_order(spark):
    docs = frames.documents(spark, [(1, "c x b y a", None, None, 0), (2, "a b " + "x " * 9 + "c", None, None, 0), (3, "a b", None, None, 0), (4, "b", None, None, 0), (5, "c a", None, None, 0)])
    tests = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    hits = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in op.contamination(docs, tests, within=5).collect()}
    assert hits == {1: [(0, 5)], 2: [], 3: [], 4: [], 5: []}


def test_empty_tables(spark):
    none = frames.empty(spark, "item_id bigint, text string")
    assert op.contamination(frames.empty(spark), none).count() == 0
    assert {r.n_hit for r in op.contamination(frames.documents(spark), none).collect()} == {0}
    with pytest.raises(ValueError):
        op.search(op.build_index(frames.empty(spark)), op.phrases_of(none)[0], within=op.GAP + 1)
