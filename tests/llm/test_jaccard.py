import random

from maskwright.llm import jaccard as op
from tests.llm import frames
from tests.llm.test_simhash import edited, plain_copies


def plain(rows, size=5):
    """(doc_id, shingles, component) by comparing all pairs of whole sets."""
    words = [frames.words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for _, t, *_ in rows]
    n = [len({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}) if w else 0 for w in words]
    roots = plain_copies([t for _, t, *_ in rows])
    groups = {}
    for k, (doc_id, *_) in enumerate(rows):
        if n[k] and doc_id is not None:
            groups[roots[k]] = min(groups.get(roots[k], doc_id), doc_id)
    return sorted(((doc_id, n[k], groups.get(roots[k]) if n[k] else doc_id) for k, (doc_id, *_) in enumerate(rows)), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_awkward_documents_match_the_plain_way(spark):
    assert found(op.linked(frames.documents(spark))) == plain(frames.ROWS)
    assert op.linked(frames.empty(spark)).collect() == []
    nothing = [(1, None, None, None, 0), (2, "", None, None, 0), (3, "  \t", None, None, 0), (4, "a b", None, None, 0)]
    assert found(op.linked(frames.documents(spark, nothing))) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4)]


def crowd(seed):
    """A large group of near copies, chains of copies of copies, unlike texts around one common passage, short texts."""
    draw = random.Random(seed)
    base = [" ".join(f"b{draw.randrange(3000)}" for _ in range(120)) for _ in range(8)]
    texts = base + [edited(base[0], draw, draw.randint(1, 3)) for _ in range(80)] + [edited(draw.choice(base), draw, draw.randint(1, 6)) for _ in range(60)]
    for _ in range(30):
        texts.append(edited(texts[draw.randrange(8, len(texts))], draw, 2))
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"t{k}x{j}" for j in range(draw.randint(3, 12))) for k in range(40)]
    texts += [" ".join(f"s{draw.randrange(4)}" for _ in range(draw.randint(1, 9))) for _ in range(60)]
    return [(k, t, "en", "a", 0) for k, t in enumerate(texts)]


def test_no_link_is_lost_however_lists_are_opened(spark):
    rows = crowd(5)
    want = plain(rows)
    assert 40 < len({c for *_, c in want}) < len(rows) - 60
    docs = frames.documents(spark, rows)
    for hot, rounds in ((op.HOT, op.ROUNDS), (3, 0), (3, 1)):
        assert found(op.linked(docs, hot=hot, rounds=rounds, most=3)) == want


def test_sets_are_those_of_words(spark):
    import numpy as np
    import pyarrow as pa

    texts = [r[1] for r in crowd(1)] + [r[1] for r in frames.ROWS] + ["A b C", "a B c", "x " * (1 << 20)]
    sets = list(op.Shingler().sets(pa.array([None if t is None else t.encode() for t in texts], pa.binary())))
    plain_sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain_sets]
    draw = random.Random(2)
    for _ in range(2000):
        a, b = draw.randrange(len(texts)), draw.randrange(len(texts))
        assert len(np.intersect1d(sets[a], sets[b])) == len(plain_sets[a] & plain_sets[b])
    assert all((op._unpacked(op._packed(s)) >> np.uint64(16) == s >> np.uint64(16)).all() for s in sets)


def test_parities_leave_every_link_open(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    sets = []
    for n in (1, 4, 9, 60, 500, 3000):
        base = np.unique(draw.integers(0, 1 << 64, n, np.uint64))
        sets += [base, *[np.unique(np.concatenate([base[k:], draw.integers(0, 1 << 64, k, np.uint64)])) for k in range(1, n, max(1, n // 40))]]
    rows = [(k, len(s), op.parities(s).tolist()) for k, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "class long, n long, bits array<bigint>")
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))]
    left = {(r.a, r.b) for r in op._close(spark.createDataFrame(pairs, "a long, b long"), classes).collect()}
    shared = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in pairs}
    links = {(a, b) for (a, b), both in shared.items() if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)}
    assert len(links) > 20 and links <= left and len(left) < len(pairs) / 2


def test_longer_prefixes_where_they_pay():
    import numpy as np

    assert op.choose_need(np.ones(50), 11, 5) == 2  # hardly anything to verify
    assert op.choose_need(np.full(50, 40.0), 11, 5) == 5  # many candidates, cheap members follow
    assert op.choose_need(np.concatenate([np.full(11, 3.0), np.full(39, 1e6)]), 11, 5) == 1  # the next member is too common


def test_only_the_result_stays_on_disk(spark):
    import os

    from maskwright.session import shared_folder

    folder = shared_folder(spark).replace("file:", "")
    before = set(os.listdir(folder))
    got = op.linked(frames.documents(spark, crowd(5)))
    assert len(set(os.listdir(folder)) - before) == 1
    assert found(got) == plain(crowd(5))


def test_turns_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(op, "TURN", 1 << 8)
    rows = crowd(7)
    assert found(op.linked(frames.documents(spark, rows), hot=6, most=3)) == plain(rows)
