import random

import xxhash

from maskwright.llm import jaccard
from maskwright.llm import simhash as op
from tests.llm import frames


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_roots(ids, fps, distance=3):
    above = {i: i for i in ids}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for k, a in enumerate(ids):
        for m in range(k):
            if (fps[k] ^ fps[m]).bit_count() <= distance:
                x, y = root(a), root(ids[m])
                above[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_documents_match_the_plain_way(spark):
    rows = [r for r in frames.ROWS if r[0] is not None] + [(50, SAME := frames.sentence(1, 5000).replace("w1 ", "w2 ", 1), None, None, 0), (51, SAME.upper(), None, None, 0)]
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    places = plain_roots(list(range(len(rows))), fps)
    groups = {}
    for k, p in places.items():
        groups.setdefault(p, set()).add(rows[k][0])
    least = {p: min(g) for p, g in groups.items()}
    want = sorted((rows[k][0], signed(fps[k]), least[places[k]]) for k in range(len(rows)))
    got = op.near_duplicates(frames.documents(spark, rows))
    assert sorted((r.doc_id, r.fp, r.component_id) for r in got.collect()) == want
    assert op.near_duplicates(frames.documents(spark)).count() == len(frames.ROWS)  # ids that are null join in
    kept = op.stage(spark, frames.documents(spark, rows), "")
    assert {r.doc_id for r in kept.collect()} == set(least.values())


def test_crowded_entries_lose_no_link(spark):
    draw = random.Random(1)
    base, found = draw.getrandbits(64), set()
    for _ in range(200):
        x = base
        for _ in range(draw.randint(0, 6)):
            x ^= 1 << draw.randrange(64)
        found.add(x)
    found = sorted(found | {draw.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1, (1 << 63)})
    fps = spark.createDataFrame([(signed(x),) for x in found], "fp bigint")
    want = plain_roots([signed(x) for x in found], [x for x in found])
    for hot in (op.HOT, 4):
        roots = dict(op.components(op.links(fps, hot=hot)).collect())
        assert all(roots.get(i, i) == r for i, r in want.items())


def plain_copies(texts, size=5):
    """Roots (places) of the groups that Jaccard >= 0.8 over word shingles links."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset() for w in words]
    above = list(range(len(sets)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for k, a in enumerate(sets):
        for m in range(k):
            if a == sets[m] or 5 * len(a & sets[m]) >= 4 * len(a | sets[m]) > 0:
                x, y = root(k), root(m)
                above[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(sets))]


def edited(text, draw, n):
    words = text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def test_stage_takes_five_word_shingles(spark):
    draw = random.Random(5)
    base = [" ".join(f"b{draw.randrange(3000)}" for _ in range(150)) for _ in range(12)]
    texts = base + [edited(draw.choice(base), draw, draw.randint(1, 8)) for _ in range(150)] + ["one two three", "One  two three", None, "", " "]
    roots = plain_copies(texts)
    prints = [plain_fingerprint(t) for t in texts]
    near = plain_roots(list(range(len(texts))), prints)
    assert sum(near[k] != near[roots[k]] for k in range(len(texts))) > 20  # 3 bits of 64 leave these
    docs = frames.documents(spark, [(k, t, "en", "a", 0) for k, t in enumerate(texts)])
    assert sorted(r.doc_id for r in op.stage(spark, docs, "").collect()) == sorted(set(roots))
    assert op.stage(spark, frames.empty(spark), "").count() == 0


def test_stage_links_by_fingerprints_first(spark, monkeypatch):
    draw = random.Random(6)
    base = [" ".join(f"b{draw.randrange(3000)}" for _ in range(400)) for _ in range(6)]
    texts = base + [edited(draw.choice(base), draw, draw.randint(1, 3)) for _ in range(40)]
    fps, roots, seen = [plain_fingerprint(t) for t in texts], plain_copies(texts), []
    near = {(a, b) for b in range(len(texts)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 3}
    assert len(near) > 20
    made = op.likely_pairs
    monkeypatch.setattr(op, "likely_pairs", lambda *a: seen.append(op.cut_lineage(made(*a))) or seen[0])
    monkeypatch.setattr(op, "settled", lambda spark, make: make())
    docs = frames.documents(spark, [(k, t, "en", "a", 0) for k, t in enumerate(texts)])
    assert sorted(r.doc_id for r in op.stage(spark, docs, "").collect()) == sorted(set(roots))
    place = {n: k for k, n in enumerate(r["class"] for r in jaccard.prints(docs).orderBy("doc_id").collect())}
    got = {tuple(sorted((place[r.a], place[r.b]))) for r in seen[0].collect()}
    assert got and got <= near
    joined = plain_roots(list(range(len(texts))), fps)
    above = plain_union(len(texts), got)
    assert all((above[a] == above[b]) == (joined[a] == joined[b]) for a in range(len(texts)) for b in range(a))


def plain_union(n, pairs):
    roots = list(range(n))
    for a, b in pairs:
        roots = [min(roots[a], roots[b]) if r in (roots[a], roots[b]) else r for r in roots]
    return roots


def test_wider_distances_lose_no_link(spark):
    fps = spark.createDataFrame([(0b01 | 0b01 << 32,), (0b10 | 0b10 << 32,)], "fp bigint")  # each half: one bit up, one down
    assert op.links(fps, distance=4).distinct().count() == 1 and op.links(fps, distance=3).count() == 0


def test_stage_keeps_one_row_of_a_group(spark):
    rows = [(3, frames.SHARED, "en", "a", 1)] * 4 + [(None, frames.SHARED, "en", "a", 1)] * 5 + [(7, frames.SHARED, "en", "a", 1)] + [(None, "text without any id", "en", "a", 1)] * 3 + [(8, "another", "en", "a", 1)] * 2
    docs = frames.documents(spark, rows)
    kept = op.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()) == [(False, 3, frames.SHARED), (False, 8, "another"), (True, 0, "text without any id")]


def test_empty_table(spark):
    assert op.near_duplicates(frames.empty(spark)).count() == 0
