from maskwright.llm import urls as op
from tests.llm import frames

URLS = [
    None, "", "no scheme", "http://", "http://Example.NET/en/1?x=1&y=2", "https://a.example.net/de/", "http://net/", "http://net", "http://xnet/", "http://org/fr/a", "https://sub.org/fr",
    "http://example.com/de/x#y", "http://www.example.com/de/", "ftp://u@example.org:80/fr/é?q", "http://a.com?b://c/d", "a://b://c/d", "http://ÄB.net/Ü", "http://a.b.c.example.net/en/\nz",
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fitting = [(len(h + p), h + p, v) for v, h, p in op.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fitting)[1:] if fitting else (None, None))


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "<html>", "?") for i, u in enumerate(URLS * 3)] + [(None, URLS[4], None, "?")], "page_id bigint, url string, html string, rule string")
    out = op.judged(pages).collect()
    assert len(out) == len(URLS) * 3 + 1
    for r in out:
        host, path, rule, verdict = plain(URLS[4 if r.page_id is None else r.page_id % len(URLS)])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block") and 0 <= r.score <= 1


def test_trees_learn_what_rules_show(spark):
    """Lexical features tell long, digit-heavy urls from short ones; the trees carry that to hosts without a rule."""
    rows = [(i, f"http://h{i % 7}.{'net' if i % 2 else 'org'}/{'x9' * 30 if i % 2 else 'fr/a'}/{i % 10}") for i in range(400)]
    rows += [(1000 + i, f"http://other{i}.com/{'x9' * 30 if i % 2 else 'fr/a'}/{i % 10}") for i in range(100)]
    out = {r.page_id: r.verdict for r in op.judged(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    right = sum(out[1000 + i] == ("block" if i % 2 else "allow") for i in range(100))
    assert right >= 90


def test_one_label_none_and_no_rows(spark):
    schema = "page_id bigint, url string"
    only = op.judged(spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/")], schema)).collect()
    assert {r.verdict for r in only} == {"block"}
    assert {r.verdict for r in op.judged(spark.createDataFrame([(2, "http://b.com/"), (3, None)], schema)).collect()} == {"allow"}
    assert op.judged(frames.empty(spark, schema)).count() == 0
