"""Operators on small fixtures, against plain twins where the rule is a loop."""

import json
import math

from pyspark.sql import functions as F

from maskwright.functions.urls import url_template
from maskwright.operators import budget, entities, names, outputs, score, skew, study, traces, vault
from maskwright.sources import files, html


def test_numbering_and_windows_in_buckets_equal_plain_windows(spark):
    df = spark.range(500).selectExpr("id % 3 AS k", "id AS o", "if(id % 4 = 0, NULL, id % 7) AS v")
    plain = {(r.k, r.o): r.n for r in df.selectExpr("k", "o", "row_number() OVER (PARTITION BY k ORDER BY o) AS n").collect()}
    got = {(r.k, r.o): r.n for r in skew.number_rows(df, ["k"], "o", "cast(floor(o / 16) AS bigint)", "n").collect()}
    assert got == plain
    specs = {"a": ("lag", "v"), "b": ("lead", "v"), "c": ("sum", "coalesce(v, 0)"), "d": ("last", "v"), "e": ("last_before", "v")}
    one = sorted(map(str, skew.ordered(df, ["k"], "o", specs).select("k", "o", *specs).collect()))
    many = sorted(map(str, skew.ordered(df, ["k"], "o", specs, "cast(floor(o / 16) AS bigint)").select("k", "o", *specs).collect()))
    assert one == many


def test_hot_join_equals_plain_join(spark):
    left = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 0, id % 900) AS k")
    right = spark.range(700).selectExpr("id AS k", "id * 2 AS v", "if(id = 0, 700, 2) AS uses")
    want = sorted(map(tuple, left.join(right.select("k", "v"), "k", "left").select("id", "v").collect()), key=str)
    got = sorted(map(tuple, skew.join_hot(left, right, ["k"], ["v"], "uses", ["id"]).select("id", "v").collect()), key=str)
    assert got == want


def test_exact_ranks(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (-5, 0, 0, 1, 2, 1000, 1e9)] + [("b", 1.0), ("b", 2.0), ("b", 3.0), ("b", 4.0)], "k string, v double")
    got = {r.k: (r.p50, r.p90) for r in study.percentile_floor(df, ["k"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    assert got == {"a": (1.0, 1e9), "b": (3.0, 4.0)}
    assert {r.k: r.median for r in study.median(df, ["k"], "v").collect()} == {"a": 1.0, "b": 2.5}


def test_tokens_share_a_spelling_and_number_by_first_sight(spark):
    rows = [("s", 0, 0, "PHONE", "+91 98765 43210"), ("s", 1, 0, "PHONE", "+919876543210"), ("s", 1, 5, "NAME", "Ａsha"), ("s", 2, 0, "NAME", "asha"), ("s", 3, 0, "PHONE", "12")]
    spans = spark.createDataFrame(rows, "scope string, seq long, start int, category string, text string")
    got = {(r.category, r.first_value): r.token for r in vault.assign_tokens(spans, ["scope"], ["seq", "start"], bucket_rows=2).collect()}
    assert got == {("PHONE", "+91 98765 43210"): "<PII:PHONE:1>", ("NAME", "Ａsha"): "<PII:NAME:1>", ("PHONE", "12"): "<PII:PHONE:2>"}


def test_hidden_spans(spark):
    cases = [
        ("call bob now", "call <PII:NAME:1> now", [(5, 8)]),
        ("ab", "<PII:NAME:1><PII:EMAIL:2>", [(0, 2)]),
        ("a x b y c", "a <PII:NAME:1> b <PII:NAME:2> c", [(2, 3), (6, 7)]),
        ("same", "same", []),
        ("same", "other", None),
        ("ab", "ab<PII:NAME:1>", None),
        ("x<1> y", "<PII:NAME:1> y", [(0, 4)]),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "id int, raw string, redacted string")
    for row in df.selectExpr("id", f"{score.hidden_spans('raw', 'redacted')} AS h").collect():
        want = cases[row.id][2]
        assert (None if row.h is None else [(s.start, s.end) for s in row.h]) == want, cases[row.id]


def test_scores_by_hand(spark):
    texts = score.with_hidden(spark.createDataFrame([("p", "t1", "bob and bob", "<PII:NAME:1> and bob"), ("p", "t2", "see karan mehta@x", "see <PII:EMAIL:1>"), ("p", "t3", "aaa", "aaa")], "page string, text_id string, raw string, redacted string"))
    items = spark.createDataFrame([("p", 0, "NAME", "bob", "text"), ("p", 1, "EMAIL", "karan.mehta@x", "canvas"), ("p", 2, "NAME", "zed", "text"), ("p", 3, "OTHER", "aa", "text")], "page string, item_no int, category string, value string, place string")
    places = score.item_occurrences(texts, items)
    got = {r.item_no: (r.seen, r.caught, r.partial, r.category_right, r.iou) for r in score.score_items(items, places).collect()}
    assert got == {0: (True, False, True, False, 0.5), 1: (True, True, False, True, 1.0), 2: (False, False, False, False, 0.0), 3: (True, False, False, False, 0.0)}
    rows = {r.text_id: (r.outside_chars, r.over_redacted, len(r.false_positives)) for r in score.text_scores(texts, places).collect()}
    assert rows == {"t1": (5, 0, 0), "t2": (4, 0, 0), "t3": (0, 0, 0)}
    empty = score.totals(score.score_items(items.limit(0), places.limit(0)), score.text_scores(texts.limit(0), places.limit(0)), score.near_misses(texts, spark.createDataFrame([], "page string, miss_no int, value string"))).first()
    assert (empty.recall, empty.iou) == (1.0, 1.0)


def test_names_learned_later_do_not_hide_earlier_views(spark):
    texts = spark.createDataFrame([("t", 0, "a", "see Asha Rao"), ("t", 2, "b", "ASHA   rao, and asharao"), ("t", 2, "c", "x-asha rao!"), ("u", 9, "d", "asha rao")], "task_id string, view_seq long, text_id string, text string")
    known = spark.createDataFrame([("t", "asha rao", "NAME", 1), ("t", "rao", "NAME", 1)], "task_id string, key string, category string, known_from long")
    got = {r.text_id: [s.text for s in r.spans] for r in names.known_in(texts, known).collect()}
    assert got == {"b": ["ASHA   rao"], "c": ["asha rao"]}


def test_rule_finder_and_addresses(spark):
    df = spark.createDataFrame([("Hi Asha Rao, welcome",), ("deliver to Ravi, 12 MG Road",), ("Turing was here",)], "text string").coalesce(1)
    got = [[s.text for s in r.s] for r in df.selectExpr(f"{entities.entity_candidates(entities.rule_entities('text'))} AS s").collect()]
    assert got == [["Asha Rao"], ["Ravi", "12 MG Road"], []]


def _line(e):
    box = ",".join(str(int(v)) for v in e["bbox"])
    out = f"{e['id']} {e['role']}" + (f' "{e["label"]}"' if e["label"] else "")
    if e["value"] and e["value"] != e["label"]:
        out += f' = "{e["value"]}"'
    return out + f" [{box}]" + (f" ({', '.join(e['state'])})" if e["state"] else "")


def _cut(text, limit):
    if text is None or len(text) <= limit:
        return text
    space = text.rfind(" ", 0, limit + 1)
    end = space if space > limit * 0.6 else limit
    return text[:end].rstrip() + "…"


def _fit_plain(elements, notes, fixed, limit, above=0, below=0, height=600):
    """One at a time, measuring after each step."""
    elements, notes = [dict(e) for e in elements], list(notes)

    def total():
        listed = f"Not listed: {above} more elements above the view and {below} below. Scroll to reach them.\n" if above + below else ""
        chars = fixed + sum(len(_line(e)) + 1 for e in elements) + (0 if elements else 13) + len(listed) + sum(len(n) + 2 for n in notes if n)
        return math.ceil(100 / 3.7 + chars / 2.8) + 20

    control = lambda e: e["role"] == "button"
    seen = lambda e: e["bbox"][1] + e["bbox"][3] > 0 and e["bbox"][1] < height

    def far(e):
        y, h = e["bbox"][1], e["bbox"][3]
        return -(y + h) if y + h <= 0 else (y - height if y >= height else 0)

    def cap(size, all_):
        for e in elements:
            if all_ or not control(e):
                e["label"], e["value"] = _cut(e["label"], size), _cut(e["value"], size)

    def drop(keep):
        nonlocal above, below
        for e in sorted((e for e in elements if not keep(e)), key=lambda e: -far(e)):
            if total() <= limit:
                return
            elements.remove(e)
            if e["bbox"][1] < 0:
                above += 1
            else:
                below += 1

    def forget():
        notes[:] = [None if i < len(notes) - 3 else n for i, n in enumerate(notes)]

    steps = [lambda: cap(160, True), lambda: drop(lambda e: control(e) or seen(e)), forget, lambda: cap(100, False), lambda: cap(60, False), lambda: drop(seen), lambda: cap(30, False)]
    for step in steps:
        if total() <= limit:
            break
        step()
    return [e["id"] for e in elements], [e["label"] for e in elements], above, below, sum(n is not None for n in notes)


def test_fit_equals_trimming_one_at_a_time(spark):
    elements = [
        {"id": f"e{i + 1}", "role": ("button", "text", "image")[i % 3], "label": ("word%d " % i) * (4 + 9 * (i % 4)), "value": None if i % 2 else "v" * (i * 7),
         "hint": None, "bbox": (10.0, float(i * 170 - 700), 50.0, 20.0), "state": [], "source": "dom"} for i in range(14)
    ]
    for e in elements:
        e["label"] = e["label"].strip()
    history = [{"action": "{}", "verified": True, "note": "n" * (10 + i)} for i in range(5)]
    ddl = (
        "budget long, system_chars int, goal string, title string, origin string, path_template string, has_query boolean, vw double, vh double, above int, below int, "
        "tokens array<string>, known_values map<string,string>, history array<struct<action:string,verified:boolean,note:string>>, "
        "elements array<struct<id:string,role:string,label:string,value:string,hint:string,bbox:struct<x:double,y:double,w:double,h:double>,state:array<string>,source:string>>"
    )
    limits = list(range(220, 1200, 35)) + [5000]
    rows = [(b, 100, "g", "t", "o", "/p", False, 800.0, 600.0, 0, 0, [], {}, [tuple(h.values()) for h in history], [tuple(e.values()) for e in elements]) for b in limits]
    df = spark.createDataFrame(rows, ddl)
    whole = df.selectExpr(f"length({budget.render_request()}) AS n").first().n
    fixed = whole - sum(len(_line(e)) + 1 for e in elements) - sum(len(h["note"]) + 2 for h in history) + len(budget.SHORTENED) + 1
    for r in budget.fit(df).collect():
        if not r.trimmed:
            assert math.ceil(100 / 3.7 + whole / 2.8) + 20 <= r.budget and len(r.elements) == 14
            continue
        want = _fit_plain(elements, [h["note"] for h in history], fixed, r.budget)
        got = ([e.id for e in r.elements], [e.label for e in r.elements], r.above, r.below, sum(h.note is not None for h in r.history))
        assert got == want, r.budget


def test_replies(spark):
    click = {"type": "click", "target": "e1"}
    cases = [
        (json.dumps(click), "click", 0), ("<think>{</think>" + json.dumps(click), "click", 0), ("ok: " + json.dumps(click) + " done", "click", 0),
        (json.dumps([click, click]), "click", 1), (json.dumps({"actions": [click] + [{"type": "wait", "ms": 1}] * 9}), "click", 6),
        (json.dumps({**click, "then": [{"type": "wait", "ms": 1.5}, click]}), "click", 0), ("{", None, 0), (json.dumps({"type": "click"}), None, 0),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, raw string")
    for r in df.selectExpr("id", f"{outputs.parse_output('raw')} AS p").collect():
        kind = json.loads(r.p.action)["type"] if r.p.action else None
        assert (kind, len(r.p.then)) == cases[r.id][1:], cases[r.id]


def test_commitments(spark):
    df = spark.createDataFrame([("Place order", "read it"), ("Buy now", "buy milk"), ("Sign up", "fill in the sign-up form"), ("Remove filter", "x")], "l string, g string").coalesce(1)
    got = [r.c for r in df.selectExpr(f"{traces.unasked_commitment('l', 'g')} AS c").collect()]
    assert got == ["place an order or pay", None, "create an account", None]


def test_addresses(spark):
    df = spark.createDataFrame([("https://A.b:443/x/12345?",), ("https://b/u%40/a@b/0123456789abcdef",), ("junk",), ("http://h/ü",)], "u string").coalesce(1)
    got = [tuple(r.t) for r in df.selectExpr(f"{url_template('u')} AS t").collect()]
    assert got == [("https://a.b", "/x/{id}", False), ("https://b", "/u%40/{email}/{hash}", False), ("about:unknown", "/", False), ("http://h", "/%C3%BC", False)]


PAGE = """<title>T</title><nav><a href=/x>Home</a></nav><form><label for=m>Mail</label><input id=m type=email value=" a@b.co " autocomplete=email required>
<input type=submit><select aria-labelledby="h h k"><option>A<option selected>B</select><input type=hidden value=z><h2 id=h>Pick <b id=k>one</b></h2>
<div hidden><button>no</button></div><div aria-hidden=true><a>no</a></div><button aria-label=Toggle aria-expanded=false>Show <img alt=panel></button></form><p>One<p>Two<span>in</span><script>var a='<p>x</p>'</script>"""


def test_page_elements(spark):
    rows = html.html_elements(spark.createDataFrame([(1, PAGE), (2, "")], "view_id int, html string")).orderBy("view_id", "ordinal").collect()
    got = [(r.id, r.role, r.label, r.value, r.hint, r.state, r.parent_id) for r in rows]
    assert got == [
        ("e1", "region", None, None, None, [], None), ("e2", "link", "Home", None, None, [], "e1"), ("e3", "form", None, None, None, [], None),
        ("e4", "text", "Mail", None, None, [], "e3"), ("e5", "textbox", "Mail", "a@b.co", None, ["required", "editable"], "e3"),
        ("e6", "button", "Submit", None, None, [], "e3"), ("e7", "combobox", "Pick one", "B", "options: A | B", [], "e3"),
        ("e8", "heading", "Pick one", None, None, [], "e3"), ("e9", "text", "one", None, None, [], "e8"),
        ("e10", "button", "Toggle", "Show panel", None, ["collapsed"], "e3"), ("e11", "image", "panel", None, None, [], "e10"),
        ("e12", "text", "One", None, None, [], None), ("e13", "text", "Twoin", None, None, [], None),
    ]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "truth").mkdir()
    good = {"page": "a.html", "about": "x", "pii": [{"category": "EMAIL", "value": "v", "where": "text"}], "notPii": ["n"]}
    (tmp_path / "truth" / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "truth" / "b.json").write_text(json.dumps({**good, "page": "b.htm"}))
    parts = files.read_truth(spark, str(tmp_path / "truth"))
    assert [r.page for r in parts["items"].collect()] == ["a.html"] and [tuple(r) for r in parts["rejects"].collect()] == [("b.json", "page")]
    clean = spark.createDataFrame([("d", "ok <PII:EMAIL:1>")], "day string, redacted string")
    files.write_redacted(clean, str(tmp_path / "out"), ["day"], ["redacted"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    try:
        files.write_redacted(clean.withColumn("redacted", F.lit("a.b@x.com")), str(tmp_path / "bad"), ["day"], ["redacted"])
        raise AssertionError("private data was written")
    except Exception as error:
        assert "unredacted PII" in str(error) and "a.b@x.com" not in str(error).split("Caused")[0][:300]


def test_report_is_written_by_section_and_read_back(spark, tmp_path):
    raw = spark.createDataFrame([("a", 0, "mail ann@x.org or 12345678"), ("b", 1, "nothing private"), ("b", 2, "")], "page string, text_id int, text string")
    shown = spark.createDataFrame([("a", 0, "mail <PII:EMAIL:1> or 12345678"), ("b", 1, "nothing <PII:PHONE:2>")], "page string, text_id int, text string")
    pairs = score.text_pairs(raw, shown, ["page", "text_id"])
    assert sorted((r.page, r.raw, [(h.start, h.end) for h in r.hidden], r.unaligned) for r in pairs.collect()) == [
        ("a", "mail ann@x.org or 12345678", [(5, 14)], False), ("b", "nothing private", [(8, 15)], False),
    ]
    truth = [("a", 0, "EMAIL", "ann@x.org", "text"), ("a", 1, "ACCOUNT", "12345678", "text"), ("b", 0, "EMAIL", "gone@x.org", "image")]
    items = spark.createDataFrame(truth, "page string, item_no long, category string, value string, place string")
    places = score.item_occurrences(pairs, items)
    judged = score.score_items(items, places)
    misses = score.near_misses(pairs, spark.createDataFrame([("b", 0, "private")], "page string, miss_no int, value string"))
    timings = score.median_timings(spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (3.0, 2.0, 5.0, 4.0)], "observe_ms double, vision_ms double, names_ms double, redact_ms double"))
    files.write_report(score.full_report(judged, score.text_scores(pairs, places), misses, timings=timings), str(tmp_path / "report"))
    back = {(r.section, r.key, r.metric): r.value for r in spark.read.parquet(str(tmp_path / "report")).collect()}
    assert back["metrics", "all", "pii"] == "3" and back["metrics", "all", "caught"] == "1" and back["metrics", "all", "recall"] == "0.3333"
    assert back["metrics", "all", "precision"] == "0.5000" and back["metrics", "all", "near_misses_hidden"] == "1"
    assert ("metrics", "all", "unaligned") not in back and float(back["metrics", "median ms", "names"]) == 4
    assert (back["by category", "EMAIL", "caught"], back["by category", "EMAIL", "pii"]) == ("1", "2")
    assert (back["by place", "image", "caught"], back["by place", "text", "pii"]) == ("0", "2")
    assert back["missed", "a", "ACCOUNT #1"] == "readable" and back["missed", "b", "EMAIL #0"] == "not in the text (image)"
    assert back["per page", "b", "false positives"] == "1"


def test_audit_is_written_in_order(spark, tmp_path):
    events = spark.createDataFrame([("t", k, f"e{k}") for k in (3, 0, 2, 1)] + [("u", 0, "x")], "task_id string, seq int, type string")
    goals = spark.createDataFrame([("t", "buy <PII:NAME:1>"), ("u", None)], "task_id string, redacted_goal string")
    files.write_audit(files.audit_rows(events, goals), str(tmp_path / "audit"), day="DATE '2026-01-02'")
    assert [p.name for p in (tmp_path / "audit").glob("day=*")] == ["day=2026-01-02"]
    lines = [json.loads(x) for f in sorted((tmp_path / "audit" / "day=2026-01-02").glob("*.json")) for x in f.read_text().splitlines()]
    assert [(r["task_id"], r["seq"]) for r in lines] == [("t", -1), ("t", 0), ("t", 1), ("t", 2), ("t", 3), ("u", -1), ("u", 0)]
    assert json.loads(lines[0]["event"])["redacted_goal"] == "buy <PII:NAME:1>" and json.loads(lines[2]["event"])["type"] == "e1"


def test_studies_are_read_from_files(spark, tmp_path):
    call = {"latencyMs": 900, "repairs": 1, "promptTokens": 50, "completionTokens": 5}
    run = {"task": "buy", "repeat": 0, "passed": True, "endedRight": True, "overreach": False, "leaked": 0, "steps": 3, "unverified": 0, "rateLimitWaits": 0, "errors": 0, "seconds": 7.5}
    one = {"provider": "p", "model": "m", "label": "", "repeats": 1, "date": "2026-01-01", "serverErrors": 0, "runs": [{**run, "calls": [call, call]}]}
    two = {**one, "label": "long", "runs": [{**run, "calls": []}, {**run, "repeat": 1, "refused": 2, "calls": [call]}]}
    for k, study_file in enumerate((one, two)):
        (tmp_path / f"{k}.json").write_text(json.dumps(study_file, indent=1))
    parts = files.read_studies(spark, str(tmp_path))
    assert sorted(r.study for r in parts["studies"].collect()) == ["p: m", "p: m (long)"]
    assert sorted((r.study, r.repeat, r.refused) for r in parts["runs"].collect()) == [("p: m", 0, 0), ("p: m (long)", 0, 0), ("p: m (long)", 1, 2)]
    assert sorted((r.study, r.repeat, r.call_no, r.latency_ms) for r in parts["calls"].collect()) == [("p: m", 0, 0, 900), ("p: m", 0, 1, 900), ("p: m (long)", 1, 0, 900)]
