"""Detectors: what must match, what must not, offsets, overlaps, labels; and a brute-force twin."""

import re

import pytest

from maskwright.functions import detectors as D
from maskwright.functions.detectors import candidates, detect, detect_in_context, detect_one, normalize_ocr
from maskwright.functions.spans import find, replace_spans, running_lengths
from maskwright.functions.sql import lit
from maskwright.operators.score import _union_ranges

CASES = [
    ("mail asha.rao@example.com.", [("EMAIL", "asha.rao@example.com")]),
    ("asha@localhost", [("ACCOUNT", "asha@localhost")]),
    ("x@-bad.com", []),
    ("pay asha@okaxis. now", [("ACCOUNT", "asha@okaxis")]),
    ("é@x bob@ex.org", [("EMAIL", "bob@ex.org")]),
    ("call +91  98765  43210", [("PHONE", "+91  98765  43210")]),
    ("call +1 (743) 555-0100", []),
    ("98309 65520", [("PHONE", "98309 65520")]),
    ("09830965520 x", [("PHONE", "09830965520")]),
    ("5830965520", []),
    ("983096552012", []),
    ("Order no: 9876543210", []),
    ("PNR 9876543210", []),
    ("ordered by 9830965520", [("PHONE", "9830965520")]),
    ("Phone: 033 2456 7890", [("PHONE", "033 2456 7890")]),
    ("033 2456 7890", []),
    ("4111 1111 1111 1111", [("CARD", "4111 1111 1111 1111")]),
    ("4111 1111 1111 1112", []),
    ("0000 0000 0000 0000", []),
    ("isbn 9780306406157", []),
    ("pan abcde1234f ok", [("GOV_ID", "abcde1234f")]),
    ("abcde1234fg", []),
    ("IFSC HDFC0123456", [("ACCOUNT", "HDFC0123456")]),
    ("Aadhaar 2345 6789 0123", [("GOV_ID", "2345 6789 0123")]),
    ("2345 6789 0123", []),
    ("Aadhaar 2345 6789 0123, other 2345 6789 0124", [("GOV_ID", "2345 6789 0123")]),
    ("passport no K1234567", [("GOV_ID", "K1234567")]),
    ("K1234567", []),
    ("account number 12345678", [("ACCOUNT", "12345678")]),
    ("Account number 9876543210", [("ACCOUNT", "9876543210")]),
    ("account " + "x" * 49 + " 12345678", []),
    ("Patient ID AB-1234", [("OTHER", "AB-1234")]),
    ("Patient ID Next appointment", []),
    ("born 12/03/1990", [("DOB", "12/03/1990")]),
    ("DOB: 3 March 1990", [("DOB", "3 March 1990")]),
    ("on 12/03/1990", []),
    ("", []),
]


def _spans(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [r.s for r in df.selectExpr("id", f"{expression} AS s").orderBy("id").collect()]


def test_must_and_must_not(spark):
    texts = [t for t, _ in CASES]
    for (text, want), spans in zip(CASES, _spans(spark, texts, detect("text"))):
        assert [(s.category, s.text) for s in spans] == want, text
        assert all(text[s.start : s.end] == s.text for s in spans), text


def test_overlaps_keep_the_earliest_then_longest_then_first_listed(spark):
    text = "a 4111111111111111@okaxis b"
    (spans,) = _spans(spark, [text], detect("text"))
    assert [s.text for s in spans] == ["4111111111111111@okaxis"]
    (raw,) = _spans(spark, [text], candidates("text"))
    assert {s.category for s in raw} == {"CARD", "ACCOUNT"}


def test_phone_kinds_merge_in_list_order(spark):
    (spans,) = _spans(spark, ["phone 98309 65520 and +91 98309 65520"], detect_one("text", "phone"))
    assert [(s.text, s.confidence) for s in spans] == [("98309 65520", 0.95), ("+91 98309 65520", 1.0)]


def test_context_describes_but_is_not_matched(spark):
    df = spark.createDataFrame([("12/03/1990", "Date of birth"), ("12/03/1990", None), ("345678", "Account 12")], "text string, context string")
    got = [[(s.start, s.text) for s in r.s] for r in df.selectExpr(f"{detect_in_context('text', 'context')} AS s").collect()]
    assert got == [[(0, "12/03/1990")], [], []]


def test_fields(spark):
    rows = [("secret", "password", None), ("Asha", "text", "shipping name"), ("x@y", "email", None), ("  ", "tel", None), ("v", "text", "off"), ("pw", "text", "current-password name")]
    df = spark.createDataFrame(rows, "value string, kind string, auto string").coalesce(1)
    got = [r.s and (r.s[0].category, r.s[0].confidence) for r in df.selectExpr(f"{D.field_spans('value', 'kind', 'auto')} AS s").collect()]
    assert got == [("OTHER", 1.0), ("NAME", 0.9), ("EMAIL", 0.9), None, None, ("OTHER", 1.0)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("karan. mehta@example.com", "karan.mehta@example.com"),
        ("karan, mehta@example.com", "karan.mehta@example.com"),
        ("karan mehta@example.com", "karan.mehta@example.com"),
        ("write to us at help@example.com", "write to us at help@example.com"),
        ("Email karan@example.com", "Email karan@example.com"),
    ],
)
def test_ocr(spark, text, want):
    assert spark.createDataFrame([(text,)], "text string").selectExpr(f"{normalize_ocr('text')} AS t").first().t == want


def test_long_texts_take_the_blocked_sums(spark):
    """Thousands of matches in one text: offsets stay exact, and so do those of a text with none."""
    text = " ".join(f"mail{i}@example.com é" for i in range(3000))
    (spans,) = _spans(spark, [text], find("text", lit(D.P.java(D.P.EMAIL))))
    want = [(m.start(), m.end()) for m in re.finditer(r"mail[0-9]+@example\.com", text)]
    assert [(s.start, s.end) for s in spans] == want
    df = spark.createDataFrame([(list(range(1000)),), ([1],)], "n array<int>")
    for row in df.selectExpr("n", f"{running_lengths('n')} AS s").collect():
        assert row.s[: len(row.n)] == [sum(row.n[:i]) for i in range(len(row.n))]


def test_result_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, CASES[i % len(CASES)][0]) for i in range(200)], "id int, text string")
    one, seven = (
        sorted((r.id, str(r.s)) for r in df.repartition(n).selectExpr("id", f"{detect('text')} AS s").collect()) for n in (1, 7)
    )
    assert one == seven


def test_kept_spans_are_disjoint(spark):
    texts = [a + " " + b for a, _ in CASES for b, _ in CASES[:12]]
    for spans in _spans(spark, texts, detect("text")):
        assert all(x.end <= y.start for x, y in zip(spans, spans[1:]))


def test_a_new_kind_is_one_more_detector(spark):
    plate = D.Detector("plate", "OTHER", 0.8, r"%L%[A-Z]{2}[0-9]{2}[A-Z]{2}[0-9]{4}%R%", lambda t: f"{t} rlike '[A-Z]{{2}}[0-9]'")
    (spans,) = _spans(spark, ["car KA01AB1234, mail a.b@x.com"], detect("text", (*D.ALL, plate)))
    assert [s.text for s in spans] == ["KA01AB1234", "a.b@x.com"]


def test_a_kind_without_tokens_is_refused(spark):
    with pytest.raises(ValueError, match="PLATE"):
        D.Detector("plate", "PLATE", 0.8, "x", lambda t: "true")
    missing = "array(named_struct('start', 4, 'end', 8, 'token', cast(NULL AS string)))"
    with pytest.raises(Exception, match="span without a token"):
        spark.sql(f"SELECT {replace_spans(lit('car KA01 parked'), missing)}").collect()


def test_very_many_matches_in_one_text(spark):
    """Far more than a block of the folds holds, touching and apart."""
    text = " ".join(f"a{i}@x.com{',b@y.com' if i % 7 == 0 else ''}" for i in range(3000))
    (spans,) = _spans(spark, [text], detect("text"))
    assert [s.text for s in spans] == re.findall(r"[a-z0-9]+@[xy]\.com", text)
    ranges = [(i * 3 % 1009 * 5, i * 3 % 1009 * 5 + 3 + i % 4) for i in range(2000)]
    rows = spark.createDataFrame([(ranges,)], "r array<struct<start:int,end:int>>")
    merged = [[s, e] for s, e in sorted(ranges)[:1]]
    for s, e in sorted(ranges):
        if s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    assert [[x.start, x.end] for x in rows.selectExpr(f"{_union_ranges('r')} AS u").first().u] == merged
    as_spans = ", ".join(["'EMAIL' AS category", "'regex' AS source", "1.0D AS confidence", "0 AS priority", "'' AS text"])
    listed = f"transform(r, x -> struct(x.start AS start, x.end AS end, {as_spans}))"
    kept = []
    for s, e in ranges:
        if not any(s < b and a < e for a, b in kept):
            kept.append((s, e))
    assert [(x.start, x.end) for x in rows.selectExpr(f"{D.first_wins(listed)} AS u").first().u] == sorted(kept)
