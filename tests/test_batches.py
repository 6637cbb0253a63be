"""Detection over Arrow batches gives what the SQL expressions give, also where RE2 and Java's expressions part."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import detectors as D
from maskwright.functions.batches import with_candidates_in_context, with_spans
from maskwright.functions.sql import once
from maskwright.plans import catalog

BITS = [
    "Phone", "mobile no", "contact  number:", "account", "Order no.", "customer id", "policy #", "mrn", "DOB", "born", "passport", "aadhaar", "9876543210", "+91 98765-43210",
    "4111 1111 1111 1111", "9780306406157", "ABCDE1234F", "K1234567", "HDFC0ABC123", "a.b_c@okaxis", "x@y.com", "foo-bar@ex-1.co.in.", "AB-12", "abcd-1_",
    "abcdefghijklmnopqrstuvwx-y1", "12/03/1999", "1999-01-02", "2 jan 2001", "é", "ſ", "K", "\x01", "\x02", "_", "-", ".", "\n", "1234 5678 9012",
    "12345678901234567890", "５", "　", "😀", "me@okaxis.", "u1@okaxis-x", "id card", "govt. id", "0 9876543210", "a/c", "00000000000000",
]


def odd_texts():
    draw = random.Random(1)
    gaps = [" ", " ", "", " ", "-", ".", ": ", "5"]
    return [None, "", *["".join(draw.choice(BITS) + draw.choice(gaps) for _ in range(draw.randrange(1, 40))) for _ in range(600)]]


@pytest.mark.parametrize("kind", ["all", "candidates", *D.KINDS])
def test_same_as_sql(spark, kind):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts())], "text_id bigint, text string")
    detectors, merge = D.KINDS.get(kind, D.ALL), {"all": "earliest", "candidates": None}.get(kind, "listed")
    sql = {"all": D.detect("text"), "candidates": D.candidates("text")}.get(kind) or D.detect_one("text", kind)
    both = with_spans(texts, detectors=detectors, merge=merge).withColumn("want", F.expr(once(sql)))
    rows = both.select("text", "spans", "want").collect()
    assert len(rows) == 602 and any(r.want for r in rows)
    assert [r.text for r in rows if r.spans != r.want] == []


@pytest.mark.parametrize("name", ["record_spans", "candidate_counts", "phone_spans", "other_id_spans"])
def test_records_are_read_in_batches(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_vault_of_is_the_vault_of_redact(spark):
    from maskwright.operators import vault
    from maskwright.plans.derived import records

    texts = with_spans(records(spark, "/root/testdata/sf0.001").limit(200))
    redacted, whole = vault.redact(texts, ["scope_id"], ["seq"], unicode_values=False)
    assert sorted(map(str, vault.vault_of(texts, ["scope_id"], ["seq"], unicode_values=False).collect())) == sorted(map(str, whole.collect()))
    assert all(len(r.spans) == len(r.replacements) for r in redacted.collect())


def test_context_same_as_sql(spark):
    contexts = [None, "", "Date of birth", "Account number 12345678", "Phone", "\x01", "K", "mail to a@b.co"]
    rows = [(i, t, contexts[i % len(contexts)]) for i, t in enumerate(odd_texts())]
    texts = spark.createDataFrame(rows, "text_id bigint, text string, context string")
    both = with_candidates_in_context(texts).withColumn("want", F.expr(once(D.candidates_in_context("text", "context"))))
    found = both.select("text", "context", "found", "want").collect()
    assert any(r.want and r.context for r in found)
    assert [(r.text, r.context) for r in found if (r.found or []) != (r.want or [])] == []


@pytest.mark.parametrize("name", ["private_views", "redacted_views"])
def test_views_are_detected_in_batches_and_once(spark, monkeypatch, name):
    """No detection is left in what is read after the texts were written with their spans."""
    from maskwright.operators import names, views

    plans = []

    def keep(frame, cut=views.cut_lineage):
        plans.append((set(frame.columns), frame._jdf.queryExecution().executedPlan().toString()))
        return cut(frame)

    monkeypatch.setattr(views, "cut_lineage", keep)
    monkeypatch.setattr(names, "cut_lineage", keep)
    last = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert any("ArrowEvalPython [run(" in plan for _, plan in plans)
    assert "ArrowEvalPython [run(" not in last and "spans" in set.union(*[columns for columns, _ in plans])
