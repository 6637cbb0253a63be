"""Streams: the same answers as the batch twins, stable tokens across batches and restarts."""

import json

from pyspark.sql import functions as F

from maskwright.functions.detectors import detect
from maskwright.operators import vault
from maskwright.sources import files
from maskwright.streaming import feed, redact, scopes

LINES = [
    [(0, "s", 0, "write a.b@x.com or c.d@x.com"), (1, "s", 1, "again C.D@x.com")],
    [(2, "s", 2, "c.d@x.com then e.f@x.com"), (3, "t", 3, "only e.f@x.com")],
    [(4, "s", 4, "nothing here"), (5, "s", 5, "a.b@x.com g.h@x.com")],
]


def _write(spark, rows, path):
    spark.createDataFrame(rows, "text_id long, scope_id string, seq long, text string").coalesce(1).write.mode("append").parquet(path)


def test_stream_redaction_equals_batch_and_survives_restart(spark, tmp_path):
    src, vault_path, out, check = (str(tmp_path / n) for n in ("src", "vault", "out", "check"))
    for rows in LINES:  # one run per file: each is a restart from the checkpoint
        _write(spark, rows, src)
        stream = spark.readStream.schema("text_id long, scope_id string, seq long, text string").parquet(src)
        redact.stream_redact(stream, vault_path, out, check, ["seq"]).awaitTermination(120)
    got = {r.text_id: r.redacted for r in spark.read.parquet(out).collect()}
    everything = spark.createDataFrame([r for rows in LINES for r in rows], "text_id long, scope_id string, seq long, text string")
    done, _ = vault.redact(everything.withColumn("spans", F.expr(detect("text"))), ["scope_id"], ["seq"])
    want = {r.text_id: r.redacted for r in done.collect()}
    assert got == want
    assert want[1] == "again <PII:EMAIL:2>" and want[3] == "only <PII:EMAIL:1>"
    kept = redact.drop_scope(spark, vault_path, spark.createDataFrame([("t",)], "scope_id string"))
    assert {r.scope_id for r in kept.collect()} == {"s"}


def test_rerun_of_a_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "vault")
    batch = spark.createDataFrame(LINES[0], "text_id long, scope_id string, seq long, text string")
    first = sorted(map(tuple, redact.redact_batch(batch, 0, path, ["seq"]).collect()))
    assert first == sorted(map(tuple, redact.redact_batch(batch, 0, path, ["seq"]).collect()))


EVENTS = [
    {"sent_at": "2024-01-01T00:00:00Z", "task_id": "a", "seq": 0, "type": "started", "redacted_goal": "buy"},
    {"sent_at": "2024-01-01T00:00:01Z", "task_id": "a", "seq": 1, "type": "observed", "step": 0, "elements": 3, "page": "p", "redactions": {"EMAIL": 1}},
    {"sent_at": "2024-01-01T00:00:02Z", "task_id": "a", "seq": 2, "type": "planned", "step": 0, "action_type": "click", "model": "m", "latency_ms": 5.0, "prompt_tokens": 7, "completion_tokens": 2},
    {"sent_at": "2024-01-01T00:00:03Z", "task_id": "a", "seq": 3, "type": "heartbeat"},
    {"sent_at": "2024-01-01T00:00:04Z", "task_id": "b", "seq": 4, "type": "started", "redacted_goal": "read"},
    {"sent_at": "2024-01-01T00:00:20Z", "task_id": "a", "seq": 5, "type": "finished", "outcome": "completed", "steps": 1},
    {"sent_at": "2024-01-01T00:00:21Z", "task_id": "b", "seq": 6, "type": "warning", "message": "mail me at x@example.com"},
]


def _feed_file(tmp_path, name, rows):
    folder = tmp_path / "feed"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
    return str(folder)


def test_task_feed_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    check, rows = str(tmp_path / "check"), []

    def run():
        def keep(batch, number):
            rows.extend(r.asDict() for r in batch.collect())

        stream = files.stream_events(spark, path)
        query = feed.task_feed(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert query.awaitTermination(60)

    path = _feed_file(tmp_path, "1.json", EVENTS[:4])
    run()
    _feed_file(tmp_path, "2.json", EVENTS[4:])
    run()
    later = [{"sent_at": "2024-01-01T00:02:00Z", "task_id": "c", "seq": 7, "type": "started", "redacted_goal": "x"}]
    _feed_file(tmp_path, "3.json", later)
    run()
    assert {r["task_id"] for r in rows if not r["connected"]} == {"a", "b"}  # both silent for over six seconds by then
    latest = {}
    for row in rows:
        if row["connected"]:
            latest[row["task_id"]] = row
    batch = spark.read.schema(files.EVENT).json(path).withColumn("sent_at", F.to_timestamp("sent_at"))
    for want in feed.task_feed_batch(batch).collect():
        got = latest[want.task_id]
        for field in ("events", "steps", "prompt_tokens", "completion_tokens", "last_model", "last_latency", "finished", "redacted_goal", "page"):
            assert got[field] == want[field], (want.task_id, field)


def test_liveness_and_totals(spark, tmp_path):
    events = spark.read.schema(files.EVENT).json(_feed_file(tmp_path, "1.json", EVENTS)).withColumn("sent_at", F.to_timestamp("sent_at"))
    gaps = feed.liveness(events).collect()
    assert [(g.task_id, g.disconnected_at.second, g.back_at.second) for g in sorted(gaps)] == [("a", 9, 20), ("b", 10, 21)]
    still = feed.liveness(events, until="timestamp'2024-01-01 00:01:00'").collect()
    assert sorted((g.task_id, g.disconnected_at.second) for g in still if g.back_at is None) == [("a", 26), ("b", 27)]
    for bucket in (None, "cast(floor(seq / 2) AS bigint)"):
        totals = {r.seq: (r.total_steps, r.total_prompt, r.latest_latency) for r in feed.running_totals(events, bucket=bucket).collect()}
        assert totals[1] == (0, 0, None) and totals[2] == (1, 7, 5.0) and totals[5] == (1, 7, 5.0)


def test_gate_drops_private_and_broken_events(spark, tmp_path):
    bad = [{"sent_at": "2024-01-01T00:00:22Z", "task_id": "b", "seq": 7, "type": "planned", "step": -1, "action_type": "click", "model": "m", "latency_ms": 1.0}]
    events = spark.read.schema(files.EVENT).json(_feed_file(tmp_path, "1.json", EVENTS + bad)).withColumn("sent_at", F.to_timestamp("sent_at"))
    clean, dropped = feed.gated_feed(events)
    assert {r.seq for r in clean.collect()} == {0, 1, 2, 3, 4, 5}
    assert {(r.reason, r.findings) for r in dropped.collect()} == {("private data", 1), ("invalid", 1)}
    seen = []
    counts = []
    sink = feed.gated_sink(lambda rows, number: seen.append(len(rows.collect())), lambda n, number: counts.append((number, n)))
    sink(events, 0)
    sink(events.where("seq > 5"), 1)
    assert seen[0] == 6
    assert counts[0] == (0, {"came": 8, "invalid": 1, "private data": 1}) and counts[1][1]["came"] == 2


def test_scopes_keep_their_tokens_in_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    lines = [*LINES, [(6, "t", 6, "new h.i@x.com, old E.F@x.com")], [(7, "t", 7, "last j.k@x.com done"), (8, "s", 8, "g.h@x.com 4111 1111 1111 1111")], [(9, "t", 9, "after e.f@x.com"), (10, "s", 10, None)]]
    for k, rows in enumerate(lines):  # one run per file: each is a restart, and finds no vault to read
        _write(spark, rows, src)
        stream = spark.readStream.schema("text_id long, scope_id string, seq long, text string").parquet(src)
        query = scopes.stream_redact_scopes(stream, str(tmp_path / f"vault{k}"), out, check, ["seq"], finished="text LIKE '%done'")
        assert query.awaitTermination(120)
    got = {r.text_id: r.redacted for r in spark.read.parquet(out).collect()}
    twin = spark.createDataFrame([r for rows in lines[:-1] for r in rows], "text_id long, scope_id string, seq long, text string")
    done, _ = vault.redact(twin.withColumn("spans", F.expr(detect("text"))), ["scope_id"], ["seq"])
    assert {k: v for k, v in got.items() if k < 9} == {r.text_id: r.redacted for r in done.collect()}
    assert got[9] == "after <PII:EMAIL:1>" and got[10] is None  # t was over: its state is gone
    added = [(r.scope_id, r.token, r.first_value) for k in range(len(lines)) for r in spark.read.parquet(str(tmp_path / f"vault{k}")).collect()]
    assert ("s", "<PII:EMAIL:4>", "g.h@x.com") in added and added.count(("t", "<PII:EMAIL:1>", "e.f@x.com")) == 2 and len(added) == 9


def test_unicode_values_share_a_key_with_the_batch(spark):
    values = ["Ａｂ－１（２）", "A.b, C", "ﬁne", "x y", "É-é"]
    want = [r.value_key for r in vault.value_key(spark.createDataFrame([(v,) for v in values], "text string")).collect()]
    assert [scopes.value_key(v) for v in values] == want


def test_an_unreadable_vault_stops_the_stream(spark, tmp_path):
    import pytest
    from pyspark.errors import PySparkException

    from maskwright.streaming import redact

    assert redact._known(spark, str(tmp_path / "new"), 0).count() == 0 and (tmp_path / "new" / "batch=-1").is_dir()
    for name in ("batch=0", "other=0"):  # folders that do not agree on their columns
        spark.range(1).write.parquet(str(tmp_path / "odd" / name))
    with pytest.raises(PySparkException):
        redact._known(spark, str(tmp_path / "odd"), 1).count()
