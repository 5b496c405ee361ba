import json
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomlight import lineage
from loomlight.plans.ingest import ingest as plan_ingest
from loomlight.sources import manifest, writers
from loomlight.streaming import ingest, jobs, tokens, uploads, usage

START = datetime(2024, 1, 1)


def write(path, name, rows):
    path.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps(r, default=lambda d: d.strftime("%Y-%m-%dT%H:%M:%S.000Z")) for r in rows]
    target = path / f"{name}.json"
    target.write_text("\n".join(lines) + "\n")


def at(minutes):
    return START + timedelta(minutes=minutes)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def test_redelivery_within_the_lock_is_dropped(spark, tmp_path):
    deliveries = [[("j", 0), ("k", 0)], [("j", 5)], [("x", 60)], [("y", 61)], [("j", 62)]]
    for i, rows in enumerate(deliveries):
        write(tmp_path / "log", f"{i}", [{"job_id": j, "ts": at(m)} for j, m in rows])
        time.sleep(0.02)
    log = stream(spark, tmp_path / "log", "job_id string, ts timestamp")
    firsts = jobs.finish(jobs.drop_redelivered(log, "job_id", jobs.INGESTION_LOCK), "firsts")
    got = sorted((r.job_id, int((r.ts - START).total_seconds() // 60)) for r in firsts.collect())
    assert got == [("j", 0), ("j", 62), ("k", 0), ("x", 60), ("y", 61)]


def test_ingestion_records(spark):
    good = json.dumps({"jobId": 1, "sourceType": "PDF", "sessionId": 2})
    log = spark.createDataFrame(
        [(good, START), ("{broken", START), (None, START), ('{"sessionId": 3}', START)],
        "payload string, ts timestamp",
    )
    parsed, dropped = jobs.ingestion_jobs(log)
    assert [(r.job_id, r.source_type) for r in parsed.collect()] == [(1, "PDF")]
    assert dropped.count() == 3


def test_chat_and_export_records(spark):
    chat = spark.createDataFrame(
        [("5", "6", "q", "m", "1704067200000"), ("bad", "6", "q", "m", "x")],
        "messageId string, sessionId string, query string, model string, timestamp string",
    )
    first, second = jobs.chat_jobs(chat).collect()
    assert (first.message_id, first.session_id, first.ts) == (5, 6, START)
    assert second.message_id is None and second.ts is None


def test_job_status(spark):
    rows = [(1, 1, "QUEUED", None), (1, 3, "FAILED", "boom"), (1, 2, "PROCESSING", None),
            (2, 1, "QUEUED", None), (2, 2, "COMPLETED", None)]
    events = spark.createDataFrame(rows, "job_id int, seq int, status string, error string")
    found = {r.job_id: r for r in jobs.job_status(events).collect()}
    assert (found[1].status, found[1].error, found[1].progress) == ("FAILED", "boom", 0)
    assert (found[2].status, found[2].error, found[2].progress) == ("COMPLETED", None, 100)


@pytest.mark.parametrize("minutes, shown", [(-1, "QUEUED"), (0, "READY"), (29, "READY"), (30, "QUEUED")])
def test_export_results_expire(spark, minutes, shown):
    results = spark.createDataFrame([("j", "READY", START)], "job_id string, status string, written_at timestamp")
    seen = jobs.export_status(results, F.lit(at(minutes)))
    assert seen.first()["shown_status"] == shown


EVENTS = [
    (1, 1, "message", "bad "), (1, 2, "retry", ""), (1, 3, "message", "good "),
    (1, 4, "progress", "{}"), (1, 5, "message", "end"), (1, 6, "done", ""),
    (1, 7, "message", "stray"), (1, 8, "retry", ""),
    (2, 1, "message", "half"), (2, 2, "error", "oops"), (2, 3, "done", ""),
    (3, 1, "message", "open"),
]
TOKENS = "message_id bigint, seq bigint, event string, data string"


def test_token_assembly_in_batch(spark):
    events = spark.createDataFrame(EVENTS, TOKENS)
    text = {r.message_id: r.text for r in tokens.assembled_text(events).collect()}
    assert text == {1: "good end", 2: "half", 3: "open"}
    status = {r.message_id: r.status for r in tokens.message_status(events).collect()}
    assert status == {1: "COMPLETED", 2: "FAILED", 3: "PROCESSING"}


def test_long_answers_come_in_segments(spark):
    events = spark.range(2500).select(
        F.lit(1).cast("bigint").alias("message_id"),
        (F.col("id") + 1).alias("seq"),
        F.lit("message").alias("event"),
        F.lit("x").alias("data"),
    )
    parts = tokens.assembled_text(events).orderBy("segment_no").collect()
    assert [len(p.text) for p in parts] == [1000, 1000, 500]


def test_token_assembly_over_batches(spark, tmp_path):
    names = ["message_id", "seq", "event", "data"]
    for i in range(0, len(EVENTS), 5):
        rows = [dict(zip(names, e)) for e in EVENTS[i : i + 5]]
        write(tmp_path / "tokens", f"{i:02d}", rows)
        time.sleep(0.02)
    out = jobs.finish(tokens.assemble_stream(stream(spark, tmp_path / "tokens", TOKENS)), "text")
    got = {r.message_id: (r.text, r.status) for r in out.collect()}
    assert got == {1: ("good end", "COMPLETED"), 2: ("half", "FAILED")}


def test_progress_notices(spark):
    rows = [
        (1, 1, "progress", '{"stage":"PLANNING","status":"RUNNING","message":"m","iteration":1}'),
        (1, 2, "scope_expansion", '{"type":"scope_expansion"}'),
        (1, 3, "progress", "broken"),
    ]
    log = tokens.progress_log(spark.createDataFrame(rows, TOKENS)).orderBy("seq", "part").collect()
    assert [(r.stage, r.status) for r in log] == [
        ("PLANNING", "RUNNING"), ("RETRIEVAL", "WARN"), ("RETRIEVAL", "INFO"),
    ]


UPLOADS = "session_id bigint, event_id bigint, ts timestamp, state string, file_name string"


def test_upload_states(spark):
    rows = [(1, 1, at(0), "EMBEDDING", "a"), (1, 2, at(1), "READY", "b"), (2, 3, at(0), "READY", "c")]
    events = spark.createDataFrame(rows, UPLOADS)
    live = {r.session_id: r for r in uploads.upload_states(events, F.lit(at(5.5))).collect()}
    assert set(live) == {1} and live[1].state == "READY" and live[1].names == 2


def test_upload_tracking_stream(spark, tmp_path):
    names = ["session_id", "event_id", "ts", "state", "file_name"]
    rows = [(1, 1, at(0), "EMBEDDING", "a"), (1, 2, at(1), "INGESTING", "a"), (1, 3, at(2), "READY", "b")]
    write(tmp_path / "up", "0", [dict(zip(names, r)) for r in rows])
    tracked = uploads.track_uploads(spark.readStream.schema(UPLOADS).json(str(tmp_path / "up")))
    running = (
        tracked.writeStream.format("memory").queryName("tracked").outputMode("update").start()
    )
    try:
        deadline = time.time() + 90
        while time.time() < deadline and spark.table("tracked").isEmpty():
            time.sleep(0.5)
        assert [tuple(r) for r in spark.table("tracked").collect()] == [(1, "READY", 2)]
    finally:
        running.stop()


def test_answers_wait_for_busy_sessions(spark):
    asked = [(1, 1, at(10)), (2, 2, at(10)), (3, 3, at(10)), (4, 4, at(10)), (5, 5, at(10)), (6, 1, at(15))]
    states = [
        (1, at(9), 1, "EMBEDDING"), (1, at(11), 2, "READY"), (1, at(11.5), 3, "READY"),
        (2, at(9), 4, "INGESTING"), (2, at(12.5), 5, "READY"),  # too late
        (3, at(8), 6, "EMBEDDING"), (3, at(9), 7, "READY"),  # ready before the question
        (4, at(4), 8, "EMBEDDING"),  # forgotten
    ]
    answers = spark.createDataFrame(asked, "message_id int, session_id int, asked_at timestamp")
    events = spark.createDataFrame(states, "session_id int, ts timestamp, event_id int, state string")
    rows = jobs.gate_on_ingestion(answers, events).collect()
    got = {r.message_id: (r.ready_at, r.still_indexing) for r in rows}
    none = (None, False)
    assert len(rows) == 6
    assert got == {1: (at(11), False), 2: (None, True), 3: none, 4: none, 5: none, 6: none}


def test_late_jobs_are_not_lost(spark, tmp_path):
    for i, (job, minute) in enumerate([("a", 120), ("b", 180), ("late", 0), ("a", 60), ("a", 121)]):
        write(tmp_path / "log", f"{i}", [{"job_id": job, "ts": at(minute)}])
        time.sleep(0.02)
    log = stream(spark, tmp_path / "log", "job_id string, ts timestamp")
    taken = jobs.finish(jobs.drop_redelivered(log, "job_id", jobs.INGESTION_LOCK), "late")
    got = sorted((r.job_id, int((r.ts - START).total_seconds() // 60)) for r in taken.collect())
    assert got == [("a", 60), ("a", 120), ("b", 180), ("late", 0)]


def test_long_answer_in_one_batch_keeps_its_order(spark, tmp_path):
    n = 25_000
    events = [{"message_id": 1, "seq": i, "event": "message", "data": f"{i} "} for i in range(n)]
    events.append({"message_id": 1, "seq": n, "event": "done", "data": ""})
    write(tmp_path / "tokens", "0", events[::-1])
    out = jobs.finish(tokens.assemble_stream(stream(spark, tmp_path / "tokens", TOKENS)), "long")
    row = out.first()
    assert row.status == "COMPLETED" and row.text == "".join(f"{i} " for i in range(n))


def test_upload_states_forget_earlier_lives(spark):
    rows = [(1, i, at(i * 4), "READY", f"f{i}") for i in range(5)]
    rows += [(1, 9, at(60), "EMBEDDING", "f0"), (1, 10, at(64), "INGESTING", "z")]
    events = spark.createDataFrame(rows, UPLOADS)
    live = uploads.upload_states(events, F.lit(at(66))).first()
    assert (live.state, live.names, live.changed_at) == ("INGESTING", 2, at(64))
    assert uploads.upload_states(events, F.lit(at(18))).first().names == 5


def test_streamed_counters_and_visits(spark, tmp_path):
    rows = [
        {"ts": at(0), "user_id": 1, "kind": "chat", "succeeded": True, "tokens": 4, "duration_ms": 10.0},
        {"ts": at(1), "user_id": 1, "kind": "chat", "succeeded": True, "tokens": 6, "duration_ms": 20.0},
        {"ts": at(2), "user_id": 2, "kind": "document", "succeeded": False, "tokens": 0, "duration_ms": 0.0},
    ]
    write(tmp_path / "out", "0", rows)
    layout = ("ts timestamp, user_id int, kind string, succeeded boolean, tokens int, "
              "duration_ms double")  # fmt: skip
    source = spark.readStream.schema(layout).json(str(tmp_path / "out"))
    running = (
        usage.daily_counters(source).writeStream.format("memory").queryName("counters")
        .outputMode("complete").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    day = spark.table("counters").first()
    assert (day.chat_requests, day.documents_uploaded, day.tokens_generated) == (2, 0, 10)
    assert day.avg_response_ms == 15.0
    assert jobs.finish(usage.first_visits(source), "visits").count() == 2


def test_streamed_ingestion_twice_adds_nothing(spark, tmp_path):
    layout = (
        "job_id bigint, ts timestamp, doc_id bigint, session_id bigint, uploaded_at timestamp, "
        "file_name string, source_type string, image_url string, source_url string, text string"
    )
    row = {"job_id": 1, "ts": at(0), "doc_id": 1, "session_id": 1, "uploaded_at": at(0),
           "file_name": "a.txt", "source_type": "TEXT", "text": "hello there"}
    write(tmp_path / "in", "0", [row])
    time.sleep(0.02)
    write(tmp_path / "in", "1", [row | {"job_id": 2, "doc_id": 2}, row])
    table = str(tmp_path / "chunks")
    for run in ("a", "b"):
        source = stream(spark, tmp_path / "in", layout)
        ingest.ingest_stream(source, table, f"twice-{run}-{tmp_path.name}").awaitTermination()
    assert ingest.read_chunks(spark, table).count() == 1


def test_known_content_moves_to_the_newest_session(spark, tmp_path):
    layout = (
        "doc_id bigint, session_id bigint, uploaded_at timestamp, file_name string, source_type string, "
        "image_url string, source_url string, text string"
    )

    def rows(*uploads):
        return spark.createDataFrame(
            [(d, s, at(m), f"{d}.txt", "TEXT", None, None, text) for d, s, m, text in uploads], layout
        )

    first = rows((1, 1, 1, "shared text"), (2, 2, 2, "only here"), (3, 3, 3, "older copy"))
    second = rows((4, 4, 4, "shared  text"), (5, 5, 0, "older copy"), (6, 6, 6, "fresh"), (7, 7, 7, "fresh"))
    table = str(tmp_path / "chunks")
    assert ingest.ingest_batch(first, table, 0)
    kept = ingest.manifest.load(spark, table)
    assert ingest.ingest_batch(second, table, 1) and not ingest.ingest_batch(second, table, 1)
    got = {r.content: (r.session_id, r.original_file_name) for r in ingest.read_chunks(spark, table).collect()}
    both, _ = plan_ingest(first.unionByName(second.filter("doc_id <> 5")))
    assert got == {r.content: (r.session_id, r.original_file_name) for r in both.collect()}
    assert got["shared text"] == (4, "1.txt") and got["older copy"] == (3, "3.txt")
    # Only the bucket of the moved content was written anew.
    now = ingest.manifest.load(spark, table)
    assert sum(now.folders.get(b) != f for b, f in kept.folders.items()) == 1
    assert not list((tmp_path / "chunks").glob("**/batch-*"))


def test_records_are_logged_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "vector_id int, value string")
    for _ in range(2):
        writers.upsert_records(rows, path, 0)
    assert manifest.read_table(spark, path).count() == 20
    writers.upsert_records(rows.filter("vector_id < 5").withColumn("value", F.lit("new")), path, 0, writer="other")
    writers.delete_records(rows.filter("vector_id >= 15"), path, 1)

    def state():
        return {r.vector_id: r.value for r in writers.read_records(spark, path).collect()}

    want = {i: "new" if i < 5 else f"v{i}" for i in range(15)}
    assert state() == want
    assert manifest.compact(spark, path, "vector_id") and state() == want
    assert manifest.read_table(spark, path).count() == 15
    assert manifest.remove_unreferenced(spark, path) and state() == want
    assert manifest.remove_unreferenced(spark, path) == []
    writers.upsert_records(rows.filter("vector_id = 19"), path, 2)
    assert state() == want | {19: "v19"}


def test_a_conflicting_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a")], "vector_id int, value string")
    assert writers.read_records(spark, path) is None
    before = manifest.load(spark, path)
    assert writers.upsert_records(rows, path, 0)
    with pytest.raises(manifest.Conflict):
        manifest.write_batch(rows, path, F.lit("0"), "late", 0, at=before)
    assert manifest.load(spark, path).number == 1 and writers.read_records(spark, path).count() == 1


def test_tables_written_inside_a_scope_go(spark):
    with lineage.tables_removed_after(spark):
        inside = lineage.materialize(spark.range(3), "inside")
        path = inside.inputFiles()[0]
        assert inside.count() == 3
    outside = lineage.materialize(spark.range(3), "outside")
    assert not Path(path.removeprefix("file://")).exists() and outside.count() == 3


def test_answers_wait_for_missing_tokens(spark, tmp_path):
    names = ["message_id", "seq", "event", "data"]
    late = [(1, 1, "message", "a"), (1, 3, "message", "c"), (1, 4, "done", ""), (1, 2, "message", "b")]
    again = [(2, 3, "done", ""), (2, 1, "message", "x"), (2, 1, "message", "x"), (2, 2, "error", "oops")]
    after = [(1, 2, "message", "b"), (1, 5, "message", "stray"), (3, 1, "message", "open"), (3, 3, "done", "")]
    for i, event in enumerate([*late, *again, *after]):
        write(tmp_path / "tokens", f"{i:02d}", [dict(zip(names, event))])
        time.sleep(0.02)
    out = jobs.finish(tokens.assemble_stream(stream(spark, tmp_path / "tokens", TOKENS)), "gaps")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "abc", "COMPLETED"), (2, "x", "FAILED")]


def run_until(spark, frame, name, done):
    running = frame.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        deadline = time.time() + 90
        while time.time() < deadline and not done(spark.table(name).collect()):
            time.sleep(0.5)
        return spark.table(name).collect()
    finally:
        running.stop()


def test_missing_tokens_are_not_waited_for_for_ever(spark, tmp_path):
    names = ["message_id", "seq", "event", "data"]
    events = [(1, 1, "message", "a"), (1, 3, "message", "c"), (1, 4, "done", "")]
    write(tmp_path / "tokens", "0", [dict(zip(names, e)) for e in events])
    answers = tokens.assemble_stream(stream(spark, tmp_path / "tokens", TOKENS), expire=True, wait="2 seconds")
    got = run_until(spark, answers, "incomplete", len)
    assert [tuple(r) for r in got] == [(1, "ac", "INCOMPLETE")]


def test_visits_past_retention_go_to_the_side(spark, tmp_path):
    day = 24 * 60
    for i, (user, minute) in enumerate([(1, 0), (2, 9 * day), (1, 5), (3, 9 * day), (1, 10), (2, 9 * day + 1)]):
        write(tmp_path / "visits", f"{i}", [{"user_id": user, "ts": at(minute)}])
        time.sleep(0.02)
    visits = stream(spark, tmp_path / "visits", "ts timestamp, user_id int")
    rows = jobs.finish(usage.first_visits(visits, retention="2 days"), "retention")
    firsts, side = usage.split_by_retention(rows)
    assert sorted(r.user_id for r in firsts.collect()) == [1, 2, 3]
    # The first of user 1's late visits may still meet the state that its arrival ends.
    assert {r.user_id for r in side.collect()} == {1}
    counted = {r.date.day: r.unique_visitors for r in usage.daily_visitors(rows).collect()}
    assert counted == {1: 1, 10: 2}
    whole = jobs.finish(usage.first_visits(visits, retention="30 days"), "whole")
    assert whole.count() == 3 and whole.filter("past_retention").isEmpty()


def test_streamed_gate(spark, tmp_path):
    states = [
        (1, 9, "EMBEDDING"), (1, 11, "READY"), (1, 11.5, "READY"),
        (2, 9, "INGESTING"), (2, 12.5, "READY"),  # too late
        (3, 8, "EMBEDDING"), (3, 9, "READY"),  # ready before the question
        (4, 4, "EMBEDDING"),  # forgotten
        (5, 9.5, "INGESTING"), (5, 9.9, "FAILED"),  # the second comes in the last batch
        (7, 10, "EMBEDDING"), (7, 12, "READY"),  # both at the edge
    ]
    asked = [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7)]
    rows = [{"session_id": s, "ts": at(m), "event_id": i, "state": k} for i, (s, m, k) in enumerate(states)]
    rows += [{"session_id": s, "ts": at(10), "message_id": m} for m, s in asked]
    order = [rows[i] for i in (1, 4, 12, 6, 8, 13, 14, 15, 16, 17, 18, 0, 2, 3, 5, 7, 10, 11, 9)]
    for i in range(0, len(order), 5):
        write(tmp_path / "log", f"{i:02d}", order[i : i + 5])
        time.sleep(0.02)
    write(tmp_path / "log", "98", [{"ts": at(60)}])
    time.sleep(0.02)
    write(tmp_path / "log", "99", [{"session_id": 1, "ts": at(10), "message_id": 99}])
    log = stream(spark, tmp_path / "log", "session_id int, ts timestamp, event_id int, state string, message_id int")
    answers = log.filter("state is null").select("message_id", "session_id", F.col("ts").alias("asked_at"))
    decided = jobs.gate_stream(answers, log.filter("state is not null"), delay="10 minutes")
    out = jobs.finish(decided, "gate").collect()
    got = {r.message_id: (r.ready_at, r.still_indexing) for r in out}
    none = (None, False)
    late = [r.message_id for r in out if r.late]
    assert late == [99] and len(out) == 8
    del got[99]
    assert got == {1: (at(11), False), 2: (None, True), 3: none, 4: none, 5: none, 6: none, 7: (at(12), False)}


def test_session_lives(spark, tmp_path):
    rows = [
        (1, 1, 0, "EMBEDDING", "Notes_a.txt"), (1, 2, 1, "INGESTING", "b.pdf"), (1, 3, 2, "READY", "Notes_a.txt"),
        (1, 4, 2, "READY", " "), (1, 5, 10, "UPLOADING", "c.png"), (2, 6, 3, "FAILED", None),
    ]
    names = ["session_id", "event_id", "ts", "state", "file_name"]
    order = [rows[i] for i in (4, 2, 0, 3, 5, 1)]
    for i, (s, e, m, k, f) in enumerate(order):
        write(tmp_path / "up", f"{i}", [dict(zip(names, (s, e, at(m), k, f)))])
        time.sleep(0.02)
    write(tmp_path / "up", "8", [{"ts": at(90)}])
    time.sleep(0.02)
    write(tmp_path / "up", "9", [dict(zip(names, (2, 9, at(1), "READY", "late.txt")))])
    lives = jobs.finish(uploads.session_lives(stream(spark, tmp_path / "up", UPLOADS), "20 minutes"), "lives").collect()
    ended = {(r.session_id, r.began): r for r in lives if r.kind == "ended"}
    assert set(ended) == {(1, at(0)), (1, at(10)), (2, at(3))}
    first = ended[1, at(0)]
    assert (first.state, first.names, first.changed) == ("READY", 2, at(2))
    words = {a.alias: a.file_name for a in first.aliases}
    assert (words["first"], words["second"], words["latest"], words["notes"]) == ("Notes_a.txt", "b.pdf", "Notes_a.txt", "Notes_a.txt")
    assert ended[1, at(10)].names == 1 and ended[2, at(3)].names == 0
    assert [(r.session_id, r.file_name) for r in lives if r.kind == "late"] == [(2, "late.txt")]
