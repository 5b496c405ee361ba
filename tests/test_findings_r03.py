"""Cases of the third round's findings."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomlight.catalog import QUERIES
from loomlight.catalog.streams import split_stream
from loomlight.functions import terms
from loomlight.llm import flat, quality_rules
from loomlight.operators import dense, lexical, postings
from loomlight.operators.embedding import hashed_terms
from loomlight.plans import retrieval
from loomlight.sources import manifest
from loomlight.streaming import jobs, tokens, uploads, usage


def written(spark, folder, name, rows):
    rows.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_page_tables_split_a_text_outside_the_loop_over_its_words(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b  c", "en", "s", 6), (2, "d e", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    built = QUERIES["page_tables_and_figures"].build(spark, written(spark, tmp_path, "documents", rows))
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2
    tables = {r["doc_id"]: r["text"] for r in built.filter("chunk_type = 'WIKITABLE'").collect()}
    head = "| Left | Right\\|side |\n|---|---|\n"
    assert tables == {1: head + "| xa | yb |\n| xc | y |\n", 2: head + "| xd | ye |\n"}


def state_rows(stream, folder):
    """(rows given, state rows held) of a stream run to its end."""
    running = (
        stream.writeStream.format("parquet").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
    return rows, max(p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress)


def test_jobs_share_state_and_keep_their_numbers(spark, tmp_path):
    big = 2**53 + 1
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(i % 3000, start + timedelta(minutes=4 * (i // 3000)), None if i % 2 else big + i) for i in range(12_000)]
    log = split_stream(spark.createDataFrame(rows, "job_id long, ts timestamp, size long"), "job_id", 2)
    got, held = state_rows(jobs.drop_redelivered(log, "job_id", jobs.INGESTION_LOCK), tmp_path)
    # A job comes at 0, 4, 8 and 12 minutes.
    assert sorted((r.job_id, r.ts.minute) for r in got.collect()) == sorted((j, m) for j in range(3000) for m in (0, 12))
    assert {r.size for r in got.collect()} <= {r[2] for r in rows}
    assert held <= 2 * jobs.JOB_BUCKETS


def test_visitors_of_a_day_share_state(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(i % 2500, start + timedelta(hours=i // 2500)) for i in range(5000)] + [(None, start)] * 3
    visits = split_stream(spark.createDataFrame(rows, "user_id long, ts timestamp").withColumn("n", F.rand(1)), "n").drop("n")
    got, held = state_rows(usage.first_visits(visits), tmp_path)
    assert got.count() == 2501
    assert got.select("user_id").distinct().count() == 2501
    assert held <= 4 * (usage.USER_PARTS + 1)


def test_sessions_share_state(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(i % 3000, i, start + timedelta(minutes=i // 3000), "READY", f"f{i // 3000}.txt") for i in range(6000)]
    rows.append((None, None, start + timedelta(days=2), None, None))
    events = spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp, state string, file_name string")
    got, held = state_rows(uploads.session_lives(split_stream(events.coalesce(1), "state", 1)), tmp_path)
    ended = got.filter("kind = 'ended'").collect()
    assert sorted(r.session_id for r in ended) == list(range(3000))
    assert {(r.names, r.state, r.changed.minute) for r in ended} == {(2, "READY", 1)}
    assert held <= 3 * uploads.SESSION_BUCKETS


def test_waiting_answers_share_state(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    # Every session is busy from 0 on and READY after a minute; answers are asked at 59:30 and at 60:00.
    rows = [(s, start + timedelta(seconds=at), 10 * s + n, state) for s in range(400) for n, (at, state) in enumerate(
        [(3560, "EMBEDDING"), (3570, None), (3600, None), (3620, "READY")])]
    rows.append((None, start + timedelta(days=1), -1, None))
    events = split_stream(spark.createDataFrame(rows, "session_id long, ts timestamp, event_id long, state string"), "event_id", 1)
    answers = events.filter("state is null").select("session_id", F.col("ts").alias("asked_at"), F.col("event_id").alias("message_id"))
    states = events.filter("state is not null")
    got, held = state_rows(jobs.gate_stream(answers, states), tmp_path)
    assert got.count() == 800
    assert [tuple(r) for r in got.select("ready_at", "still_indexing", "late").distinct().collect()] == [
        (datetime(2024, 1, 1, 1, 0, 20), False, False)
    ]
    assert held <= 20 * jobs.GATE_PARTS


def test_stems_are_made_once_a_word(monkeypatch):
    made = []
    monkeypatch.setattr(terms, "stem", lambda w: made.append(w) or w[:2])
    rows = pa.array([["zz"], ["walks", "", "talks"], None, [], ["walks", "walks"]], pa.list_(pa.string())).slice(1)
    assert terms.stem_lists(rows).to_pylist() == [["wa", "", "ta"], None, [], ["wa", "wa"]]
    assert sorted(made) == ["", "talks", "walks"]
    assert terms.stem_lists(rows.slice(0, 0)).to_pylist() == []


def cover_brute(words, terms):
    spans = {(a, b) for a in range(len(words)) for b in range(a, len(words)) if set(terms) <= set(words[a : b + 1])}
    minimal = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return round(sum(0.1 / (1 + b - a + 1 - sum(w in terms for w in words[a : b + 1])) for a, b in minimal), 9)


def test_matches_of_common_terms_are_never_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 14))) for _ in range(150)] + [None, ""]
    chunks = spark.createDataFrame([(f"c{i:03d}", x) for i, x in enumerate(texts)], "vector_id string, content string")
    asked = [(i, " ".join(rng.choices("abcdefgh", k=3))) for i in range(120)] + [(900, "a b zzz"), (901, "a b")]
    queries = spark.createDataFrame(asked, "query_id int, text string")
    want = {}
    for key, question in asked:
        terms = sorted(set(question.split()))
        held = [(f"c{i:03d}", x.split()) for i, x in enumerate(texts) if x and set(terms) <= set(x.split())]
        if len(question.split()) >= 3:
            scored = sorted((-cover_brute(w, terms), c) for c, w in held)
            want |= {(key, c): (-s, n) for n, (s, c) in enumerate(scored[:4], 1)}
    path = str(tmp_path / "index")
    postings.add_postings(chunks, path, 0)
    for bound in (300_000, 100):
        monkeypatch.setattr(lexical, "MAX_BROADCAST_TERMS", bound)
        for found in (lexical.keyword_matches(queries, chunks, 4), postings.search(queries, path, 4)):
            assert {(r.query_id, r.vector_id): (r.density, r.rank) for r in found.collect()} == want
            # Words of a chunk are not dealt out to meet queries one by one.
            assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_an_indexed_batch_is_not_inverted_again(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "b a the b"), ("c2", None), ("c3", "A")], "vector_id string, content string")
    path = str(tmp_path / "index")
    assert postings.add_postings(chunks, path, 0, analyzer="english")
    held = {(r.term, r.chunk_id): r.places for r in manifest.read_table(spark, f"{path}/postings").collect()}
    # Stop words keep their places empty.
    assert held == {("b", "c1"): [0, 3]}
    assert {r.term: r.n for r in manifest.read_table(spark, f"{path}/counts").collect()} == {"b": 1}
    unread = chunks.withColumn("content", F.raise_error(F.lit("read again")).cast("string"))
    assert not postings.add_postings(unread, path, 0, analyzer="english")


def test_sources_are_compared_a_block_at_a_time():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(6_000, 4))
    targets = [[f"s{i % 7}"] if i % 2 else None for i in range(len(vectors))]
    held = dense._Queries(pa.array(range(len(vectors))), vectors, targets)
    rows = rng.normal(size=(4_096, 4))
    sources = [f"s{i % 5}" for i in range(len(rows))]
    part = pa.RecordBatch.from_arrays(
        [pa.array(range(len(rows))), pa.array(rows.tolist()), pa.array(sources)], names=["c", "v", "s"]
    )
    widths = []
    allowed = held.allowed
    held.allowed = lambda names, asked: widths.append(len(names) * len(asked)) or allowed(names, asked)
    leaders = dense._PivotLeaders(held, 3, 0.0, True)
    leaders.add(part)
    best = leaders.result(pa.int64()).to_pandas().groupby("_q")["_c"].apply(list)
    assert widths and max(widths) <= dense.CELLS
    scores = np.round(dense._unit(rows) @ held.unit.T, 9)
    for q in (0, 1, 3, 13, 4_001, 5_999):
        near = sorted((-scores[c, q], c) for c in range(len(rows)) if targets[q] in (None, [sources[c]]) and scores[c, q] >= 0)
        assert best.get(q, []) == [c for _, c in near[:3]]


def test_grams_are_told_apart_without_a_sort(monkeypatch):
    rng = np.random.default_rng(4)
    sorts = []
    unique = np.unique
    monkeypatch.setattr(quality_rules.np, "unique", lambda *a, **k: sorts.append(len(a[0])) or unique(*a, **k))
    top = 64**quality_rules.ORDER - 1
    code = np.concatenate([rng.integers(0, 5_000, 100_000), rng.integers(0, top, 9_000), [0, top]])
    every, place = quality_rules.distinct(code)
    want, at = unique(code, return_inverse=True)
    assert np.array_equal(every, want) and np.array_equal(place, at)
    # A text of a known language asks no other model.
    models = [quality_rules.Grams(*unique(rng.integers(0, top, 500), return_counts=True)) for _ in range(2)]
    data, starts, ends = flat.buffers(pa.array(["abc def " * 9_000, "Ghi " * 9_000, "x"]))
    sorts.clear()
    asked = []
    log2 = quality_rules.Grams.log2
    monkeypatch.setattr(quality_rules.Grams, "log2", lambda self, codes: asked.append(len(codes)) or log2(self, codes))
    _, _, mine, bits, _ = quality_rules._perplexity(data, starts, ends, np.array([0, 0, 1]), models)
    assert mine.tolist() == [0, 0, 1] and asked[1] <= 2 < asked[0]
    assert max(sorts) < 1 << 16
    _, _, likeliest, free, _ = quality_rules._perplexity(data, starts, ends, np.array([0, -1, 1]), models)
    assert free[0] == bits[0] and free[2] == bits[2] and likeliest[1] in (0, 1) and free[1] <= bits[1]


def test_queries_meet_no_chunks_of_sources_they_may_not_see():
    rng = np.random.default_rng(5)
    vectors, rows = rng.normal(size=(500, 8)), rng.normal(size=(900, 8))
    targets = [["nowhere"] if i % 5 else None for i in range(len(vectors))]
    part = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(rows.tolist()), pa.array(["s"] * 900)], names=["c", "v", "s"])
    leaders = dense._PivotLeaders(dense._Queries(pa.array(range(500)), vectors, targets), 3, 0.0, True)
    leaders.add(part)
    assert leaders.products <= 100 * 900
    best = leaders.result(pa.int64()).to_pandas().groupby("_q")["_c"].apply(list).to_dict()
    scores = np.round(dense._unit(vectors) @ dense._unit(rows).T, 9)
    assert best == {q: sorted(range(900), key=lambda c: (-scores[q, c], c))[:3] for q in range(0, 500, 5)}


def test_equal_queries_are_searched_once(spark, monkeypatch):
    asked = spark.range(60).select(
        F.col("id").alias("query_id"),
        F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("embedding"),
        F.when(F.col("id") % 2 == 1, F.array(F.lit("a"))).alias("targets"),
    )
    held = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 1.0], "b"), (3, [1.0, 1.0], "a")], "vector_id int, embedding array<double>, source_name string")
    written = {}
    write = dense.materialize
    monkeypatch.setattr(dense, "materialize", lambda df, label: written.setdefault(label, write(df, label)))
    found = dense.nearest_chunks(asked, held, 1, targets="targets", max_broadcast=10).collect()
    assert written["sought"].count() == 6
    want = {i: 1 if i % 3 == 0 else (3 if i % 2 else 2) for i in range(60)}
    assert {r.query_id: r.vector_id for r in found} == want


def test_both_rounds_share_a_keyword_search(spark, monkeypatch):
    chunks = spark.createDataFrame(
        [("v1", "red green blue", "a"), ("v2", "red green blue sky", "b")], "vector_id string, content string, source_name string"
    ).withColumns(
        {"source_type": F.lit("TEXT"), "session_id": F.lit(1), "chunk_index": F.lit(0), "image_url": F.lit(None).cast("string"),
         "source_url": F.lit(None).cast("string"), "embedding": F.array(F.lit(1.0), F.lit(0.0))}
    )
    plans = spark.createDataFrame(
        [(1, "p1", "red green blue", ["nowhere"], "RANKED_RETRIEVAL"), (2, "p2", "red green blue", ["gone"], "WHOLE_DOCUMENT")],
        "request_id int, plan_id string, query_text string, targets array<string>, mode string",
    ).withColumns(
        {"plan_pos": F.lit(0), "purpose": F.lit("p"), "question": F.col("query_text"), "target_documents": F.col("targets"),
         "entities": F.array().cast("array<string>"), "scope": F.lit("CORPUS"), "current_session_id": F.lit(1), "embedding": F.array(F.lit(0.0), F.lit(1.0))}
    )
    calls = []
    search = retrieval.keyword_matches
    monkeypatch.setattr(retrieval, "keyword_matches", lambda *a, **k: calls.append(1) or search(*a, **k))
    evidence, status = retrieval.retrieve_with_expansion(plans, chunks)
    assert len(calls) == 1
    # A whole-document plan that finds nothing is searched by its words as well.
    assert {(r.plan_id, r.vector_id) for r in evidence.collect()} == {(p, v) for p in ("p1", "p2") for v in ("v1", "v2")}
    assert {r.reason for r in status.collect()} <= {"NO_RESULTS", "LOW_CONFIDENCE", "NONE"}


def test_answers_share_state(spark, tmp_path):
    big = 2**53
    rows = [(big + i, n, "message", f"{i}-{n} ") for i in range(3000) for n in (1, 2)]
    rows += [(big + i, 3, "done" if i % 3 else "message", "") for i in range(3000)] + [(None, 1, "done", "")]
    events = spark.createDataFrame(rows, "message_id long, seq long, event string, data string")
    got, held = state_rows(tokens.assemble_stream(split_stream(events, "seq", 3)), tmp_path)
    want = {(big + i, f"{i}-1 {i}-2 ", "COMPLETED") for i in range(3000) if i % 3} | {(None, "", "COMPLETED")}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert held <= 4 * tokens.MESSAGE_BUCKETS


def test_quality_rules_read_a_text_in_few_passes(monkeypatch):
    """No table of all grams is scanned for a slice, and no words are sorted to find the few that repeat."""
    rng = np.random.default_rng(8)
    texts = ["", None, " A", "a b c d e f g h a b c d e f g h\n\na  B#", " ".join(rng.choice(["eins", "Zwei", "漢字", "#"], 30_000))]
    data, starts, ends = flat.buffers(pa.array(texts, pa.string()))
    scanned, placed = [], []
    nonzero, lexsort = np.flatnonzero, np.lexsort
    monkeypatch.setattr(quality_rules.np, "flatnonzero", lambda x: scanned.append(len(x)) or nonzero(x))
    monkeypatch.setattr(quality_rules.np, "lexsort", lambda keys: placed.append(len(keys[0])) or lexsort(keys))
    code, row = quality_rules.gram_codes(data, starts, ends)
    every, place = quality_rules.distinct(code)
    assert np.array_equal(every[place], code) and (np.diff(every) > 0).all()
    assert np.bincount(row).tolist()[:3] == [1, 1, 3]  # an end; an end, a shift and its letter
    got = quality_rules.base_counts(data, starts, ends)
    assert max(scanned) <= 2 * len(data) and max(placed) < 1_000
    assert got["n_words"].tolist() == [0, 0, 1, 18, 30_000] and got["n_repeat_words"].tolist()[:4] == [0, 0, 0, 17]
    assert got["n_symbols"].tolist()[:4] == [0, 0, 0, 1] and got["word_chars"].tolist()[:4] == [0, 0, 1, 19]


def test_texts_are_cut_into_terms_where_they_are_used(spark):
    """The same terms as Spark's pattern finds, without an array of words on the way."""
    rng = random.Random(11)
    odd = [chr(c) for c in (*range(0x300), 0x345, 0x3A3, 0x1E9E, 0x2028, 0x2167, 0x3007, 0xFFFD, 0x10400, 0x1D7CE, 0x1F600, 0x11F04, 0x31350)]
    kinds = [odd, [chr(c) for c in range(0x300)], list("aZ09 .\nİßª¼")]
    texts = ["", None, " ", "·", "A"]
    texts += ["".join(rng.choice(kinds[i % 3]) for _ in range(rng.choice([1, 2, 9, 80]))) for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", terms.terms_of(F.col("t")).alias("words"), terms.term_text(F.col("t")).alias("text")).orderBy("i").toArrow()
    for at in (0, 3):
        got = terms.term_lists(rows["text"].combine_chunks().slice(at)).to_pylist()
        assert got == [w or [] for w in rows["words"].to_pylist()[at:]]
    plan = df.select(hashed_terms(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan
    asked = spark.createDataFrame([(1, "aa bb aa cc")], "query_id int, text string")
    plan = lexical.keyword_matches(asked, df.select(F.col("i").alias("vector_id"), F.col("t").alias("content")), 3)._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan
