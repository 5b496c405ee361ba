"""Batch forms of the stream operators, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomlight.catalog import tables as t
from loomlight.catalog.registry import query
from loomlight.lineage import shared_folder
from loomlight.sources import manifest as mf
from loomlight.streaming import ingest as ig
from loomlight.streaming import jobs as jb
from loomlight.streaming import tokens as tk
from loomlight.streaming import uploads as up
from loomlight.streaming import usage as us


def job_events(spark, folder):
    """Events of a user as the status log of one job."""
    status = (
        F.when(F.col("event_type") == "click", "PROCESSING")
        .when(F.col("event_type") == "purchase", "COMPLETED")
        .when(F.col("event_type") == "error", "FAILED")
        .otherwise("QUEUED")
    )
    return t.table(spark, folder, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("seq"),
        status.alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        "ts",
    )


@query(
    "X2",
    sql="""
    WITH e AS (
      SELECT user_id AS job_id, event_id, event_type, props FROM events),
    l AS (
      SELECT job_id, arg_max(event_type, event_id) AS kind, arg_max(props, event_id) AS props,
        count(*) AS events FROM e GROUP BY 1)
    SELECT job_id, CASE kind WHEN 'click' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED'
        WHEN 'error' THEN 'FAILED' ELSE 'QUEUED' END AS status,
      CASE WHEN kind = 'purchase' THEN 100 ELSE 0 END AS progress,
      CASE WHEN kind = 'error' THEN props END AS error, events FROM l""",
)
def job_status(spark, folder):
    return jb.job_status(job_events(spark, folder))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(spark, folder, name):
    """A given table as a stream."""
    spark.conf.set(STATE_STORE, ROCKSDB)
    file = f"{name}.parquet"
    schema = spark.read.parquet(f"{folder}/{file}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def split_stream(rows, key, files=4):
    """A table as a stream of several files, one a batch; a key's rows share a file.

    Each file spans all times, so every batch after the first is late.
    """
    spark = rows.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    path = f"{shared_folder(spark)}/loomlight/split-{uuid.uuid4().hex}"
    rows.repartition(files, key).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


DISORDER_HOURS = 36


def disordered_stream(rows, ts, files=4):
    """A table as a stream in batches of time, with rows up to 36 hours out of place.

    A row's place is its time plus a drawn part of the disorder. A last row,
    null but for its time, closes the stream.
    """
    spark = rows.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    drawn = F.pmod(F.xxhash64(*rows.columns), F.lit(DISORDER_HOURS * 3600))
    placed = rows.withColumn("_place", F.unix_seconds(F.col(ts)) + drawn)
    low, high = placed.agg(F.min("_place"), F.max("_place")).first()
    after = F.col(ts) + F.expr(f"interval '{10 * DISORDER_HOURS}' hour")
    end = rows.agg(F.max(ts).alias(ts)).select(
        *[(after if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]
    )
    width = (high - low) // files + 1
    path = f"{shared_folder(spark)}/loomlight/split-{uuid.uuid4().hex}"
    # The file source reads older files first.
    for number in range(files):
        part = placed.filter(F.floor((F.col("_place") - low) / width) == number).drop("_place")
        part.repartition(1).write.mode("append").parquet(path)
    end.repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "X1",
    sql="""
    WITH RECURSIVE d AS (
      SELECT user_id || ' ' || strftime(ts, '%Y-%m-%d %H') AS job_id, ts FROM events),
    accepted(job_id, ts) AS (
      SELECT job_id, min(ts) FROM d GROUP BY 1
      UNION ALL
      SELECT a.job_id, min(d.ts) FROM accepted a JOIN d ON d.job_id = a.job_id
      WHERE d.ts >= a.ts + INTERVAL 10 MINUTE GROUP BY a.job_id)
    SELECT job_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS accepted_at FROM accepted""",
)
def accepted_deliveries(spark, folder):
    """A stream of deliveries: all of a user's events in an hour deliver one job."""
    hour = F.date_format("ts", "yyyy-MM-dd HH")
    deliveries = t.table(spark, folder, "events").select(
        F.concat_ws(" ", F.col("user_id").cast("string"), hour).alias("job_id"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    accepted = jb.drop_redelivered(split_stream(deliveries, "job_id"), "job_id", jb.INGESTION_LOCK)
    done = jb.finish(accepted, "deliveries")
    return done.select("job_id", t.stamp("ts").alias("accepted_at"))


@query(
    "A2",
    "X6",
    sql="""
    SELECT strftime(ts, '%Y-%m-%d') AS date, count(DISTINCT user_id) AS unique_visitors
    FROM events GROUP BY 1""",
)
def streamed_visitors(spark, folder):
    """First visits of a stream in four batches, counted per day; many come after retention."""
    events = t.table(spark, folder, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")
    )
    visits = split_stream(events, "event_id").drop("event_id")
    firsts = jb.finish(us.first_visits(visits, retention="1 day"), "visits")
    return us.daily_visitors(firsts).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "unique_visitors"
    )


@query(
    "X6",
    sql="""
    SELECT strftime(ts, '%Y-%m-%d') AS date,
      count(*) FILTER (event_type = 'click') AS chat_requests,
      count(*) FILTER (event_type = 'signup' AND value > 5) AS documents_uploaded,
      count(*) FILTER (event_type = 'purchase') AS pdf_exports,
      round(avg(value) FILTER (event_type = 'click'), 6) AS avg_response_ms
    FROM events GROUP BY 1""",
)
def streamed_counters(spark, folder):
    """Daily counters of a stream of outcomes in four batches; cheap signups count as failed uploads.

    Changed days are logged after every batch, and the newest row of a day counts.
    """
    kind = F.col("event_type")
    outcomes = split_stream(t.table(spark, folder, "events"), "event_id").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "click", "chat")
        .when(kind == "signup", "document")
        .when(kind == "purchase", "export")
        .otherwise("visit")
        .alias("kind"),
        ((kind != "signup") | (F.col("value") > 5)).alias("succeeded"),
        F.lit(0).alias("tokens"),
        F.col("value").alias("duration_ms"),
    )
    run = uuid.uuid4().hex
    table = f"{shared_folder(spark)}/loomlight/counters-{run}"
    jb.start(
        us.daily_counters(outcomes),
        f"counters-{run}",
        lambda rows, number: mf.upsert_rows(rows, table, "date", "counters", number),
        mode="update",
    ).awaitTermination()
    return mf.newest_rows(spark, table, "date").select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "chat_requests",
        "documents_uploaded",
        "pdf_exports",
        F.round("avg_response_ms", 6).alias("avg_response_ms"),
    )


TOKENS_SQL = r"""said AS (
  SELECT conv_id * 1000 + turn AS message_id, role, regexp_split_to_array(text, ' ') AS w
  FROM conversations),
tokens AS (
  SELECT message_id, unnest(w) || ' ' AS data, generate_subscripts(w, 1) AS seq FROM said),
token_events AS (
  SELECT message_id, seq, CASE data WHEN 'and ' THEN 'retry' WHEN 'un ' THEN 'retry'
    WHEN 'for ' THEN 'citations' ELSE 'message' END AS event, data FROM tokens
  UNION ALL
  SELECT message_id, len(w) + 1, CASE WHEN role = 'assistant' THEN 'done'
    WHEN role = 'system' THEN 'error' ELSE 'message' END, 'end' FROM said
  UNION ALL
  SELECT message_id, len(w) + 2, 'message', 'stray' FROM said)"""


def token_events(conversations):
    """Messages as token events: some words are retries or citations, answers end with done."""
    said = conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        "role",
        F.split("text", " ").alias("w"),
    )
    word = F.col("word")
    event = (
        F.when(word.isin("and", "un"), "retry").when(word == "for", "citations").otherwise("message")
    )
    words = said.select("message_id", F.posexplode("w").alias("at", "word")).select(
        "message_id",
        (F.col("at") + 1).cast("bigint").alias("seq"),
        event.alias("event"),
        F.concat("word", F.lit(" ")).alias("data"),
    )
    last = (
        F.when(F.col("role") == "assistant", "done")
        .when(F.col("role") == "system", "error")
        .otherwise("message")
    )
    size = F.size("w").cast("bigint")
    ends = said.select(
        "message_id", (size + 1).alias("seq"), last.alias("event"), F.lit("end").alias("data")
    )
    stray = said.select(
        "message_id",
        (size + 2).alias("seq"),
        F.lit("message").alias("event"),
        F.lit("stray").alias("data"),
    )
    return words.unionByName(ends).unionByName(stray)


@query(
    "X3",
    sql=f"""
    WITH {TOKENS_SQL}, bounds AS (
      SELECT message_id, min(seq) FILTER (event = 'done') AS done_at FROM token_events GROUP BY 1),
    kept AS (
      SELECT e.* FROM token_events e JOIN bounds b USING (message_id)
      WHERE done_at IS NULL OR seq < done_at),
    retried AS (SELECT message_id, max(seq) AS r FROM kept WHERE event = 'retry' GROUP BY 1)
    SELECT k.message_id, (seq - 1) // 1000 AS segment_no,
      string_agg(data, '' ORDER BY seq) AS text
    FROM kept k LEFT JOIN retried r ON r.message_id = k.message_id
    WHERE event = 'message' AND (r IS NULL OR seq > r) GROUP BY ALL""",
)
def assembled_answers(spark, folder):
    return tk.assembled_text(token_events(t.table(spark, folder, "conversations")))


@query(
    "X3",
    sql=f"""
    WITH {TOKENS_SQL}
    SELECT message_id, min(seq) FILTER (event = 'done') AS done_at,
      CASE WHEN count(*) FILTER (event = 'error') > 0 THEN 'FAILED'
        WHEN count(*) FILTER (event = 'done') > 0 THEN 'COMPLETED' ELSE 'PROCESSING' END AS status,
      arg_max(data, seq) FILTER (event = 'citations') AS citations_json
    FROM token_events GROUP BY 1""",
)
def answer_status(spark, folder):
    return tk.message_status(token_events(t.table(spark, folder, "conversations"))).select(
        "message_id", "done_at", "status", "citations_json"
    )


@query(
    "X3",
    sql=f"""
    WITH {TOKENS_SQL}, bounds AS (
      SELECT message_id, min(seq) AS done_at FROM token_events WHERE event = 'done' GROUP BY 1),
    kept AS (
      SELECT e.* FROM token_events e JOIN bounds b USING (message_id) WHERE seq < done_at),
    retried AS (SELECT message_id, max(seq) AS r FROM kept WHERE event = 'retry' GROUP BY 1)
    SELECT b.message_id, 'COMPLETED' AS status, coalesce(string_agg(data, '' ORDER BY seq)
      FILTER (event = 'message' AND (r IS NULL OR seq > r)), '') AS text
    FROM bounds b LEFT JOIN kept k USING (message_id) LEFT JOIN retried USING (message_id)
    GROUP BY 1""",
)
def streamed_answers(spark, folder):
    """Finished answers of a token stream in four batches, each with tokens of every answer."""
    events = token_events(t.table(spark, folder, "conversations"))
    return jb.finish(tk.assemble_stream(split_stream(events, "seq")), "answers")


@query(
    "X8",
    "W6",
    sql=f"""
    WITH RECURSIVE {t.CHUNKS_SQL}, owners AS (
      SELECT content_hash, arg_max(session_id, (uploaded_at, doc_id)) AS session_id FROM uploads GROUP BY 1)
    SELECT c.content_hash, o.session_id, c.chunk_index::INTEGER AS chunk_index, c.content
    FROM chunks c JOIN owners o USING (content_hash)""",
)
def streamed_ingestion(spark, folder):
    """Documents arriving in four batches, ingested into a chunk table; copies move it to their session."""
    arriving = t.uploads(spark, folder).withColumns(
        {"job_id": F.col("doc_id"), "ts": F.col("uploaded_at").cast("timestamp")}
    )
    run = uuid.uuid4().hex
    table = f"{shared_folder(spark)}/loomlight/streamed-{run}"
    ig.ingest_stream(split_stream(arriving, "doc_id"), table, f"ingest-{run}").awaitTermination()
    return ig.read_chunks(spark, table).select("content_hash", "session_id", "chunk_index", "content")


@query(
    "X4",
    sql="""
    SELECT user_id AS message_id, event_id AS seq, 0 AS part,
      CASE WHEN event_type = 'view' THEN 'RETRIEVAL' ELSE 'RANKING' END AS stage,
      'RUNNING' AS status, event_type AS message, (event_id % 3)::INTEGER AS iteration
    FROM events WHERE event_type NOT IN ('error', 'signup')
    UNION ALL
    SELECT user_id, event_id, part, 'RETRIEVAL', status, message, NULL
    FROM events, (VALUES (0, 'WARN', 'No sufficient evidence found'),
      (1, 'INFO', 'Expanding to entire knowledge base')) AS v(part, status, message)
    WHERE event_type = 'error'""",
)
def progress_notices(spark, folder):
    """Events as progress of a user's message: errors widen the search, signups are noise."""
    kind = F.col("event_type")
    stage = F.when(kind == "view", "RETRIEVAL").otherwise("RANKING")
    notice = F.to_json(
        F.struct(
            stage.alias("stage"),
            F.lit("RUNNING").alias("status"),
            kind.alias("message"),
            (F.col("event_id") % 3).alias("iteration"),
        )
    )
    widened = F.lit('{"type":"scope_expansion","from":"TARGET_DOCUMENTS","to":"GLOBAL_CORPUS"}')
    events = t.table(spark, folder, "events").select(
        F.col("user_id").alias("message_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "error", "scope_expansion").otherwise("progress").alias("event"),
        F.when(kind == "error", widened)
        .when(kind == "signup", F.lit("not json"))
        .otherwise(notice)
        .alias("data"),
    )
    return tk.progress_log(events)


@query(
    "X5",
    sql="""
    WITH e AS (
      SELECT user_id AS session_id, event_id, event_type, props, ts,
        lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    born AS (
      SELECT session_id, max(ts) AS born_at FROM e
      WHERE before IS NULL OR before + INTERVAL 5 MINUTE <= ts GROUP BY 1),
    s AS (
      SELECT session_id, arg_max(event_type, (ts, event_id)) AS kind,
        count(DISTINCT props) AS names FROM e JOIN born USING (session_id) WHERE ts >= born_at GROUP BY 1)
    SELECT session_id, CASE kind WHEN 'click' THEN 'EMBEDDING' WHEN 'view' THEN 'INGESTING'
      WHEN 'purchase' THEN 'READY' WHEN 'error' THEN 'FAILED' ELSE 'UPLOADING' END AS state, names
    FROM s""",
)
def upload_states(spark, folder):
    """Every session's state two minutes after its last event."""
    kind = F.col("event_type")
    state = (
        F.when(kind == "click", "EMBEDDING")
        .when(kind == "view", "INGESTING")
        .when(kind == "purchase", "READY")
        .when(kind == "error", "FAILED")
        .otherwise("UPLOADING")
    )
    events = t.table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"),
        "event_id",
        "ts",
        state.alias("state"),
        F.col("props").alias("file_name"),
    )
    ends = events.groupBy("session_id").agg(F.max("ts").alias("ended"))
    asked = F.col("ended") + F.expr("interval '2' minute")
    return up.upload_states(events.join(ends, "session_id"), asked).select(
        "session_id", "state", "names"
    )


@query(
    "X7",
    sql="""
    WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS as_of FROM events)
    SELECT event_id AS job_id,
      CASE WHEN ts <= as_of AND as_of < ts + INTERVAL 30 MINUTE THEN 'READY' ELSE 'QUEUED' END
        AS shown_status
    FROM events, m WHERE event_type = 'purchase'""",
)
def export_results(spark, folder):
    """Exports as a reader sees them ten minutes before the last event."""
    events = t.table(spark, folder, "events")
    as_of = events.agg(F.max("ts") - F.expr("interval '10' minute")).scalar()
    results = events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("job_id"), F.lit("READY").alias("status"),
        F.col("ts").alias("written_at"),
    )
    return jb.export_status(results, as_of).select("job_id", "shown_status")


GATE_SQL = """
    WITH s AS (
      SELECT user_id % 20 AS session_id, ts, event_id, CASE event_type WHEN 'view' THEN 'EMBEDDING'
        WHEN 'error' THEN 'INGESTING' ELSE 'READY' END AS state
      FROM events WHERE event_type IN ('view', 'error', 'signup')),
    a AS (
      SELECT event_id AS message_id, user_id, user_id % 20 AS session_id, ts
      FROM events WHERE event_type = 'click'),
    l AS (
      SELECT message_id, arg_max(state, (s.ts, event_id)) AS state
      FROM a JOIN s ON s.session_id = a.session_id AND s.ts <= a.ts
        AND s.ts > a.ts - INTERVAL 5 MINUTE GROUP BY 1),
    r AS (
      SELECT message_id, min(s.ts) AS ready_at
      FROM a JOIN s ON s.session_id = a.session_id AND state = 'READY' AND s.ts > a.ts
        AND s.ts <= a.ts + INTERVAL 120 SECOND GROUP BY 1)
    SELECT message_id, user_id AS session_id,
      CASE WHEN state IN ('EMBEDDING', 'INGESTING')
        THEN strftime(ready_at, '%Y-%m-%d %H:%M:%S') END AS ready_at,
      coalesce(state IN ('EMBEDDING', 'INGESTING'), false) AND ready_at IS NULL AS still_indexing
    FROM a LEFT JOIN l USING (message_id) LEFT JOIN r USING (message_id)"""


def gated_events(events):
    """(answers, upload states) of events, streaming or not: clicks are the answers.

    Views, errors and signups of the user's group are upload states. Rows
    without a type only close a stream.
    """
    session = (F.col("user_id") % 20).alias("session_id")
    kind = F.col("event_type")
    answers = events.filter((kind == "click") | kind.isNull()).select(
        F.concat_ws(" ", "event_id", "user_id").alias("message_id"), session, F.col("ts").alias("asked_at")
    )
    state = F.when(kind == "view", "EMBEDDING").when(kind == "error", "INGESTING").otherwise("READY")
    states = events.filter(kind.isin("view", "error", "signup")).select(
        session, "ts", "event_id", state.alias("state")
    )
    return answers, states


def gated(decided):
    parts = F.split("message_id", " ")
    return decided.select(
        parts[0].cast("bigint").alias("message_id"),
        parts[1].cast("bigint").alias("session_id"),
        t.stamp("ready_at").alias("ready_at"),
        "still_indexing",
    )


@query("J12", sql=GATE_SQL)
def ingestion_gate(spark, folder):
    return gated(jb.gate_on_ingestion(*gated_events(t.table(spark, folder, "events"))))


@query("J12", sql=GATE_SQL)
def streamed_ingestion_gate(spark, folder):
    """The same from a stream whose answers and states come out of order, in five batches."""
    events = t.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    answers, states = gated_events(disordered_stream(events, "ts"))
    decided = jb.gate_stream(answers, states, delay=f"{DISORDER_HOURS + 1} hours")
    return gated(jb.finish(decided, "gate"))


@query(
    "X5",
    "T5",
    sql="""
    WITH e AS (
      SELECT user_id AS session_id, event_id, event_type, ts,
        'File ' || (event_id % 4) || '-' || event_type || '.txt' AS file_name,
        'file ' || (event_id % 4) || ' ' || event_type AS spoken,
        lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    lives AS (
      SELECT *, sum(CASE WHEN before IS NULL OR before + INTERVAL 5 MINUTE <= ts THEN 1 ELSE 0 END)
        OVER (PARTITION BY session_id ORDER BY ts, event_id) AS life FROM e),
    ends AS (
      SELECT session_id, life, min(ts) AS began, max(ts) AS changed,
        arg_max(event_type, (ts, event_id)) AS kind,
        count(DISTINCT file_name) AS names FROM lives GROUP BY 1, 2),
    named AS (
      SELECT session_id, life, file_name, min((ts, event_id)) AS first_at,
        max((ts, event_id)) AS last_at, min(spoken) AS spoken
      FROM lives GROUP BY 1, 2, 3),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY session_id, life ORDER BY first_at) AS n FROM named),
    written AS (
      SELECT session_id, life, ['first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh',
        'eighth', 'ninth', 'tenth'][n] AS alias, file_name, first_at AS written_at FROM ranked WHERE n <= 10
      UNION ALL
      SELECT session_id, life, unnest(list_concat(['latest', 'last'], string_split(spoken, ' '))),
        file_name, last_at FROM ranked),
    aliases AS (
      SELECT session_id, life, alias, arg_max(file_name, written_at) AS file_name FROM written GROUP BY 1, 2, 3)
    SELECT session_id, strftime(began, '%Y-%m-%d %H:%M:%S') AS began,
      strftime(changed, '%Y-%m-%d %H:%M:%S') AS changed,
      CASE kind WHEN 'click' THEN 'EMBEDDING' WHEN 'view' THEN 'INGESTING'
        WHEN 'purchase' THEN 'READY' WHEN 'error' THEN 'FAILED' ELSE 'UPLOADING' END AS state,
      names, string_agg(alias || '=' || file_name, ',' ORDER BY alias) AS aliases
    FROM ends JOIN aliases USING (session_id, life) GROUP BY ALL""",
)
def streamed_session_lives(spark, folder):
    """Every life of a session's uploads, from events out of order, in five batches."""
    kind = F.col("event_type")
    state = (
        F.when(kind == "click", "EMBEDDING")
        .when(kind == "view", "INGESTING")
        .when(kind == "purchase", "READY")
        .when(kind == "error", "FAILED")
        .otherwise("UPLOADING")
    )
    number = (F.col("event_id") % 4).cast("string")
    events = t.table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        state.alias("state"),
        F.concat(F.lit("File "), number, F.lit("-"), kind, F.lit(".txt")).alias("file_name"),
    )
    stream = disordered_stream(events, "ts")
    lives = jb.finish(up.session_lives(stream, delay=f"{DISORDER_HOURS + 1} hours"), "lives")
    pairs = F.transform("aliases", lambda a: F.concat(a["alias"], F.lit("="), a["file_name"]))
    return lives.filter("kind = 'ended'").select(
        "session_id",
        t.stamp("began").alias("began"),
        t.stamp("changed").alias("changed"),
        "state",
        F.col("names").cast("bigint").alias("names"),
        F.array_join(pairs, ",").alias("aliases"),
    )


@query(
    "S8",
    sql="""
    SELECT event_id AS job_id, user_id, 'TEXT' AS source_type, user_id % 20 AS session_id
    FROM events WHERE event_type NOT IN ('view', 'error')""",
)
def ingestion_log(spark, folder):
    """Events as ingestion records; views carry no payload and errors a broken one."""
    kind = F.col("event_type")
    payload = F.to_json(
        F.struct(
            F.col("event_id").alias("jobId"),
            F.lit("TEXT").alias("sourceType"),
            (F.col("user_id") % 20).alias("sessionId"),
            F.col("user_id").alias("userId"),
        )
    )
    log = t.table(spark, folder, "events").select(
        F.when(kind == "error", F.lit("{broken")).when(kind != "view", payload).alias("payload"),
        "ts",
    )
    jobs, _ = jb.ingestion_jobs(log)
    return jobs.select("job_id", "user_id", "source_type", "session_id")


@query(
    "S9",
    sql="""
    SELECT conv_id * 1000 + turn AS message_id, conv_id AS session_id, text AS query,
      strftime(TIMESTAMP '2024-01-01' + turn * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS ts
    FROM conversations""",
)
def chat_log(spark, folder):
    """Messages as chat records of text fields."""
    millis = F.lit(1704067200000) + F.col("turn") * 1000
    log = t.table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("messageId"),
        F.col("conv_id").cast("string").alias("sessionId"),
        F.col("text").alias("query"),
        F.lit("").alias("model"),
        millis.cast("string").alias("timestamp"),
    )
    return jb.chat_jobs(log).select("message_id", "session_id", "query", t.stamp("ts").alias("ts"))


@query(
    "S10",
    sql="""
    SELECT 'job-' || event_id AS job_id, user_id AS session_id, user_id || '@x.example' AS user_email
    FROM events WHERE event_type = 'purchase'""",
)
def export_log(spark, folder):
    log = t.table(spark, folder, "events").filter("event_type = 'purchase'").select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("jobId"),
        F.col("user_id").cast("string").alias("sessionId"),
        F.concat(F.col("user_id").cast("string"), F.lit("@x.example")).alias("userEmail"),
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"),
    )
    return jb.export_jobs(log).select("job_id", "session_id", "user_email")
