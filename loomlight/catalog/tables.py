"""The given tables seen as domain tables, in Spark and in SQL.

Documents stand for uploads, conversations for messages and sessions, events
for activity, benchmark texts for questions. Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.functions.text import content_hash, normalize_source_name, short_title
from loomlight.lineage import materialize
from loomlight.partitioning import spread
from loomlight.plans.ingest import ingest
from loomlight.sources.writers import route_uploads

USERS = 7
UPLOAD_SESSIONS = 50
FILES = "https://files.example/"
ASSETS = "https://assets.example/"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, dealt to all cores when they come in few splits."""
    return spread(table(spark, folder, "documents"))


def minutes_after_start(minutes: str):
    return F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + ({minutes}) * interval '1' minute")


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as uploads, with text."""
    return uploads_from(documents(spark, folder))


def uploads_from(docs: DataFrame) -> DataFrame:
    mime = (
        F.when(F.col("lang") == "en", "text/plain")
        .when(F.col("lang") == "fr", "Application/PDF")
        .when(F.col("lang") == "de", "image/png")
        .otherwise("application/octet-stream")
    )
    rows = docs.select(
        "doc_id",
        (F.col("doc_id") % USERS).alias("user_id"),
        (F.col("doc_id") % UPLOAD_SESSIONS).alias("session_id"),
        F.concat("source", F.lit("_"), "lang", F.lit("-Notes.txt")).alias("file_name"),
        mime.alias("mime_type"),
        F.col("n_chars").alias("file_size_bytes"),
        minutes_after_start("doc_id").alias("uploaded_at"),
        content_hash(F.col("text")).alias("content_hash"),
        "text",
        "lang",
        "source",
    )
    return (
        route_uploads(rows)
        .withColumnRenamed("type", "source_type")
        .withColumn("source_url", F.concat(F.lit(FILES), F.substring("content_hash", 1, 16)))
        .withColumns(
            {
                "enriched_file_name": F.concat("lang", F.lit(" "), "file_name"),
                "asset_classification": F.when(F.col("source_type") == "IMAGE", "photo"),
                "asset_tags": F.concat("lang", F.lit(","), "source"),
            }
        )
        .drop("lang", "source")
        .withColumn(
            "image_url",
            F.when(
                F.col("source_type") == "IMAGE",
                F.concat(F.lit(ASSETS), F.col("doc_id").cast("string"), F.lit(".png")),
            ),
        )
    )


UPLOADS_SQL = r"""uploads AS (
  SELECT doc_id, doc_id % 7 AS user_id, doc_id % 50 AS session_id,
         source || '_' || lang || '-Notes.txt' AS file_name,
         lower(source || ' ' || lang || ' notes') AS source_name,
         CASE lang WHEN 'en' THEN 'text/plain' WHEN 'fr' THEN 'Application/PDF'
              WHEN 'de' THEN 'image/png' ELSE 'application/octet-stream' END AS mime_type,
         CASE lang WHEN 'en' THEN 'TEXT' WHEN 'fr' THEN 'PDF'
              WHEN 'de' THEN 'IMAGE' ELSE 'OTHER' END AS source_type,
         n_chars AS file_size_bytes,
         TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS uploaded_at,
         sha256(regexp_replace(regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'),
                               '\s+', ' ', 'g')) AS content_hash,
         text, lang, source
  FROM documents),
files AS (
  SELECT *, 'https://files.example/' || substr(content_hash, 1, 16) AS source_url,
         CASE WHEN source_type = 'IMAGE'
              THEN 'https://assets.example/' || doc_id || '.png' END AS image_url,
         lang || ' ' || file_name AS enriched_file_name,
         CASE WHEN source_type = 'IMAGE' THEN 'photo' END AS asset_classification,
         lang || ',' || source AS asset_tags
  FROM uploads)"""


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads as attachment rows; copies of a content share its url."""
    return uploads(spark, folder).select(
        F.col("doc_id").alias("attachment_id"),
        "user_id",
        "session_id",
        F.col("source_type").alias("type"),
        "file_name",
        F.col("source_url").alias("url"),
        "mime_type",
        "file_size_bytes",
        "uploaded_at",
    )


ATTACHMENTS_SQL = (
    UPLOADS_SQL
    + """,
attachments AS (
  SELECT doc_id AS attachment_id, user_id, session_id, source_type AS type, file_name,
         source_url AS url, mime_type, file_size_bytes, uploaded_at
  FROM files)"""
)


def view_attachments(spark: SparkSession, folder: str) -> DataFrame:
    return attachments(spark, folder).select(
        "session_id", "attachment_id", F.col("uploaded_at").alias("added_at")
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as messages, a minute apart, session after session."""
    return table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.col("conv_id").alias("session_id"),
        F.upper("role").alias("role"),
        F.col("text").alias("content"),
        minutes_after_start("conv_id * 60 + turn").alias("created_at"),
        "turn",
    )


MESSAGES_SQL = """messages AS (
  SELECT conv_id * 1000 + turn AS message_id, conv_id AS session_id, upper(role) AS role,
         text AS content,
         TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 60 + turn) * INTERVAL 1 MINUTE
           AS created_at,
         turn
  FROM conversations)"""


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """One session per conversation, titled by its first message."""
    said = messages(spark, folder)
    return said.groupBy("session_id").agg(
        (F.col("session_id") % USERS).alias("user_id"),
        short_title(F.min_by("content", "turn")).alias("title"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
    )


SESSIONS_SQL = (
    MESSAGES_SQL
    + """,
sessions AS (
  SELECT session_id, session_id % 7 AS user_id,
         CASE WHEN length(arg_min(content, turn)) <= 40 THEN arg_min(content, turn)
              ELSE substr(arg_min(content, turn), 1, 40) || '…' END AS title,
         min(created_at) AS created_at, max(created_at) AS updated_at
  FROM messages GROUP BY session_id)"""
)


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """Events as activity: clicks are chats, signups documents, purchases exports."""
    kind = (
        F.when(F.col("event_type") == "click", "chat")
        .when(F.col("event_type") == "signup", "document")
        .when(F.col("event_type") == "purchase", "export")
        .when(F.col("event_type") == "error", "failure")
        .otherwise("visit")
    )
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        kind.alias("kind"),
        F.length("props").cast("bigint").alias("tokens"),
        F.col("value").alias("duration_ms"),
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table of all uploads, written once per call."""
    made, _ = ingest(uploads(spark, folder))
    return materialize(made, "chunks")


# Cut points of every text by recursion: a row per chunk start.
CHUNKS_SQL = (
    UPLOADS_SQL
    + r""",
chosen AS (
  SELECT content_hash, arg_min(doc_id, (uploaded_at, doc_id)) AS doc_id,
         arg_max(session_id, (uploaded_at, doc_id)) AS owner_session
  FROM files WHERE regexp_matches(text, '\S') GROUP BY content_hash),
texts AS (
  SELECT f.*, c.owner_session FROM files f JOIN chosen c ON f.doc_id = c.doc_id),
cuts(doc_id, start, n, span_start, span_stop) AS (
  SELECT doc_id, 0, length(text), -1, -1 FROM texts
  UNION ALL
  SELECT doc_id, CASE WHEN stop - 200 > here THEN stop - 200 ELSE stop END, n, here, stop
  FROM (
    SELECT doc_id, n, here,
      CASE WHEN here + 1000 >= n THEN n
           WHEN para >= 402 THEN here + para
           WHEN sent >= 400 THEN here + sent
           WHEN line >= 400 THEN here + line
           WHEN gap >= 400 THEN here + gap
           ELSE here + 1000 END AS stop
    FROM (
      SELECT c.doc_id, c.n, c.start AS here,
        length(regexp_extract(substr(t.text, c.start + 1, 1002), '(?s)^(.*\n\n)', 1)) AS para,
        length(regexp_extract(substr(t.text, c.start + 1, 1001), '(?s)^(.*[.!?])\s', 1)) AS sent,
        length(regexp_extract(substr(t.text, c.start + 1, 1001), '(?s)^(.*)\n', 1)) AS line,
        length(regexp_extract(substr(t.text, c.start + 1, 1001), '(?s)^(.*) ', 1)) AS gap
      FROM cuts c JOIN texts t ON c.doc_id = t.doc_id WHERE c.start < c.n))),
pieces AS (
  SELECT c.doc_id, c.span_start AS start,
    regexp_replace(substr(t.text, c.span_start + 1, c.span_stop - c.span_start),
                   '^\s+|\s+$', '', 'g') AS content
  FROM cuts c JOIN texts t ON c.doc_id = t.doc_id WHERE c.span_stop >= 0),
emitted AS (
  SELECT doc_id, start, content FROM (
    SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY start) AS previous
    FROM pieces WHERE content <> '')
  WHERE previous IS NULL OR previous <> content),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index,
         count(*) OVER (PARTITION BY doc_id) AS total_chunks
  FROM emitted),
chunks AS (
  SELECT t.content_hash || '-' || lpad(n.chunk_index::VARCHAR, 6, '0') AS vector_id,
         t.content_hash, t.owner_session AS session_id, t.source_name, t.source_type,
         t.file_name AS original_file_name, t.enriched_file_name, t.asset_classification,
         t.asset_tags, t.image_url, t.source_url,
         n.chunk_index, n.total_chunks, n.content, t.doc_id
  FROM numbered n JOIN texts t ON n.doc_id = t.doc_id)"""
)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts as questions with a session, a named source and entities."""
    item = F.col("item_id")
    named = F.concat(F.lit("src"), (item % 20).cast("string"))
    return table(spark, folder, "benchmark").select(
        item.alias("request_id"),
        F.lit(0).alias("plan_pos"),
        item.cast("string").alias("plan_id"),
        F.lit("Retrieval").alias("purpose"),
        F.lit(None).cast("string").alias("optimized_query"),
        F.col("text").alias("question"),
        F.when(item % 2 == 1, F.array(F.concat(named, F.lit("_en-Notes.txt"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("target_documents"),
        F.array(named).alias("entities"),
        F.lit("RANKED_RETRIEVAL").alias("mode"),
        F.lit("CORPUS").alias("scope"),
        (item % UPLOAD_SESSIONS).alias("session_id"),
    )


QUESTIONS_SQL = r"""questions AS (
  SELECT item_id AS request_id, item_id::VARCHAR AS plan_id, text AS question,
         regexp_replace(lower(text), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS query_text,
         CASE WHEN item_id % 2 = 1 THEN 'src' || (item_id % 20) || ' en notes' END AS target,
         'src' || (item_id % 20) AS entity,
         item_id % 50 AS session_id
  FROM benchmark)"""


def source_name_of(file_name: str):
    return normalize_source_name(F.col(file_name))
