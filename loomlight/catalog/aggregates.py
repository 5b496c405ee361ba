"""Aggregations over activity, attachments, citations and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlight.catalog import scalars as sc
from loomlight.catalog import tables as t
from loomlight.catalog.registry import query
from loomlight.operators import evidence as ev
from loomlight.operators import ownership as ow
from loomlight.operators import sessions as se
from loomlight.operators import usage as us

DAILY_SQL = """
    SELECT strftime(ts, '%Y-%m-%d') AS date, count(DISTINCT user_id) AS unique_visitors,
      count(*) FILTER (event_type = 'click') AS chat_requests,
      count(*) FILTER (event_type = 'signup') AS documents_uploaded,
      count(*) FILTER (event_type = 'purchase') AS pdf_exports,
      coalesce(sum(length(props)) FILTER (event_type = 'click'), 0)::BIGINT AS tokens_generated,
      round(coalesce(avg(value) FILTER (event_type = 'click'), 0), 6) AS avg_response_ms,
      count(*) FILTER (event_type = 'click') AS response_count
    FROM events GROUP BY 1"""


def _shown(daily):
    return daily.withColumn("date", F.date_format("date", "yyyy-MM-dd")).withColumn(
        "avg_response_ms", F.round("avg_response_ms", 6)
    )


@query("A1", "A3", sql=DAILY_SQL)
def daily_usage(spark, folder):
    return _shown(us.daily_usage(t.activity(spark, folder)))


@query("A1", "A3", sql=DAILY_SQL)
def daily_usage_merged(spark, folder):
    """Two batches of a day's activity added to each other.

    Visitors count in the batch of their first visit that day only.
    """
    rows = t.activity(spark, folder)
    firsts = rows.groupBy(F.to_date("ts").alias("day"), "user_id").agg(
        F.min("event_id").alias("event_id")
    )
    seen = rows.join(
        firsts.select("event_id", F.lit(True).alias("is_first")), "event_id", "left"
    ).withColumn("user_id", F.when(F.col("is_first"), F.col("user_id")))
    batches = [us.daily_usage(seen.filter(F.hour("ts") < 12)),
               us.daily_usage(seen.filter(F.hour("ts") >= 12))]
    return _shown(us.merge_daily(*batches))


@query(
    "A2",
    sql="""
    SELECT strftime(ts, '%Y-%m-%d') AS date, count(DISTINCT user_id) AS unique_visitors
    FROM events GROUP BY 1""",
)
def unique_visitors(spark, folder):
    daily = us.unique_visitors(t.activity(spark, folder))
    return daily.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "A2",
    sql="SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date, user_id FROM events",
)
def daily_visits(spark, folder):
    visits = us.daily_visits(t.activity(spark, folder))
    return visits.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "A5",
    sql=f"""
    WITH {t.ATTACHMENTS_SQL}
    SELECT coalesce(type, 'ALL') AS type, count(*) AS attachments
    FROM attachments GROUP BY ROLLUP (type)""",
)
def type_histogram(spark, folder):
    return us.type_histogram(t.attachments(spark, folder))


def cited_uploads(spark, folder):
    """Uploads of a session as the numbered citations of one message."""
    return t.uploads(spark, folder).select(
        F.col("session_id").alias("message_id"),
        F.col("doc_id").alias("citation_no"),
        t.source_name_of("file_name").alias("source_name"),
        F.when(F.col("doc_id") % 4 == 0, "WIKIPEDIA")
        .otherwise(F.col("source_type"))
        .alias("source_type"),
        (F.col("source_type") == "IMAGE").alias("is_image"),
    )


@query(
    "A6",
    sql=f"""
    WITH {t.UPLOADS_SQL}
    SELECT session_id AS message_id, source_name, count(*) AS citations,
           min(doc_id) AS first_no
    FROM uploads GROUP BY ALL""",
)
def citations_per_source(spark, folder):
    return ev.citations_per_source(
        cited_uploads(spark, folder), "message_id", "citation_no", "source_name"
    )


@query(
    "A7",
    sql=f"""
    WITH {t.UPLOADS_SQL}, c AS (
      SELECT session_id AS message_id, doc_id % 4 = 0 AS wiki, source_type = 'IMAGE' AS image
      FROM uploads)
    SELECT message_id, count(*) AS "all", count(*) FILTER (NOT wiki AND NOT image) AS docs,
      count(*) FILTER (image) AS images, count(*) FILTER (wiki) AS wiki
    FROM c GROUP BY 1""",
)
def citation_tabs(spark, folder):
    return ev.citation_tabs(cited_uploads(spark, folder), "message_id", "source_type", "is_image")


@query(
    "A8",
    sql=f"WITH {t.UPLOADS_SQL} SELECT DISTINCT source_name FROM uploads",
)
def distinct_sources(spark, folder):
    named = t.uploads(spark, folder).select(t.source_name_of("file_name").alias("source_name"))
    return us.distinct_sources(named)


@query(
    "A9",
    sql=sc.ANCHORED_SQL
    + """
    SELECT session_id, count(*) AS messages FROM anchored GROUP BY 1 HAVING count(*) >= 20""",
)
def sessions_at_cap(spark, folder):
    """Sessions that reached a cap of twenty messages, upload anchors included."""
    return se.sessions_at_cap(sc.anchored_messages(spark, folder), 20)


# Every upload as evidence for its session, scored from its size.
SCORED_SQL = (
    t.UPLOADS_SQL
    + """,
evidence AS (
  SELECT session_id AS request_id, doc_id AS position, doc_id, source_name, source_type,
    text AS content, image_url, source_url, doc_id % 3 AS chunk_index,
    CASE WHEN session_id % 9 = 0 OR doc_id % 6 = 0 THEN 0.0
         ELSE file_size_bytes % 1009 / 1009.0::DOUBLE END AS final_score,
    CASE WHEN session_id % 9 = 0 THEN 0.0
         ELSE file_size_bytes % 499 / 998.0::DOUBLE END AS semantic_score,
    doc_id % 97 = 0 AS whole_document_match,
    CASE session_id % 3 WHEN 0 THEN 'UNION' WHEN 1 THEN 'COMPARE' ELSE 'NONE' END AS merge_op,
    CASE WHEN doc_id % 5 > 0 THEN 'part ' || doc_id % 5 END AS purpose
  FROM files),
effective AS (
  SELECT *, CASE WHEN final_score = 0.0 THEN semantic_score ELSE final_score END AS score
  FROM evidence),
per_source AS (
  SELECT request_id, source_name, max(score) AS source_best,
    bool_or(whole_document_match) AS whole, min(position) AS source_first
  FROM effective GROUP BY ALL),
relevant AS (
  SELECT request_id, source_name, source_first FROM (
    SELECT *, greatest(max(source_best) OVER (PARTITION BY request_id), 0.0) AS best,
      count(*) OVER (PARTITION BY request_id) AS sources FROM per_source)
  WHERE sources = 1 OR whole OR best <= 0 OR source_best >= 0.3::DOUBLE * best)"""
)


def upload_evidence(spark, folder):
    size = F.col("file_size_bytes")
    doc, session = F.col("doc_id"), F.col("session_id")
    silent = session % 9 == 0
    return t.uploads(spark, folder).select(
        session.alias("request_id"),
        doc.alias("position"),
        "doc_id",
        t.source_name_of("file_name").alias("source_name"),
        "source_type",
        F.col("text").alias("content"),
        "image_url",
        "source_url",
        (doc % 3).cast("int").alias("chunk_index"),
        F.when(silent | (doc % 6 == 0), 0.0).otherwise(size % 1009 / 1009.0).alias("final_score"),
        F.when(silent, 0.0).otherwise(size % 499 / 998.0).alias("semantic_score"),
        (doc % 97 == 0).alias("whole_document_match"),
        F.when(session % 3 == 0, "UNION")
        .when(session % 3 == 1, "COMPARE")
        .otherwise("NONE")
        .alias("merge_op"),
        F.when(doc % 5 > 0, F.concat(F.lit("part "), (doc % 5).cast("string"))).alias("purpose"),
    )


@query(
    "A10",
    sql=f"""
    WITH {SCORED_SQL}
    SELECT e.request_id, e.doc_id, r.source_first
    FROM evidence e JOIN relevant r USING (request_id, source_name)""",
)
def relevant_evidence(spark, folder):
    kept = ev.filter_to_relevant_sources(upload_evidence(spark, folder))
    return kept.select("request_id", "doc_id", "source_first")


@query(
    "A11",
    "J9",
    sql=f"""
    WITH {t.ATTACHMENTS_SQL}
    SELECT attachment_id, count(*) OVER (PARTITION BY url) AS owner_count FROM attachments""",
)
def owner_counts(spark, folder):
    counted = ow.owner_counts(t.attachments(spark, folder))
    return counted.select("attachment_id", "owner_count")


@query(
    "A11",
    sql=f"""
    WITH {t.ATTACHMENTS_SQL}, o AS (
      SELECT *, count(*) OVER (PARTITION BY url) AS n FROM attachments)
    SELECT attachment_id, url, n <= 1 AS fully_deleted, n AS owner_count,
      CASE WHEN n <= 1 THEN 'File removed for everyone — no other user had it.'
           ELSE 'Removed from your Explore list. Kept — ' || (n - 1)
             || ' other user(s) still have this file.' END AS message
    FROM o WHERE user_id = attachment_id % 11 % 7""",
)
def deletion_decisions(spark, folder):
    """Every attachment requested by a caller who often is not its owner."""
    owned = t.attachments(spark, folder)
    requested = owned.select("attachment_id", (F.col("attachment_id") % 11 % 7).alias("user_id"))
    return ow.deletion_decisions(requested, owned)


@query(
    "A12",
    sql=f"""
    WITH {SCORED_SQL}, g AS (
      SELECT request_id, coalesce(purpose, 'General Retrieval') AS purpose,
        min(position) AS group_first, count(*) AS rows FROM evidence GROUP BY ALL)
    SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY group_first))::INTEGER
      AS group_no FROM g""",
)
def purpose_groups(spark, folder):
    return ev.purpose_groups(upload_evidence(spark, folder))


@query(
    "A13",
    sql=f"""
    WITH {t.UPLOADS_SQL}
    SELECT session_id, substr(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10)
      ORDER BY uploaded_at, doc_id), 1, 12000) AS text
    FROM uploads WHERE regexp_matches(text, '\\S') GROUP BY 1""",
)
def session_texts(spark, folder):
    return se.session_texts(t.uploads(spark, folder))
