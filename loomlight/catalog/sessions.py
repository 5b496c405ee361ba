"""Histories, transcripts, listings, ownership and aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlight.catalog import scalars as sc
from loomlight.catalog import tables as t
from loomlight.catalog.registry import query
from loomlight.operators import aliases as al
from loomlight.operators import dedup as de
from loomlight.operators import ownership as ow
from loomlight.operators import sessions as se


@query(
    "W3",
    sql=f"""
    WITH {t.MESSAGES_SQL}, r AS (
      SELECT *, row_number() OVER (PARTITION BY session_id
        ORDER BY created_at DESC, message_id DESC) AS recency FROM messages)
    SELECT session_id, regexp_replace(string_agg(
      CASE WHEN role = 'USER' THEN 'User' ELSE 'Assistant' END || ': ' || content, chr(10)
      ORDER BY recency DESC), {sc.TRIM}) AS history
    FROM r WHERE recency <= 10 GROUP BY 1""",
)
def history_blocks(spark, folder):
    return se.history_blocks(t.messages(spark, folder))


@query(
    "W4",
    sql=rf"""
    WITH {t.MESSAGES_SQL}, r AS (
      SELECT session_id, role, regexp_replace(content, {sc.TRIM}) AS content,
        row_number() OVER (PARTITION BY session_id
          ORDER BY created_at DESC, message_id DESC) AS recency FROM messages)
    SELECT session_id, regexp_replace(string_agg(
      CASE WHEN role = 'USER' THEN 'User' ELSE 'Assistant' END || ': ' || content, chr(10)
      ORDER BY recency DESC), {sc.TRIM}) AS history
    FROM r WHERE recency <= 6 AND content <> '' GROUP BY 1""",
)
def follow_up_blocks(spark, folder):
    return se.follow_up_blocks(t.messages(spark, folder))


@query(
    "P22",
    sql=sc.ANCHORED_SQL
    + rf"""
    SELECT session_id, substr(string_agg(
      CASE WHEN role = 'USER' THEN 'User' ELSE 'Assistant' END || ': '
        || regexp_replace(content, {sc.TRIM}), chr(10) ORDER BY created_at, message_id),
      1, 18000) AS conversation
    FROM anchored WHERE regexp_matches(content, '\S')
      AND NOT starts_with(content, '[file upload:') GROUP BY 1""",
)
def summary_inputs(spark, folder):
    return se.summary_inputs(sc.anchored_messages(spark, folder))


@query(
    "S12",
    "P32",
    sql=sc.ANCHORED_SQL
    + rf"""
    , lines AS (
      SELECT session_id, created_at, message_id, CASE
        WHEN role = 'USER' AND starts_with(content, '[file upload:')
          THEN '📎 *' || content || '*' || chr(10) || chr(10)
        ELSE '### ' || CASE WHEN role = 'USER' THEN 'You' WHEN role = 'ASSISTANT' THEN 'Assistant'
               ELSE role END || chr(10) || content || chr(10) || chr(10) END AS line
      FROM anchored WHERE regexp_matches(content, '\S')),
    placed AS (
      SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY created_at, message_id) - 1)
        // 100 AS segment_no FROM lines),
    bodies AS (
      SELECT session_id, segment_no, string_agg(line, '' ORDER BY created_at, message_id) AS body
      FROM placed GROUP BY ALL),
    heads AS (
      SELECT session_id, min(created_at) AS created_at, arg_min(content, turn) AS first_text
      FROM messages GROUP BY 1)
    SELECT h.session_id, coalesce(b.segment_no, 0) AS segment_no,
      CASE WHEN coalesce(b.segment_no, 0) = 0 THEN '# '
        || CASE WHEN length(first_text) <= 40 THEN first_text
                ELSE substr(first_text, 1, 40) || '…' END
        || chr(10) || chr(10) || '**Created:** ' || strftime(h.created_at, '%Y-%m-%d %H:%M:%S')
        || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Session Summary'
        || chr(10) || chr(10) || 'No summary available for this session.'
        || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END
        || coalesce(body, '') AS text
    FROM heads h LEFT JOIN bodies b USING (session_id)""",
)
def transcripts(spark, folder):
    """Markdown transcripts of every session, upload anchors included."""
    head = t.sessions(spark, folder).withColumn("summary", F.lit(None).cast("string"))
    return se.transcripts(head, sc.anchored_messages(spark, folder))


@query(
    "J3",
    sql=f"""
    WITH {t.ATTACHMENTS_SQL}
    SELECT session_id, attachment_id, file_name,
      strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS added_at
    FROM attachments ORDER BY session_id, uploaded_at DESC, attachment_id DESC""",
)
def session_attachments(spark, folder):
    """Attachments of each session, the one added last first."""
    listed = se.session_attachments(
        t.view_attachments(spark, folder), t.attachments(spark, folder)
    )
    return listed.select("session_id", "attachment_id", "file_name", t.stamp("added_at").alias("added_at"))


@query(
    "J4",
    sql=f"""
    WITH {t.SESSIONS_SQL}
    SELECT message_id, session_id FROM messages
    WHERE session_id IN (SELECT session_id FROM sessions WHERE user_id = 3)""",
)
def owned_messages(spark, folder):
    owned = se.owned_rows(t.messages(spark, folder), t.sessions(spark, folder), 3)
    return owned.select("message_id", "session_id")


@query(
    "K7",
    sql=f"""
    WITH {t.ATTACHMENTS_SQL}
    SELECT attachment_id, user_id, file_name FROM attachments
    ORDER BY uploaded_at DESC, attachment_id DESC""",
)
def newest_attachments(spark, folder):
    listed = se.newest_first(t.attachments(spark, folder))
    return listed.select("attachment_id", "user_id", "file_name")


@query(
    "K8",
    sql=f"""
    WITH {t.ATTACHMENTS_SQL}, r AS (
      SELECT attachment_id, user_id, row_number() OVER (PARTITION BY user_id
        ORDER BY uploaded_at DESC, attachment_id DESC) AS listing_rank,
        count(*) OVER (PARTITION BY user_id) AS total FROM attachments)
    SELECT attachment_id, user_id, listing_rank::INTEGER AS listing_rank,
      (listing_rank - 1) // 24 + 1 AS page_no, total > 48 AS has_more
    FROM r WHERE listing_rank <= 48""",
)
def listing_pages(spark, folder):
    """The first two pages of every user's listing."""
    pages = se.listing_pages(t.attachments(spark, folder), pages=2)
    return pages.select("attachment_id", "user_id", "listing_rank", "page_no", "has_more")


@query(
    "K9",
    sql=f"""
    WITH {t.SESSIONS_SQL}
    SELECT session_id, title, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM sessions ORDER BY updated_at DESC, session_id DESC""",
)
def recent_sessions(spark, folder):
    listed = se.recent_sessions(t.sessions(spark, folder))
    return listed.select("session_id", "title", t.stamp("updated_at").alias("updated_at"))


@query(
    "J14",
    sql=f"""
    WITH {t.ATTACHMENTS_SQL}, {t.MESSAGES_SQL}, gone AS (
      SELECT DISTINCT session_id FROM messages WHERE role = 'SYSTEM')
    SELECT 'message' AS kind, message_id AS id, session_id FROM messages
    WHERE session_id NOT IN (FROM gone)
    UNION ALL
    SELECT 'listing', attachment_id, session_id FROM attachments
    WHERE session_id NOT IN (FROM gone)
    UNION ALL
    SELECT 'attachment', attachment_id,
      CASE WHEN session_id NOT IN (FROM gone) THEN session_id END FROM attachments""",
)
def session_deletion(spark, folder):
    """Sessions with a system message are deleted: what remains of the three tables."""
    said = t.messages(spark, folder)
    gone = said.filter("role = 'SYSTEM'").select("session_id")
    left = se.delete_sessions(
        gone, said, t.view_attachments(spark, folder), t.attachments(spark, folder)
    )
    kinds = [("message", "message_id"), ("listing", "attachment_id"), ("attachment", "attachment_id")]
    parts = [
        rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "session_id")
        for rows, (kind, key) in zip(left, kinds)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "W5",
    sql=f"""
    WITH {t.ATTACHMENTS_SQL}, r AS (
      SELECT *, row_number() OVER (PARTITION BY url, user_id
        ORDER BY uploaded_at, attachment_id) AS n FROM attachments)
    SELECT url, user_id, attachment_id FROM r WHERE n = 1""",
)
def first_uploads_by_user(spark, folder):
    firsts = ow.first_uploads(t.attachments(spark, folder), ["url", "user_id"])
    return firsts.select("url", "user_id", "attachment_id")


@query(
    "W5",
    sql=f"""
    WITH {t.ATTACHMENTS_SQL}
    SELECT url, arg_min(attachment_id, (uploaded_at, attachment_id)) AS attachment_id
    FROM attachments GROUP BY 1""",
)
def first_uploads_by_url(spark, folder):
    firsts = ow.first_uploads(t.attachments(spark, folder), ["url"])
    return firsts.select("url", "attachment_id")


@query(
    "J10",
    sql=f"""
    WITH RECURSIVE {t.CHUNKS_SQL}, gone AS (
      SELECT source_url FROM files GROUP BY source_url HAVING count(*) = 1)
    SELECT vector_id, source_url IN (FROM gone) AS purged FROM chunks""",
)
def purged_chunks(spark, folder):
    """Chunks after everybody deletes every file once: sole owners purge theirs."""
    owned = t.attachments(spark, folder)
    decisions = ow.deletion_decisions(owned.select("attachment_id", "user_id"), owned)
    purged, kept = ow.purge_chunks(t.chunks(spark, folder), decisions)
    return purged.withColumn("purged", F.lit(True)).unionByName(
        kept.select("vector_id", F.lit(False).alias("purged"))
    )


# The earlier half of the uploads, by time, counts as the corpus.
HALVES_SQL = (
    t.UPLOADS_SQL
    + """,
middle AS (SELECT avg(doc_id) AS m FROM uploads),
stored AS (SELECT * FROM files, middle WHERE doc_id < m),
incoming AS (SELECT * FROM files, middle WHERE doc_id >= m)"""
)


def halves(spark, folder):
    every = t.uploads(spark, folder)
    middle = every.agg(F.avg("doc_id")).scalar()
    return every.filter(F.col("doc_id") < middle), every.filter(F.col("doc_id") >= middle)


@query(
    "J2",
    sql=f"""
    WITH {HALVES_SQL}
    SELECT doc_id, content_hash IN (SELECT content_hash FROM stored) AS known FROM incoming""",
)
def known_content(spark, folder):
    """Which of the later uploads hold content the earlier ones already brought."""
    stored, incoming = halves(spark, folder)
    fresh, seen = de.split_by_known(incoming, stored)
    return fresh.select("doc_id", F.lit(False).alias("known")).unionByName(
        seen.select("doc_id", F.lit(True).alias("known"))
    )


@query(
    "W6",
    sql=f"""
    WITH {HALVES_SQL}, newest AS (
      SELECT content_hash, arg_max(session_id, (uploaded_at, doc_id)) AS session_id
      FROM incoming GROUP BY 1)
    SELECT s.doc_id, coalesce(n.session_id, s.session_id) AS session_id
    FROM stored s LEFT JOIN newest n USING (content_hash)""",
)
def repointed_uploads(spark, folder):
    """Earlier content moves to the newest session that uploads it again."""
    stored, incoming = halves(spark, folder)
    return de.repoint_chunks(stored, incoming).select("doc_id", "session_id")


ALIAS_SQL = (
    t.UPLOADS_SQL
    + """,
names AS (
  SELECT session_id, file_name, any_value(source_name) AS source_name,
    min((uploaded_at, doc_id)) AS first_at, max((uploaded_at, doc_id)) AS last_at
  FROM uploads GROUP BY session_id, file_name),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_at) AS ordinal FROM names),
words AS (
  SELECT *, ['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth']
    [ordinal] AS word FROM ranked WHERE ordinal <= 10),
written AS (
  SELECT session_id, word AS alias, file_name, first_at AS written_at FROM words
  UNION ALL
  SELECT session_id, unnest(list_concat(['latest', 'last'], string_split(source_name, ' '))),
    file_name, last_at FROM names),
aliases AS (
  SELECT session_id, alias, arg_max(file_name, written_at) AS file_name
  FROM written GROUP BY ALL)"""
)


@query("T5", sql=f"WITH {ALIAS_SQL} SELECT session_id, alias, file_name FROM aliases")
def session_aliases(spark, folder):
    return al.session_aliases(t.uploads(spark, folder).drop("text"))


@query(
    "W7",
    sql=f"WITH {ALIAS_SQL} SELECT session_id, file_name, ordinal::INTEGER AS ordinal, word "
    "FROM words",
)
def upload_ordinals(spark, folder):
    words = al.ordinal_words(t.uploads(spark, folder).drop("text"))
    return words.select("session_id", "file_name", "ordinal", "word")


@query(
    "J13",
    sql=rf"""
    WITH {ALIAS_SQL}, q AS (
      SELECT conv_id * 1000 + turn AS request_id, conv_id AS session_id,
        unnest(list_distinct(regexp_split_to_array(lower(text || ' the ' ||
          CASE turn % 3 WHEN 0 THEN 'latest one' WHEN 1 THEN 'second file, src3' ELSE 'notes' END),
          '\W+'))) AS alias
      FROM conversations)
    SELECT DISTINCT q.request_id, a.file_name
    FROM q JOIN aliases a USING (session_id, alias)""",
)
def alias_resolution(spark, folder):
    """Messages that end in a reference to an upload of their session."""
    reference = (
        F.when(F.col("turn") % 3 == 0, "latest one")
        .when(F.col("turn") % 3 == 1, "second file, src3")
        .otherwise("notes")
    )
    asked = t.messages(spark, folder).select(
        F.col("message_id").alias("request_id"),
        "session_id",
        F.concat("content", F.lit(" the "), reference).alias("question"),
    )
    names = al.session_aliases(t.uploads(spark, folder).drop("text"))
    return al.resolve_aliases(asked, names)
