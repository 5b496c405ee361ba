"""Chunking of documents and pages, and whole ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlight.catalog import tables as t
from loomlight.catalog.registry import query
from loomlight.functions.text import page_title
from loomlight.operators import chunking as ch
from loomlight.operators import html as ht
from loomlight.partitioning import spread
from loomlight.plans.ingest import ingest

CHUNK_ROWS_SQL = f"""
    WITH RECURSIVE {t.CHUNKS_SQL}
    SELECT vector_id, content_hash, session_id, source_name, source_type, original_file_name,
      enriched_file_name, asset_classification, asset_tags, source_url, chunk_index::INTEGER AS chunk_index, total_chunks::INTEGER AS total_chunks,
      content FROM chunks"""


@query(
    "T1",
    "U4",
    sql=f"""
    WITH RECURSIVE {t.CHUNKS_SQL}
    SELECT doc_id, chunk_index::INTEGER AS chunk_index, content FROM chunks""",
)
def chunk_texts(spark, folder):
    """Chunks of every distinct document text."""
    rows = t.uploads(spark, folder)
    firsts = rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    texts = rows.join(firsts.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    return ch.chunk_documents(texts).select("doc_id", "chunk_index", "content")


@query("C12", "S4", sql=CHUNK_ROWS_SQL)
def ingest_uploads(spark, folder):
    """Hash, deduplicate, re-point and chunk all uploads."""
    made, _ = ingest(t.uploads(spark, folder))
    return made.select(
        "vector_id", "content_hash", "session_id", "source_name", "source_type",
        "original_file_name", "enriched_file_name", "asset_classification", "asset_tags",
        "source_url", "chunk_index", "total_chunks", "content",
    )


@query(
    "W8",
    sql=f"""
    WITH RECURSIVE {t.CHUNKS_SQL}
    SELECT vector_id, count(*) OVER (PARTITION BY content_hash) AS total_chunks FROM chunks""",
)
def total_chunks(spark, folder):
    filled = ch.back_fill_totals(t.chunks(spark, folder), ["content_hash"])
    return filled.select("vector_id", "total_chunks")


@query(
    "W11",
    sql="""
    SELECT conv_id, turn::BIGINT AS chunk_index FROM (
      SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before
      FROM (SELECT conv_id, turn,
              CASE WHEN turn % 4 < 2 THEN 'same' ELSE text END AS role FROM conversations))
    WHERE role = before""",
)
def repeated_neighbours(spark, folder):
    """Turns equal to the one before; half of all turns say the same."""
    said = t.table(spark, folder, "conversations").select(
        "conv_id",
        F.col("turn").alias("chunk_index"),
        F.when(F.col("turn") % 4 < 2, "same").otherwise(F.col("text")).alias("content"),
    )
    return ch.repeated_neighbours(said, ["conv_id"])


def sections(spark, folder):
    pages = spread(t.table(spark, folder, "pages")).select(
        "page_id", "url", "html", page_title(F.col("url")).alias("title")
    )
    return ht.section_chunks(pages)


# The pages are flat: a paragraph ends at the next paragraph, at its end tag or
# at a block. Scripts, styles and comments go first.
SECTIONS_SQL = r"""plain AS (
  SELECT page_id, url_decode(replace(regexp_replace(url, '^.*/', ''), '+', ' ')) AS title,
    regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'),
                   '(?s)<!--.*?-->', '', 'g') AS html
  FROM pages),
opened AS (
  SELECT page_id, title, unnest(list[2:]) AS rest, generate_subscripts(list[2:], 1) AS nth
  FROM (SELECT page_id, title, regexp_split_to_array(html, '<p>') AS list FROM plain)),
paragraphs AS (
  SELECT page_id, title, nth, trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(
      regexp_replace(
        regexp_replace(
          regexp_extract(rest,
            '(?s)^(.*?)(?:</p>|</?(?:article|aside|body|div|dl|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|section|table|ul)\b|$)', 1),
          '<br\s*/?>', ' ', 'g'),
        '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
    '[ \t\n\f\r' || chr(160) || ']+', ' ', 'g')) AS text
  FROM opened),
sections AS (
  SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY nth))::INTEGER AS chunk_order
  FROM paragraphs WHERE length(text) >= 20)"""


@query(
    "T2",
    "S3",
    sql=f"""
    WITH {SECTIONS_SQL}
    SELECT page_id, replace(title, ' ', '_') || ':summary_' || chunk_order AS semantic_id,
      'LEAD_SECTION' AS chunk_type, text, chunk_order FROM sections""",
)
def page_sections(spark, folder):
    """Semantic chunks of all pages, which have no second-level headings."""
    return sections(spark, folder).select(
        "page_id", "semantic_id", "chunk_type", "text", "chunk_order"
    )


@query(
    "T6",
    sql=rf"""
    WITH {SECTIONS_SQL}, hashes AS (
      SELECT page_id, sha256(regexp_replace(regexp_replace(
        string_agg(text || chr(10), '' ORDER BY chunk_order),
        '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '\s+', ' ', 'g')) AS content_hash
      FROM sections GROUP BY 1)
    SELECT page_id, content_hash, 'Lead' AS section_path, chunk_order AS chunk_index,
      0 AS total_chunks,
      trim(lower(replace(replace(regexp_replace(title, '\.[^.]+$', ''), '_', ' '), '-', ' ')))
        AS source_name,
      'Page: ' || title || chr(10) || 'Section: Lead' || chr(10) || chr(10) || text AS content
    FROM sections JOIN hashes USING (page_id)""",
)
def page_index_rows(spark, folder):
    rows = ht.section_index_rows(sections(spark, folder))
    return rows.select(
        "page_id", "content_hash", "section_path", "chunk_index", "total_chunks", "source_name",
        "content",
    )


# Tables, info boxes and figures built around the text of each document.
@query(
    "T3",
    "T4",
    "P24",
    sql=r"""
    WITH w AS (
      SELECT doc_id, source, lang, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w
      FROM documents),
    v AS (
      SELECT doc_id, source, lang, list_transform(w, lambda x: regexp_replace(x, '[^a-zA-Z]', '', 'g')) AS c
      FROM w)
    SELECT doc_id, source || ':info1' AS semantic_id, 'INFOBOX' AS chunk_type,
      'Lead' AS section, 1 AS chunk_order,
      '**Source**: ' || source || chr(10) || '**Language**: ' || lang || chr(10) AS text FROM v
    UNION ALL
    SELECT doc_id, source || ':table1', 'WIKITABLE', 'Words > First', 2,
      '| Left | Right\|side |' || chr(10) || '|---|---|' || chr(10)
        || array_to_string(list_transform(range(1, len(c) + 1, 2),
          lambda i: '| x' || c[i] || ' | y' || coalesce(c[i + 1], '') || ' |' || chr(10)), '') FROM v
    UNION ALL
    SELECT doc_id, source || ':img1', 'IMAGE', 'Figures', 3,
      'Image Caption: ' || CASE WHEN doc_id % 2 = 0 THEN 'Picture of ' || source
                                ELSE 'Image without caption' END FROM v""",
)
def page_tables_and_figures(spark, folder):
    docs = t.documents(spark, folder)
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    # One row of the table per two words of the whole text. Each cell is made from its own word:
    # looking the words up by place would split the whole text again for every cell.
    parts = F.transform(
        words,
        lambda w, i: F.concat(
            F.when(i % 2 == 0, "<tr><td>x").otherwise("<td>y"), F.regexp_replace(w, "[^a-zA-Z]", "")
        ),
    )
    odd = F.when(F.size(words) % 2 == 1, "<td>y").otherwise("")
    html = F.format_string(
        "<table class='big infobox'><tr><th>Source<td>%s<tr><th>Language</th><td> %s</td></tr>"
        "<tr><td>lonely</td></tr></table><h2>Words</h2><h3>First</h3>"
        "<table class=wikitable><tr><th>Left</th><th>Right|side</th></tr>"
        "%s</table><h2>Figures</h2>"
        "<figure><img src='//a/b.png' alt=''>%s</figure><p>too short</p>",
        F.col("source"),
        F.col("lang"),
        F.concat(F.array_join(parts, ""), odd),
        F.when(
            F.col("doc_id") % 2 == 0,
            F.concat(F.lit("<figcaption>Picture of <b>"), "source", F.lit("</b></figcaption>")),
        ).otherwise(""),
    )
    pages = docs.select("doc_id", F.col("source").alias("title"), html.alias("html"))
    path = F.concat_ws(" > ", "h2", "h3", "h4")
    return ht.section_chunks(pages).select(
        "doc_id",
        "semantic_id",
        "chunk_type",
        F.when(path == "", "Lead").otherwise(path).alias("section"),
        "chunk_order",
        "text",
    )
