"""Scans, sinks, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlight.catalog import scalars as sc
from loomlight.catalog import tables as t
from loomlight.catalog.registry import query
from loomlight.functions import text
from loomlight.lineage import shared_folder
from loomlight.sources import manifest as mf
from loomlight.sources import readers as rd
from loomlight.sources import writers as wr


def fresh_path(spark, label):
    import uuid

    return f"{shared_folder(spark)}/loomlight/{label}-{uuid.uuid4().hex}"


@query(
    "S1",
    sql="SELECT doc_id, lang FROM documents WHERE source = 'src3' AND n_chars > 500",
)
def table_scan(spark, folder):
    predicate = (F.col("source") == "src3") & (F.col("n_chars") > 500)
    return rd.scan(spark, f"{folder}/documents.parquet", predicate, ["doc_id", "lang"])


@query(
    "S2",
    sql="""
    SELECT lang || '.txt' AS file_name, sum(length(text) + 1)::BIGINT AS characters,
      sum(len(regexp_extract_all(text, '\n')) + 1)::BIGINT AS lines
    FROM documents GROUP BY 1""",
)
def text_file_source(spark, folder):
    """Texts written as files by language and read back whole, under upload names."""
    path = fresh_path(spark, "texts")
    t.table(spark, folder, "documents").select("lang", "text").write.partitionBy("lang").option(
        "maxRecordsPerFile", 10_000
    ).text(path)
    read = rd.text_files(spark, f"{path}/*")
    stored = F.concat(
        F.lit("01234567-89ab-cdef-0123-456789abcdef_"),
        F.regexp_extract("path", r"lang=([^/]+)/", 1),
        F.lit(".txt"),
    )
    return read.groupBy(text.strip_upload_prefix(stored).alias("file_name")).agg(
        F.sum(F.length("text")).alias("characters"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("lines"),
    )


@query(
    "S3",
    sql="""
    SELECT page_id, url, url_decode(replace(regexp_replace(url, '^.*/', ''), '+', ' ')) AS title,
      md5(html) AS digest FROM pages""",
)
def html_page_source(spark, folder):
    pages = rd.html_pages(spark, f"{folder}/pages.parquet")
    return pages.select("page_id", "url", "title", F.md5("html").alias("digest"))


@query(
    "S4",
    sql=f"""
    WITH RECURSIVE {t.CHUNKS_SQL}
    SELECT source_type, count(*) AS chunks, count(DISTINCT content_hash) AS documents
    FROM chunks GROUP BY 1""",
)
def appended_chunks(spark, folder):
    """The chunk table after two appends, one of them retried, read back by its partitions."""
    path = fresh_path(spark, "chunk-table")
    chunks = t.chunks(spark, folder)
    odd = F.substring("content_hash", 1, 1).isin(*"13579bdf")
    wr.append_chunks(chunks.filter(odd), path, "a")
    for _ in range(2):
        wr.append_chunks(chunks.filter(~odd), path, "b")
    return (
        spark.read.parquet(path)
        .groupBy("source_type")
        .agg(
            F.count(F.lit(1)).alias("chunks"), F.countDistinct("content_hash").alias("documents")
        )
    )


VERSIONS_SQL = (
    t.UPLOADS_SQL
    + """,
records AS (
  SELECT file_name AS vector_id, doc_id, session_id, doc_id // 100 AS version,
         length(text) AS size FROM uploads)"""
)


def records(spark, folder):
    """Uploads as vector records named by file, so that names repeat."""
    return t.uploads(spark, folder).select(
        F.col("file_name").alias("vector_id"),
        "doc_id",
        "session_id",
        F.floor(F.col("doc_id") / 100).alias("version"),
        F.length("text").cast("bigint").alias("size"),
    )


@query(
    "S5",
    sql=f"""
    WITH {VERSIONS_SQL}, lasts AS (
      SELECT vector_id, arg_max(doc_id, doc_id) AS doc_id FROM records GROUP BY 1)
    SELECT r.* REPLACE (doc_id AS version) FROM records r JOIN lasts USING (vector_id, doc_id)""",
)
def upserted_records(spark, folder):
    """The last record of every name replaces its first one."""
    rows = records(spark, folder).withColumn("version", F.col("doc_id"))
    record = F.struct("doc_id", "session_id", "version", "size")
    ends = rows.groupBy("vector_id").agg(
        F.min_by(record, "doc_id").alias("first"), F.max_by(record, "doc_id").alias("last")
    )
    return wr.upsert(ends.select("vector_id", "first.*"), ends.select("vector_id", "last.*"))


@query(
    "S5",
    "S6",
    sql=f"""
    WITH {VERSIONS_SQL}, lasts AS (
      SELECT vector_id, arg_max(doc_id, (doc_id % 3, doc_id)) AS doc_id FROM records GROUP BY 1)
    SELECT vector_id, r.doc_id, session_id, size FROM records r JOIN lasts USING (vector_id, doc_id)
    WHERE size % 5 <> 0 OR doc_id % 3 = 2""",
)
def logged_records(spark, folder):
    """Three batches of records by name, one retried, some deleted before the last, then compacted."""
    path = fresh_path(spark, "record-log")
    rows = records(spark, folder).drop("version")
    newest = F.max_by(F.struct("doc_id", "session_id", "size"), "doc_id").alias("row")
    for number in (0, 1, 0):
        part = rows.filter(F.col("doc_id") % 3 == number)
        wr.upsert_records(part.groupBy("vector_id").agg(newest).select("vector_id", "row.*"), path, number)
    wr.delete_records(wr.read_records(spark, path).filter("size % 5 = 0"), path, 2)
    part = rows.filter(F.col("doc_id") % 3 == 2)
    wr.upsert_records(part.groupBy("vector_id").agg(newest).select("vector_id", "row.*"), path, 3)
    mf.compact(spark, path, "vector_id")
    mf.remove_unreferenced(spark, path)
    return wr.read_records(spark, path)


@query(
    "S5",
    sql=f"""
    WITH {t.UPLOADS_SQL}
    SELECT doc_id, json_object('_id', doc_id::VARCHAR, 'text', source_name,
      'sessionId', session_id, 'sourceType', source_type)::VARCHAR AS record FROM uploads""",
)
def vector_records(spark, folder):
    """Records as written to the sink and read back as lines."""
    rows = t.uploads(spark, folder).select(
        F.col("doc_id").cast("string").alias("vector_id"),
        t.source_name_of("file_name").alias("content"),
        F.col("session_id").alias("sessionId"),
        F.col("source_type").alias("sourceType"),
    )
    path = fresh_path(spark, "records")
    wr.write_vector_records(rows, ["sessionId", "sourceType"], path)
    return spark.read.text(path).select(
        F.get_json_object("value", "$._id").cast("bigint").alias("doc_id"),
        F.col("value").alias("record"),
    )


@query(
    "S6",
    sql=f"""
    WITH {VERSIONS_SQL}
    SELECT doc_id, vector_id FROM records
    WHERE vector_id NOT IN (SELECT vector_id FROM records WHERE size > 15000)""",
)
def deleted_by_ids(spark, folder):
    """Every name that ever had a record over 15,000 characters is deleted."""
    rows = records(spark, folder)
    return wr.delete_ids(rows, rows.filter("size > 15000")).select("doc_id", "vector_id")


@query(
    "S7",
    sql=f"WITH {VERSIONS_SQL} SELECT doc_id, session_id FROM records WHERE session_id <> 7",
)
def deleted_by_session(spark, folder):
    return wr.delete_session(records(spark, folder), 7).select("doc_id", "session_id")


@query(
    "S11",
    sql=f"""
    WITH {t.UPLOADS_SQL}
    SELECT source_type AS type, CASE source_type WHEN 'PDF' THEN 'pdfs' WHEN 'IMAGE' THEN 'images'
      WHEN 'TEXT' THEN 'texts' ELSE 'other' END AS folder, count(*) AS uploads
    FROM uploads GROUP BY ALL""",
)
def routed_uploads(spark, folder):
    """Uploads written by type and read back."""
    rows = t.uploads(spark, folder).select("doc_id", "mime_type")
    path = fresh_path(spark, "uploads")
    wr.write_uploads(rows, path)
    return spark.read.parquet(path).groupBy("type", "folder").agg(F.count("*").alias("uploads"))


@query(
    "S13",
    sql=sc.EXCHANGES_SQL
    + """
    SELECT session_id, message_id AS conversation_pair_id,
      'User: ' || question || chr(10) || 'Assistant: ' || answer AS text
    FROM gated WHERE memorable AND coalesce(top_score, 0) >= 0.4""",
)
def remembered_exchanges(spark, folder):
    rows = wr.memory_rows(sc.exchanges(spark, folder), F.col("created_at"))
    return rows.select("session_id", "conversation_pair_id", "text")
