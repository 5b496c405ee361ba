"""Chunk, record, transcript and memory sinks.

Every writer is a plain Spark write. Upserts and deletes come in two forms: as
a log by key behind a manifest, which a retried batch leaves as it is, and as
the new state of a table as a DataFrame, for the caller to put somewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.functions.intent import is_remembered
from loomlight.functions.text import attachment_type, storage_folder
from loomlight.sources import manifest

RECORDS_PER_FILE = 1_000_000


def append_chunks(chunks: DataFrame, path: str, batch: str | None = None) -> None:
    """Append to the chunk table, one folder per source type.

    A named ``batch`` has folders of its own, which it replaces when it is
    written again: a retried job adds nothing.
    """
    if batch is None:
        writer = chunks.write.mode("append").partitionBy("source_type")
    else:
        named = chunks.withColumn("ingest_batch", F.lit(batch))
        writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer = writer.partitionBy("ingest_batch", "source_type")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).parquet(path)


def vector_records(chunks: DataFrame, metadata: Sequence[str]) -> DataFrame:
    """One JSON line per chunk: _id, text and its metadata as top-level fields."""
    fields = F.struct(
        F.col("vector_id").alias("_id"), F.col("content").alias("text"), *metadata
    )
    return chunks.select(F.to_json(fields).alias("value"))


def write_vector_records(chunks: DataFrame, metadata: Sequence[str], path: str) -> None:
    vector_records(chunks, metadata).write.mode("append").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


def upsert_records(rows: DataFrame, path: str, batch: int, writer: str = "records", key: str = "vector_id") -> bool:
    """Log a batch of records by id; false if it is there already. ``read_records`` gives the newest."""
    return manifest.upsert_rows(rows, path, key, writer, batch)


def delete_records(ids: DataFrame, path: str, batch: int, writer: str = "records", key: str = "vector_id") -> bool:
    return manifest.delete_keys(ids, path, key, writer, batch)


def read_records(spark: SparkSession, path: str, key: str = "vector_id") -> DataFrame | None:
    return manifest.newest_rows(spark, path, key)


def upsert(
    stored: DataFrame, incoming: DataFrame, key: str = "vector_id", version: str = "version"
) -> DataFrame:
    """The newest row per key; an incoming row wins over a stored one of equal version.

    The maximum combines on the map side, so many versions of one key cost one
    row per task.
    """
    columns = stored.columns
    tagged = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = F.struct(*[c for c in columns if c != key])
    newest = tagged.groupBy(key).agg(F.max_by(rest, F.struct(version, "_new")).alias("_row"))
    return newest.select(key, "_row.*").select(columns)


def delete_ids(stored: DataFrame, ids: DataFrame, key: str = "vector_id") -> DataFrame:
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def delete_session(stored: DataFrame, session_id: int) -> DataFrame:
    return stored.filter(~F.col("session_id").eqNullSafe(F.lit(session_id)))


def route_uploads(uploads: DataFrame, mime: str = "mime_type") -> DataFrame:
    """Adds the attachment type and its storage folder."""
    kind = attachment_type(F.col(mime))
    return uploads.withColumn("type", kind).withColumn("folder", storage_folder(F.col("type")))


def write_uploads(uploads: DataFrame, path: str, mime: str = "mime_type") -> None:
    route_uploads(uploads, mime).write.mode("append").partitionBy("type").parquet(path)


def write_transcripts(segments: DataFrame, path: str) -> None:
    """Text files under one folder per session; a file holds whole segments in order.

    Rows are spread by (session, segment), so a long session is several files
    whose names sort in order. The writer ends every row with the line break
    that is taken off the segment here.
    """
    (
        segments.repartitionByRange("session_id", "segment_no")
        .sortWithinPartitions("session_id", "segment_no")
        .select("session_id", F.regexp_replace("text", r"\n\z", "").alias("text"))
        .write.mode("append")
        .partitionBy("session_id")
        .text(path)
    )


def memory_rows(exchanges: DataFrame, stamp: Column) -> DataFrame:
    """Question and answer pairs worth keeping, with their session and pair id."""
    kept = exchanges.filter(
        is_remembered(F.col("question"), F.col("answer"), F.col("top_score"))
    )
    text = F.concat(
        F.lit("User: "), F.col("question"), F.lit("\nAssistant: "), F.col("answer")
    )
    return kept.select(
        "session_id",
        F.col("message_id").alias("conversation_pair_id"),
        stamp.alias("timestamp"),
        text.alias("text"),
    )


def append_memory(exchanges: DataFrame, stamp: Column, path: str) -> None:
    memory_rows(exchanges, stamp).write.mode("append").parquet(path)
