"""Ingestion of uploads as they arrive.

The chunks lie in buckets by the first digits of their content's hash, behind a
manifest (``sources.manifest``). A batch reads only the buckets its own hashes
fall into. Contents that are new are added to them; where a known content was
uploaded again, and later than the upload its chunks point to, its bucket is
written anew with the chunks moved to that session. Readers see all of a batch
or nothing, and a batch that is run again does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.lineage import materialize, tables_removed_after
from loomlight.operators.dedup import with_hash
from loomlight.plans.ingest import new_chunks
from loomlight.sources import manifest
from loomlight.streaming.jobs import INGESTION_LOCK, drop_redelivered, start

# 256 buckets; three or four digits suit billions of contents.
PREFIX_DIGITS = 2
#: The upload that a chunk's session comes from.
POINTER = ("pointed_at", "pointed_by")


def bucket_of(content_hash: str, digits: int) -> Column:
    return F.substring(content_hash, 1, digits)


def read_chunks(spark: SparkSession, table: str) -> DataFrame | None:
    """The chunks of all batches so far; null before the first one."""
    rows = manifest.read_table(spark, table)
    return None if rows is None else rows.drop(*POINTER)


def _newest(hashed: DataFrame) -> DataFrame:
    """Per content, the session and the mark of its newest upload in a batch."""
    last = F.max(F.struct("uploaded_at", "doc_id", "session_id")).alias("last")
    return hashed.groupBy("content_hash").agg(last).select(
        "content_hash",
        F.col("last.session_id").alias("new_session"),
        F.col("last.uploaded_at").alias("new_at"),
        F.col("last.doc_id").alias("new_by"),
    )


def ingest_batch(uploads: DataFrame, table: str, batch: int, writer: str = "ingest", digits: int = PREFIX_DIGITS) -> bool:
    """Add new contents and move known ones to their newest session; false if the batch is in already.

    A content keeps what its first ingested upload said of it; its session is
    that of the newest upload, by (uploaded_at, doc_id), in whatever order the
    batches come.
    """
    spark = uploads.sparkSession
    now = manifest.load(spark, table)
    if now.applied.get(writer, -1) >= batch:
        return False
    with tables_removed_after(spark):
        hashed = materialize(with_hash(uploads), "batch")
        newest = materialize(_newest(hashed), "newest")
        # At most 16 ** digits of them.
        touched = [r[0] for r in newest.select(bucket_of("content_hash", digits)).distinct().collect()]
        stored = manifest.read_table(spark, table, touched)
        fresh, moved, rewritten = hashed, None, []
        if stored is not None:
            marks = stored.select("content_hash", *POINTER).distinct()
            known = materialize(newest.join(marks, "content_hash"), "known")
            fresh = hashed.join(known.select("content_hash"), "content_hash", "left_anti")
            later = F.struct("new_at", "new_by") > F.struct(*POINTER)
            ahead = known.filter(later).select("content_hash", "new_session", "new_at", "new_by")
            rewritten = [r[0] for r in ahead.select(bucket_of("content_hash", digits)).distinct().collect()]
            if rewritten:
                held = manifest.read_table(spark, table, rewritten)
                moved = _pointed(held.join(ahead, "content_hash", "left"), held.columns)
        chunks = new_chunks(fresh).join(newest, "content_hash")
        rows = _pointed(chunks, [c for c in chunks.columns if not c.startswith("new_")] + list(POINTER))
        if moved is not None:
            rows = rows.unionByName(moved)
        return manifest.write_batch(rows, table, bucket_of("content_hash", digits), writer, batch, rewritten, at=now)


def _pointed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the session and mark of the newer upload, where there is one."""
    newer = {"session_id": "new_session", "pointed_at": "new_at", "pointed_by": "new_by"}
    has = set(rows.columns)
    return rows.select(
        *[
            c if c not in newer else (F.coalesce(newer[c], c) if c in has else F.col(newer[c])).alias(c)
            for c in columns
        ]
    )


def ingest_stream(jobs: DataFrame, table: str, name: str = "ingest", digits: int = PREFIX_DIGITS):
    """Deduplicate redelivered jobs and ingest each batch.

    ``jobs`` carries job_id, ts and the upload columns with their text. The
    name and ``digits`` must stay the same over restarts of one stream.
    """
    firsts = drop_redelivered(jobs, "job_id", INGESTION_LOCK)
    return start(
        firsts,
        name,
        lambda rows, number: ingest_batch(rows.drop("job_id", "ts"), table, number, name, digits),
    )
