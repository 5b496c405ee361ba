"""Documents recognised by the hash of their content.

Copies of one document may make up a large share of all uploads, so uploads
are aggregated by hash before anything is joined: after that every hash is one
row on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.functions.text import content_hash, is_blank
from loomlight.lineage import materialize


def with_hash(documents: DataFrame, text: str = "text") -> DataFrame:
    """Non-blank documents with their content hash."""
    return documents.filter(~is_blank(F.col(text))).withColumn(
        "content_hash", content_hash(F.col(text))
    )


def known_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.select("content_hash").filter("content_hash is not null").distinct()


def split_by_known(uploads: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new uploads, uploads whose content the corpus already holds).

    Hashes meet hashes first. The hashes found are written, so the joins that
    touch the texts are planned with their size known.
    """
    arriving = uploads.select("content_hash").distinct()
    seen = materialize(arriving.join(known_hashes(chunks), "content_hash", "left_semi"), "seen")
    return (
        uploads.join(seen, "content_hash", "left_anti"),
        uploads.join(seen, "content_hash", "left_semi"),
    )


def first_and_latest(uploads: DataFrame) -> DataFrame:
    """One row per hash: the document to ingest and the session it ends up in.

    The first upload of a content is the one ingested; every later copy only
    moves it to its own session.
    """
    at = F.struct("uploaded_at", "doc_id")
    return uploads.groupBy("content_hash").agg(
        F.min_by("doc_id", at).alias("doc_id"),
        F.max_by("session_id", at).alias("session_id"),
        F.count(F.lit(1)).alias("copies"),
    )


def repoint_chunks(chunks: DataFrame, uploads: DataFrame) -> DataFrame:
    """Existing chunks moved to the newest session that uploaded the same content."""
    at = F.struct("uploaded_at", "doc_id")
    newest = uploads.groupBy("content_hash").agg(F.max_by("session_id", at).alias("_session"))
    return (
        chunks.join(newest, "content_hash", "left")
        .withColumn("session_id", F.coalesce("_session", "session_id"))
        .select(chunks.columns)
    )
