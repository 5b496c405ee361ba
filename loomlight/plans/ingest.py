"""From uploads to chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions.text import normalize_source_name
from loomlight.lineage import materialize
from loomlight.operators.chunking import chunk_documents
from loomlight.operators.dedup import first_and_latest, repoint_chunks, split_by_known, with_hash


#: Columns of the chunk table that uploads may lack.
ASSET_COLUMNS = ("enriched_file_name", "asset_classification", "asset_tags")


def chunk_id(content_hash: Column, index: Column) -> Column:
    """Id of a chunk: the same content gets the same ids on every run and retry."""
    number = index.cast("string")
    padded = F.when(F.length(number) >= 6, number).otherwise(F.lpad(number, 6, "0"))
    return F.concat(content_hash, F.lit("-"), padded)


def new_chunks(uploads: DataFrame) -> DataFrame:
    """Chunk rows of uploads whose content is new.

    ``uploads`` has doc_id (unique), session_id, uploaded_at, text,
    content_hash, file_name, source_type, image_url and source_url, and may
    have the asset columns. What is kept of copies is decided on ids and hashes
    alone; the decision, one row per document whose content came more than
    once, meets the texts by document id, so no frequent content gathers texts
    in one task. It is written first, so that its size is known when that join
    is planned: if it can be broadcast, the texts stay where they were read.
    """
    keys = materialize(uploads.select("doc_id", "content_hash", "session_id", "uploaded_at"), "keys")
    repeated = materialize(
        first_and_latest(keys)
        .filter("copies > 1")
        .select(
            "content_hash",
            F.col("doc_id").alias("first_doc"),
            F.col("session_id").alias("owner_session"),
        ),
        "repeated",
    )
    copies = materialize(
        keys.join(repeated, "content_hash").select(
            "doc_id", "owner_session", (F.col("first_doc") == F.col("doc_id")).alias("is_first")
        ),
        "copies",
    )
    assets = [
        F.col(c) if c in uploads.columns else F.lit(None).cast("string").alias(c)
        for c in ASSET_COLUMNS
    ]
    texts = (
        uploads.join(copies, "doc_id", "left")
        .filter(F.coalesce("is_first", F.lit(True)))
        .select(
            "content_hash",
            F.coalesce("owner_session", "session_id").alias("session_id"),
            normalize_source_name(F.col("file_name")).alias("source_name"),
            "source_type",
            F.col("file_name").alias("original_file_name"),
            *assets,
            "image_url",
            "source_url",
            F.col("uploaded_at").alias("created_at"),
            "text",
        )
    )
    cut = chunk_documents(texts)
    return cut.withColumn("vector_id", chunk_id(F.col("content_hash"), F.col("chunk_index")))


def ingest(uploads: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(chunks to append, stored chunks after re-pointing).

    Content the corpus already holds is not cut again; its chunks move to the
    newest uploading session.
    """
    hashed = with_hash(uploads)
    if stored is None:
        return new_chunks(hashed), None
    fresh, seen = split_by_known(hashed, stored)
    return new_chunks(fresh), repoint_chunks(stored, seen)
