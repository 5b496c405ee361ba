"""Attachment ownership: first uploads, shared addresses, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_uploads(attachments: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest attachment per key, such as (url, user_id) or (url).

    A minimum over a struct combines on the map side, so a widely shared
    address costs one row per task.
    """
    rest = [c for c in attachments.columns if c not in keys]
    order = ["uploaded_at", "attachment_id"]
    packed = F.struct(*order, *[c for c in rest if c not in order])
    first = attachments.groupBy(*keys).agg(F.min_by(packed, F.struct(*order)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def owner_counts(attachments: DataFrame) -> DataFrame:
    """Every attachment with the number of rows that share its url."""
    owners = (
        attachments.filter("url is not null")
        .groupBy("url")
        .agg(F.count(F.lit(1)).alias("_owners"))
    )
    return (
        attachments.join(owners, "url", "left")
        .withColumn("owner_count", F.coalesce("_owners", F.lit(1)))
        .drop("_owners")
    )


def deletion_decisions(requested: DataFrame, attachments: DataFrame) -> DataFrame:
    """What deleting each requested attachment does: (attachment_id, user_id) decided one by one.

    Rows of other users are refused (absent). A sole owner's file is purged
    everywhere; a shared one is only detached.
    """
    owners = attachments.filter("url is not null").groupBy("url").agg(F.count("*").alias("_n"))
    mine = attachments.select("attachment_id", "user_id", "url").join(
        requested.select("attachment_id", "user_id"), ["attachment_id", "user_id"], "left_semi"
    )
    counted = mine.join(owners, "url", "left").withColumn(
        "owner_count", F.coalesce("_n", F.lit(1))
    )
    sole = F.col("owner_count") <= 1
    others = (F.col("owner_count") - 1).cast("string")
    message = F.when(sole, "File removed for everyone — no other user had it.").otherwise(
        F.concat(
            F.lit("Removed from your Explore list. Kept — "),
            others,
            F.lit(" other user(s) still have this file."),
        )
    )
    return counted.select(
        "attachment_id",
        "url",
        sole.alias("fully_deleted"),
        "owner_count",
        message.alias("message"),
    )


def purge_chunks(chunks: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(purged vector ids, remaining chunks) for files that lost their sole owner."""
    gone = (
        decisions.filter("fully_deleted and url is not null")
        .select(F.col("url").alias("source_url"))
        .distinct()
    )
    purged = chunks.join(gone, "source_url", "left_semi").select("vector_id")
    return purged, chunks.join(gone, "source_url", "left_anti").select(chunks.columns)
