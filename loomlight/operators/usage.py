"""Daily usage counters and small catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def daily_usage(activity: DataFrame) -> DataFrame:
    """One row per date.

    ``activity`` has ts, user_id, kind, tokens and duration_ms. A row of any
    kind is a visit; kinds chat, document and export are counted, and a chat
    adds its tokens and its duration. The running mean of durations is their
    plain mean, which merges from partial sums.
    """
    chat = F.col("kind") == "chat"
    return activity.groupBy(F.to_date("ts").alias("date")).agg(
        F.countDistinct("user_id").alias("unique_visitors"),
        _counted(chat).alias("chat_requests"),
        _counted(F.col("kind") == "document").alias("documents_uploaded"),
        _counted(F.col("kind") == "export").alias("pdf_exports"),
        F.coalesce(F.sum(F.when(chat, F.col("tokens"))), F.lit(0)).alias("tokens_generated"),
        F.coalesce(F.avg(F.when(chat, F.col("duration_ms"))), F.lit(0.0)).alias(
            "avg_response_ms"
        ),
        _counted(chat).alias("response_count"),
    )


def daily_visits(activity: DataFrame) -> DataFrame:
    """Distinct (date, user_id)."""
    return activity.select(F.to_date("ts").alias("date"), "user_id").filter(
        "user_id is not null"
    ).distinct()


def unique_visitors(activity: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return activity.groupBy(F.to_date("ts").alias("date")).agg(
        count("user_id").alias("unique_visitors")
    )


def merge_daily(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Add a batch of daily rows to the stored ones, as repeated increments would.

    Visitors add up too: the batch must count only first visits of a day.
    """
    sums = ["unique_visitors", "chat_requests", "documents_uploaded", "pdf_exports",
            "tokens_generated", "response_count"]
    weighted = F.sum(F.col("avg_response_ms") * F.col("response_count"))
    responses = F.sum("response_count")
    return (
        stored.unionByName(added)
        .groupBy("date")
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            F.when(responses > 0, weighted / responses).otherwise(0.0).alias("avg_response_ms"),
        )
    )


def type_histogram(attachments: DataFrame) -> DataFrame:
    """Attachments per type, and ALL for their total."""
    return (
        attachments.rollup("type")
        .agg(F.count(F.lit(1)).alias("attachments"), F.grouping("type").alias("_all"))
        .select(
            F.when(F.col("_all") == 1, "ALL").otherwise(F.col("type")).alias("type"),
            "attachments",
        )
    )


def distinct_sources(chunks: DataFrame) -> DataFrame:
    return chunks.select("source_name").filter("source_name is not null").distinct()
