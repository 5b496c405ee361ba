"""Reciprocal rank fusion of two ranked lists and spreading over sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
RRF_K = 60
POOL_SIZE = 15
PER_SOURCE = 2
SCORE_DIGITS = 12


def fuse_ranks(
    dense: DataFrame,
    lexical: DataFrame,
    query_id: str = "query_id",
    chunk_id: str = "vector_id",
) -> DataFrame:
    """One row per (query, chunk) of either list, which carry a 1-based ``rank``.

    Adds fused_score, the sum of 1 / (60 + rank); dense_rank and lexical_rank
    (null when absent); paths; and fused_rank. Equal scores keep the dense
    order, then the lexical one. A union and one aggregation replace a full
    outer join; the lists hold at most k rows per query.
    """
    tagged = dense.select(query_id, chunk_id, "rank", F.lit("dense").alias("path")).unionByName(
        lexical.select(query_id, chunk_id, "rank", F.lit("bm25").alias("path"))
    )

    def rank_of(path: str):
        return F.max(F.when(F.col("path") == path, F.col("rank")))

    # Adding in a fixed order keeps the sum identical on every run.
    share = [
        F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col(name)), F.lit(0.0))
        for name in ("dense_rank", "lexical_rank")
    ]
    fused = (
        tagged.groupBy(query_id, chunk_id)
        .agg(
            rank_of("dense").alias("dense_rank"),
            rank_of("bm25").alias("lexical_rank"),
            F.array_sort(F.collect_set("path")).alias("paths"),
        )
        .withColumn("fused_score", F.round(share[0] + share[1], SCORE_DIGITS))
    )
    order = Window.partitionBy(query_id).orderBy(
        F.col("fused_score").desc(),
        F.col("dense_rank").asc_nulls_last(),
        F.col("lexical_rank").asc_nulls_last(),
        F.col(chunk_id),
    )
    return fused.withColumn("fused_rank", F.row_number().over(order))


def spread_sources(
    pool: DataFrame,
    query_id: str = "query_id",
    source: str = "source_name",
    order: str = "fused_rank",
    size: int = POOL_SIZE,
    per_source: int = PER_SOURCE,
) -> DataFrame:
    """Keep the two best per source, then fill to 15 by rank.

    Pools of up to 15 pass unchanged; the guaranteed rows are not capped. All
    windows share the query partitioning, so this adds no shuffle after fusion.
    """
    within = Window.partitionBy(query_id, source).orderBy(order)
    overall = Window.partitionBy(query_id)
    running = overall.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The query-wide count comes first: it places a query in one partition, which
    # then also serves the windows by (query, source).
    kept = F.col("_nth") <= per_source
    counted = (
        pool.withColumn("_pool", F.count(F.lit(1)).over(overall))
        .withColumn("_nth", F.row_number().over(within))
        .withColumn("_kept", F.sum(kept.cast("int")).over(overall))
        .withColumn("_fill", F.sum((~kept).cast("int")).over(running))
    )
    room = F.greatest(F.lit(size) - F.col("_kept"), F.lit(0))
    return counted.filter(
        (F.col("_pool") <= size) | (F.col("_nth") <= per_source) | (F.col("_fill") <= room)
    ).drop("_nth", "_pool", "_kept", "_fill")
