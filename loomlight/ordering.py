"""Top-k, numbering and ordered joining of groups that may be very large.

One key can hold a third of all rows, so nothing here gathers a whole group
in one task:

* ``top_k`` relies on the partial group limit Spark runs before the shuffle
  (k rows per key leave a map task), or on a salted first round;
* ``number_rows`` numbers each group 1..n from a range partitioning, where a
  hot key simply spans many partitions;
* ``join_segments`` concatenates bounded runs of consecutive rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlight.lineage import materialize

SALTS = 64


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    salt_by: str | None = None,
) -> DataFrame:
    """The first ``k`` rows per key, with a 1-based ``rank`` column.

    ``salt_by`` names a column that spreads the rows of a key over
    ``SALTS`` tasks for a first round; use it when k is too large for the
    partial group limit, or when the input comes in so many partitions that
    k rows of each would overload the task that owns the key.
    """
    rows = df
    if salt_by is not None:
        salt = F.pmod(F.xxhash64(salt_by), F.lit(SALTS))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        rows = (
            rows.withColumn("_salt", salt)
            .withColumn("_first", F.row_number().over(first))
            .filter(F.col("_first") <= k)
            .drop("_salt", "_first")
        )
    final = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """Number the rows of every key 1..n in ascending ``order``.

    Rows are range-partitioned by (keys, order), so the partition id and the
    offset inside it are enough once the rows of the same key in earlier
    partitions are counted. The counts hold one row per key and partition.
    """
    ordered = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # Both uses below must see one and the same range partitioning.
    ordered = materialize(ordered, "numbered")
    runs = ordered.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *keys,
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    return (
        ordered.join(runs, [*keys, "_part"])
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1)
        .drop("_part", "_at", "_first", "_before")
    )


def join_segments(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    text: str,
    separator: str = "",
    size: int = 1000,
    segment: str = "segment_no",
    out: str = "text",
) -> DataFrame:
    """Concatenate ``text`` in ``position`` order, ``size`` positions per row.

    Positions start at 1. A group of up to ``size`` rows gives one segment;
    a larger one gives several, whose texts in segment order are the whole.
    """
    number = F.floor((F.col(position) - 1) / F.lit(size)).cast("bigint")
    pieces = F.array_sort(F.collect_list(F.struct(F.col(position), F.col(text))))
    return (
        df.filter(F.col(text).isNotNull())
        .groupBy(*keys, number.alias(segment))
        .agg(pieces.alias("_pieces"))
        .withColumn(out, F.array_join(F.transform("_pieces", lambda p: p[text]), separator))
        .drop("_pieces")
    )
