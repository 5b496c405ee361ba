"""Using all cores on small inputs without shuffling large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a small scan to all cores before a CPU-heavy step.

    A scan with at least as many splits as cores, which any large table has,
    passes unchanged. Call it on a scan or on projections and filters of one:
    asking for the splits of a frame with shuffles would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
