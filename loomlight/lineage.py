"""Cutting lineage through a shared folder.

A materialised table survives the loss of an executor, is columnar (later
readers prune columns and push filters) and carries file sizes, so the
optimizer can prove that a side is small enough to broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def tables_removed_after(spark: SparkSession) -> Iterator[None]:
    """Remove what ``materialize`` wrote inside, once the result that reads it is written."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back; the result depends on files only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomlight/{label}-{uuid.uuid4().hex}"
    paths = _written.get()
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
