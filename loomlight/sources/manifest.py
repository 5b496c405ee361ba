"""Tables of bucket folders behind a manifest.

Data files are never changed. A batch writes its rows into a folder of its own,
one subfolder per bucket, and then publishes a manifest that names the folders
of every bucket: readers see all of a batch or nothing. The manifest also keeps
the last batch of every writer, so a batch that is run again does nothing. A
bucket can be given new content as a whole (copy on write); the others keep
their folders. Manifests have as many entries as there are buckets and deltas.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
LOG_COLUMNS = ("_version", "_gone")


class Conflict(RuntimeError):
    """Another writer published first; run the batch again."""


@dataclass
class Manifest:
    number: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)  # bucket -> folders, oldest first
    applied: dict[str, int] = field(default_factory=dict)  # writer -> last batch
    schema: dict | None = None


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    store, where = _files(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


def load(spark: SparkSession, path: str) -> Manifest:
    """The newest manifest; an empty one before the first batch."""
    names = [n for n in _names(spark, f"{path}/_manifests") if n.endswith(".json")]
    if not names:
        return Manifest()
    store, where = _files(spark, f"{path}/_manifests/{names[-1]}")
    source = store.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    return Manifest(**json.loads(text))


def _publish(spark: SparkSession, path: str, manifest: Manifest) -> None:
    final = f"{path}/_manifests/{manifest.number:012d}.json"
    store, draft = _files(spark, f"{path}/_manifests/.{uuid.uuid4().hex}")
    out = store.create(draft, True)
    try:
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
    finally:
        out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(final)
    if store.exists(target) or not store.rename(draft, target):
        store.delete(draft, False)
        raise Conflict(final)


@contextmanager
def _open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Let a task have several files open, so that its rows need not be sorted by bucket first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_batch(
    rows: DataFrame,
    path: str,
    bucket: Column,
    writer: str,
    batch: int,
    replaced: Iterable[str] = (),
    at: Manifest | None = None,
    spread: Column | None = None,
    shuffled: bool = True,
    most_buckets: int = BUCKETS,
    compression: str = "snappy",
) -> bool:
    """Add rows to their buckets; ``replaced`` buckets hold only these rows from now on.

    Batches of one writer have growing numbers. False if this one is in the
    table already. ``at`` is the manifest that the rows were made from; if
    another batch was published since, ``Conflict`` is raised and nothing is
    changed. ``spread`` deals the rows of a bucket to several tasks and files.
    Rows that are not ``shuffled`` are written by the tasks that make them, in
    their order: a file per task and bucket, of up to ``most_buckets`` open at once.
    """
    spark = rows.sparkSession
    now = load(spark, path) if at is None else at
    if now.applied.get(writer, -1) >= batch:
        return False
    folder = f"{writer}-{batch}-{uuid.uuid4().hex}"
    tagged = rows.withColumn("_bucket", bucket.cast("string"))
    if shuffled:
        dealt = tagged.repartition("_bucket") if spread is None else tagged.repartition("_bucket", spread)
        dealt.write.partitionBy("_bucket").parquet(f"{path}/data/{folder}", compression=compression)
    else:
        with _open_files(spark, most_buckets + 1):
            tagged.write.partitionBy("_bucket").parquet(f"{path}/data/{folder}", compression=compression)
    written = {n.split("=", 1)[1] for n in _names(spark, f"{path}/data/{folder}") if n.startswith("_bucket=")}
    gone = set(replaced)
    folders = {b: f for b, f in now.folders.items() if b not in gone}
    for name in written:
        folders[name] = [*folders.get(name, []), folder]
    schema = now.schema or json.loads(rows.schema.json())
    _publish(spark, path, Manifest(now.number + 1, folders, now.applied | {writer: batch}, schema))
    return True


def read_table(spark: SparkSession, path: str, buckets: Iterable[str] | None = None) -> DataFrame | None:
    """The rows of the newest manifest, of some buckets if named; null before the first batch."""
    now = load(spark, path)
    if now.schema is None:
        return None
    schema = T.StructType.fromJson(now.schema)
    chosen = now.folders if buckets is None else {b: now.folders[b] for b in buckets if b in now.folders}
    paths = [f"{path}/data/{folder}/_bucket={b}" for b, folders in sorted(chosen.items()) for folder in folders]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def read_batch(spark: SparkSession, path: str, writer: str, batch: int) -> DataFrame:
    """The rows one batch of a writer added, as far as the newest manifest names them."""
    now = load(spark, path)
    prefix = f"{writer}-{batch}-"
    paths = [
        f"{path}/data/{folder}/_bucket={b}"
        for b, folders in sorted(now.folders.items())
        for folder in folders
        if folder.startswith(prefix) and len(folder) == len(prefix) + 32
    ]
    schema = T.StructType.fromJson(now.schema)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def key_bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def upsert_rows(rows: DataFrame, path: str, key: str, writer: str, batch: int, buckets: int = BUCKETS) -> bool:
    """Log new versions of rows by key; a retried batch adds nothing.

    The order of publication decides between versions, whoever wrote them. A
    batch has at most one row of a key, or any of them wins.
    """
    return _log(rows, path, key, writer, batch, buckets, gone=False)


def delete_keys(keys: DataFrame, path: str, key: str, writer: str, batch: int, buckets: int = BUCKETS) -> bool:
    """Log the end of keys; a later upsert brings one back."""
    schema = T.StructType.fromJson(load(keys.sparkSession, path).schema)
    names = keys.select(key).distinct()
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in (key, *LOG_COLUMNS)]
    return _log(names.select(key, *empty), path, key, writer, batch, buckets, gone=True)


def _log(rows: DataFrame, path: str, key: str, writer: str, batch: int, buckets: int, gone: bool) -> bool:
    now = load(rows.sparkSession, path)
    if now.applied.get(writer, -1) >= batch:
        return False
    logged = rows.withColumns({"_version": F.lit(now.number + 1).cast("bigint"), "_gone": F.lit(gone)})
    return write_batch(logged, path, key_bucket(key, buckets), writer, batch, at=now)


def _newest_versions(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    logged = read_table(spark, path)
    if logged is None:
        return None
    rest = F.struct(*[c for c in logged.columns if c != key])
    newest = logged.groupBy(key).agg(F.max_by(rest, "_version").alias("_row"))
    return newest.select(key, "_row.*").select(logged.columns)


def newest_rows(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The newest version of every key that is not deleted; null before the first batch."""
    newest = _newest_versions(spark, path, key)
    return None if newest is None else newest.filter("not _gone").drop(*LOG_COLUMNS)


def compact(spark: SparkSession, path: str, key: str, writer: str = "compaction", buckets: int = BUCKETS) -> bool:
    """One folder per bucket with only the newest versions; readers go on with the old ones meanwhile."""
    now, rows = load(spark, path), _newest_versions(spark, path, key)
    if rows is None:
        return False
    batch = now.applied.get(writer, -1) + 1
    rows = rows.filter("not _gone")
    return write_batch(rows, path, key_bucket(key, buckets), writer, batch, list(now.folders), at=now)


def remove_unreferenced(spark: SparkSession, path: str) -> list[str]:
    """Delete data folders and manifests that the newest manifest does not name.

    For when no reader of an older manifest is left. Returns what went.
    """
    now = load(spark, path)
    kept = {folder for folders in now.folders.values() for folder in folders}
    gone = [f"data/{n}" for n in _names(spark, f"{path}/data") if n not in kept]
    gone += [f"_manifests/{n}" for n in _names(spark, f"{path}/_manifests") if n != f"{now.number:012d}.json"]
    for name in gone:
        store, where = _files(spark, f"{path}/{name}")
        store.delete(where, True)
    return gone
