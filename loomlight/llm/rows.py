"""Keys, schemas and scans shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Two 64-bit keys of a row: of its id and of its text. Rows that agree in both
#: are repeated rows and get equal results.
KEYS = ("k1", "k2")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def key_columns(id_col: str, text_col: str) -> list[Column]:
    """``k1`` and ``k2``; null ids and texts have keys of their own."""
    return [
        F.xxhash64(F.col(id_col).isNull(), F.col(id_col)).alias("k1"),
        F.xxhash64(F.col(text_col).isNull(), F.col(text_col)).alias("k2"),
    ]


def with_results(docs: DataFrame, results: Iterable[str]) -> list[str]:
    """The columns of ``docs`` that no result column replaces."""
    names = {name.lower() for name in results}
    return [c for c in docs.columns if c.lower() not in names]


def carried(docs: DataFrame, text_col: str) -> list[str]:
    """The columns that go through a task beside the text; a text of type string goes once."""
    once = isinstance(docs.schema[text_col].dataType, T.StringType)
    return [c for c in docs.columns if not (once and c == text_col)]


def row_struct(columns: Iterable[str]) -> Column:
    """``row``, a struct of some columns; the constant keeps it from being empty."""
    return F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`").alias(c) for c in columns]).alias("row")


def release_memory() -> None:
    """Give back what a finished task no longer uses: Python workers serve many stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another allocator than glibc's


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of few rows for the jobs that run inside; rows are large there."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], dict | None], schema: str | T.StructType
) -> DataFrame:
    """Apply a function of one Arrow batch to columns by name, or several such."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = function(batch)
            if out is None:
                continue
            for columns in [out] if isinstance(out, dict) else out:
                arrays = [
                    c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type)
                    for c, f in ((columns[f.name], f) for f in target)
                ]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)
        release_memory()

    return df.mapInArrow(run, fields)


def map_groups(
    df: DataFrame,
    key: str,
    function: Callable[[pa.Table], dict | list | None],
    schema: str | T.StructType,
    rows: int = 20_000,
) -> DataFrame:
    """Apply a function to tables that hold whole groups of ``key``.

    Groups are dealt by hash and sorted inside a partition. About ``rows``
    rows are handled at a time; only a group of more than that is held whole,
    so callers split large groups first.
    """
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    dealt = df.repartition(F.col(key)).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)

        def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
            out = function(table)
            for columns in (out if isinstance(out, list) else [out]) if out else []:
                arrays = [pa.array(columns[f.name], f.type) for f in target]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                held.append(part)
                count += part.num_rows
                if count < rows:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table[key].to_numpy()
                cut = int(keys.searchsorted(keys[-1], side="left"))
                if cut:
                    yield from finished(table.slice(0, cut))
                    rest = table.slice(cut).combine_chunks()
                    held = rest.to_batches()
                    count = rest.num_rows
        if held:
            yield from finished(pa.Table.from_batches(held).combine_chunks())
        release_memory()

    return dealt.mapInArrow(run, fields)


def map_each_group(
    df: DataFrame, key: str, function: Callable[[pa.Table], Iterable[dict]], schema: str | T.StructType
) -> DataFrame:
    """Apply a function to the table of one group of ``key`` after the other.

    For groups of packed rows, whose number says little about their size: a
    task holds one group and the piece of its result that is being written.
    """
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    dealt = df.repartition(F.col(key)).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)

        def finished(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for columns in function(table):
                arrays = [pa.array(columns[f.name], f.type) for f in target]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)
            pa.default_memory_pool().release_unused()

        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(keys):
                end = int(keys.searchsorted(keys[at], side="right"))
                if held and keys[at] != current:
                    yield from finished(held)
                current = keys[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from finished(held)

    return dealt.mapInArrow(run, fields)
