"""Vector code compression by member-resident Lloyd rounds.

A vector becomes integers and is cut into parts; each part position has a
codebook of entries. Part rows live with the owner of their entry, partitioned
by (position, entry, salt); the salt splits an entry that holds very many parts.
An owner adds up its resident members, the sums make the new entries, and every
part looks for its nearest entry where it lives. Parts whose entry stays are
written on in place; only those that change it go through the next shuffle.

What reaches the driver is the codebooks: parts x entries x width integers,
whatever the number of vectors. All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlight.lineage import materialize
from loomlight.llm.rows import map_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers end here, so that squared distances of 1,024 components fit 64 bits.
LIMIT = 1 << 25
ROWS_AT_ONCE = 4096


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component, between plus and minus ``LIMIT``."""

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(float(scale))
        return F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), scaled))).cast("int")

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    infinite = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite))
    return F.coalesce(finite, F.lit(False))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (the least one of a tie) and its squared distance."""
    n, width = rows.shape
    largest = max(int(np.abs(rows).max(initial=0)), int(np.abs(book).max(initial=0)))
    # Doubles hold every term exactly up to 53 bits, and multiply far faster.
    kind = np.float64 if 4 * width * largest * largest < 1 << 53 else np.int64
    entries = book.astype(kind)
    own = (entries * entries).sum(axis=1)
    index, distance = np.empty(n, np.int16), np.empty(n, np.int64)
    for at in range(0, n, ROWS_AT_ONCE):
        part = rows[at : at + ROWS_AT_ONCE].astype(kind)
        squared = (part * part).sum(axis=1)[:, None] - 2 * (part @ entries.T) + own
        best = squared.argmin(axis=1)
        index[at : at + len(part)] = best
        distance[at : at + len(part)] = squared[np.arange(len(part)), best]
    return index, distance


def _packed(rows: np.ndarray, kind: str) -> pa.Array:
    data = np.ascontiguousarray(rows, kind)
    step = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _unpacked(column: pa.Array, width: int, kind: str) -> np.ndarray:
    if width == 0:
        return np.zeros((len(column), 0), np.int64)
    raw, first = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(raw, np.uint8)[first[0] : first[-1]]
    return data.view(np.dtype(kind)).reshape(len(column), width).astype(np.int64)


class Codebooks:
    """Entries by part position; arrays of (entries, width)."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    @property
    def width(self) -> int:
        return self.books[0].shape[1]

    def sha256(self) -> str:
        """Of all integers by position, entry and place, joined by commas."""
        text = ",".join(str(int(x)) for book in self.books for x in book.ravel())
        return hashlib.sha256(text.encode()).hexdigest()


_STATE = "row bigint, position int, entry smallint, moved boolean, error bigint, part binary"


def _state_type(df: DataFrame) -> T.StructType:
    kept = [T.StructField(c, df.schema[c].dataType) for c in ("id", "label")]
    return T.StructType(T._parse_datatype_string(_STATE).fields + kept)


def _first_assignment(vectors: DataFrame, books: Codebooks, kind: str) -> DataFrame:
    width, parts = books.width, len(books.books)

    def assign(batch: pa.RecordBatch) -> Iterator[dict]:
        ints = batch.column("ints")
        flat = ints.flatten().to_numpy(zero_copy_only=False) if width else np.zeros(0, np.int64)
        rows = flat.reshape(batch.num_rows, parts, width)
        for p in range(parts):
            entry, error = nearest(rows[:, p].astype(np.int64), books.books[p])
            yield {
                "row": batch.column("row"),
                "position": np.full(batch.num_rows, p, np.int32),
                "entry": entry,
                "moved": np.ones(batch.num_rows, bool),
                "error": error,
                "part": _packed(rows[:, p], kind),
                "id": batch.column("id"),
                "label": batch.column("label"),
            }

    return map_batches(vectors.select("row", "ints", "id", "label"), assign, _state_type(vectors))


def _assignment(state: DataFrame, books: Codebooks, kind: str) -> DataFrame:
    """Every part against the codebook of its position, where it lives."""

    def assign(batch: pa.RecordBatch) -> dict:
        position, before = batch.column("position").to_numpy(), batch.column("entry").to_numpy()
        rows = _unpacked(batch.column("part"), books.width, kind)
        entry, error = np.empty(len(rows), np.int16), np.empty(len(rows), np.int64)
        for p in np.unique(position):
            mine = np.flatnonzero(position == p)
            entry[mine], error[mine] = nearest(rows[mine], books.books[p])
        out = {name: batch.column(name) for name in ("row", "position", "part", "id", "label")}
        return out | {"entry": entry, "moved": entry != before, "error": error}

    return map_batches(state, assign, state.schema)


def _settled(assigned: DataFrame, salts: int) -> DataFrame:
    """The next state: who stays is read where it is, who moved goes to its new owner."""
    movers = assigned.filter("moved")
    owner = F.pmod(F.xxhash64("row"), F.lit(salts))
    return materialize(movers.repartition("position", "entry", owner), "movers")


def _updated(state: DataFrame, books: Codebooks, kind: str) -> Codebooks:
    """New entries: floors of the means of the members; entries without any stay.

    A task adds up the members it holds and gives one row per entry, so the
    sums that meet are as many as owners.
    """
    parts, entries, width = len(books.books), len(books.books[0]), books.width

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(parts * entries, np.int64)
        total = np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = _unpacked(batch.column("part"), width, kind)
            owner = batch.column("position").to_numpy().astype(np.int64) * entries + batch.column("entry").to_numpy()
            order = np.argsort(owner, kind="stable")
            used, first = np.unique(owner[order], return_index=True)
            total[used] += np.add.reduceat(rows[order], first, axis=0)
            count += np.bincount(owner, minlength=len(count))
        used = np.flatnonzero(count)
        if len(used):
            sums = pa.array(list(total[used]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), sums], names=["owner", "n", "sums"])

    resident = state.select("position", "entry", "part").mapInArrow(add, "owner bigint, n bigint, sums array<bigint>")
    counts = resident.groupBy("owner").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)],
    )
    new = [book.copy() for book in books.books]
    for owner, n, *sums in counts.collect():
        new[owner // entries][owner % entries] = [s // n for s in sums]
    return Codebooks(new)


def compress_vectors(
    rows: DataFrame,
    vector_col: str,
    id_col: str,
    label_col: str | None = None,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """``id``, ``label``, ``code`` and ``error`` of every usable row, and the codebooks.

    Rows whose vector is null or holds a null, NaN or infinity are left out.
    Vectors shorter than the longest, and lengths that ``parts`` does not
    divide, are filled up with zeros. The codebooks start from the rows of the
    smallest ids, nulls last, ties by vector; there are fewer entries where
    there are fewer rows, and none for an empty table. Repeated rows and ids
    count each. Components end at plus and minus 2**25 after scaling. Other
    columns are not read, so their names do not matter.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hexadecimal digits an entry")
    spark = rows.sparkSession
    vector = F.col(vector_col)
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col)
    kept = rows.filter(usable(vector)).select(
        F.col(id_col).alias("id"), label.alias("label"), integers(vector, scale).alias("ints")
    )
    # Written once, so that row numbers stay what they are.
    kept = materialize(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    longest, reach = kept.agg(
        F.max(F.size("ints")), F.max(F.greatest(F.abs(F.array_max("ints")), F.abs(F.array_min("ints"))))
    ).first()
    if longest is None:
        none = kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return none, Codebooks([np.zeros((0, 0), np.int64) for _ in range(parts)])
    width = -(-longest // parts)
    zeros = F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("ints"))
    vectors = kept.withColumn("ints", F.concat("ints", zeros))
    kind = "<i2" if (reach or 0) < 1 << 15 else "<i4"
    starts = vectors.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    first = np.array([r.ints for r in starts], np.int64).reshape(len(starts), parts, width)
    books = Codebooks([first[:, p] for p in range(parts)])

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = _settled(_first_assignment(vectors, books, kind), salts)
    for turn in range(rounds):
        if turn:
            assigned = materialize(_assignment(state, books, kind), "assigned")
            state = assigned.filter("not moved").unionByName(_settled(assigned, salts))
        books = _updated(state, books, kind)
    final = _assignment(state, books, kind).select("row", "position", "entry", "error", "id", "label")
    digits = F.lpad(F.lower(F.hex(F.col("entry").cast("bigint"))), 2, "0")
    coded = final.groupBy("row").agg(
        F.first("id").alias("id"),
        F.first("label").alias("label"),
        F.concat(*[F.max(F.when(F.col("position") == p, digits)) for p in range(parts)]).alias("code"),
        F.sum("error").alias("error"),
    )
    return coded.drop("row"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the errors of equal labels added up; nulls are one label.

    Null where a sum leaves 64 bits.
    """
    coded = materialize(coded, "coded")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
