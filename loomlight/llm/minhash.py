"""Document fingerprints: MinHash signatures over word shingles.

``PERMUTATIONS`` multiply-add hashes modulo 2**64 with odd factors run over the
32-bit names of all shingles of many documents at a time; the upper 16 bits of
each minimum are the signature. Signatures that agree in a share of places have
about that Jaccard similarity. Signatures are cut into bands whose equal values
are joined in Spark to find similar documents, and the pairs found are verified
on the whole shingle sets.

Comparing each document with the next one in order of id needs neighbours of the
whole table side by side. Ids alone are range-partitioned first; the last key of
each range bounds it, and texts are shuffled once, packed, to the range they
belong to. The last document of a range goes to the range behind it as well.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlight.lineage import materialize
from loomlight.llm import flat
from loomlight.llm.graph import components
from loomlight.llm.rows import map_batches

U64 = np.uint64
PERMUTATIONS = 128
SHINGLE = 5
BANDS = 32
PERCENT = 80
RANGE_BYTES = 64 << 20
MAX_RANGES = 1 << 16  # what the bounds in a task's closure hold at most
_SEED = 12061


def _factors(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(_SEED)
    factor = draw.integers(0, 1 << 63, permutations, dtype=U64) * U64(2) + U64(1)
    return factor, draw.integers(0, 1 << 63, permutations, dtype=U64) * U64(2)


def shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = SHINGLE):
    """(name, row) of each run of ``size`` words of rows that lie one after the other.

    A-Z count as a-z. A text of fewer words is one shingle, one without words none.
    """
    if len(starts) == 0 or ends[-1] == starts[0]:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    part = flat.lower(data[int(starts[0]) : int(ends[-1])])
    low = starts - starts[0]
    first, last, row = flat.words(part, low, ends - starts[0])
    if not len(first):
        return np.zeros(0, U64), row
    hashes = flat.Hashes(flat.word_hashes(part, first, last))
    count = np.bincount(row, minlength=len(starts))
    stop = np.cumsum(count)[row]  # end of the row's words
    begin = np.arange(len(row))
    whole = begin == stop - count[row]  # the first word of each row
    keep = whole | (begin + size <= stop)
    return hashes.of(begin[keep], np.minimum(begin + size, stop)[keep]), row[keep]


def signatures(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = SHINGLE, permutations: int = PERMUTATIONS) -> np.ndarray:
    """A row of 16-bit minima per text; all ones where there is no shingle."""
    out = np.full((len(starts), permutations), 0xFFFF, np.uint16)
    factor, addend = _factors(permutations)
    for lo, hi in flat.row_slices(starts, ends):
        names, row = shingles(data, starts[lo:hi], ends[lo:hi], size)
        if not len(names):
            continue
        names = names >> U64(32)
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        value = np.empty_like(names)
        for k in range(permutations):
            np.multiply(names, factor[k], out=value)
            value += addend[k]
            out[lo + row[begin], k] = np.minimum.reduceat(value, begin) >> U64(48)
    return out


def text_signatures(texts: pa.Array, **options) -> np.ndarray:
    return signatures(*flat.buffers(texts), **options)


def likeness(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (first == second).mean(axis=1)


def fingerprint_strings(rows: np.ndarray) -> list[str]:
    """Four hexadecimal digits a place."""
    digits, step = rows.astype(">u2").tobytes().hex(), 4 * rows.shape[1]
    return [digits[at : at + step] for at in range(0, len(digits), step)]


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (2 * rows.shape[1])
    data = np.ascontiguousarray(rows, "<u2").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _bounds(docs: DataFrame) -> tuple[list[tuple], int]:
    """The last key of each range of (id, text hash), ascending; keys only are shuffled."""
    spark = docs.sparkSession
    key = F.struct(F.col("id").isNotNull().alias("there"), "id", "name")
    keys = materialize(docs.select("id", "name", F.octet_length("text").cast("long").alias("bytes")), "keys")
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    ranges = min(int(wanted), MAX_RANGES)
    dealt = keys.repartitionByRange(ranges, F.col("id").asc_nulls_first(), "name")
    ends = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.max(key).alias("last"))
    found = [(r["last"]["there"], r["last"]["id"], r["last"]["name"]) for r in ends.select("last").collect()]
    return sorted(found, key=_place), ranges


def _place(key: tuple) -> tuple:
    there, name, text = key
    return (1, name, text) if there else (0, text)


def compare_neighbours(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Columns ``id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. The next document is
    the one before in ascending order of id, nulls first, equal ids by a hash of
    their texts; after the first one comes the last. In the edited text the last
    half of the code points, rounded down, gives way to as many from the start
    of the next document, or all it has. Null texts are empty; texts without
    words have one fingerprint of their own and are alike. Repeated rows follow
    each other. Other columns are not read; an empty table gives no row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("name"))
    bounds, ranges = _bounds(rows)
    id_type = rows.schema["id"].dataType
    packed = T.StructType(
        [T.StructField("id", id_type)]
        + T._parse_datatype_string("name bigint, range int, carried boolean, size bigint, packed binary, signature binary").fields
    )
    places = [_place(b) for b in bounds]

    def pack(batch: pa.RecordBatch) -> dict:
        data, starts, ends = flat.buffers(batch.column("text"))
        own = signatures(data, starts, ends, size, permutations)
        keys = list(zip(batch.column("id").to_pylist(), batch.column("name").to_pylist(), strict=True))
        keys = [_place((i is not None, i, n)) for i, n in keys]
        home = np.array([bisect_left(places, k) for k in keys], np.int32)
        last = np.flatnonzero([places[h] == k for h, k in zip(home, keys, strict=True)])
        blobs = [pa.compress(data[a:b], codec="zstd", asbytes=True) for a, b in zip(starts, ends, strict=True)]
        take = np.concatenate([np.arange(len(keys)), last])
        index = pa.array(take)
        return {
            "id": batch.column("id").take(index),
            "name": batch.column("name").take(index),
            "range": np.concatenate([home, (home[last] + 1) % len(places)]).astype(np.int32),
            "carried": np.arange(len(take)) >= len(keys),
            "size": (ends - starts)[take],
            "packed": pa.array(blobs, pa.binary()).take(index),
            "signature": _binary(own).take(index),
        }

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, before = None, b""  # the range at hand and the text seen last
        near = np.zeros((1, permutations), np.uint16)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = part.num_rows
                raw = b"".join(part.column("signature").to_pylist())
                own = np.frombuffer(raw, "<u2").reshape(n, permutations)
                carried = part.column("carried").to_pylist()
                edited, next_to, chars, kept = [], np.empty_like(own), [], []
                columns = (part.column(c).to_pylist() for c in ("range", "size", "packed"))
                for i, (number, length, blob) in enumerate(zip(*columns, strict=True)):
                    whole = pa.decompress(blob, length, codec="zstd", asbytes=True) if length else b""
                    if carried[i]:
                        if number != here:  # copies of the carried row say the same
                            here, before, near = number, whole, own[i : i + 1]
                        continue
                    points = whole.decode()
                    half = len(points) // 2
                    edited.append(points[: len(points) - half].encode() + before.decode()[:half].encode())
                    next_to[len(kept)] = near
                    chars.append(len(points))
                    kept.append(i)
                    before, near = whole, own[i : i + 1]
                if not kept:
                    continue
                mine, other = own[kept], next_to[: len(kept)]
                changed = text_signatures(pa.array(edited, pa.binary()).cast(pa.string()), size=size, permutations=permutations)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(kept)),
                        pa.array(chars, pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                        pa.array(fingerprint_strings(mine)),
                        pa.array(fingerprint_strings(changed)),
                        pa.array(likeness(mine, changed)),
                        pa.array(likeness(mine, other)),
                    ],
                    names=result.names,
                )

    result = T.StructType(
        [T.StructField("id", id_type)]
        + T._parse_datatype_string(
            "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
        ).fields
    )
    dealt = (
        map_batches(rows, pack, packed)
        .repartition(ranges, "range")
        .sortWithinPartitions("range", F.col("carried").desc(), F.col("id").asc_nulls_first(), "name")
    )
    return dealt.mapInArrow(compare, result)


def _band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    step = rows.shape[1] // bands
    out = np.empty((len(rows), bands), np.int64)
    for b in range(bands):
        key = np.full(len(rows), b + 1, U64)
        for value in rows[:, b * step : (b + 1) * step].T:
            key = flat.mix(key ^ (value.astype(U64) + U64(0x9E3779B97F4A7C15)))
        out[:, b] = key.view(np.int64)
    return out


def similar_classes(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    size: int = SHINGLE,
    percent: int = PERCENT,
    permutations: int = PERMUTATIONS,
    bands: int = BANDS,
) -> DataFrame:
    """``id`` and ``class_id`` of every row: the least id that similar documents lead to.

    Documents are candidates if a band of their signatures agrees and their
    signatures are not clearly too different; they are linked if the Jaccard
    similarity of their whole shingle sets is ``percent`` in a hundred or more. With 32
    bands of four places a pair at 0.8 is missed once in ten million. Equal sets
    are one member of a band's bucket. A bucket is compared with one drawn member
    at a time, which takes rows in proportion to its size; members that links
    join already need no comparison, and what stays apart is compared in slices
    of ``SLICE`` against each other. Rows without words have no links. Null ids
    count as larger than all others; repeated rows share their class.
    """
    spark_text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), spark_text.alias("text"))

    def sign(batch: pa.RecordBatch) -> dict:
        data, starts, ends = flat.buffers(batch.column("text"))
        own = signatures(data, starts, ends, size, permutations)
        name = np.zeros(len(starts), U64)
        for lo, hi in flat.row_slices(starts, ends):
            names, row = shingles(data, starts[lo:hi], ends[lo:hi], size)
            once = np.unique(np.stack([row.astype(U64), names]), axis=1)
            np.add.at(name, lo + once[0].astype(np.int64), flat.mix(once[1] ^ U64(0x51)))
        words = np.array([bool(len(blob.split())) for blob in batch.column("text").to_pylist()], bool)
        return {
            "id": batch.column("id"),
            "name": pa.array(name.view(np.int64), mask=~words),
            "signature": _binary(own),
            "bands": pa.array(list(_band_keys(own, bands)), pa.list_(pa.int64())),
        }

    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType)]
        + T._parse_datatype_string("name bigint, signature binary, bands array<bigint>").fields
    )
    signed = materialize(map_batches(rows, sign, schema), "signed")
    sets = materialize(
        signed.filter("name is not null").groupBy("name").agg(
            F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("bands").alias("bands")
        ),
        "sets",
    )
    buckets = sets.select("name", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    buckets = materialize(buckets.join(shared, "key"), "buckets")
    links = _links(buckets, sets.select("name", "signature"), rows, size, percent)

    roots = components(links).withColumnRenamed("node", "name")
    classes = sets.select("name", "id").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = classes.groupBy("root").agg(F.min("id").alias("class_id"))
    of_set = classes.select("name", "root").join(least, "root").select("name", "class_id")
    found = signed.select("id", "name").join(of_set, "name", "left")
    return found.select("id", F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


SLICE = 256
STAR_ROUNDS = 6


def _links(buckets: DataFrame, signed: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v) links whose components are those of all candidate pairs that hold."""
    texts = _texts_by_set(buckets.select("name").distinct(), rows, size)
    links = None
    open_members = buckets.withColumn("root", F.col("name"))
    before = open_members.count()
    for turn in range(STAR_ROUNDS):
        if not before:
            break
        leader = open_members.groupBy("key").agg(
            F.min_by(F.struct("name", "root"), F.xxhash64("name", F.lit(turn))).alias("leader")
        )
        pairs = (
            open_members.join(leader, "key")
            .filter("root != leader.root")
            .select(F.least("name", "leader.name").alias("u"), F.greatest("name", "leader.name").alias("v"))
            .distinct()
        )
        links, open_members = _joined(links, _verified(pairs, signed, texts, percent), buckets)
        now = open_members.count()
        if now > before // 2:
            before = now
            break
        before = now
    if before:
        pairs = _sliced_pairs(open_members)
        links, _ = _joined(links, _verified(pairs, signed, texts, percent), buckets)
    if links is None:
        return buckets.select(F.col("name").alias("u"), F.col("name").alias("v")).limit(0)
    return links


def _joined(links: DataFrame | None, more: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links, and the members of buckets that still hold several components."""
    links = more if links is None else links.unionByName(more)
    roots = components(links).withColumnRenamed("node", "name")
    placed = buckets.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    several = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("key")
    return links, materialize(placed.join(several, "key"), "open")


def _sliced_pairs(members: DataFrame) -> DataFrame:
    """Pairs of one bucket and different components; slices of a bucket meet two by two."""
    counts = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    own = F.pmod(F.xxhash64("name"), F.col("slices")).cast("int")
    sliced = members.join(counts, "key").withColumn("slice", own)
    other = sliced.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    tile = other.select(
        "key", F.least("slice", "with").alias("a"), F.greatest("slice", "with").alias("b"), "slice", "name", "root"
    )

    def cross(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names, roots, slices = rows["name"].to_numpy(), rows["root"].to_numpy(), rows["slice"].to_numpy()
        first, second = np.flatnonzero(slices == key[1]), np.flatnonzero(slices == key[2])
        i, j = np.nonzero(roots[first][:, None] != roots[second][None, :])
        u, v = names[first[i]], names[second[j]]
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return tile.groupBy("key", "a", "b").applyInPandas(cross, "u bigint, v bigint").distinct()


def _texts_by_set(names: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(name, sorted shingles) of one document of each set that stands in a bucket."""

    def list_shingles(batch: pa.RecordBatch) -> dict:
        data, starts, ends = flat.buffers(batch.column("text"))
        out, name = [np.zeros(0, np.int64)] * len(starts), np.zeros(len(starts), U64)
        for lo, hi in flat.row_slices(starts, ends):
            found, row = shingles(data, starts[lo:hi], ends[lo:hi], size)
            at = np.searchsorted(row, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                once = np.unique(found[at[i] : at[i + 1]])
                out[lo + i] = once.view(np.int64)
                name[lo + i] = flat.mix(once ^ U64(0x51)).sum(dtype=U64)
        return {"name": name.view(np.int64), "shingles": pa.array(out, pa.list_(pa.int64()))}

    listed = map_batches(rows.select("text"), list_shingles, "name bigint, shingles array<bigint>")
    return materialize(listed.join(names, "name", "left_semi").dropDuplicates(["name"]), "shingles")


def _verified(pairs: DataFrame, signed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    slack = 0.2  # more than five deviations of an estimate from 128 places

    def close(batch: pa.RecordBatch) -> dict:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("a", "b"))
        keep = pa.array(np.flatnonzero(likeness(a, b) >= percent / 100 - slack))
        return {"u": batch.column("u").take(keep), "v": batch.column("v").take(keep)}

    def side(name: str, table: DataFrame, column: str, alias: str) -> DataFrame:
        return table.select(F.col("name").alias(name), F.col(column).alias(alias))

    near = pairs.join(side("u", signed, "signature", "a"), "u").join(side("v", signed, "signature", "b"), "v")
    near = materialize(map_batches(near.select("u", "v", "a", "b"), close, "u bigint, v bigint"), "near")
    both = near.join(side("u", texts, "shingles", "a"), "u").join(side("v", texts, "shingles", "b"), "v")
    shared = F.size(F.array_intersect("a", "b"))
    similar = 100 * shared >= percent * (F.size("a") + F.size("b") - shared)
    return materialize(both.filter(similar).select("u", "v"), "links")
