"""Exact substring dedup over bytes by bucket-pointer refinement.

Suffixes start in the bucket of the q-gram at their anchor. A bucket is refined
by sorting on the bucket identifiers of later offsets: with buckets of length h
known everywhere, the bucket of a position and that of the position h further
on give the buckets of length 2h, which serve the next pass in turn. Buckets
left with one suffix are final and drop out of every later pass.

Which buckets are worth refining, and in how many groups, is decided by counts
over the whole table first (``repeats``). Identifiers are 64-bit names of
content, so tasks agree on them without exchanging ranks; two windows count as
equal only if q-gram, offset and name all agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomlight.llm import flat
from loomlight.llm.repeats import find_repeats, joined_spans, span_arrays, suffixes
from loomlight.llm.rows import map_batches, with_results

WINDOW = 400
GRAM = 32
GROUP_LIMIT = 1000
RESULTS = ("kept_bytes", "n_bytes", "n_removed", "removed_spans")


def _refine(bucket: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new bucket numbers, members) after sorting each bucket by ``name``.

    Only members of buckets of two or more are returned, in bucket order.
    """
    order = np.lexsort((name, bucket))
    b, v = bucket[order], name[order]
    new = np.concatenate([[True], (b[1:] != b[:-1]) | (v[1:] != v[:-1])])
    number = np.cumsum(new) - 1
    several = np.bincount(number)[number] > 1
    return number[several], order[several]


def refined_repeats(units, start, anchor, lo, hi, key, window, q=GRAM):
    """Windows of some groups that are equal to another one of their group."""
    context, offset, position = suffixes(start, anchor, lo, hi)
    q = min(q, window)
    size = q
    names = flat.Hashes(units).grams(q)
    bucket = np.unique(key, return_inverse=True)[1][context] * np.int64(window) + offset
    bucket, alive = _refine(bucket, names[position])
    while size < window and len(alive):
        later = min(size, window - size)
        bucket, members = _refine(bucket, names[position[alive] + later])
        alive = alive[members]
        size += later
        if size < window:
            joined = names[:-later] if later else names
            names = flat.mix(joined + flat.mix(names[later:]))
    return context[alive], offset[alive]


def _keep(batch: pa.RecordBatch) -> dict:
    data, starts, ends = flat.buffers(batch.column("text"))
    raw = data.tobytes() if len(data) < (1 << 27) else memoryview(data)
    n_removed, kept, spans = [], [], []
    rows = zip(starts.tolist(), ends.tolist(), span_arrays(batch), strict=True)
    for low, high, (start, stop) in rows:
        n_removed.append(int((stop - start).sum()))
        spans.append([{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
        cuts = [0, *np.stack([start, stop], axis=1).ravel().tolist(), high - low]
        kept.append(b"".join(bytes(raw[low + a : low + b]) for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
    return {
        "row": batch.column("row"),
        "kept_bytes": kept,
        "n_bytes": ends - starts,
        "n_removed": n_removed,
        "removed_spans": spans,
    }


def remove_repeated_bytes(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    window: int = WINDOW,
    q: int = GRAM,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """The input with ``kept_bytes``, ``n_bytes``, ``n_removed``, ``removed_spans``.

    A byte goes if a string of ``window`` bytes that also starts elsewhere
    covers it; cuts may fall inside a character, so what is kept is binary.
    Null text counts as empty. Result columns replace input columns of the same
    name. Rows with equal id and text are repeats of each other.
    """
    spans = find_repeats(docs, text_col, id_col, "byte", window, q, refined_repeats, group_limit)
    rows = joined_spans(docs, text_col, id_col, spans)
    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("kept_bytes", T.BinaryType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("removed_spans", T.ArrayType(pair)),
        ]
    )
    done = map_batches(rows, _keep, schema)
    return done.select(*[done["row"].getField(c).alias(c) for c in with_results(docs, RESULTS)], *RESULTS)
