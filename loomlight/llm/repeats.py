"""Long substrings that occur more than once in a table of texts.

Both substring operators share this frame; they differ in how a memory-sized
group of suffixes is resolved (a suffix tree, or bucket-pointer refinement).

A *window* is ``window`` consecutive units (words or bytes) of one document.
Equal windows hold the same *anchor*, the leftmost of their q-grams with the
least hash, at the same offset. So only anchors are shuffled (a few per cent
of all positions), each with the run of window starts that it serves:

1. runs by the hash of their anchor's q-gram (the initial buckets / the first
   prefix). A bucket of one run cannot hold a repeat and ends there; a bucket
   whose runs are all equal is repeated as a whole.
2. equal runs of the other buckets are counted before anything is gathered,
   and one of each goes on, with the units that its windows cover.
3. a bucket of more than ``group_limit`` distinct runs is split: its windows by
   offset into two halves, whose common core, now longer, joins the key. A
   bucket of one offset has the whole window in its key and is decided by a
   count. So no key, however frequent, is gathered in one task.
4. what is left are groups of bounded size, resolved in tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.lineage import materialize
from loomlight.llm import flat
from loomlight.llm.rows import KEYS, key_columns, map_batches, map_groups, row_struct

U64 = np.uint64
#: (units of the contexts, start of each, anchor inside each, smallest and largest
#: offset of each, group of each, window) -> (context, offset) of repeated windows
Resolver = Callable[..., tuple[np.ndarray, np.ndarray]]

RUNS = "k1 bigint, k2 bigint, bucket bigint, whole bigint, anchor bigint, first bigint, last bigint"
CONTEXTS = "key bigint, low int, high int, bucket bigint, whole bigint, anchor int, lo int, hi int, context binary"
FOUND = "bucket bigint, whole bigint, start int, stop int"


def word_pieces(batch: pa.RecordBatch, column: str, limit: int = 4 * flat.SLICE):
    """(rows, word hashes, first word of each row, end, byte spans) of slices."""
    data, starts, ends = flat.buffers(batch.column(column))
    for lo, hi in flat.row_slices(starts, ends, limit):
        base = int(starts[lo])
        part = data[base : int(ends[hi - 1])]
        begin, stop, row = flat.words(data, starts[lo:hi], ends[lo:hi])
        count = np.bincount(row, minlength=hi - lo)
        end = np.cumsum(count)
        yield np.arange(lo, hi), flat.word_hashes(part, begin, stop), end - count, end, (part, begin, stop)


def _runs(batch: pa.RecordBatch, unit: str, q: int, window: int) -> list[dict]:
    k1, k2 = (batch.column(k).to_numpy() for k in KEYS)
    out = []

    def add(rows: np.ndarray, origin: np.ndarray, units, start, end) -> None:
        got = flat.runs_by_anchor(units, start, end, q, window)
        seg = got["segment"]
        shift = origin[seg] - start[seg] if len(seg) else seg
        out.append(
            {
                "k1": k1[rows[seg]] if len(seg) else k1[:0],
                "k2": k2[rows[seg]] if len(seg) else k2[:0],
                "bucket": got["bucket"].view(np.int64),
                "whole": got["whole"].view(np.int64),
                **{k: got[k] + shift for k in ("anchor", "first", "last")},
            }
        )

    if unit == "word":
        for rows, hashes, start, end, _ in word_pieces(batch, "text"):
            add(rows, np.zeros(len(rows), np.int64), hashes, start, end)
    else:
        data, starts, ends = flat.buffers(batch.column("text"))
        for rows, start, end in flat.pieces(starts, ends, window - 1):
            base = int(start[0])
            units = flat.byte_values()[data[base : int(end[-1])]]
            add(rows, start - starts[rows], units, start - base, end - base)
    return out


def _contexts(batch: pa.RecordBatch, unit: str, window: int) -> list[dict]:
    """The units that the windows of the chosen runs cover."""
    chosen = batch.column("runs")
    counts = np.diff(np.asarray(chosen.offsets))
    values = chosen.flatten()
    col = {f: values.field(f).to_numpy() for f in ("bucket", "whole", "anchor", "first", "last")}
    owner = np.repeat(np.arange(len(counts)), counts)
    data, starts, ends = flat.buffers(batch.column("text"))
    raw = data.tobytes() if unit == "byte" else None
    first, stop = col["first"], col["last"] + window
    contexts: list[bytes] = []
    if unit == "byte":
        at = starts[owner]
        contexts = [raw[a:b] for a, b in zip((at + first).tolist(), (at + stop).tolist(), strict=True)]
    else:
        ranges, at = list(zip(first.tolist(), stop.tolist(), strict=True)), 0
        for row, n in enumerate(counts.tolist()):
            parts = data[int(starts[row]) : int(ends[row])].tobytes().split()
            contexts += [b" ".join(parts[a:b]) for a, b in ranges[at : at + n]]
            at += n
    low = (col["anchor"] - col["last"]).astype(np.int32)
    high = (col["anchor"] - col["first"]).astype(np.int32)
    n = len(contexts)
    return [
        {
            "key": col["bucket"],
            "low": np.zeros(n, np.int32),
            "high": np.full(n, 1 << 30, np.int32),
            "bucket": col["bucket"],
            "whole": col["whole"],
            "anchor": high,
            "lo": low,
            "hi": high,
            "context": contexts,
        }
    ]


def _unpack(table: pa.Table | pa.RecordBatch, unit: str):
    """Units of all contexts, and where each starts and ends."""
    column = table.column("context")
    data, starts, ends = flat.buffers(column)
    base = int(starts[0])
    part = data[base : int(ends[-1])]
    if unit == "byte":
        return flat.byte_values()[part], starts - base, ends - base
    begin, stop, row = flat.words(data, starts, ends)
    count = np.bincount(row, minlength=len(starts))
    end = np.cumsum(count)
    return flat.word_hashes(part, begin, stop), end - count, end


def _split(batch: pa.RecordBatch, unit: str, q: int, window: int) -> list[dict]:
    """Both halves of each context's offsets, keyed by their longer common core."""
    units, start, _ = _unpack(batch, unit)
    hashes = flat.Hashes(units)
    col = {n: batch.column(n).to_numpy() for n in ("key", "low", "high", "bucket", "whole", "anchor", "lo", "hi")}
    high = np.minimum(col["high"], window - q)
    middle = (col["low"] + high) // 2
    out = []
    for low, top in ((col["low"], middle), (middle + 1, high)):
        mine = np.flatnonzero((col["lo"] <= top) & (col["hi"] >= low) & (low <= top))
        if not len(mine):
            continue
        at = start[mine] + col["anchor"][mine]
        core = hashes.of(at - low[mine], at - top[mine] + window)
        key = flat.mix(core ^ flat.mix(col["key"][mine].view(U64) + low[mine].astype(U64) + U64(1)))
        out.append(
            {
                "key": key.view(np.int64),
                "low": low[mine].astype(np.int32),
                "high": top[mine].astype(np.int32),
                "bucket": col["bucket"][mine],
                "whole": col["whole"][mine],
                "anchor": col["anchor"][mine],
                "lo": np.maximum(col["lo"][mine], low[mine]).astype(np.int32),
                "hi": np.minimum(col["hi"][mine], top[mine]).astype(np.int32),
                "context": batch.column("context").take(pa.array(mine)),
            }
        )
    return out


def _resolve(table: pa.Table, unit: str, window: int, resolver: Resolver) -> dict | None:
    units, start, _ = _unpack(table, unit)
    col = {n: table.column(n).to_numpy() for n in ("key", "bucket", "whole", "anchor", "lo", "hi")}
    context, offset = resolver(units, start, col["anchor"], col["lo"], col["hi"], col["key"], window)
    if not len(context):
        return None
    order = np.lexsort((offset, context))
    context, offset = context[order], offset[order]
    new = np.concatenate([[True], (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)])
    at = np.flatnonzero(new)
    end = np.concatenate([at[1:], [len(context)]]) - 1
    # An offset counts back from the anchor: the largest is the first window.
    place = col["anchor"][context[at]]
    return {
        "bucket": col["bucket"][context[at]],
        "whole": col["whole"][context[at]],
        "start": (place - offset[end]).astype(np.int32),
        "stop": (place - offset[at]).astype(np.int32),
    }


def find_repeats(
    docs: DataFrame, text_col: str, id_col: str, unit: str, window: int, q: int, resolver: Resolver, group_limit: int
) -> DataFrame:
    """Ranges of units covered by windows that start more than once.

    Returns ``k1``, ``k2`` and ``spans``, an array of half-open (start, stop)
    ranges, for every row that has any.
    """
    texts = docs.select(*key_columns(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    runs = map_batches(
        texts.filter(F.length("text") > 0), lambda batch: _runs(batch, unit, q, window), RUNS
    )
    runs = materialize(runs, "runs")
    buckets = (
        runs.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most"))
        .filter("n > 1")
        .select("bucket", (F.col("least") == F.col("most")).alias("one"))
    )
    # Written first, so that Spark can split a frequent bucket of the join.
    buckets = materialize(buckets, "buckets")
    live = materialize(runs.join(buckets, "bucket"), "live")
    several = live.filter("not one")
    classes = materialize(
        several.groupBy("bucket", "whole").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "anchor", "first", "last")).alias("run")
        ),
        "classes",
    )
    by_row = (
        classes.select("run.k1", "run.k2", F.struct("bucket", "whole", "run.anchor", "run.first", "run.last").alias("r"))
        .groupBy("k1", "k2")
        .agg(F.collect_list("r").alias("runs"))
    )
    held = map_batches(
        texts.join(by_row, ["k1", "k2"]).select("text", "runs"),
        lambda batch: _contexts(batch, unit, window),
        CONTEXTS,
    )
    held = materialize(held, "contexts")
    # About as many units at once as a slice of texts has, whatever a unit is.
    rows = max(500, 2 * flat.SLICE // (2 * window))
    found: list[DataFrame] = []
    while True:
        sizes = held.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), (F.min("low") == F.max("high")).alias("single")
        )
        large = materialize(sizes.filter(f"n > {group_limit} or single"), "large")
        bounded = held.join(large, "key", "left_anti")
        found.append(
            map_groups(bounded, "key", lambda table: _resolve(table, unit, window, resolver), FOUND, rows)
        )
        if large.isEmpty():
            break
        # One offset: the key holds the whole window, so a count decides.
        decided = held.join(large.filter("single and n > 1"), "key", "left_semi")
        found.append(
            decided.select("bucket", "whole", (F.col("anchor") - F.col("hi")).alias("start"), (F.col("anchor") - F.col("lo")).alias("stop"))
        )
        rest = held.join(large.filter("not single"), "key", "left_semi")
        held = materialize(map_batches(rest, lambda batch: _split(batch, unit, q, window), CONTEXTS), "contexts")
    part = found[0]
    for more in found[1:]:
        part = part.unionByName(more)
    part = part.select("bucket", "whole", F.struct("start", "stop").alias("r"))
    part = part.groupBy("bucket", "whole").agg(F.collect_set("r").alias("parts"))
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.col("last") - F.col("first")).cast("int").alias("stop")))
    equal = classes.filter("n > 1").select("bucket", "whole")
    # Written first, so that Spark can split a frequent class of the join.
    part = materialize(part.join(equal, ["bucket", "whole"], "left_anti"), "parts")
    spans = [
        live.filter("one").select("k1", "k2", "first", whole.alias("parts"), "last"),
        several.join(equal, ["bucket", "whole"], "left_semi").select("k1", "k2", "first", whole.alias("parts"), "last"),
        several.join(part, ["bucket", "whole"]).select("k1", "k2", "first", "parts", "last"),
    ]
    joined = spans[0].unionByName(spans[1]).unionByName(spans[2])
    moved = F.transform(
        "parts",
        lambda p: F.struct(
            (F.col("first") + p["start"]).alias("start"), (F.col("first") + p["stop"] + window).alias("stop")
        ),
    )
    return (
        joined.select("k1", "k2", moved.alias("parts"))
        .groupBy("k1", "k2")
        .agg(F.flatten(F.collect_list("parts")).alias("spans"))
    )


def joined_spans(docs: DataFrame, text_col: str, id_col: str, spans: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``row`` (``columns``, by default all), ``text`` and ``spans`` of every row of ``docs``."""
    rows = docs.select(
        row_struct(docs.columns if columns is None else columns),
        *key_columns(id_col, text_col),
        F.col(text_col).cast("string").alias("text"),
    )
    return rows.join(spans, ["k1", "k2"], "left").select("row", "text", "spans")


def span_arrays(batch: pa.RecordBatch):
    """For each row the merged (start, stop) arrays of its ``spans``."""
    column = batch.column("spans")
    if column.null_count:
        column = column.fill_null(pa.scalar([], column.type))
    counts = np.diff(np.asarray(column.offsets))
    values = column.flatten()
    start, stop = values.field("start").to_numpy(), values.field("stop").to_numpy()
    at = 0
    for n in counts.tolist():
        yield flat.merge_spans(start[at : at + n], stop[at : at + n])
        at += n


def suffixes(start: np.ndarray, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """(context, offset, position) of every window start of the contexts."""
    count = (hi - lo + 1).astype(np.int64)
    context = np.repeat(np.arange(len(lo)), count)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return context, offset, start[context] + anchor[context] - offset
