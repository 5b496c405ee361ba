"""Substring dedup by prefix-partitioned suffix trees.

Words covered by a window of ``window`` words that also starts elsewhere are
removed. Suffixes are partitioned by prefixes of variable length: first by the
words of their anchor, and where that leaves more suffixes than fit in memory
by ever longer ones (``repeats``). For each memory-sized group a task builds
the subtree of its suffixes, cut at the depth of a window: the suffixes in
order and the length each shares with the next give its internal nodes, and
those as deep as a window are the repeats. A match is by words; equality of a
group's suffixes is decided on hashed words within one prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomlight.llm import flat
from loomlight.llm.repeats import find_repeats, joined_spans, span_arrays, suffixes
from loomlight.llm.rows import map_batches, with_results

WINDOW = 35
PREFIX = 8
GROUP_LIMIT = 1000
RESULTS = ("n_words", "n_removed", "removed_spans")


def deep_nodes(shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last leaf of each internal node of at least ``depth``.

    ``shared[i]`` is the length that leaves i and i + 1 have in common.
    """
    deep = np.concatenate([[False], shared >= depth, [False]])
    edge = np.flatnonzero(deep[1:] != deep[:-1])
    return edge[::2], edge[1::2]


def subtree_repeats(units, start, anchor, lo, hi, key, window):
    """Suffixes below the deep nodes of the subtrees of some groups."""
    context, offset, position = suffixes(start, anchor, lo, hi)
    _, names = np.unique(units, return_inverse=True)
    names = names.astype(np.int32)
    path = names[position[:, None] + np.arange(window)]
    group = key[context]
    order = np.lexsort((*path.T[::-1], group))
    path, group = path[order], group[order]
    differ = path[1:] != path[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), window)
    shared[group[1:] != group[:-1]] = 0
    first, last = deep_nodes(shared, window)
    count = last - first + 1
    leaf = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return context[order[leaf]], offset[order[leaf]]


def _keep(batch: pa.RecordBatch, layout: bool) -> Iterator[dict]:
    _, starts, ends = flat.buffers(batch.column("text"))
    for lo, hi in flat.row_slices(starts, ends):
        yield _kept(batch.slice(lo, hi - lo), layout)


def _kept(batch: pa.RecordBatch, layout: bool) -> dict:
    texts = batch.column("text").to_pylist()
    n_words, n_removed, kept, spans = [], [], [], []
    for text, (start, stop) in zip(texts, span_arrays(batch), strict=True):
        words = (text or "").encode().split()
        n_words.append(len(words))
        n_removed.append(int((stop - start).sum()))
        spans.append([{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
        at, parts = 0, []
        for a, b in zip(start.tolist(), stop.tolist(), strict=True):
            parts += words[at:a]
            at = b
        whole = layout and not len(start)
        kept.append(text if whole else b" ".join(parts + words[at:]).decode())
    return {"row": batch.column("row"), "kept": kept, "n_words": n_words, "n_removed": n_removed, "removed_spans": spans}


def remove_repeated_words(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    window: int = WINDOW,
    prefix: int = PREFIX,
    group_limit: int = GROUP_LIMIT,
    keep_layout: bool = False,
) -> DataFrame:
    """The input with repeated words removed from ``text_col``.

    Every input row comes back with its columns; ``text_col`` holds the kept
    words joined by one space (empty for null), and ``n_words``, ``n_removed``
    and ``removed_spans`` (word ranges of the input) are added in place of any
    columns of those names. Windows are judged on the input. Rows with equal
    id and text are repeats of each other. An empty table gives an empty one.
    With ``keep_layout`` a text that loses nothing stays as it is, null included.
    """
    spans = find_repeats(docs, text_col, id_col, "word", window, prefix, subtree_repeats, group_limit)
    # The kept words replace the text, so it is not carried beside itself.
    rows = joined_spans(docs, text_col, id_col, spans, [c for c in docs.columns if c != text_col])
    schema = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("kept", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField(
                "removed_spans",
                T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])),
            ),
        ]
    )
    done = map_batches(rows, lambda batch: _keep(batch, keep_layout), schema)
    kept = [c for c in with_results(docs, RESULTS)]
    return done.select(
        *[done["kept"].alias(c) if c == text_col else done["row"].getField(c).alias(c) for c in kept], *RESULTS
    )
