"""Text embedding hook.

An embedder is any function from a text column to an ``array<float>`` column.
The default hashes words into a fixed number of buckets and scales the counts
to unit length: it needs no model, and equal texts get equal vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from loomlight.functions.terms import term_lists, term_text

Embedder = Callable[[Column], Column]
DIMENSIONS = 64
SLICE_ROWS = 2_048


def _buckets(words: pa.LargeStringArray) -> np.ndarray:
    """The first six hexadecimal digits of each word's MD5, modulo ``DIMENSIONS``."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8).tolist()
    data = words.buffers()[2].to_pybytes()
    # Bytes of the buffer as they are: most distinct words are rare, and strings of them cost more than their hash.
    heads = b"".join([md5(data[a:b]).digest()[:3] for a, b in pairwise(ends)])
    high, middle, low = np.frombuffer(heads, np.uint8).reshape(-1, 3).astype(np.int64).T
    return (high << 16 | middle << 8 | low) % DIMENSIONS


@F.arrow_udf(ArrayType(FloatType()))
def _hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        # Cut in slices that fit a cache; words of a batch repeat: hash each distinct one once.
        terms = pa.concat_arrays([term_lists(texts.slice(at, SLICE_ROWS)) for at in range(0, max(len(texts), 1), SLICE_ROWS)])
        words = terms.flatten().dictionary_encode()
        buckets = _buckets(words.dictionary)
        counts = np.zeros(len(terms) * DIMENSIONS)
        if len(words):
            rows = pc.list_parent_indices(terms)
            cells = np.asarray(rows) * DIMENSIONS + buckets[np.asarray(words.indices)]
            counts = np.bincount(cells, minlength=len(counts)).astype(np.float64)
        matrix = counts.reshape(-1, DIMENSIONS)
        norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
        offsets = pa.array(np.arange(len(terms) + 1) * DIMENSIONS, pa.int32())
        yield pa.ListArray.from_arrays(offsets, pa.array(unit.ravel().astype(np.float32)))


def hashed_terms(text: Column) -> Column:
    """Bucket counts of the terms of a text, scaled to unit length."""
    return _hashed(term_text(text))
