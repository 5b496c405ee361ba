"""Terms of a text for lexical search.

``simple`` keeps every lower-case run of letters and digits; ``english`` drops
stop words and stems the rest. Tasks in Python take texts as they are and cut
them there (``term_text``, ``term_lists``): an array of words is much slower to
make and to pass on than its text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loomlight.functions.stemming import STOP_WORDS, stem

NOT_A_TERM = r"[^\p{L}\p{N}]+"
#: Code points below are letters, digits or neither in every version of Unicode in use.
SETTLED = 0x250
_UNSETTLED = r"[^\x00-\u024F]"
_IN_TERM = np.array([unicodedata.category(chr(i))[0] in "LN" for i in range(SETTLED)])
# Of the bytes beyond ASCII, only two-byte characters may be no part of a term.
_BYTE = np.concatenate([_IN_TERM[:128], np.ones(128, bool)])
_LEADS = np.zeros(256, bool)
_LEADS[0xC2 : 0xC0 + (SETTLED >> 6) + 1] = True


def terms_of(text: Column) -> Column:
    """All terms in order; a term's place in the array is its position."""
    return F.filter(F.split(F.lower(text), NOT_A_TERM), lambda t: t != "")


def term_text(text: Column) -> Column:
    """A text with the terms of ``text``, in their order, for ``term_lists``."""
    lowered = F.lower(text)
    return F.when(lowered.rlike(_UNSETTLED), F.regexp_replace(lowered, NOT_A_TERM, " ")).otherwise(lowered)


def term_lists(texts: pa.Array) -> pa.Array:
    """Terms of texts that ``term_text`` made, as ``terms_of`` gives them; null has none."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return pa.array([], pa.large_list(pa.large_string()))
    bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    held = texts.buffers()[2]
    data = (np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8))[bounds[0] : bounds[-1]]
    inside = _BYTE[data]
    lead = np.flatnonzero(_LEADS[data])
    if len(lead):
        point = (data[lead].astype(np.int64) & 0x1F) << 6 | (data[lead + 1] & 0x3F)
        out = lead[(point < SETTLED) & ~_IN_TERM[np.minimum(point, SETTLED - 1)]]
        inside[out] = inside[out + 1] = False
    at = np.flatnonzero(inside)
    # A term begins after a gap, and with the first byte a text has.
    begins = np.ones(len(at), bool)
    begins[1:] = at[1:] != at[:-1] + 1
    firsts = np.searchsorted(at, bounds - bounds[0])
    begins[firsts[firsts < len(at)]] = True
    begin = np.flatnonzero(begins)
    ends = np.append(begin, len(at))
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(data[at]))
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(begin, firsts), pa.int64()), words)


def stem_lists(rows: pa.Array) -> pa.Array:
    """Stems of lists of words; words repeat, so each distinct one is stemmed once and none is copied."""
    words = rows.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(rows), 0)
    ends = pc.cumulative_sum(sizes) if len(rows) else sizes
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, stems.take(words.indices), mask=rows.is_null())


@F.arrow_udf(ArrayType(StringType()))
def _stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for rows in batches:
        yield stem_lists(rows)


def lexemes(text: Column, analyzer: str = "simple") -> Column:
    """Terms with '' in the place of a stop word, so positions keep their gaps."""
    if analyzer == "simple":
        return terms_of(text)
    if analyzer != "english":
        raise ValueError(f"unknown analyzer {analyzer!r}")
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.transform(
        terms_of(text), lambda t: F.when(F.array_contains(stops, t), "").otherwise(t)
    )
    return _stems(kept)
