"""Overlapping chunks that end at natural boundaries.

Where a chunk starts depends on where the one before it ended, so the cut
points of one text are found by a small function over that text. Spark spreads
the texts; the work per text is linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

# Chunk geometry in characters (code points).
CHUNK_SIZE = 1000
OVERLAP = 200
MIN_CHUNK = 400

# Chunks written at a time, about 2 MB.
CHUNKS_PER_BATCH = 2_000

# White space as the source platform defines it (no no-break spaces).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a"
    "\u2028\u2029\u205f\u3000"
)
_SPACES = frozenset(WHITESPACE)
SENTENCE_ENDS = ".!?"


def _sentence_end(text: str, low: int, limit: int) -> int:
    """Largest end in [low, limit] that closes a sentence, or -1."""
    best = -1
    for mark in SENTENCE_ENDS:
        at = text.rfind(mark, max(low - 1, 0), limit)
        while at >= 0 and at + 1 > best:
            if at + 1 == len(text) or text[at + 1] in _SPACES:
                best = at + 1
                break
            at = text.rfind(mark, max(low - 1, 0), at)
    return best


def _cut(text: str, start: int, size: int, least: int) -> int:
    limit = start + size
    if limit >= len(text):
        return len(text)
    low = start + least
    paragraph = text.rfind("\n\n", low, limit + 2)
    if paragraph >= 0:
        return paragraph + 2
    sentence = _sentence_end(text, low, limit)
    if sentence >= 0:
        return sentence
    for gap in "\n ":
        at = text.rfind(gap, low, limit + 1)
        if at >= 0:
            return at
    return limit


def split_text(
    text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = MIN_CHUNK
) -> Iterator[str]:
    """Chunks of one text; empty ones and repeats of the one before are left out."""
    start, previous = 0, None
    while start < len(text):
        end = _cut(text, start, size, least)
        piece = text[start:end].strip(WHITESPACE)
        if piece and piece != previous:
            yield piece
            previous = piece
        start = end - overlap if end - overlap > start else end


def chunk_documents(
    documents: DataFrame,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    least: int = MIN_CHUNK,
) -> DataFrame:
    """One row per chunk: the columns of ``documents`` without the text, plus
    chunk_index (from 0), total_chunks and content.

    A narrow step: each Arrow batch of documents gives batches of chunk rows,
    so a text is cut exactly once and its total costs no shuffle.
    """
    kept = [c for c in documents.columns if c != text]
    source = documents.select(*kept, text)
    fields = [f for f in source.schema.fields if f.name != text]
    schema = (
        StructType(fields)
        .add("chunk_index", IntegerType(), False)
        .add("total_chunks", IntegerType(), False)
        .add("content", StringType(), False)
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Texts become Python strings one at a time.
            texts = batch.column(len(kept))
            start = 0
            while start < len(texts):
                rows, places, totals, pieces = [], [], [], []
                # Bounded output batches, whatever the texts expand to.
                while start < len(texts) and len(pieces) < CHUNKS_PER_BATCH:
                    found = list(split_text(texts[start].as_py() or "", size, overlap, least))
                    rows += [start] * len(found)
                    places += range(len(found))
                    totals += [len(found)] * len(found)
                    pieces += found
                    start += 1
                chosen = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(chosen) for i in range(len(kept))]
                    + [
                        pa.array(places, pa.int32()),
                        pa.array(totals, pa.int32()),
                        pa.array(pieces, pa.string()),
                    ],
                    names=[*kept, "chunk_index", "total_chunks", "content"],
                )
        # Python workers serve many stages.
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(cut, schema)


def back_fill_totals(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunk count per document on every chunk of an existing chunk table.

    Counting first and joining keeps a very large document out of a single
    window partition.
    """
    totals = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_chunks"))
    return chunks.drop("total_chunks").join(totals, keys)


def repeated_neighbours(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks equal to the one before them in their document (none after chunking).

    The neighbour is met by equality on (document, index), which spreads even
    a single huge document evenly.
    """
    digest = F.sha2("content", 256)
    here = chunks.select(*keys, "chunk_index", digest.alias("digest"))
    before = here.select(
        *keys, (F.col("chunk_index") + 1).alias("chunk_index"), F.col("digest").alias("previous")
    )
    return (
        here.join(before, [*keys, "chunk_index"])
        .filter(F.col("digest") == F.col("previous"))
        .select(*keys, "chunk_index")
    )
