"""Keyword search over an inverted index that is built as chunks arrive.

A posting is one term of one chunk with its places. Postings lie in buckets by
term behind a manifest, so a batch of chunks adds folders and a search reads
only the buckets of its own terms. Every task writes the postings of its chunks,
chunk by chunk, so nothing is shuffled and a term that stands in very many
chunks is spread over the files of its bucket. Next to the postings lie the counts of
chunks per term, which tell the rarest term of a query exactly.

A search starts from the postings of each query's rarest term: only chunks that
hold one of these can match. They gather the postings of wanted terms, and meet
the term sets of the queries as bits (``operators.cover``). No text is read and
no term that no query has is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.functions.terms import lexemes
from loomlight.lineage import materialize
from loomlight.operators import lexical
from loomlight.operators.cover import cover_scores, from_postings
from loomlight.operators.lexical import query_terms
from loomlight.sources import manifest

BUCKETS = 64
CHUNKS_PER_BATCH = 2_000


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets))


def postings(chunks: DataFrame, chunk_id: str = "vector_id", chunk_text: str = "content", analyzer: str = "simple") -> DataFrame:
    """(term, chunk_id, places): the places of each term in each chunk, in order.

    ``english`` drops stop words, whose places stay empty, and stems the rest. A
    task sorts the words of some chunks by chunk and term. Nothing is shuffled.
    """

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNKS_PER_BATCH):
                part = batch.slice(at, CHUNKS_PER_BATCH)
                yield _inverted(part.column(0), part.column(1))
        # Python workers serve many stages.
        pa.default_memory_pool().release_unused()

    kind = chunks.schema[chunk_id].dataType.simpleString()
    words = chunks.select(chunk_id, lexemes(F.col(chunk_text), analyzer).alias("words"))
    return words.mapInArrow(invert, f"term string, chunk_id {kind}, places array<int>")


def _inverted(ids: pa.Array, words: pa.Array) -> pa.RecordBatch:
    """Postings of some chunks; '' holds the place of a stop word and is no term."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    named = words.flatten().dictionary_encode()
    code = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    stops = pc.equal(named.dictionary, "").to_numpy(zero_copy_only=False).astype(bool)
    kept = np.flatnonzero(~stops[code])
    # Chunk by chunk: ids that stand together, and those of one text, take little room.
    order = kept[np.argsort(chunk[kept] * len(named.dictionary) + code[kept], kind="stable")]
    pair = chunk[order] * len(named.dictionary) + code[order]
    start = np.flatnonzero(np.diff(pair, prepend=-1))
    ends = pa.array(np.append(start, len(order)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            named.dictionary.take(pa.array(code[order[start]])),
            ids.take(pa.array(chunk[order[start]])),
            pa.ListArray.from_arrays(ends, pa.array(place[order].astype(np.int32))),
        ],
        names=["term", "chunk_id", "places"],
    )


def add_postings(
    chunks: DataFrame,
    path: str,
    batch: int,
    writer: str = "postings",
    chunk_id: str = "vector_id",
    chunk_text: str = "content",
    analyzer: str = "simple",
    buckets: int = BUCKETS,
) -> bool:
    """Index a batch of new chunks; false if it is indexed already.

    Postings are published before counts, and counts only help to choose, so a
    batch that ends between the two is whole after it is run again.
    """
    spark = chunks.sparkSession
    if all(manifest.load(spark, f"{path}/{part}").applied.get(writer, -1) >= batch for part in ("postings", "counts")):
        return False
    rows = postings(chunks, chunk_id, chunk_text, analyzer)
    added = manifest.write_batch(
        rows, f"{path}/postings", _bucket("term", buckets), writer, batch,
        shuffled=False, most_buckets=buckets, compression="zstd",
    )
    stored = manifest.read_batch(spark, f"{path}/postings", writer, batch)
    counts = stored.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    manifest.write_batch(counts, f"{path}/counts", _bucket("term", buckets), writer, batch)
    return added


def search_scores(
    queries: DataFrame,
    path: str,
    query_id: str = "query_id",
    query_text: str = "text",
    chunk_id: str = "vector_id",
    analyzer: str = "simple",
    buckets: int = BUCKETS,
    k: int | None = None,
) -> DataFrame:
    """Every (query_id, chunk_id) where the chunk holds all terms, with its density; with ``k``, the k best and their rank.

    Equals ``lexical.keyword_scores`` over the indexed chunks.
    """
    spark: SparkSession = queries.sparkSession
    asked = materialize(query_terms(queries, query_id, query_text, analyzer), "asked")
    wanted = materialize(asked.select(F.explode("terms").alias("term")).distinct(), "wanted")
    # At most as many as there are buckets.
    touched = [str(r[0]) for r in wanted.select(_bucket("term", buckets)).distinct().collect()]
    index = manifest.read_table(spark, f"{path}/postings", touched)
    counts = manifest.read_table(spark, f"{path}/counts", touched)
    if index is None or counts is None:
        raise ValueError(f"no index at {path}")
    known = counts.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    counted = asked.select(query_id, F.explode("terms").alias("term")).join(known, "term", "left")
    rarest = counted.groupBy(query_id).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("rarest"))
    anchors = materialize(rarest.select(F.col("rarest.term").alias("term")).distinct(), "anchors")
    # Written, so its size is known when it meets the postings.
    candidates = materialize(index.join(anchors, "term", "left_semi").select("chunk_id").distinct(), "candidates")
    met = index.join(wanted, "term", "left_semi").join(candidates, "chunk_id", "left_semi")
    # A chunk has a bounded number of terms.
    held = met.groupBy(F.col("chunk_id").alias("chunk")).agg(F.collect_list(F.struct("term", "places")).alias("held"))
    return cover_scores(asked, held, query_id, chunk_id, from_postings, lexical.MAX_BROADCAST_TERMS, k)


def search(queries: DataFrame, path: str, k: int, query_id: str = "query_id", query_text: str = "text", chunk_id: str = "vector_id", **options) -> DataFrame:
    """Top-k per query: query_id, chunk_id, density, rank; ties by chunk id."""
    return search_scores(queries, path, query_id, query_text, chunk_id, k=k, **options)
