"""Lexical search: chunks that hold every term of a query, best cover first.

Queries come as distinct term sets to the chunks (``operators.cover``). All
terms must match, so a chunk and a set meet as bits, and only chunks that hold
the whole set are scored, by cover density.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.functions.terms import lexemes, term_text
from loomlight.functions.text import word_count
from loomlight.operators.cover import cover_scores, from_texts, from_words
from loomlight.ordering import top_k

# Fixed value.
MIN_QUERY_WORDS = 3

# Terms of query sets in one broadcast, about 10 MB: four bytes a term, and every distinct one.
MAX_BROADCAST_TERMS = 1_500_000


def query_terms(
    queries: DataFrame, query_id: str = "query_id", text: str = "text", analyzer: str = "simple"
) -> DataFrame:
    """query_id and the distinct terms of every query long enough to be searched."""
    long_enough = word_count(F.lower(text)) >= MIN_QUERY_WORDS
    terms = F.array_distinct(F.filter(lexemes(F.col(text), analyzer), lambda t: t != ""))
    return (
        queries.filter(long_enough)
        .select(query_id, terms.alias("terms"))
        .filter(F.size("terms") > 0)
    )


def keyword_scores(
    queries: DataFrame,
    chunks: DataFrame,
    query_id: str = "query_id",
    query_text: str = "text",
    chunk_id: str = "vector_id",
    chunk_text: str = "content",
    analyzer: str = "simple",
) -> DataFrame:
    """Every (query_id, chunk_id) where the chunk holds all terms, with its density.

    Queries under three words are skipped. Filters on the chunks (only images,
    only one session) belong on ``chunks`` before the call.
    """
    return _covers(queries, chunks, query_id, query_text, chunk_id, chunk_text, analyzer)


def _covers(
    queries: DataFrame, chunks: DataFrame, query_id: str, query_text: str, chunk_id: str, chunk_text: str,
    analyzer: str, k: int | None = None,
) -> DataFrame:
    asked = query_terms(queries, query_id, query_text, analyzer)
    if analyzer == "simple":
        read, words = from_texts, term_text(F.col(chunk_text))
    else:
        read, words = from_words, lexemes(F.col(chunk_text), analyzer)
    rows = chunks.select(F.col(chunk_id).alias("chunk"), words.alias("words"))
    return cover_scores(asked, rows, query_id, chunk_id, read, MAX_BROADCAST_TERMS, k)


def best_matches(scored: DataFrame, k: int, query_id: str, chunk_id: str) -> DataFrame:
    return top_k(scored, [query_id], [F.col("density").desc(), F.col(chunk_id)], k)


def keyword_matches(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_text: str = "text",
    chunk_id: str = "vector_id",
    chunk_text: str = "content",
    analyzer: str = "simple",
) -> DataFrame:
    """Top-k per query: query_id, chunk_id, density, rank; ties by chunk id."""
    return _covers(queries, chunks, query_id, query_text, chunk_id, chunk_text, analyzer, k)
