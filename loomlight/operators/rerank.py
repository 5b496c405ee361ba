"""Scoring of (query, chunk) pairs and diverse selection.

A pair scorer is any function from a query column and a text column to a logit
column, for example an iterator ``pandas_udf`` that loads a model once per
worker. The default needs no model: it grows with the share of query words the
text holds and yields scores in (0, 1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions.text import sigmoid_score, word_set

PairScorer = Callable[[Column, Column], Column]

# Fixed values.
LAMBDA = 0.5
TEXT_RESULTS = 5
VISUAL_RESULTS = 3

LOGIT_SPREAD = 8.0


def word_coverage(query: Column, text: Column) -> Column:
    """Logit from -4 (no query word in the text) to 4 (all of them)."""
    asked = word_set(query)
    shared = F.size(F.array_intersect(asked, word_set(text)))
    share = F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(shared / F.size(asked))
    return F.lit(LOGIT_SPREAD) * share - F.lit(LOGIT_SPREAD / 2)


def score_pairs(
    pairs: DataFrame, scorer: PairScorer = word_coverage, query: str = "query_text",
    text: str = "content",
) -> DataFrame:
    """Adds semantic_score, the logistic of the scorer's logit in single precision."""
    score = sigmoid_score(scorer(F.col(query), F.col(text))).cast("double")
    return pairs.withColumn("semantic_score", score)


def _pick(scores: list[float], words: list[frozenset], n: int) -> list[int]:
    """Indices chosen one by one: relevance minus likeness to what is chosen.

    Candidates come best first, so the first maximum wins ties.
    """
    chosen, nearest = [], [0.0] * len(scores)
    left = list(range(len(scores)))
    while left and len(chosen) < n:
        if chosen:
            best = max(left, key=lambda i: LAMBDA * scores[i] - (1.0 - LAMBDA) * nearest[i])
        else:
            best = left[0]
        chosen.append(best)
        left.remove(best)
        for i in left:
            if words[i] and words[best]:
                common = len(words[i] & words[best])
                union = len(words[i]) + len(words[best]) - common
                nearest[i] = max(nearest[i], common / union)
    return chosen


def select_diverse(
    scored: DataFrame,
    n: int = TEXT_RESULTS,
    query_id: str = "query_id",
    chunk_id: str = "vector_id",
    text: str = "content",
    before: str = "fused_rank",
) -> DataFrame:
    """Maximal marginal relevance (Carbonell and Goldstein, 1998): n rows per query.

    Adds ``pick``, the order of selection from 1. Candidates are ordered by
    semantic_score, ties by ``before``. The pool of a query is bounded by the
    retrievers' k, so its rows fit one array; many queries share one batch.
    """
    entry = F.struct(
        (-F.col("semantic_score")).alias("key"),
        F.col(before).alias("before"),
        F.col(chunk_id).alias("id"),
        word_set(F.col(text)).alias("words"),
    )
    pools = scored.groupBy(query_id).agg(F.array_sort(F.collect_list(entry)).alias("pool"))

    @F.pandas_udf("array<int>")
    def pick(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for scores, words in batches:
            yield pd.Series(
                [
                    _pick(list(s), [frozenset(x) for x in w], n)
                    for s, w in zip(scores, words)
                ]
            )

    relevance = F.transform("pool", lambda c: -c["key"])
    # Word sets travel as arrays of arrays, in pool order.
    chosen = pick(relevance, F.transform("pool", lambda c: c["words"]))
    picks = pools.select(query_id, "pool", F.posexplode(chosen).alias("at", "index")).select(
        query_id,
        F.element_at("pool", F.col("index") + 1)["id"].alias(chunk_id),
        (F.col("at") + 1).alias("pick"),
    )
    return scored.join(picks, [query_id, chunk_id])
