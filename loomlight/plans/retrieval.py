"""Retrieval for whole tables of plans.

A *plan* is one query: request_id, plan_pos, plan_id, purpose,
optimized_query, question, target_documents, entities, mode, scope and
session_id (the caller's). Chunks carry vector_id, content, source_name,
source_type, session_id, chunk_index, image_url, source_url and embedding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.functions.intent import clean_query, effective_query
from loomlight.functions.text import is_blank, normalize_source_name, word_set
from loomlight.lineage import materialize
from loomlight.operators.dense import nearest_chunks
from loomlight.operators.embedding import Embedder, hashed_terms
from loomlight.operators.fusion import POOL_SIZE, fuse_ranks, spread_sources
from loomlight.operators.lexical import best_matches, keyword_matches, keyword_scores
from loomlight.operators.ranking import rank_candidates
from loomlight.operators.rerank import (
    TEXT_RESULTS,
    VISUAL_RESULTS,
    PairScorer,
    score_pairs,
    select_diverse,
    word_coverage,
)
from loomlight.ordering import top_k

# Fixed values.
WHOLE_DOCUMENT_CAP = 60
MIN_CONFIDENCE = 0.42
TOP_WEIGHT, MEAN_WEIGHT, MEAN_OF = 0.6, 0.4, 5
FOUND_ABOVE, PARTIAL_ABOVE = 0.8, 0.5
MAX_ITERATIONS = 2
IMAGE_TYPES = ["IMAGE", "PDF_IMAGE"]

CHUNK_FIELDS = [
    "vector_id", "content", "source_name", "source_type", "session_id", "chunk_index",
    "image_url", "source_url",
]
PLAN_FIELDS = [
    "plan_id", "request_id", "plan_pos", "purpose", "entities", "target_documents",
    "current_session_id",
]

Decider = Callable[[DataFrame], DataFrame]


def _targets(column: str = "target_documents"):
    """Normalised, non-empty target names."""
    names = F.transform(F.col(column), normalize_source_name)
    return F.coalesce(F.filter(names, lambda n: n != ""), F.array().cast("array<string>"))


def plan_queries(plans: DataFrame, embed: Embedder = hashed_terms) -> DataFrame:
    """Plans with the text they search by, its vector and normalised targets."""
    text = effective_query(F.col("optimized_query"), clean_query(F.col("question")))
    searched = plans.withColumn("query_text", text).withColumn("targets", _targets())
    renamed = searched.withColumnRenamed("session_id", "current_session_id")
    if "embedding" not in plans.columns:
        renamed = renamed.withColumn("embedding", embed(F.col("query_text")))
    return renamed


def hybrid_retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = POOL_SIZE,
    image_only: bool = False,
    analyzer: str = "simple",
    targets_in_lexical: bool = False,
    lexical: DataFrame | None = None,
) -> DataFrame:
    """Fused, source-spread candidates: plan_id, chunk fields, fused_score, fused_rank, ranks.

    Targets restrict the dense side; the lexical side searches everything
    unless ``targets_in_lexical``. Image-only search reads image chunks.
    ``lexical`` is the keyword list of these and maybe other queries, where it is known already.
    """
    dense_side, lexical_side = chunks, chunks
    if image_only:
        dense_side = chunks.filter(F.col("source_type").isin(IMAGE_TYPES))
        lexical_side = chunks.filter(~is_blank(F.col("image_url")))
    dense = nearest_chunks(
        queries, dense_side, k, query_id="plan_id", targets="targets", source="source_name"
    )
    if targets_in_lexical:
        scored = keyword_scores(queries, lexical_side, "plan_id", "query_text", analyzer=analyzer)
        lexical = best_matches(_inside_targets(scored, queries, lexical_side), k, "plan_id", "vector_id")
    elif lexical is None:
        lexical = keyword_matches(queries, lexical_side, k, "plan_id", "query_text", analyzer=analyzer)
    else:
        lexical = lexical.join(queries.select("plan_id"), "plan_id", "left_semi")
    # Written, so its size is known: a pool that can be broadcast meets the chunks
    # where they are read, instead of both sides being shuffled.
    fused = materialize(fuse_ranks(dense, lexical, query_id="plan_id"), "fused")
    pool = fused.join(chunks.select(*CHUNK_FIELDS), "vector_id")
    return spread_sources(pool, query_id="plan_id")


def _inside_targets(scored: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Scored pairs whose chunk is of a target source, for queries that have targets."""
    sources = chunks.select("vector_id", "source_name")
    allowed = queries.select("plan_id", "targets")
    return (
        scored.join(sources, "vector_id")
        .join(allowed, "plan_id")
        .filter((F.size("targets") == 0) | F.array_contains("targets", F.col("source_name")))
        .drop("source_name", "targets")
    )


def whole_documents(
    queries: DataFrame, chunks: DataFrame, cap: int | None, query_id: str = "plan_id"
) -> DataFrame:
    """Every chunk of each query's targets in document order, with score 1.

    ``targets`` are normalised. Sources meet by equality on the lower-case
    name; ``cap`` limits the rows per query. Adds target_pos and
    whole_document_match.
    """
    asked = queries.select(query_id, F.posexplode("targets").alias("target_pos", "_name"))
    found = (
        chunks.select(*CHUNK_FIELDS)
        .withColumn("_name", F.lower("source_name"))
        .join(asked, "_name")
        .drop("_name")
        .withColumn("semantic_score", F.lit(1.0))
        .withColumn("final_score", F.lit(1.0))
        .withColumn("whole_document_match", F.lit(True))
    )
    if cap is None:
        return found
    order = [F.col("target_pos"), F.col("chunk_index"), F.col("vector_id")]
    return top_k(found, [query_id], order, cap, "document_rank")


def _is_whole_document():
    return (F.col("mode") == "WHOLE_DOCUMENT") & (F.size("targets") == 1)


def retrieve_evidence(
    queries: DataFrame,
    chunks: DataFrame,
    scorer: PairScorer = word_coverage,
    results: int = TEXT_RESULTS,
    rerank_by: str = "query_text",
    image_only: bool = False,
    analyzer: str = "simple",
    lexical: DataFrame | None = None,
) -> DataFrame:
    """Candidates, pair scores, diverse selection and signal ranking for each plan.

    A plan for one whole document takes its first 60 chunks instead of a search.
    """
    plain = F.coalesce(_is_whole_document(), F.lit(False))
    searched = hybrid_retrieve(
        queries.filter(~plain), chunks, image_only=image_only, analyzer=analyzer, lexical=lexical
    ).select("plan_id", *CHUNK_FIELDS, "fused_rank", F.lit(False).alias("whole_document_match"))
    offered = chunks.filter(~is_blank(F.col("image_url"))) if image_only else chunks
    whole = whole_documents(queries.filter(plain), offered, WHOLE_DOCUMENT_CAP).select(
        "plan_id", *CHUNK_FIELDS, F.col("document_rank").alias("fused_rank"),
        "whole_document_match",
    )
    pool = searched.unionByName(whole)
    asked = queries.select(*PLAN_FIELDS, F.col(rerank_by).alias("query_text"))
    scored = score_pairs(pool.join(asked, "plan_id"), scorer)
    # Scores feed both the selection and its output: keep one copy.
    scored = materialize(scored, "scored")
    diverse = select_diverse(scored, results, query_id="plan_id")
    return rank_candidates(diverse, query_id="plan_id")


def retrieval_quality(
    evidence: DataFrame, key: str = "plan_id", rank: str = "final_rank"
) -> DataFrame:
    """Top score, mean of the first five, rows, sources and confidence per plan."""
    within = F.col(rank) <= MEAN_OF
    return (
        evidence.groupBy(key)
        .agg(
            F.max(F.when(F.col(rank) == 1, F.col("final_score"))).alias("top_score"),
            F.avg(F.when(within, F.col("final_score"))).alias("mean_top5"),
            F.count(F.lit(1)).alias("chunks"),
            F.countDistinct("source_name").alias("sources"),
        )
        .withColumn(
            "confidence", F.col("top_score") * TOP_WEIGHT + F.col("mean_top5") * MEAN_WEIGHT
        )
    )


def observations(
    plans: DataFrame, evidence: DataFrame, key: str = "plan_id", rank: str = "final_rank"
) -> DataFrame:
    """What a retrieval round showed, from the score of its first row."""
    tops = (
        evidence.filter(F.col(rank) == 1)
        .groupBy(key)
        .agg(F.max("final_score").alias("top_score"))
    )
    top = F.col("top_score")
    kind = (
        F.when(top.isNull(), "EVIDENCE_MISSING")
        .when(top > FOUND_ABOVE, "EVIDENCE_FOUND")
        .when(top > PARTIAL_ABOVE, "PARTIAL_EVIDENCE")
        .otherwise("OUT_OF_SCOPE")
    )
    return plans.join(tops, key, "left").withColumn("observation", kind)


def needs_expansion(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Plans with targets whose evidence is missing or weak: plan_id, confidence, reason."""
    quality = retrieval_quality(evidence).select("plan_id", "confidence")
    judged = queries.filter(F.size("targets") > 0).select("plan_id").join(
        quality, "plan_id", "left"
    )
    return judged.select(
        "plan_id",
        "confidence",
        F.when(F.col("confidence").isNull(), "NO_RESULTS")
        .when(F.col("confidence") < MIN_CONFIDENCE, "LOW_CONFIDENCE")
        .alias("reason"),
    ).filter("reason is not null")


def retrieve_with_expansion(
    queries: DataFrame, chunks: DataFrame, scorer: PairScorer = word_coverage,
    analyzer: str = "simple",
) -> tuple[DataFrame, DataFrame]:
    """(evidence, status): plans that fail inside their targets search the whole corpus.

    Only the failing plans run again. Keyword search ignores targets, so both
    rounds share its list. The status row of a plan holds the
    requested and actual scope, expanded_scope and the reason.
    """
    queries = materialize(queries, "queries")
    lexical = materialize(
        keyword_matches(queries, chunks, POOL_SIZE, "plan_id", "query_text", analyzer=analyzer), "lexical"
    )
    primary = materialize(
        retrieve_evidence(queries, chunks, scorer, analyzer=analyzer, lexical=lexical), "primary"
    )
    failing = materialize(needs_expansion(queries, primary), "failing")
    widened = queries.join(failing.select("plan_id"), "plan_id", "left_semi").withColumns(
        {
            "targets": F.array().cast("array<string>"),
            "target_documents": F.array().cast("array<string>"),
        }
    )
    if failing.isEmpty():
        evidence = primary
    else:
        second = retrieve_evidence(widened, chunks, scorer, analyzer=analyzer, lexical=lexical)
        kept = primary.join(failing.select("plan_id"), "plan_id", "left_anti")
        evidence = kept.unionByName(second)
    status = queries.join(failing.select("plan_id", "reason"), "plan_id", "left").select(
        "plan_id",
        F.col("scope").alias("requested_scope"),
        F.when(F.col("reason").isNotNull(), "CORPUS").otherwise(F.col("scope")).alias(
            "actual_scope"
        ),
        F.col("reason").isNotNull().alias("expanded_scope"),
        F.coalesce("reason", F.lit("NONE")).alias("reason"),
    )
    return evidence, status


def visual_evidence(
    queries: DataFrame, chunks: DataFrame, scorer: PairScorer = word_coverage
) -> DataFrame:
    """Up to three image chunks per plan, scored against the question itself."""
    ranked = retrieve_evidence(
        queries, chunks, scorer, VISUAL_RESULTS, rerank_by="question", image_only=True
    )
    return ranked.filter(F.col("final_rank") <= VISUAL_RESULTS).select(
        "request_id",
        "plan_id",
        "plan_pos",
        F.col("final_rank").alias("visual_rank"),
        F.col("vector_id").alias("semantic_id"),
        "image_url",
        F.col("content").alias("caption"),
        F.col("final_score").alias("score"),
        "source_name",
    )


def merge_evidence(evidence: DataFrame, requests: DataFrame, rank: str = "final_rank") -> DataFrame:
    """Evidence of all plans of a request in plan order, with ``position``.

    UNION keeps the first occurrence of a chunk; COMPARE and NONE keep all.
    Scores are not compared across plans.
    """
    order = F.struct("plan_pos", rank)
    tagged = evidence.join(requests.select("request_id", "merge_op"), "request_id")
    firsts = (
        tagged.filter("merge_op = 'UNION'")
        .groupBy("request_id", "vector_id")
        .agg(F.min(order).alias("_first"))
    )
    placed = tagged.join(firsts, ["request_id", "vector_id"], "left").filter(
        F.col("_first").isNull() | (F.col("_first") == order)
    )
    # Ranks of a plan stay below 2**32, so plans never interleave.
    position = F.col("plan_pos").cast("bigint") * (1 << 32) + F.col(rank)
    return placed.withColumn("position", position).drop("_first")


def attach_plan(evidence: DataFrame, plans: DataFrame) -> DataFrame:
    """Plan id and purpose on every evidence row; the ranking reasons stay."""
    known = [c for c in ("purpose", "request_id", "plan_pos") if c in evidence.columns]
    return evidence.drop(*known).join(
        plans.select("plan_id", "request_id", "plan_pos", "purpose"), "plan_id"
    )


def rule_decider(observed: DataFrame) -> DataFrame:
    """Next actions by rule: stop on found evidence, else search by the content words."""
    words = F.array_join(word_set(F.col("query_text")), " ")
    going_on = (F.col("observation") != "EVIDENCE_FOUND") & (words != F.col("query_text"))
    return observed.select(
        "plan_id",
        F.when(going_on, "REFINE").otherwise("STOP").alias("type"),
        F.when(going_on & (words != ""), words).alias("next_query"),
    )


def iterate_retrieval(
    queries: DataFrame,
    chunks: DataFrame,
    decide: Decider = rule_decider,
    max_iterations: int = MAX_ITERATIONS,
    scorer: PairScorer = word_coverage,
    embed: Embedder = hashed_terms,
) -> DataFrame:
    """Retrieve, observe, decide and go on with the next query, a few times.

    Every round is written out, so the plan of one round never contains those
    before it, and only the plans that go on take part in the next. Evidence of
    all rounds is kept with its ``iteration``, without removing repeats.
    """
    active = materialize(queries, "active")
    rounds = []
    for iteration in range(1, max_iterations + 1):
        found = materialize(
            retrieve_evidence(active, chunks, scorer).withColumn("iteration", F.lit(iteration)),
            "round",
        )
        rounds.append(found)
        if iteration == max_iterations:
            break
        actions = decide(observations(active, found)).filter(
            "type != 'STOP' and next_query is not null"
        )
        following = active.join(actions.select("plan_id", "next_query"), "plan_id").withColumns(
            {
                "query_text": F.col("next_query"),
                "embedding": embed(F.col("next_query")),
                "targets": F.array().cast("array<string>"),
                "target_documents": F.array().cast("array<string>"),
                "mode": F.lit("RANKED_RETRIEVAL"),
                "scope": F.lit("CORPUS"),
            }
        )
        active = materialize(following.drop("next_query"), "active")
        if active.isEmpty():
            break
    whole = rounds[0]
    for more in rounds[1:]:
        whole = whole.unionByName(more)
    return whole
