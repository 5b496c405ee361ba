"""From a table of questions to the prompts that answer them, in one job.

Every question takes the route its plan gives it: a fixed context, the whole of
some documents, or a search with its plans, expansion, merge and visuals. The
three meet again as context segments, and these become prompts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.functions.prompts import session_block, user_prompt
from loomlight.lineage import materialize
from loomlight.operators.embedding import Embedder, hashed_terms
from loomlight.operators.evidence import context_blocks, stable_visuals
from loomlight.operators.rerank import PairScorer, word_coverage
from loomlight.ordering import number_rows
from loomlight.plans.retrieval import (
    merge_evidence,
    plan_queries,
    retrieve_with_expansion,
    visual_evidence,
)
from loomlight.plans.routing import direct_documents, dispatch, fixed_contexts, plans_of, routed

_SHOWN = [
    "request_id", "position", "vector_id", "content", "source_name", "source_type", "purpose",
    "merge_op",
]
_PLACE = "\0"


def _document_evidence(dispatched: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks of the documents a request reads, by document and place in it."""
    found = direct_documents(dispatched, chunks).join(
        dispatched.select("plan_id", "request_id", "purpose", "merge_op"), "plan_id"
    )
    order = ["target_pos", "chunk_index", "vector_id"]
    return number_rows(found, ["request_id"], order).select(*_SHOWN)


def question_contexts(
    requests: DataFrame,
    sessions: DataFrame,
    chunks: DataFrame,
    scorer: PairScorer = word_coverage,
    embed: Embedder = hashed_terms,
) -> DataFrame:
    """Context of every request as (request_id, route, segment_no, text).

    ``requests`` has request_id (unique), question, session_id, raw_routing and
    uploads; ``sessions`` session_id (unique), uploads, active_document and
    still_indexing; ``chunks`` the columns retrieval needs, with embeddings.
    A request of an unknown session is dispatched without uploads. A question
    that asks for visuals gets up to three per plan before its texts. A context
    is its segments in order; a request without evidence has one that says so.
    """
    asked = materialize(routed(requests), "routed")
    plans = materialize(plans_of(asked), "plans")
    dispatched = materialize(dispatch(plans.filter("plan_pos = 0"), sessions), "dispatched")
    routes = dispatched.select("request_id", "route")

    searching = routes.filter("route = 'SEARCH'").select("request_id")
    names = F.coalesce(F.transform("entity_list", lambda e: e["name"]), F.array().cast("array<string>"))
    searched = plans.join(searching, "request_id", "left_semi").withColumn("entities", names)
    queries = materialize(plan_queries(searched, embed), "queries")
    evidence, _ = retrieve_with_expansion(queries, chunks, scorer)
    merging = queries.select("request_id", "merge_op").distinct()
    found = merge_evidence(evidence.drop("merge_op"), merging).select(*_SHOWN)
    read = _document_evidence(dispatched, chunks)
    shown = materialize(stable_visuals(visual_evidence(queries.filter("visual_search"), chunks, scorer)), "visuals")

    texts = context_blocks(
        routes.filter("route in ('SEARCH', 'DOCUMENT')").select("request_id"),
        materialize(found.unionByName(read), "evidence"),
        shown,
    )
    fixed = fixed_contexts(dispatched).select(
        "request_id", F.lit(0).cast("bigint").alias("segment_no"), F.col("context").alias("text")
    )
    return texts.select("request_id", "segment_no", "text").unionByName(fixed).join(
        routes, "request_id"
    ).select("request_id", "route", "segment_no", "text")


def question_prompts(
    contexts: DataFrame, requests: DataFrame, histories: DataFrame | None = None
) -> DataFrame:
    """User prompts around contexts, as (request_id, segment_no, prompt).

    The first segment opens the prompt; the last one is followed by the session,
    the history (request_id, history; at most one a request) and the question.
    ``requests`` may have an ``active_document``. A null question is empty.
    """
    told = requests
    if histories is None:
        told = told.withColumn("history", F.lit(""))
    else:
        told = told.join(histories.select("request_id", "history"), "request_id", "left")
    active = F.col("active_document") if "active_document" in requests.columns else F.lit(None).cast("string")
    whole = user_prompt(
        F.coalesce("question", F.lit("")),
        F.lit(_PLACE),
        F.coalesce("history", F.lit("")),
        F.coalesce(session_block(F.col("uploads"), active), F.lit("")),
    )
    # The first mark is the context's: only fixed words stand before it.
    around = told.select("request_id", F.split(whole, _PLACE, 2).alias("around"))
    last = contexts.groupBy("request_id").agg(F.max("segment_no").alias("_last"))
    return contexts.join(last, "request_id").join(around, "request_id").select(
        "request_id",
        "segment_no",
        F.concat(
            F.when(F.col("segment_no") == 0, F.col("around")[0]).otherwise(""),
            "text",
            F.when(F.col("segment_no") == F.col("_last"), F.col("around")[1]).otherwise(""),
        ).alias("prompt"),
    )
