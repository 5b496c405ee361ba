"""From questions and raw routing answers to plans and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.functions.intent import (
    clean_query,
    effective_query,
    fast_intent,
    parse_routing,
    retrieval_scope,
)
from loomlight.functions.text import normalize_source_name
from loomlight.plans.retrieval import whole_documents
from loomlight.schemas import MERGE_OPERATIONS

# Fixed values.
META_CONTEXT = (
    "Context: The user is asking about past conversations or asking for clarification. "
    "Rely on the Conversation History above."
)
SESSION_HEADER = "SESSION_INFO:\nActive session documents uploaded by the user:\n"
NO_DOCUMENTS = "No active documents in this session."


def routed(requests: DataFrame) -> DataFrame:
    """Requests with their routing: request_id, question, session_id, raw_routing, uploads.

    ``uploads`` is the array of the session's file names. A fast intent wins
    over the raw answer. Adds clean, intent, routing, tier, merge_op and
    visual_search.
    """
    clean = clean_query(F.col("question"))
    routing = parse_routing(F.col("raw_routing"), F.col("question"))
    tier = F.upper(F.coalesce(F.col("routing.execution_tier"), F.lit("DIRECT")))
    merge = F.upper(F.col("routing.merge_operation"))
    return (
        requests.withColumn("clean", clean)
        .withColumn("intent", fast_intent(F.col("clean")))
        .withColumn("routing", routing)
        .withColumn("tier", F.when(F.col("intent").isNotNull(), "DIRECT").otherwise(tier))
        .withColumn(
            "merge_op",
            F.when(F.col("intent").isNull() & merge.isin(MERGE_OPERATIONS), merge).otherwise(
                "NONE"
            ),
        )
        .withColumn(
            "visual_search",
            F.col("intent").isNull() & F.coalesce(F.col("routing.visual_search"), F.lit(False)),
        )
    )


def plans_of(requests: DataFrame) -> DataFrame:
    """One row per plan of each routed request, with its tier normalised.

    More than one plan, or a DECOMPOSE tier, makes a request STATIC; ADAPTIVE
    keeps its first plan; anything else is DIRECT and takes its first plan.
    """
    fallback = F.array(
        F.struct(
            F.lit("Fallback Plan").alias("purpose"),
            F.col("question").alias("optimized_query"),
            F.array().cast("array<string>").alias("target_documents"),
        )
    )
    fast = F.array(
        F.struct(
            F.col("intent").alias("purpose"),
            F.col("clean").alias("optimized_query"),
            F.array().cast("array<string>").alias("target_documents"),
        )
    )
    given = F.col("routing.plans")
    empty = F.coalesce(F.size(given) < 1, F.lit(True))
    listed = (
        F.when(F.col("intent").isNotNull(), fast).when(empty, fallback).otherwise(given)
    )
    kind = (
        F.when(F.col("tier") == "ADAPTIVE", "ADAPTIVE")
        .when((F.col("tier") == "DECOMPOSE") | (F.size("_plans") > 1), "STATIC")
        .otherwise("DIRECT")
    )
    used = F.when(F.col("execution") == "STATIC", F.col("_plans")).otherwise(
        F.slice("_plans", 1, 1)
    )
    about_assistant = F.coalesce(F.col("routing.is_bot_qa"), F.lit(False))
    # The default plan of an empty list is plain: no scope or mode is derived for it.
    derived = F.col("intent").isNull() & ~F.col("_empty")
    scope = (
        F.when(F.col("intent").isNotNull(), "NONE")
        .when(F.col("_empty"), "CORPUS")
        .otherwise(retrieval_scope(F.col("clean"), F.size("uploads") > 0, about_assistant))
    )
    whole = F.col("intent").isNotNull() | (
        derived
        & (
            about_assistant
            | (F.upper(F.coalesce("routing.retrieval_mode", F.lit(""))) == "WHOLE_DOCUMENT")
        )
    )
    purpose = F.when(derived & about_assistant, "BOT_QA").otherwise(
        F.coalesce(F.col("plan.purpose"), F.lit("Retrieval"))
    )
    return (
        requests.withColumn("_empty", empty)
        .withColumn("_plans", listed)
        .withColumn("execution", kind)
        .select("*", F.posexplode(used).alias("plan_pos", "plan"))
        .select(
            "request_id",
            "plan_pos",
            F.concat_ws("-", "request_id", "plan_pos").alias("plan_id"),
            "session_id",
            "question",
            "execution",
            F.when(F.col("execution") == "STATIC", F.col("merge_op"))
            .otherwise("NONE")
            .alias("merge_op"),
            "visual_search",
            purpose.alias("purpose"),
            effective_query(F.col("plan.optimized_query"), F.col("clean")).alias(
                "optimized_query"
            ),
            F.coalesce("plan.target_documents", F.array().cast("array<string>")).alias(
                "target_documents"
            ),
            F.when(F.col("intent").isNull(), F.col("routing.entities")).alias("entity_list"),
            F.when(whole, "WHOLE_DOCUMENT").otherwise("RANKED_RETRIEVAL").alias("mode"),
            scope.alias("scope"),
        )
    )


def dispatch(plans: DataFrame, sessions: DataFrame) -> DataFrame:
    """Where each first plan goes: ``route`` and the documents to read for DOCUMENT.

    ``sessions`` has session_id, uploads, active_document and still_indexing.
    Routes are GENERAL, HISTORY, SESSION_INFO, DOCUMENT and SEARCH.
    """
    joined = plans.join(sessions, "session_id", "left")
    unscoped = F.col("scope") == "NONE"
    purpose = F.col("purpose")
    fallback = F.when(F.col("active_document").isNotNull(), F.array("active_document")).when(
        F.size("uploads") > 0, F.slice("uploads", 1, 1)
    )
    documents = F.when(F.size("target_documents") > 0, F.col("target_documents")).otherwise(
        fallback
    )
    reads = (F.col("execution") == "DIRECT") & (
        (F.col("scope") == "SPECIFIC_DOC") | F.coalesce("still_indexing", F.lit(False))
    )
    route = (
        F.when(F.col("execution") == "ADAPTIVE", "SEARCH")
        .when(unscoped & (purpose.contains("GREETING") | purpose.contains("BOT_QA")), "GENERAL")
        .when(
            unscoped & (purpose.contains("META_HISTORY") | purpose.contains("CLARIFICATION")),
            "HISTORY",
        )
        .when(unscoped & purpose.contains("SESSION_INFO"), "SESSION_INFO")
        .when(reads & (F.size("documents") > 0), "DOCUMENT")
        .otherwise("SEARCH")
    )
    names = F.transform("documents", normalize_source_name)
    return (
        joined.withColumn("documents", F.coalesce(documents, F.array().cast("array<string>")))
        .withColumn("route", route)
        .withColumn("targets", F.filter(names, lambda n: n != ""))
    )


def direct_documents(dispatched: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks of the documents read directly, in order and without a cap."""
    return whole_documents(dispatched.filter("route = 'DOCUMENT'"), chunks, None)


def fixed_contexts(dispatched: DataFrame) -> DataFrame:
    """Context text of requests that need no retrieval: request_id, route, context."""
    listed = F.when(
        F.size("uploads") > 0, F.array_join("uploads", "\n- ")
    ).otherwise(NO_DOCUMENTS)
    context = (
        F.when(F.col("route") == "GENERAL", "")
        .when(F.col("route") == "HISTORY", META_CONTEXT)
        .when(F.col("route") == "SESSION_INFO", F.concat(F.lit(SESSION_HEADER), listed))
    )
    return dispatched.filter("route in ('GENERAL', 'HISTORY', 'SESSION_INFO')").select(
        "request_id", "route", context.alias("context")
    )
