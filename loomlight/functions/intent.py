"""Classification of questions and parsing of routing payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlight.functions.text import is_blank, java_trim, word_count

# Phrases that decide an intent, tried in this order.
GREETINGS = [
    "hi", "hello", "hey", "thanks", "thank you", "ok", "okay", "clear history", "bye",
    "good morning", "good evening",
]
GREETING_STARTS = ["hi ", "hello ", "hey "]
SESSION_STARTS = ["what did i upload"]
SESSION_PHRASES = [
    "what files", "what documents did i upload", "how many files", "how many uploaded files",
    "my uploaded files",
]
HISTORY_STARTS = ["what did i", "what have we"]
HISTORY_PHRASES = ["what did i ask"]
ASSISTANT_PHRASES = [
    "what are your", "who are you", "what can you do", "what all you can do",
    "what all can you do", "what can u do", "what do you do", "what are you capable",
    "your capabilities", "your features", "how can you help", "how do you help", "what are you",
]

# Answers and questions that are not worth remembering.
MEMORY_MIN_WORDS = 4
MEMORY_MIN_SCORE = 0.4
REFUSALS = [
    "I couldn't find relevant information", "I apologize", "I currently have no information",
]
META_QUESTIONS = [
    "what did i say", "our chat", "what are your capabilities", "who are you",
    "what can you do", "what are you",
]

# Words that point at an uploaded document.
DEICTIC_WORDS = ["this", "that", "the", "given", "uploaded", "attached", "above", "provided"]

ROUTING_SCHEMA = (
    "strategy string, is_bot_qa boolean, entities array<struct<name: string, confidence: double>>, "
    "execution_tier string, retrieval_mode string, merge_operation string, "
    "plans array<struct<purpose: string, optimized_query: string, "
    "target_documents array<string>>>, visual_search boolean"
)
ACTION_SCHEMA = "type string, reasoning string, next_query string"
ACTIONS = ["SEARCH", "REFINE", "EXPAND", "SWITCH_SOURCE", "STOP"]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _contains(text: Column, phrases: list[str]) -> Column:
    return _any([text.contains(p) for p in phrases])


def _starts(text: Column, phrases: list[str]) -> Column:
    return _any([text.startswith(p) for p in phrases])


def clean_query(question: Column) -> Column:
    return java_trim(F.lower(question))


def fast_intent(clean: Column) -> Column:
    """Intent decided from the cleaned question alone; null when a router must decide."""
    greeting = clean.isin(GREETINGS) | (
        (word_count(clean) <= 3) & _starts(clean, GREETING_STARTS)
    )
    session = _starts(clean, SESSION_STARTS) | _contains(clean, SESSION_PHRASES)
    history = (
        _starts(clean, HISTORY_STARTS)
        | _contains(clean, HISTORY_PHRASES)
        | (clean.contains("earlier") & clean.contains("said"))
    )
    return (
        F.when(greeting, "GREETING_ACK")
        .when(session, "SESSION_INFO")
        .when(history, "META_HISTORY")
        .when(_contains(clean, ASSISTANT_PHRASES), "BOT_QA")
    )


def is_memorable(question: Column, answer: Column) -> Column:
    """True for an exchange that carries content; false when a side is missing."""
    lower = F.lower(question)
    worth = (
        (word_count(question) >= MEMORY_MIN_WORDS)
        & ~_contains(answer, REFUSALS)
        & ~_contains(lower, META_QUESTIONS)
    )
    return F.coalesce(worth, F.lit(False))


def is_remembered(question: Column, answer: Column, top_score: Column) -> Column:
    return is_memorable(question, answer) & (
        F.coalesce(top_score, F.lit(0.0)) >= MEMORY_MIN_SCORE
    )


def is_deictic(clean: Column) -> Column:
    """A pointing word in a question of one line.

    Word edges are ASCII, so the pattern spells them out.
    """
    words = "|".join(DEICTIC_WORDS)
    edge = r"A-Za-z0-9_"
    return clean.rlike(rf"\A[^\n\r]*(?<![{edge}])({words})(?![{edge}])[^\n\r]*\z")


def retrieval_scope(clean: Column, has_uploads: Column, about_assistant: Column) -> Column:
    return (
        F.when(F.coalesce(about_assistant, F.lit(False)), "NONE")
        .when(is_deictic(clean) & F.coalesce(has_uploads, F.lit(False)), "SPECIFIC_DOC")
        .otherwise("CORPUS")
    )


def json_span(raw: Column) -> Column:
    """From the first opening to the last closing brace; the text itself without both."""
    span = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(span == "", raw).otherwise(span)


def parse_routing(raw: Column, question: Column) -> Column:
    """Routing decision of a raw model answer, or the default plan when it does not parse."""
    default = F.struct(
        F.lit("SINGLE_SOURCE").alias("strategy"),
        F.lit(False).alias("is_bot_qa"),
        F.array().cast("array<struct<name: string, confidence: double>>").alias("entities"),
        F.lit("DIRECT").alias("execution_tier"),
        F.lit("RANKED").alias("retrieval_mode"),
        F.lit("NONE").alias("merge_operation"),
        F.array(
            F.struct(
                F.lit("Fallback Plan").alias("purpose"),
                question.alias("optimized_query"),
                F.array().cast("array<string>").alias("target_documents"),
            )
        ).alias("plans"),
        F.lit(False).alias("visual_search"),
    )
    schema = ROUTING_SCHEMA + ", _bad string"
    options = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    parsed = F.from_json(json_span(raw), schema, options)
    usable = parsed.isNotNull() & parsed["_bad"].isNull()
    return F.when(usable, parsed.dropFields("_bad")).otherwise(default)


def parse_next_action(raw: Column) -> Column:
    """Struct of type, reasoning and next_query; unparsable or unknown types stop."""
    schema = ACTION_SCHEMA + ", _bad string"
    options = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    parsed = F.from_json(json_span(raw), schema, options)
    usable = parsed["_bad"].isNull() & F.coalesce(parsed["type"].isin(ACTIONS), F.lit(False))
    going_on = usable & (parsed["type"] != "STOP")
    return F.struct(
        F.when(usable, parsed["type"]).otherwise("STOP").alias("type"),
        F.when(usable, F.coalesce(parsed["reasoning"], F.lit("")))
        .otherwise("Parse failed, stopping")
        .alias("reasoning"),
        F.when(going_on, parsed["next_query"]).alias("next_query"),
    )


def effective_query(optimized: Column, clean: Column) -> Column:
    return F.when(is_blank(optimized), clean).otherwise(optimized)
