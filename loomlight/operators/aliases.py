"""Names by which a session's uploads can be referred to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions.text import is_blank, normalize_source_name
from loomlight.ordering import top_k

# Words for the place of an upload in its session, and for the newest one.
ORDINALS = [
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth",
]
NEWEST = ["latest", "last"]


def first_names(uploads: DataFrame) -> DataFrame:
    """Each file name of a session once, at its first upload: a repeated name adds no ordinal."""
    named = uploads.filter(~is_blank(F.col("file_name")))
    return named.groupBy("session_id", "file_name").agg(
        F.min(F.struct("uploaded_at", "doc_id")).alias("first_at"),
        F.max(F.struct("uploaded_at", "doc_id")).alias("last_at"),
    )


def ordinal_words(uploads: DataFrame) -> DataFrame:
    """(session_id, file_name, ordinal, word) of the first ten names per session."""
    ranked = top_k(
        first_names(uploads), ["session_id"], [F.col("first_at")], len(ORDINALS), "ordinal"
    )
    words = F.array(*[F.lit(w) for w in ORDINALS])
    return ranked.select(
        "session_id",
        "file_name",
        "ordinal",
        F.element_at(words, F.col("ordinal")).alias("word"),
        "first_at",
    )


def session_aliases(uploads: DataFrame) -> DataFrame:
    """(session_id, alias, file_name): ordinals, newest words and name tokens.

    The last write of an alias wins. An ordinal is written at the first upload
    of its name, the other words again at every upload of it.
    """
    names = first_names(uploads)
    ordinals = ordinal_words(uploads).select(
        "session_id", F.col("word").alias("alias"), "file_name", F.col("first_at").alias("at")
    )
    tokens = F.filter(F.split(normalize_source_name(F.col("file_name")), r"\s+"), lambda t: t != "")
    spoken = names.select(
        "session_id",
        F.explode(F.array_union(F.array(*[F.lit(w) for w in NEWEST]), tokens)).alias("alias"),
        "file_name",
        F.col("last_at").alias("at"),
    )
    return (
        ordinals.unionByName(spoken)
        .groupBy("session_id", "alias")
        .agg(F.max_by("file_name", "at").alias("file_name"))
    )


def query_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != ""))


def resolve_aliases(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exact file names a question refers to: (request_id, file_name).

    Words of the question meet the aliases of its session by equality.
    """
    words = questions.select(
        "request_id", "session_id", F.explode(query_words(F.col("question"))).alias("alias")
    )
    return (
        words.join(aliases, ["session_id", "alias"]).select("request_id", "file_name").distinct()
    )
