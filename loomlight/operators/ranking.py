"""Ranking by several signals, with the reasons."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlight.functions.text import is_blank, normalize_source_name
from loomlight.lineage import materialize

# Fixed values.
ENTITY_HIT = 1.2
ENTITY_MISS = 0.8
TARGET_BOOST = 1.15
SESSION_BOOST = 1.1
KEEP_RATIO = 0.8
KEEP_FLOOR = 0.1

NEEDLE_BYTES = 4 << 20  # an automaton takes some dozens of bytes for each
MATCH_ROWS = 20_000


def _named(names: Column, source: Column) -> Column:
    """Names whose normalised form stands inside the lower-case source name."""
    lower = F.lower(source)
    return F.filter(
        names,
        lambda n: (normalize_source_name(n) != "") & lower.contains(normalize_source_name(n)),
    )


def entity_signal(entities: Column, source: Column) -> Column:
    neutral = (F.coalesce(F.size(entities), F.lit(0)) < 1) | (F.coalesce(source, F.lit("")) == "")
    return (
        F.when(neutral, 1.0)
        .when(F.size(_named(entities, source)) > 0, ENTITY_HIT)
        .otherwise(ENTITY_MISS)
    )


def target_signal(targets: Column, source: Column) -> Column:
    hit = (F.coalesce(source, F.lit("")) != "") & (F.size(_named(targets, source)) > 0)
    return F.when(hit, TARGET_BOOST).otherwise(1.0)


def session_signal(current: Column, owner: Column) -> Column:
    return F.when(current == owner, SESSION_BOOST).otherwise(1.0)


def _signed(candidates: DataFrame) -> DataFrame:
    source = F.col("source_name")
    boost = F.col("entity_boost") * F.col("target_boost") * F.col("session_boost")
    return (
        candidates.withColumn("entity_boost", entity_signal(F.col("entities"), source))
        .withColumn("target_boost", target_signal(F.col("target_documents"), source))
        .withColumn(
            "session_boost", session_signal(F.col("current_session_id"), F.col("session_id"))
        )
        .withColumn("final_score", F.col("semantic_score") * boost)
        .withColumn("matched_entities", F.coalesce(_named(F.col("entities"), source), F.array()))
    )


def explanation() -> Column:
    return F.format_string(
        "Semantic: %.3f | EntityBoost: %.2f | MetadataBoost: %.2f | SessionBoost: %.2f "
        "| Final: %.3f",
        "semantic_score",
        "entity_boost",
        "target_boost",
        "session_boost",
        "final_score",
    )


def rank_candidates(
    candidates: DataFrame,
    query_id: str = "query_id",
    chunk_id: str = "vector_id",
    before: str = "pick",
) -> DataFrame:
    """Multiply the score by entity, target and session signals; keep the competitive rows.

    Needs source_name, session_id, semantic_score, entities, target_documents
    and current_session_id. Adds the signals, final_score, matched_entities,
    reasoning and final_rank (ties by ``before``, then id). A query's
    candidates are bounded by the rerank size.
    """
    per_query = Window.partitionBy(query_id)
    order = per_query.orderBy(F.col("final_score").desc(), F.col(before), F.col(chunk_id))
    ranked = _signed(candidates).withColumn("_best", F.max("final_score").over(per_query))
    floor = F.greatest(F.col("_best") * KEEP_RATIO, F.lit(KEEP_FLOOR))
    return (
        ranked.withColumn("final_rank", F.row_number().over(order))
        .filter(F.col("final_score") >= floor)
        .withColumn("reasoning", explanation())
        .drop("_best")
    )


def match_names(sources: DataFrame, names: DataFrame) -> DataFrame:
    """(source_name, name) where the normalised name stands inside the source name.

    For long lists of names, which come in parts of about ``NEEDLE_BYTES``. A
    task builds one automaton of a part and reads every source name once
    against all its names; no key is shared between rows, so none is hot.
    Blank source names match nothing, as do names that normalise to nothing.
    """
    offered = (
        sources.select("source_name").distinct().filter(~is_blank(F.col("source_name")))
        .select("source_name", F.lower("source_name").alias("lower"))
    )
    wanted = (
        names.select("name")
        .distinct()
        .withColumn("needle", normalize_source_name(F.col("name")))
        .filter("needle != ''")
    )
    size = wanted.agg(F.sum(F.octet_length("needle") + F.octet_length("name"))).first()[0] or 0
    parts = max(1, -(-size // NEEDLE_BYTES))
    if parts > 1:
        dealt = wanted.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int"))
        wanted = materialize(dealt.repartition("part"), "names")
        offered = materialize(offered, "sources")
    found = []
    for part in range(parts):
        rows = wanted.filter(F.col("part") == part).collect() if parts > 1 else wanted.collect()
        named: dict[str, list[str]] = {}
        for row in rows:
            named.setdefault(row.needle, []).append(row.name)
        shared = sources.sparkSession.sparkContext.broadcast(named)
        found.append(offered.mapInArrow(_matches(shared), "source_name string, name string"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _matches(shared):
    """Every name of the broadcast part that stands in a source name, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = shared.value
        automaton = ahocorasick.Automaton()
        for needle in named:
            automaton.add_word(needle, needle)
        if not named:
            return
        automaton.make_automaton()
        for batch in batches:
            held: list[tuple[str, str]] = []
            for source, lower in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                for needle in {needle for _, needle in automaton.iter(lower)}:
                    held.extend((source, name) for name in named[needle])
                if len(held) >= MATCH_ROWS:
                    yield _pairs(held)
                    held = []
            yield _pairs(held)

    return run


def _pairs(held: list[tuple[str, str]]) -> pa.RecordBatch:
    source, name = zip(*held, strict=True) if held else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(source, pa.string()), pa.array(name, pa.string())], names=["source_name", "name"]
    )
