"""Evidence products: source filter, citations, numbered context blocks.

Ranked evidence is a handful of rows per request, but a whole-document request
returns every chunk of its sources. Nothing here assumes the small case:
source filters aggregate and join, numbering comes from the order that the
evidence carries, and joined texts come in bounded segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlight.functions.images import visual_title
from loomlight.functions.text import citation_score, excerpt, is_blank
from loomlight.ordering import join_segments, number_rows

# Fixed values.
RELEVANT_RATIO = 0.3
NO_EVIDENCE = "No relevant evidence found."
VISUAL_HEADER = "=== Visual Evidence ===\n"
TEXT_HEADER = "=== Text Evidence ===\n"
DEFAULT_PURPOSE = "General Retrieval"

CITATION_SCHEMA = (
    "array<struct<sourceName: string, sourceType: string, chunkIndex: int, excerpt: string, "
    "fullExcerpt: string, score: double, documentId: string, isImage: boolean, "
    "imageUrl: string, url: string, rankingExplanation: string>>"
)
VISUAL_SCHEMA = (
    "array<struct<semanticId: string, stableId: string, imageUrl: string, thumbnailUrl: string, "
    "caption: string, score: double, sourceDocument: string>>"
)
BLOCKS_PER_SEGMENT = 60


def effective_score() -> Column:
    return F.when(F.col("final_score") == 0.0, F.col("semantic_score")).otherwise(
        F.col("final_score")
    )


def relevant_sources(evidence: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, source) pairs worth citing.

    A source stays when it is the only one, holds a whole-document match, or
    its best score reaches 0.3 of the best overall; all stay when that best is
    not positive.
    """
    source = F.coalesce("source_name", F.lit("unknown"))
    per_source = evidence.groupBy(key, source.alias("cited_source")).agg(
        F.max(effective_score()).alias("source_best"),
        F.max(F.coalesce("whole_document_match", F.lit(False))).alias("source_whole"),
    )
    # One row per source from here on, so the window is over few rows.
    overall = Window.partitionBy(key)
    best = F.greatest(F.max("source_best").over(overall), F.lit(0.0))
    sources = F.count(F.lit(1)).over(overall)
    return (
        per_source.withColumn("best", best)
        .withColumn("sources", sources)
        .filter(
            (F.col("sources") == 1)
            | F.col("source_whole")
            | (F.col("best") <= 0.0)
            | (F.col("source_best") >= F.col("best") * RELEVANT_RATIO)
        )
        .select(key, "cited_source")
    )


def filter_to_relevant_sources(
    evidence: DataFrame, key: str = "request_id", order: str = "position"
) -> DataFrame:
    """Evidence of the relevant sources, regrouped by first-seen source.

    Adds source_first, the smallest ``order`` of the source; rows sort by
    (source_first, order).
    """
    named = evidence.withColumn("cited_source", F.coalesce("source_name", F.lit("unknown")))
    seen = named.groupBy(key, "cited_source").agg(F.min(order).alias("source_first"))
    return named.join(
        seen.join(relevant_sources(evidence, key), [key, "cited_source"]), [key, "cited_source"]
    )


def citation_fields() -> list[Column]:
    """The fields of a citation, from the columns of an evidence row."""
    image = F.when(~is_blank(F.col("image_url")), F.col("image_url"))
    return [
        F.coalesce("source_name", F.lit("unknown")).alias("sourceName"),
        F.coalesce("source_type", F.lit("")).alias("sourceType"),
        F.coalesce("chunk_index", F.lit(0)).cast("int").alias("chunkIndex"),
        excerpt(F.col("content")).alias("excerpt"),
        F.col("content").alias("fullExcerpt"),
        citation_score(F.col("final_score"), F.col("semantic_score")).alias("score"),
        F.coalesce("document_id", F.lit("")).alias("documentId"),
        image.isNotNull().alias("isImage"),
        image.alias("imageUrl"),
        F.when(~is_blank(F.col("source_url")), F.col("source_url")).alias("url"),
        F.col("reasoning").alias("rankingExplanation"),
    ]


def citations(
    evidence: DataFrame, key: str = "request_id", order: str = "position"
) -> DataFrame:
    """One row per citation: key, citation_no from 1, and the citation fields."""
    kept = filter_to_relevant_sources(evidence, key, order)
    optional = {"document_id": "string", "reasoning": "string", "image_url": "string",
                "source_url": "string"}
    for name, kind in optional.items():
        if name not in kept.columns:
            kept = kept.withColumn(name, F.lit(None).cast(kind))
    numbered = number_rows(kept, [key], ["source_first", order], "citation_no")
    return numbered.select(key, "citation_no", *citation_fields())


def citation_lists(cited: DataFrame, key: str = "request_id") -> DataFrame:
    """The citations of a request as JSON arrays of up to 60 entries each."""
    names = [c for c in cited.columns if c not in (key, "citation_no")]
    listed = F.floor((F.col("citation_no") - 1) / BLOCKS_PER_SEGMENT).alias("list_no")
    entries = F.array_sort(F.collect_list(F.struct("citation_no", F.struct(*names).alias("c"))))
    return (
        cited.groupBy(key, listed)
        .agg(F.to_json(F.transform(entries, lambda e: e["c"])).alias("citations_json"))
    )


def parse_citations(messages: DataFrame) -> DataFrame:
    """Decode the stored citation and visual lists; text that does not parse gives null."""
    return messages.withColumns(
        {
            "citations": F.from_json("citations_json", CITATION_SCHEMA),
            "visuals": F.from_json("visuals_json", VISUAL_SCHEMA),
        }
    )


def citations_per_source(cited: DataFrame, key: str, order: str, source: str) -> DataFrame:
    """Count per source and the first citation's number, per message."""
    return cited.groupBy(key, source).agg(
        F.count(F.lit(1)).alias("citations"), F.min(order).alias("first_no")
    )


def citation_tabs(cited: DataFrame, key: str, kind: str, is_image: str) -> DataFrame:
    """Counts of all, document, image and wiki citations per message."""
    wiki = F.coalesce(F.upper(kind).contains("WIKI"), F.lit(False))
    image = F.coalesce(F.col(is_image), F.lit(False))
    return cited.groupBy(key).agg(
        F.count(F.lit(1)).alias("all"),
        F.count_if(~wiki & ~image).alias("docs"),
        F.count_if(image).alias("images"),
        F.count_if(wiki).alias("wiki"),
    )


def _fenced_parts(text: Column) -> Column:
    """Parts outside fenced code; code parts are dropped."""
    return F.split(text, r"(?s)```.*?```")


def citation_markers(messages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cited_no): every id in a citation marker outside fenced code, repeats kept."""
    groups = F.flatten(
        F.transform(
            _fenced_parts(F.col(text)),
            lambda part: F.regexp_extract_all(part, F.lit(r"(?i)\[CITE:\s*([\d,\s]+)\]"), 1),
        )
    )
    ids = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    clean = F.filter(F.transform(ids, lambda i: F.regexp_replace(i, r"\s", "")), lambda i: i != "")
    numbers = F.transform(clean, lambda i: i.cast("bigint"))
    return messages.select(key, F.explode(numbers).alias("cited_no"))


def linked_citations(text: Column) -> Column:
    """The text with each marker outside fenced code turned into links.

    Three passes over the text: fenced parts are kept by splitting around
    them, a marker's ids become links, its brackets disappear.
    """
    fence = F.regexp_extract_all(text, F.lit(r"(?s)```.*?```"), 0)
    plain = F.split(text, r"(?s)```.*?```", -1)

    def link(part: Column) -> Column:
        pieces = F.split(part, r"(?i)(?=\[CITE:\s*[\d,\s]+\])|(?<=\])", -1)
        return F.array_join(F.transform(pieces, _link_piece), "")

    woven = F.transform(
        plain, lambda part, i: F.concat(link(part), F.coalesce(F.get(fence, i), F.lit("")))
    )
    return F.array_join(woven, "")


def _link_piece(piece: Column) -> Column:
    ids = F.regexp_extract(piece, r"(?i)^\[CITE:\s*([\d,\s]+)\]$", 1)
    numbers = F.filter(
        F.transform(F.split(ids, ","), lambda i: F.regexp_replace(i, r"\s", "")),
        lambda i: i != "",
    )
    links = F.transform(
        numbers, lambda n: F.concat(F.lit("["), n, F.lit("](#cite-"), n, F.lit(")"))
    )
    is_marker = piece.rlike(r"(?i)^\[CITE:\s*[\d,\s]+\]$")
    return F.when(is_marker, F.array_join(links, " ")).otherwise(piece)


def resolve_citations(markers: DataFrame, cited: DataFrame, key: str) -> DataFrame:
    """The citation behind each marker: marker n is the n-th citation of the message."""
    return markers.join(
        cited.withColumnRenamed("citation_no", "cited_no"), [key, "cited_no"]
    )


def stable_visuals(
    visuals: DataFrame, key: str = "request_id", order: str = "visual_rank"
) -> DataFrame:
    """Visuals with stable ids IMG_01, IMG_02, … and display titles.

    A request has at most three visuals per plan; plan follows plan where
    ``plan_pos`` is given, and chunk or attachment ids settle equal ranks.
    """
    ties = [c for c in ("vector_id", "attachment_id") if c in visuals.columns]
    plans = [c for c in ("plan_pos",) if c in visuals.columns]
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*plans, order, *ties))
    return (
        visuals.withColumn("visual_no", nth)
        .withColumn("stable_id", F.format_string("IMG_%02d", "visual_no"))
        .withColumn("display_title", visual_title(F.col("caption"), F.col("source_name")))
    )


def _visual_block() -> Column:
    return F.format_string(
        "Image %d (shown above)\nDisplay Title: %s\nDetails: %s\n\n",
        "visual_no",
        "display_title",
        "caption",
    )


def _text_block() -> Column:
    return F.format_string(
        '<CITATION id="%d">\nSource: %s | Type: %s\n%s\n</CITATION>\n\n',
        "citation_no",
        F.coalesce("source_name", F.lit("unknown")),
        F.coalesce("source_type", F.lit("")),
        "content",
    )


def number_evidence(
    evidence: DataFrame, key: str = "request_id", order: str = "position"
) -> DataFrame:
    """Evidence numbered from 1 in the order it is shown.

    Requests that compare show one group per purpose, in first-seen order; the
    numbering runs on over the groups. Needs merge_op and purpose. Adds
    citation_no, and group_first, which is null outside comparisons.
    """
    named = evidence.withColumn("purpose", F.coalesce("purpose", F.lit(DEFAULT_PURPOSE)))
    groups = (
        named.filter("merge_op = 'COMPARE'")
        .groupBy(key, "purpose")
        .agg(F.min(order).alias("group_first"))
    )
    placed = named.join(groups, [key, "purpose"], "left").withColumn(
        "_group", F.coalesce("group_first", F.lit(0))
    )
    return number_rows(placed, [key], ["_group", order], "citation_no").drop("_group")


def context_blocks(
    requests: DataFrame,
    evidence: DataFrame,
    visuals: DataFrame,
    key: str = "request_id",
    order: str = "position",
) -> DataFrame:
    """Citation-tagged context of every request, as (key, segment_no, text).

    ``visuals`` come from :func:`stable_visuals`. Requests with neither kind of
    evidence get one segment that says so. A segment holds up to 60 blocks; the
    context is the segments in order.
    """
    numbered = number_evidence(evidence, key, order)
    opens_group = F.col("group_first").isNotNull() & (F.col(order) == F.col("group_first"))
    header = F.when(
        opens_group, F.format_string("--- Evidence for: %s ---\n", "purpose")
    ).otherwise("")
    title = F.when(F.col("citation_no") == 1, TEXT_HEADER).otherwise("")
    texts = numbered.select(
        key,
        F.lit(1).alias("part"),
        F.col("citation_no").cast("bigint").alias("no"),
        F.concat(title, header, _text_block()).alias("block"),
    )
    first = F.when(F.col("visual_no") == 1, VISUAL_HEADER).otherwise("")
    shown = visuals.select(
        key,
        F.lit(0).alias("part"),
        F.col("visual_no").cast("bigint").alias("no"),
        F.concat(first, _visual_block()).alias("block"),
    )
    # Visuals are few, so a request's blocks start after them by a small shift.
    shift = shown.groupBy(key).agg(F.max("no").alias("_shift"))
    blocks = (
        shown.unionByName(texts)
        .join(shift, key, "left")
        .withColumn(
            "at", F.col("no") + F.col("part") * F.coalesce("_shift", F.lit(0)).cast("bigint")
        )
    )
    segments = join_segments(blocks, [key], "at", "block", size=BLOCKS_PER_SEGMENT)
    empty = requests.select(key).join(segments.select(key).distinct(), key, "left_anti")
    nothing = empty.select(
        key, F.lit(0).cast("bigint").alias("segment_no"), F.lit(NO_EVIDENCE).alias("text")
    )
    last = segments.groupBy(key).agg(F.max("segment_no").alias("_last"))
    ended = segments.join(last, key).select(
        key,
        "segment_no",
        F.when(F.col("segment_no") == F.col("_last"), F.regexp_replace("text", r"\s+$", ""))
        .otherwise(F.col("text"))
        .alias("text"),
    )
    return ended.unionByName(nothing)


def purpose_groups(
    evidence: DataFrame, key: str = "request_id", order: str = "position"
) -> DataFrame:
    """Evidence grouped by purpose in first-seen order: size and place of each group."""
    purpose = F.coalesce("purpose", F.lit(DEFAULT_PURPOSE)).alias("purpose")
    groups = evidence.groupBy(key, purpose).agg(
        F.min(order).alias("group_first"), F.count(F.lit(1)).alias("rows")
    )
    nth = F.row_number().over(Window.partitionBy(key).orderBy("group_first"))
    return groups.withColumn("group_no", nth)
