"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets are shares of the whole by source weight, filled like vessels: a source
takes at most ``max_epochs`` times its size and the excess goes to the others by
weight. Each document draws the key -ln(u) / quality, so that ascending keys are
a sample without replacement weighted by quality. A source first gives complete
epochs; the fraction left over is the documents, in key order, whose running
sizes fit the rest of the budget, and the one at the edge if that comes nearer.

Running sizes come from a range partitioning by (source, key): a source of any
size spans many partitions, and only one sum per source and partition is added
up centrally. Keys depend on id and seed only, so runs agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlight.lineage import materialize
from loomlight.llm.rows import with_results

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20240
WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ("size", "source_size", "target", "epochs", "taken")


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, words: Column) -> Column:
    """A weight in (0, 1] that falls with symbols and very short or long words."""
    length = F.coalesce(F.length(text), F.lit(0))
    mean = length / F.greatest(words, F.lit(1))
    usual = F.when(mean.between(4, 12), 1.0).otherwise(0.5)
    symbols = length - F.length(F.translate(F.coalesce(text, F.lit("")), "#*$%&|<>{}[]\\^~@", ""))
    return F.greatest(F.lit(0.05), usual * (1 - F.least(F.lit(1.0), 10 * symbols / F.greatest(length, F.lit(1)))))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from one size per source.

    Sources by code point, null last, take the weights in turn. Sorted by the
    share at which each fills up, the full ones are a prefix, so one running
    sum settles every target without repetition.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(cycle, (turn + 1).cast("int")))
    cap = F.col("source_size") * F.lit(max_epochs)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fills = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    after = fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = weighed.withColumn("level", left / F.sum("weight").over(after))
    full = level.withColumn("full", cap <= F.col("level") * F.col("weight"))
    # All sources from the first that stays below its cap share its level, which
    # is the highest of theirs: those after it subtract caps that are not reached.
    shared = F.max(F.when(~F.col("full"), F.col("level")))
    return full.withColumn("common", shared.over(everyone)).select(
        "source",
        "source_size",
        F.when(F.col("full"), cap.cast("double")).otherwise(F.col("common") * F.col("weight")).alias("target"),
    )


def _running(rows: DataFrame) -> DataFrame:
    """``upto``: sizes of the same source up to and with a row, in key order."""
    ordered = (
        rows.repartitionByRange(F.col("source").isNull(), "source", "key", "id")
        .withColumn("part", F.spark_partition_id())
    )
    ordered = materialize(ordered, "ordered")
    sums = ordered.groupBy("source", "part").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("source", "part").orderBy("key", "id", "row_key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = ordered.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return joined.withColumn("upto", F.col("base") + F.sum("size").over(inside)).drop("s", "p", "base", "part")


def mix_sources(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    quality_weight: Column | None = None,
) -> DataFrame:
    """``id``, ``row_key``, ``size``, ``source``, ``source_size``, ``target``, ``epochs``, ``taken``.

    One row per input row. Null and wordless texts have size 0 and give nothing;
    null sources are one source of their own, last in order. ``taken`` is
    ``epochs`` times the size. Repeated rows draw keys of their own only if
    their ids differ; equal ones stand next to each other. ``quality_weight``
    (positive) replaces the weight that ``quality`` reads from the text.
    """
    text = F.col(text_col).cast("string")
    size = word_count(text)
    keys = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
        F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text).alias("row_key"),
        (quality(text, size) if quality_weight is None else quality_weight).alias("quality"),
        F.xxhash64(F.lit(seed), F.col(id_col).isNull(), F.col(id_col)).alias("draw"),
    )
    # u in (0, 1), from 52 bits.
    u = (F.shiftrightunsigned("draw", 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    keys = materialize(keys.withColumn("key", -F.log(u) / F.col("quality")).drop("draw", "quality"), "keys")
    sizes = keys.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    targets = targets.withColumnRenamed("source", "s")
    rows = _running(keys).join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    # The document at the edge is taken if more than half of it fits.
    more = (F.col("upto") - F.col("size") / 2 <= rest) & (F.col("size") > 0) & (whole < max_epochs)
    epochs = F.when(F.col("size") > 0, whole + more.cast("long")).otherwise(0).cast("long")
    return rows.select(
        "id", "row_key", "size", "source", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken")
    )


def mixture(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with the result columns.

    ``epochs`` says how often a row is to be read; no row is written twice.
    """
    mixed = mix_sources(docs, text_col, id_col, source_col, **options).filter("epochs > 0")
    mixed = mixed.groupBy("row_key").agg(*[F.max(c).alias(c) for c in RESULTS])
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).cast("string")).alias("row_key"),
    )
    return rows.join(mixed, "row_key").select(
        *[F.col("row").getField(c).alias(c) for c in with_results(docs, RESULTS)], *RESULTS
    )
