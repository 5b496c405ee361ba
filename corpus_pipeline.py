"""From raw documents to a mixture for training: the stages, in order.

Each stage takes (spark, docs, folder of the tables) and works on all that the
stage before it kept. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.lineage import materialize
from loomlight.llm.decontamination import find_leaks
from loomlight.llm.jaccard_join import keep_one_per_group
from loomlight.llm.language_id import UNKNOWN, identify_languages
from loomlight.llm.source_mixing import mixture
from loomlight.llm.substring_dedup import remove_repeated_words
from loomlight.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

LEAST_SHARE = 0.5  # of the main language
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; those without letters or without one go."""
    ship_package(spark)
    found = identify_languages(docs.withColumn("label", F.col("lang")), F.lit(True), lang_col="label")
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)
    return found.filter(sure).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the least id."""
    ship_package(spark)
    return keep_one_per_group(docs, size=SHINGLE, percent=PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that stand anywhere else are cut.

    A text that loses nothing stays as it is; ``n_chars`` follows the text.
    """
    ship_package(spark)
    cut = remove_repeated_words(docs, keep_layout=True)
    return cut.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    ship_package(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, benchmark).filter(F.size("matches") == 0).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often."""
    ship_package(spark)
    return mixture(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: The stages infer models and hash text in ways SQL cannot follow.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the documents in ``sf_dir``; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
