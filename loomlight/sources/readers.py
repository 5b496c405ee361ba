"""Table, text-file and page sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.functions.text import page_title, strip_upload_prefix


def scan(
    spark: SparkSession, path: str, predicate: Column | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Parquet table with its predicate and columns, both of which reach the scan."""
    table = spark.read.parquet(path)
    if predicate is not None:
        table = table.filter(predicate)
    return table.select(*columns) if columns else table


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, file_name without its upload prefix, and the whole text."""
    file_path = F.col("_metadata.file_path")
    return spark.read.text(path, wholetext=True).select(
        file_path.alias("path"),
        strip_upload_prefix(F.try_url_decode(F.substring_index(file_path, "/", -1))).alias(
            "file_name"
        ),
        F.col("value").alias("text"),
    )


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages with the title their address ends in."""
    pages = spark.read.parquet(path)
    return pages.withColumn("title", page_title(F.col("url")))
