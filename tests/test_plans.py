"""Shapes of physical plans that matter at scale."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomlight.catalog import retrieval, tables
from loomlight.operators import lexical, sessions
from loomlight.plans.ingest import ingest
from loomlight.plans.retrieval import hybrid_retrieve

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_limits_groups_before_the_shuffle(spark):
    plan = plan_of(sessions.history_blocks(tables.messages(spark, FOLDER)))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange")
    assert plan.count("WindowGroupLimit") == 2


def test_ingestion_cuts_each_text_once_where_it_is_read(spark):
    plan = plan_of(ingest(tables.uploads(spark, FOLDER))[0])
    assert plan.count("MapInArrow") == 1
    # Repeated contents are broadcast to the texts; only the deal to all cores moves these.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "hashpartitioning" not in plan


def test_pool_is_broadcast_to_the_chunks(spark):
    asked, chunks = retrieval.queries_of(spark, FOLDER), retrieval.embedded_chunks(spark, FOLDER)
    plan = plan_of(hybrid_retrieve(asked, chunks))
    scan = [line for line in plan.splitlines() if "FileScan" in line and "content#" in line]
    assert len(scan) == 1 and "SortMergeJoin" not in plan


def test_keyword_scoring_is_one_stage(spark):
    chunks = spark.createDataFrame([("c", "one two three")], "vector_id string, content string")
    asked = spark.createDataFrame([(1, "one two three")], "query_id int, text string")
    plan = plan_of(lexical.keyword_scores(asked, chunks))
    first_join = plan[: plan.index("BroadcastExchange")]
    assert "Exchange" not in first_join


def test_scan_reads_two_columns(spark):
    docs = tables.table(spark, FOLDER, "documents").filter(F.col("n_chars") > 10).select("doc_id")
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan_of(docs)
