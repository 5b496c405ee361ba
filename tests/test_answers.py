"""Questions to prompts over a small table, against what each route must show."""

import json

import pytest
from pyspark.sql import functions as F

from loomlight.operators.embedding import hashed_terms
from loomlight.plans.answers import question_contexts, question_prompts

TEXTS = {
    "alpha notes": ["copper kettle boils water quickly", "silver kettle boils slowly today"],
    "beta notes": ["green tractor ploughs northern fields", "red tractor rests near barns"],
}


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (f"{name}-{i}", text, name, "PDF", 1, i, None, None)
        for name, texts in TEXTS.items()
        for i, text in enumerate(texts)
    ]
    rows.append(("image-0", "copper kettle picture", "gamma image", "IMAGE", 1, 0, "http://i", None))
    schema = (
        "vector_id string, content string, source_name string, source_type string, "
        "session_id bigint, chunk_index int, image_url string, source_url string"
    )
    return spark.createDataFrame(rows, schema).withColumn("embedding", hashed_terms(F.col("content")))


def plan(text, *targets):
    return {"purpose": "find", "optimized_query": text, "target_documents": list(targets)}


def routing(*plans, **more):
    return json.dumps({"strategy": "SINGLE_SOURCE", "plans": plans, **more})


@pytest.fixture(scope="module")
def asked(spark):
    files = ["alpha_notes.pdf"]
    rows = [
        (1, "hello", 1, None, files),
        (2, "what files do i have", 1, None, files),
        (3, "summarise this document please", 1, routing(plan("summary", "alpha_notes.pdf")), files),
        (4, "copper kettle boils", 9, routing(plan("copper kettle boils"), visual_search=True), []),
        (5, "kettles and tractors", 9, routing(plan("copper kettle boils"), plan("red tractor rests"),
                                               merge_operation="compare", execution_tier="decompose"), []),
        (6, None, 9, None, []),
    ]
    schema = "request_id bigint, question string, session_id bigint, raw_routing string, uploads array<string>"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def contexts(spark, asked, chunks):
    sessions = spark.createDataFrame(
        [(1, ["alpha_notes.pdf"], "alpha_notes.pdf", False), (9, [], None, False)],
        "session_id bigint, uploads array<string>, active_document string, still_indexing boolean",
    )
    return question_contexts(asked, sessions, chunks).cache()


def test_every_request_takes_one_route(contexts):
    rows = {r.request_id: r for r in contexts.collect()}
    assert contexts.count() == len(rows) == 6
    assert [rows[i].route for i in range(1, 6)] == ["GENERAL", "SESSION_INFO", "DOCUMENT", "SEARCH", "SEARCH"]
    assert rows[1].text == "" and rows[2].text.endswith("alpha_notes.pdf")


def test_a_document_is_shown_whole_and_in_order(contexts):
    text = contexts.filter("request_id = 3").first().text
    places = [text.index(part) for part in TEXTS["alpha notes"]]
    assert places == sorted(places) and text.count("<CITATION") == 2
    assert "tractor" not in text


def test_a_search_shows_visuals_before_texts(contexts):
    text = contexts.filter("request_id = 4").first().text
    assert text.index("copper kettle picture") < text.index("<CITATION")
    assert TEXTS["alpha notes"][0] in text


def test_plans_of_a_request_are_merged(contexts):
    text = contexts.filter("request_id = 5").first().text
    assert TEXTS["alpha notes"][0] in text and TEXTS["beta notes"][1] in text
    assert "=== Visual" not in text


def test_prompts_hold_context_and_question(spark, asked, contexts):
    histories = spark.createDataFrame([(4, "User: before")], "request_id bigint, history string")
    rows = {r.request_id: r.prompt for r in question_prompts(contexts, asked, histories).collect()}
    shown = {r.request_id: r.text for r in contexts.collect()}
    assert len(rows) == 6
    for request, prompt in rows.items():
        assert prompt.startswith("Context Information:\n" + shown[request])
    assert rows[4].endswith("User: before\n\nUser Question:\ncopper kettle boils")
    assert rows[6].endswith("User Question:\n")
    assert "- alpha_notes.pdf" in rows[3]


def test_nothing_asked(spark, asked, chunks):
    sessions = spark.createDataFrame(
        [], "session_id bigint, uploads array<string>, active_document string, still_indexing boolean"
    )
    none = question_contexts(asked.limit(0), sessions, chunks)
    assert none.count() == 0
