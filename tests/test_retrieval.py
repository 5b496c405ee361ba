import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomlight.operators import dense, lexical, postings, ranking
from loomlight.operators.dense import nearest_chunks
from loomlight.operators.embedding import hashed_terms
from loomlight.operators.evidence import citations, filter_to_relevant_sources
from loomlight.operators.fusion import fuse_ranks, spread_sources
from loomlight.operators.lexical import keyword_matches, keyword_scores
from loomlight.operators.ranking import match_names, rank_candidates
from loomlight.operators.rerank import _pick, select_diverse
from loomlight.ordering import number_rows, top_k
from loomlight.plans import retrieval as pr

NONE = "array<string>"


def test_fusion_sums_and_keeps_dense_order_on_ties(spark):
    lists = "plan_id string, vector_id string, rank int"
    d = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "both", 3)], lists)
    k = spark.createDataFrame([("q", "x", 1), ("q", "both", 2), ("q", "y", 3)], lists)
    rows = fuse_ranks(d, k, "plan_id").orderBy("fused_rank").collect()
    assert [r.vector_id for r in rows] == ["both", "a", "x", "b", "y"]
    assert rows[0].fused_score == pytest.approx(1 / 63 + 1 / 62)
    assert rows[0].paths == ["bm25", "dense"]


def pool(spark, sources):
    rows = [("q", f"v{i:02d}", s, i + 1) for i, s in enumerate(sources)]
    return spark.createDataFrame(
        rows, "query_id string, vector_id string, source_name string, fused_rank int"
    )


def test_spread_fills_to_fifteen(spark):
    kept = spread_sources(pool(spark, ["hot"] * 12 + [f"s{i}" for i in range(8)]))
    ranks = [r.fused_rank for r in kept.orderBy("fused_rank").collect()]
    # Two of the hot source, all eight others, then the five best left over.
    assert ranks == [1, 2, 3, 4, 5, 6, 7, *range(13, 21)]


def test_spread_may_exceed_fifteen_and_leaves_small_pools(spark):
    assert spread_sources(pool(spark, [f"s{i}" for i in range(20)])).count() == 20
    assert spread_sources(pool(spark, ["hot"] * 15)).count() == 15


def vectors(spark, n, seed, key, targets=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        vector = [float(x) for x in rng.normal(size=8)]
        names = ["s1"] if i % 2 else []
        rows.append((i, vector, names, f"s{i % 3}"))
    return spark.createDataFrame(
        rows, f"{key} bigint, embedding array<float>, targets array<string>, source_name string"
    )


def brute_force(asked, offered, k):
    out = {}
    for q in asked:
        scored = []
        for c in offered:
            if q.targets and c.source_name not in q.targets:
                continue
            a, b = np.array(q.embedding), np.array(c.embedding)
            score = round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) or 1)), 9)
            if score >= 0:
                scored.append((-score, c.vector_id))
        out[q.query_id] = [v for _, v in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("bound", [100, 4])
def test_dense_search_is_exact_on_both_paths(spark, monkeypatch, bound):
    monkeypatch.setattr(dense, "SLICE_ROWS", 40)
    asked = vectors(spark, 9, 1, "query_id")
    offered = vectors(spark, 130, 2, "vector_id").repartition(5)
    found = nearest_chunks(asked, offered, 7, targets="targets", max_broadcast=bound).collect()
    got = {}
    for row in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(row.query_id, []).append(row.vector_id)
    assert got == brute_force(asked.collect(), offered.collect(), 7)


def clustered(spark, n, seed, key):
    """Vectors around twenty centres, in order of their centre, and some without direction."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(20, 16))
    rows = []
    for i in range(n):
        vector = centres[i * 20 // n] + 0.05 * rng.normal(size=16)
        rows.append((i, [0.0] * 16 if i % 97 == 5 else [float(x) for x in vector], [], "s"))
    return spark.createDataFrame(
        rows, f"{key} bigint, embedding array<float>, targets array<string>, source_name string"
    )


def test_rounds_of_queries_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "ROUND_LEADERS", 300)
    asked, offered = clustered(spark, 300, 1, "query_id"), clustered(spark, 700, 2, "vector_id")
    found = nearest_chunks(asked, offered, 3, max_broadcast=10).orderBy("rank").collect()
    got = {}
    for row in found:
        got.setdefault(row.query_id, []).append(row.vector_id)
    assert got == brute_force(asked.collect(), offered.collect(), 3)


def test_pivots_rule_out_far_groups(spark):
    rows = clustered(spark, 400, 3, "query_id").filter("query_id % 97 != 5").collect()
    vectors = np.array([r.embedding for r in rows])
    ids = pa.array([r.query_id for r in rows])
    held = dense._Queries(ids, vectors, [None] * len(rows))
    leaders = dense._PivotLeaders(held, 3, 0.0, False)
    for at in range(0, len(rows), 100):
        part = slice(at, at + 100)
        batch = pa.RecordBatch.from_arrays(
            [ids[part], pa.array(list(vectors[part]), pa.list_(pa.float64())), pa.array([""] * len(ids[part]))],
            names=["c", "v", "s"],
        )
        leaders.add(batch)
        leaders._shrink()
    assert leaders.products < 0.6 * len(rows) ** 2


def test_dense_search_breaks_ties_by_id_among_copies(spark):
    copies = spark.range(500).select(
        F.col("id").alias("vector_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")
    )
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "query_id bigint, embedding array<double>")
    rows = nearest_chunks(asked, copies.repartition(6), 3).orderBy("rank").collect()
    assert [r.vector_id for r in rows] == [0, 1, 2]


def test_dense_search_without_queries(spark):
    asked = vectors(spark, 1, 1, "query_id").limit(0)
    assert nearest_chunks(asked, vectors(spark, 5, 2, "vector_id")).count() == 0


def cover_score(words, terms):
    """All minimal spans, found by trying every pair of ends."""
    hits = [i for i, w in enumerate(words) if w in terms]
    spans = [
        (a, b) for a in hits for b in hits if a <= b and set(terms) <= set(words[a : b + 1])
    ]
    minimal = [
        s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)
    ]
    total = 0.0
    for a, b in minimal:
        inside = sum(w in terms for w in words[a : b + 1])
        total += 0.1 / (1 + (b - a + 1) - inside)
    return round(total, 9)


@pytest.mark.parametrize("bound", [10**6, 0])
def test_keyword_search_matches_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(lexical, "MAX_BROADCAST_TERMS", bound)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefg"), size=12)) for _ in range(60)]
    chunks = spark.createDataFrame(
        [(f"c{i:02d}", x) for i, x in enumerate(texts)], "vector_id string, content string"
    )
    asked = [(1, "a b c"), (2, "G g f e"), (3, "a b"), (4, "a b zzz")]
    queries = spark.createDataFrame(asked, "query_id int, text string")
    got = {}
    for r in keyword_matches(queries, chunks, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vector_id, round(r.density, 6)))
    for key, question in asked[:2]:
        terms = list(dict.fromkeys(question.lower().split()))
        scored = [
            (f"c{i:02d}", cover_score(x.split(), terms))
            for i, x in enumerate(texts)
            if set(terms) <= set(x.split())
        ]
        best = sorted(scored, key=lambda s: (-s[1], s[0]))[:5]
        assert got[key] == [(v, round(s, 6)) for v, s in best]
    # Two words are too few, and no chunk holds every term of the last query.
    assert set(got) == {1, 2}


def test_english_analyzer_stems_and_skips_stop_words(spark):
    chunks = spark.createDataFrame(
        [("c1", "The runner was running through forests"), ("c2", "Forest of the king")],
        "vector_id string, content string",
    )
    asked = spark.createDataFrame([(1, "a run in the forest")], "query_id int, text string")
    rows = keyword_matches(asked, chunks, 5, analyzer="english").collect()
    assert [r.vector_id for r in rows] == ["c1"]


def test_embedding_is_unit_and_equal_for_equal_words(spark):
    texts = spark.createDataFrame([("One two",), ("two, ONE!",), ("",), (None,)], "t string")
    a, b, empty, missing = [r[0] for r in texts.select(hashed_terms(F.col("t"))).collect()]
    assert a == b and sum(x * x for x in a) == pytest.approx(1.0)
    assert set(empty) == set(missing) == {0.0}


def test_diverse_pick_prefers_new_words():
    words = [frozenset("ab"), frozenset("ab"), frozenset("cd")]
    assert _pick([0.9, 0.8, 0.5], words, 3) == [0, 2, 1]
    assert _pick([0.5, 0.5], [frozenset(), frozenset()], 5) == [0, 1]


def test_diverse_selection_is_a_growing_prefix(spark):
    rows = [("q", f"v{i}", f"alpha{i % 3} beta{i % 2} gamma", 0.9 - i / 20, i) for i in range(9)]
    scored = spark.createDataFrame(
        rows, "query_id string, vector_id string, content string, semantic_score double, "
        "fused_rank int",
    )
    picks = [
        [r.vector_id for r in select_diverse(scored, n).orderBy("pick").collect()] for n in (3, 5)
    ]
    assert picks[1][:3] == picks[0] and picks[0][0] == "v0"


def test_ranking_signals(spark):
    rows = [
        ("q", "hit", "alpha plan", 1, 0.5),
        ("q", "target", "beta report", 2, 0.6),
        ("q", "low", "gamma", 2, 0.2),
    ]
    candidates = spark.createDataFrame(
        rows,
        "query_id string, vector_id string, source_name string, session_id bigint, "
        "semantic_score double",
    ).withColumns(
        {
            "entities": F.array(F.lit("Alpha_plan.pdf")),
            "target_documents": F.array(F.lit("Beta-Report.docx")),
            "current_session_id": F.lit(1).cast("bigint"),
            "pick": F.lit(1),
        }
    )
    ranked = rank_candidates(candidates).orderBy("final_rank").collect()
    assert [r.vector_id for r in ranked] == ["hit", "target"]
    assert ranked[0].final_score == pytest.approx(0.5 * 1.2 * 1.1)
    assert ranked[1].final_score == pytest.approx(0.6 * 0.8 * 1.15)
    assert ranked[0].matched_entities == ["Alpha_plan.pdf"]
    assert ranked[0].reasoning.startswith("Semantic: 0.500 | EntityBoost: 1.20")


@pytest.mark.parametrize("part", [4 << 20, 8])
def test_name_matching_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(ranking, "NEEDLE_BYTES", part)
    sources = ["alpha plan", "x", "a", "beta alpha", "lp"]
    names = ["Alpha.pdf", "A", "lp", "a_p", "zz", "", "ta al"]
    got = match_names(
        spark.createDataFrame([(s,) for s in sources], "source_name string"),
        spark.createDataFrame([(n,) for n in names], "name string"),
    ).collect()
    clean = {n: n.rsplit(".", 1)[0].replace("_", " ").lower() for n in names}
    expected = {(s, n) for s in sources for n in names if clean[n] and clean[n] in s}
    assert {(r.source_name, r.name) for r in got} == expected


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).select(F.format_string("n%05d_x.pdf", "id").alias("name"))
    sources = spark.range(2000).select(F.format_string("n%05d x n%05d x", "id", "id").alias("source_name"))
    got = match_names(sources, names)
    assert got.count() == 2000
    assert got.filter("substring(source_name, 1, 6) = substring(name, 1, 6)").count() == 2000
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def scored_evidence(spark, score):
    rows = [("p1", "v1", score, 1, "s"), ("p2", "v1", score, 1, "s")]
    return spark.createDataFrame(
        rows,
        "plan_id string, vector_id string, final_score double, final_rank int, "
        "source_name string",
    )


@pytest.mark.parametrize("score, expanded", [(0.419, ["p1"]), (0.42, [])])
def test_expansion_needs_weak_evidence_and_targets(spark, score, expanded):
    queries = spark.createDataFrame(
        [("p1", ["s"]), ("p2", [])], f"plan_id string, targets {NONE}"
    )
    found = pr.needs_expansion(queries, scored_evidence(spark, score)).collect()
    assert [r.plan_id for r in found] == expanded
    assert all(r.reason == "LOW_CONFIDENCE" for r in found)


def test_expansion_without_any_evidence(spark):
    queries = spark.createDataFrame([("p3", ["s"])], f"plan_id string, targets {NONE}")
    found = pr.needs_expansion(queries, scored_evidence(spark, 0.9)).collect()
    assert [(r.plan_id, r.reason) for r in found] == [("p3", "NO_RESULTS")]


def evidence(spark, rows):
    return spark.createDataFrame(
        [(1, i, *r) for i, r in enumerate(rows)],
        "request_id int, position int, source_name string, final_score double, "
        "semantic_score double, whole_document_match boolean",
    )


@pytest.mark.parametrize(
    "rows, kept",
    [
        ([("a", 0.9, 0.1, False), ("b", 0.26, 0.1, False)], {"a"}),
        ([("a", 0.9, 0.1, False), ("b", 0.27, 0.1, False)], {"a", "b"}),
        ([("a", 0.9, 0.1, False), ("b", 0.01, 0.1, True)], {"a", "b"}),
        ([("a", 0.0, 0.0, False), ("b", 0.0, 0.0, False)], {"a", "b"}),
        ([("a", 0.0, 0.8, False), ("b", 0.1, 0.9, False)], {"a"}),
        ([("a", -1.0, 0.0, False)], {"a"}),
    ],
)
def test_citation_sources(spark, rows, kept):
    found = filter_to_relevant_sources(evidence(spark, rows)).collect()
    assert {r.source_name for r in found} == kept


def test_citations_are_regrouped_by_first_source(spark):
    rows = [("a", 0.9, 0.1, False), ("b", 0.9, 0.1, False), ("a", 0.9, 0.1, False)]
    full = evidence(spark, rows).withColumns(
        {
            "source_type": F.lit("TEXT"),
            "chunk_index": F.col("position"),
            "content": F.lit("x" * 300),
        }
    )
    cited = citations(full).orderBy("citation_no").collect()
    assert [(r.sourceName, r.chunkIndex) for r in cited] == [("a", 0), ("a", 2), ("b", 1)]
    assert cited[0].excerpt == "x" * 200 + "…" and not cited[0].isImage


def test_merge_keeps_first_occurrence_for_union_only(spark):
    rows = [(r, p, f"{r}-{p}", "same", 1) for r in (1, 2) for p in (0, 1)]
    found = spark.createDataFrame(
        rows, "request_id int, plan_pos int, plan_id string, vector_id string, final_rank int"
    )
    requests = spark.createDataFrame([(1, "UNION"), (2, "COMPARE")], "request_id int, merge_op string")
    merged = pr.merge_evidence(found, requests).collect()
    assert sorted(r.plan_id for r in merged) == ["1-0", "2-0", "2-1"]


def test_numbering_spans_partitions_for_a_hot_key(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        (-F.col("id")).alias("o"),
    )
    numbered = number_rows(rows.repartition(7), ["k"], ["o"])
    hot = [r.position for r in numbered.filter("k = 'hot'").orderBy("o").collect()]
    assert hot == list(range(1, len(hot) + 1))
    assert numbered.filter("k != 'hot' and position != 1").count() == 0


def test_salted_top_k_equals_plain(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 3001).alias("o"))
    plain = top_k(rows, ["k"], [F.col("o")], 40).collect()
    salted = top_k(rows, ["k"], [F.col("o")], 40, salt_by="o").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, salted))


@pytest.fixture(scope="module")
def corpus(spark):
    """Two sources of text chunks and one of images."""
    words = ["river", "mountain", "valley", "forest", "desert", "island"]
    rows = []
    for i in range(90):
        source = ["alpha notes", "beta notes", "gamma"][i % 3]
        content = f"{words[i % 6]} {words[(i * 5 + 1) % 6]} the quick text number{i}"
        rows.append((f"{i:03d}", content, source, "IMAGE" if source == "gamma" else "TEXT", i % 4, i // 3,
                     f"http://i/{i}" if source == "gamma" else None))
    chunks = spark.createDataFrame(
        rows,
        "vector_id string, content string, source_name string, source_type string, "
        "session_id bigint, chunk_index int, image_url string",
    ).withColumn("source_url", F.lit(None).cast("string"))
    return chunks.withColumn("embedding", hashed_terms(F.col("content"))).cache()


def plans(spark, rows):
    layout = (
        "plan_id string, question string, target_documents array<string>, mode string, "
        "scope string"
    )
    return pr.plan_queries(
        spark.createDataFrame(rows, layout).withColumns(
            {
                "request_id": F.lit(1),
                "plan_pos": F.lit(0),
                "purpose": F.lit("p"),
                "optimized_query": F.lit(None).cast("string"),
                "entities": F.array().cast("array<string>"),
                "session_id": F.lit(1).cast("bigint"),
            }
        )
    )


def test_whole_document_plan_reads_its_first_sixty_chunks(spark, corpus):
    asked = plans(spark, [("w", "river valley text", ["Alpha_Notes.pdf"], "WHOLE_DOCUMENT", "CORPUS")])
    pool = pr.whole_documents(asked, corpus, 10).orderBy("document_rank").collect()
    assert [r.chunk_index for r in pool] == list(range(10))
    found = pr.retrieve_evidence(asked, corpus).collect()
    assert found and {r.source_name for r in found} == {"alpha notes"}
    assert all(r.whole_document_match for r in found)
    assert pr.whole_documents(asked, corpus, None).count() == 30


def test_targets_limit_lexical_search_only_when_asked(spark, corpus):
    asked = plans(spark, [("t", "the quick text", ["beta-notes.txt"], "RANKED_RETRIEVAL", "CORPUS")])
    open_pool = pr.hybrid_retrieve(asked, corpus)
    closed = pr.hybrid_retrieve(asked, corpus, targets_in_lexical=True)
    assert open_pool.select("source_name").distinct().count() > 1
    assert {r.source_name for r in closed.collect()} == {"beta notes"}


def test_visual_search_sees_images_only(spark, corpus):
    asked = plans(spark, [("v", "river valley text", [], "RANKED_RETRIEVAL", "CORPUS")])
    shown = pr.visual_evidence(asked, corpus).collect()
    assert 0 < len(shown) <= 3 and all(r.image_url for r in shown)


def test_expansion_searches_everything_for_weak_plans(spark, corpus):
    asked = plans(
        spark,
        [
            ("missing", "river mountain", ["nowhere.txt"], "RANKED_RETRIEVAL", "CORPUS"),
            ("fine", "mountain valley", [], "RANKED_RETRIEVAL", "CORPUS"),
        ],
    )
    evidence, status = pr.retrieve_with_expansion(asked, corpus)
    by_plan = {r.plan_id: r for r in status.collect()}
    assert by_plan["missing"].expanded_scope and by_plan["missing"].reason == "NO_RESULTS"
    assert not by_plan["fine"].expanded_scope and by_plan["fine"].reason == "NONE"
    assert {r.plan_id for r in evidence.select("plan_id").distinct().collect()} == {"missing", "fine"}


def test_iteration_follows_the_decider(spark, corpus):
    asked = plans(
        spark,
        [("go", "zzz", [], "RANKED_RETRIEVAL", "CORPUS"), ("stop", "river", [], "RANKED_RETRIEVAL", "CORPUS")],
    )

    def decide(observed):
        going = F.col("plan_id") == "go"
        return observed.select(
            "plan_id",
            F.when(going, "SEARCH").otherwise("STOP").alias("type"),
            F.when(going, "river mountain").alias("next_query"),
        )

    found = pr.iterate_retrieval(asked, corpus, decide, max_iterations=3)
    rounds = {(r.plan_id, r.iteration) for r in found.select("plan_id", "iteration").distinct().collect()}
    assert ("go", 2) in rounds and ("go", 3) in rounds
    assert {i for p, i in rounds if p == "stop"} == {1}


def test_postings_give_what_keyword_search_gives(spark, tmp_path):
    rng = random.Random(11)
    words = "alpha beta gamma delta running runs the of epsilon ünï 42".split()
    rows = [(f"c{i}", " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(120)]
    rows += [("null", None), ("empty", "")]
    chunks = spark.createDataFrame(rows, "vector_id string, content string")
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(2, 5)))) for i in range(30)] + [(99, "alpha beta missing")]
    queries = spark.createDataFrame(asked, "query_id int, text string")
    for analyzer in ("simple", "english"):
        path = str(tmp_path / analyzer)
        late = F.col("vector_id").endswith("7")
        for number, part in ((0, chunks.filter(~late)), (0, chunks), (1, chunks.filter(late))):
            postings.add_postings(part, path, number, analyzer=analyzer)
        want = {(r.query_id, r.vector_id): r.density for r in keyword_scores(queries, chunks, analyzer=analyzer).collect()}
        found = postings.search_scores(queries, path, analyzer=analyzer)
        assert want and {(r.query_id, r.vector_id): r.density for r in found.collect()} == want
        # The plan of the search holds the index and no chunk text.
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "content" not in plan
        best = postings.search(queries, path, 3, analyzer=analyzer).groupBy("query_id").count().agg(F.max("count")).first()[0]
        assert best <= 3
    with pytest.raises(ValueError):
        postings.search_scores(queries, str(tmp_path / "none"))
