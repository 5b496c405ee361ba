"""Search, fusion, ranking and evidence over all questions and all chunks."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from loomlight.catalog import aggregates as ag
from loomlight.catalog import scalars as sc
from loomlight.catalog import tables as t
from loomlight.catalog.registry import query
from loomlight.functions import intent
from loomlight.lineage import materialize, shared_folder
from loomlight.operators import evidence as ev
from loomlight.operators import fusion as fu
from loomlight.operators import postings as po
from loomlight.operators.dense import nearest_chunks
from loomlight.operators.embedding import hashed_terms
from loomlight.operators.lexical import best_matches, keyword_matches, keyword_scores
from loomlight.operators.ranking import match_names, rank_candidates
from loomlight.operators.rerank import score_pairs, select_diverse
from loomlight.ordering import top_k
from loomlight.plans import answers as an
from loomlight.plans import retrieval as pr
from loomlight.plans import routing as ro
from loomlight.plans.ingest import ingest

# --- vector search over the given embeddings: one query per label, its mean vector.

CENTROIDS_SQL = """parts AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings),
means AS (SELECT label, i, avg(x) AS m FROM parts GROUP BY ALL),
mean_norm AS (SELECT label, sqrt(sum(m * m)) AS n FROM means GROUP BY 1),
vec_norm AS (SELECT vec_id, any_value(label) AS label, sqrt(sum(x * x)) AS n FROM parts GROUP BY 1),
nearby AS (
  SELECT m.label AS query_label, p.vec_id, any_value(v.label) AS label,
    round(sum(m.m * p.x) / any_value(q.n) / any_value(v.n), 9) AS similarity
  FROM means m JOIN parts p ON m.i = p.i JOIN mean_norm q ON q.label = m.label
    JOIN vec_norm v ON v.vec_id = p.vec_id
  GROUP BY m.label, p.vec_id)"""


def centroids(spark, folder):
    """Mean vector of every label; the mean is taken per dimension."""
    parts = t.table(spark, folder, "embeddings").select(
        "label", F.posexplode("embedding").alias("i", "x")
    )
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # A vector has a fixed number of dimensions.
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(
        F.transform(ordered, lambda p: p["m"]).alias("embedding")
    )


@query(
    "J6",
    sql=f"""
    WITH {CENTROIDS_SQL}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_label
        ORDER BY similarity DESC, vec_id) AS rank FROM nearby WHERE similarity >= 0.0)
    SELECT query_label, vec_id, round(similarity, 6) AS similarity, rank::INTEGER AS rank
    FROM ranked WHERE rank <= 15""",
)
def nearest_to_centroids(spark, folder):
    """The 15 vectors nearest to the mean of each label."""
    found = nearest_chunks(
        centroids(spark, folder).withColumnRenamed("label", "query_label"),
        t.table(spark, folder, "embeddings"),
        k=15,
        query_id="query_label",
        chunk_id="vec_id",
    )
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    "J11",
    sql=f"""
    WITH {CENTROIDS_SQL}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_label
        ORDER BY similarity DESC, vec_id) AS rank
      FROM nearby WHERE similarity >= 0.0 AND label <> query_label AND label = 3)
    SELECT query_label, vec_id, rank::INTEGER AS rank FROM ranked WHERE rank <= 5
    UNION ALL
    SELECT query_label, vec_id, rank::INTEGER FROM (
      SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank
      FROM nearby WHERE similarity >= 0.0 AND label = 3 AND query_label = 3) WHERE rank <= 5""",
)
def nearest_in_session(spark, folder):
    """Every label's mean against the vectors of one session (label 3)."""
    found = nearest_chunks(
        centroids(spark, folder).withColumnRenamed("label", "query_label"),
        t.table(spark, folder, "embeddings").filter("label = 3"),
        query_id="query_label",
        chunk_id="vec_id",
    )
    return found.select("query_label", "vec_id", "rank")


@query(
    "J6",
    sql="""
    WITH unit AS (
      SELECT vec_id, label, [x / n FOR x IN v] AS u FROM (
        SELECT vec_id, label, embedding::DOUBLE[] AS v,
          sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)),
    nearby AS (
      SELECT q.vec_id AS query_vec, c.vec_id,
        round(list_dot_product(q.u, c.u), 9) AS similarity
      FROM unit q JOIN unit c ON q.label % 2 = 0 OR c.label = q.label),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_vec
        ORDER BY similarity DESC, vec_id) AS rank FROM nearby WHERE similarity >= 0.0)
    SELECT query_vec, vec_id, round(similarity, 6) AS similarity, rank::INTEGER AS rank
    FROM ranked WHERE rank <= 5""",
)
def embedding_neighbours(spark, folder):
    """The five vectors nearest to every vector; those of odd labels search their own label.

    Every vector asks, so the queries come in rounds.
    """
    vectors = t.table(spark, folder, "embeddings").withColumn(
        "source", F.col("label").cast("string")
    )
    asked = vectors.select(
        F.col("vec_id").alias("query_vec"),
        "embedding",
        F.when(F.col("label") % 2 == 1, F.array("source")).alias("targets"),
    )
    found = nearest_chunks(
        asked,
        vectors,
        query_id="query_vec",
        chunk_id="vec_id",
        targets="targets",
        source="source",
        max_broadcast=256,
    )
    return found.withColumn("similarity", F.round("similarity", 6))


# --- text search: all questions against the chunks of all documents.

TERMS = r"""list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"""

LEXICAL_SQL = rf"""asked AS (
  SELECT plan_id, list_distinct({TERMS.format("query_text")}) AS terms FROM questions
  WHERE len(regexp_split_to_array(regexp_replace(query_text, '\s+$', ''), '\s+')) >= 3),
wanted AS (SELECT plan_id, len(terms) AS n, unnest(terms) AS term FROM asked),
words AS (SELECT vector_id, {TERMS.format("content")} AS w FROM chunks),
places AS (SELECT vector_id, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM words),
hits AS (
  SELECT plan_id, vector_id, n, p.term, place FROM places p JOIN wanted q ON p.term = q.term),
full_match AS (
  SELECT plan_id, vector_id FROM hits GROUP BY plan_id, vector_id
  HAVING count(DISTINCT term) = any_value(n)),
numbered_hits AS (
  SELECT h.*, row_number() OVER (PARTITION BY plan_id, vector_id ORDER BY place) AS nth
  FROM hits h JOIN full_match USING (plan_id, vector_id)),
last_places AS (
  SELECT e.plan_id, e.vector_id, e.n, e.place AS stop, e.nth AS stop_nth, o.term,
    max((o.place, o.nth)) AS last
  FROM numbered_hits e JOIN numbered_hits o
    ON e.plan_id = o.plan_id AND e.vector_id = o.vector_id AND o.place <= e.place
  GROUP BY ALL),
ends AS (
  SELECT plan_id, vector_id, stop, stop_nth, min(last) AS first FROM last_places
  GROUP BY plan_id, vector_id, stop, stop_nth, n HAVING count(*) = n),
covers AS (
  SELECT plan_id, vector_id, first, min(stop) AS stop, min(stop_nth) AS stop_nth
  FROM ends GROUP BY plan_id, vector_id, first),
scored_lexical AS (
  SELECT plan_id, vector_id, round(sum(
    0.1::DOUBLE / (1 + (stop - first[1]) - (stop_nth - first[2]))), 9) AS density
  FROM covers GROUP BY plan_id, vector_id),
lexical AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY density DESC, vector_id) AS rank
    FROM scored_lexical) WHERE rank <= 15)"""


def queries_of(spark, folder):
    """Questions ready to be searched, written once."""
    return materialize(pr.plan_queries(t.questions(spark, folder)), "queries")


def embedded_chunks(spark, folder):
    """The chunk table with the default embedding, written once."""
    made, _ = ingest(t.uploads(spark, folder))
    return materialize(made.withColumn("embedding", hashed_terms(F.col("content"))), "embedded")


@query(
    "J7",
    "K1",
    sql=f"""
    WITH RECURSIVE {t.CHUNKS_SQL}, {t.QUESTIONS_SQL}, {LEXICAL_SQL}
    SELECT plan_id, vector_id, round(density, 6) AS density, rank::INTEGER AS rank
    FROM lexical""",
)
def keyword_search(spark, folder):
    """Chunks that hold every term of a question, best cover first."""
    found = keyword_matches(
        queries_of(spark, folder), t.chunks(spark, folder), 15, "plan_id", "query_text"
    )
    return found.withColumn("density", F.round("density", 6))


# Short questions, so that many chunks match: every message in runs of three words.
SHORT_SQL = r"""message_words AS (
  SELECT conv_id * 1000 + turn AS message_id,
    list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) > 1) AS w
  FROM conversations),
starts AS (SELECT message_id, w, unnest(range(0, len(w), 3)) AS i FROM message_words),
questions AS (
  SELECT message_id || '-' || i AS plan_id, array_to_string(w[i + 1 : i + 3], ' ') AS query_text FROM starts)"""


def short_questions(spark, folder):
    words = F.filter(F.split(F.lower("text"), r"\W+"), lambda w: F.length(w) > 1)
    said = t.table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), words.alias("w")
    )
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(3))
    runs = said.filter(F.size("w") > 0).withColumn("i", F.explode(starts))
    return runs.select(
        F.concat_ws("-", "message_id", "i").alias("plan_id"),
        F.array_join(F.slice("w", F.col("i") + 1, F.lit(3)), " ").alias("query_text"),
    )


@query(
    "J7",
    sql=f"""
    WITH RECURSIVE {t.CHUNKS_SQL}, {SHORT_SQL}, {LEXICAL_SQL}
    SELECT plan_id, vector_id, round(density, 6) AS density, rank::INTEGER AS rank
    FROM lexical""",
)
def keyword_search_short(spark, folder):
    found = keyword_matches(
        short_questions(spark, folder), t.chunks(spark, folder), 15, "plan_id", "query_text"
    )
    return found.withColumn("density", F.round("density", 6))


def indexed(spark, folder, analyzer="simple"):
    """An index of all chunks, built in two batches, the first of them run twice."""
    path = f"{shared_folder(spark)}/loomlight/index-{uuid.uuid4().hex}"
    chunks = t.chunks(spark, folder)
    odd = F.substring("content_hash", 1, 1).isin(*"13579bdf")
    for number in (0, 0, 1):
        po.add_postings(chunks.filter(odd if number else ~odd), path, number, analyzer=analyzer)
    return path


@query(
    "J7",
    "K1",
    sql=f"""
    WITH RECURSIVE {t.CHUNKS_SQL}, {t.QUESTIONS_SQL}, {LEXICAL_SQL}
    SELECT plan_id, vector_id, round(density, 6) AS density, rank::INTEGER AS rank
    FROM lexical""",
)
def postings_search(spark, folder):
    """Keyword search over an index of the chunks."""
    found = po.search(queries_of(spark, folder), indexed(spark, folder), 15, "plan_id", "query_text")
    return found.withColumn("density", F.round("density", 6))


@query(
    "J7",
    sql=f"""
    WITH RECURSIVE {t.CHUNKS_SQL}, {SHORT_SQL}, {LEXICAL_SQL}
    SELECT plan_id, vector_id, round(density, 6) AS density, rank::INTEGER AS rank
    FROM lexical""",
)
def postings_search_short(spark, folder):
    found = po.search(short_questions(spark, folder), indexed(spark, folder), 15, "plan_id", "query_text")
    return found.withColumn("density", F.round("density", 6))


@query("J7")
def keyword_search_english(spark, folder):
    """The same with stop words dropped and words stemmed."""
    found = keyword_matches(
        queries_of(spark, folder), t.chunks(spark, folder), 15, "plan_id", "query_text",
        analyzer="english",
    )
    return found.withColumn("density", F.round("density", 6))


VECTOR_SQL = rf"""
question_terms AS (
  SELECT plan_id AS id, unnest({TERMS.format("query_text")}) AS term FROM questions),
chunk_words AS (SELECT vector_id AS id, unnest({TERMS.format("content")}) AS term FROM chunks),
question_counts AS (
  SELECT id, ('0x' || substr(md5(term), 1, 6))::INTEGER % 64 AS b, count(*) AS c
  FROM question_terms GROUP BY ALL),
chunk_counts AS (
  SELECT id, ('0x' || substr(md5(term), 1, 6))::INTEGER % 64 AS b, count(*) AS c
  FROM chunk_words GROUP BY ALL),
question_values AS (
  SELECT id, b, (c / sqrt(sum(c * c) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x
  FROM question_counts),
chunk_values AS (
  SELECT id, b, (c / sqrt(sum(c * c) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x
  FROM chunk_counts),
question_unit AS (
  SELECT id, b, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM question_values),
chunk_unit AS (
  SELECT id, b, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM chunk_values)"""


def dense_sql(targets: bool, images: bool = False) -> str:
    """Dense list of every question; with targets, questions that name a source see only it."""
    limited = "WHERE q.target IS NULL OR q.target = c.source_name" if targets else ""
    shown = "AND c.source_type IN ('IMAGE', 'PDF_IMAGE')" if images else ""
    return f"""{VECTOR_SQL},
nearby AS (
  SELECT q.id AS plan_id, c.id AS vector_id, round(sum(q.x * c.x), 9) AS similarity
  FROM question_unit q JOIN chunk_unit c USING (b) GROUP BY ALL),
dense AS (
  SELECT * FROM (
    SELECT s.plan_id, s.vector_id, similarity, row_number() OVER (PARTITION BY s.plan_id
      ORDER BY similarity DESC, s.vector_id) AS rank
    FROM nearby s JOIN questions q ON q.plan_id = s.plan_id
      JOIN chunks c ON c.vector_id = s.vector_id {shown}
    {limited}) WHERE rank <= 15)"""


@query(
    "J6",
    "U2",
    sql=f"""
    WITH RECURSIVE {t.CHUNKS_SQL}, {t.QUESTIONS_SQL}, {dense_sql(True)}
    SELECT plan_id, vector_id, round(similarity, 6) AS similarity, rank::INTEGER AS rank
    FROM dense""",
)
def vector_search(spark, folder):
    """Questions against chunk embeddings, within their targets where they have some."""
    found = nearest_chunks(
        queries_of(spark, folder),
        embedded_chunks(spark, folder),
        15,
        query_id="plan_id",
        targets="targets",
    )
    return found.withColumn("similarity", F.round("similarity", 6))


FUSED_SQL = """fused AS (
  SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY fused_score DESC,
    dense_rank NULLS LAST, lexical_rank NULLS LAST, vector_id) AS fused_rank
  FROM (
    SELECT coalesce(d.plan_id, l.plan_id) AS plan_id,
      coalesce(d.vector_id, l.vector_id) AS vector_id, d.rank AS dense_rank,
      l.rank AS lexical_rank,
      round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0), 12)
        AS fused_score
    FROM dense d FULL OUTER JOIN lexical l
      ON d.plan_id = l.plan_id AND d.vector_id = l.vector_id))"""

SPREAD_SQL = """spread AS (
  SELECT * FROM (
    SELECT *, sum(CASE WHEN nth > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id
        ORDER BY fused_rank ROWS UNBOUNDED PRECEDING) AS fill,
      sum(CASE WHEN nth <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id) AS kept
    FROM (
      SELECT f.*, c.source_name, c.content, c.session_id AS owner, c.source_type, c.image_url,
        count(*) OVER (PARTITION BY plan_id) AS pool,
        row_number() OVER (PARTITION BY plan_id, c.source_name ORDER BY fused_rank) AS nth
      FROM fused f JOIN chunks c USING (vector_id)))
  WHERE pool <= 15 OR nth <= 2 OR fill <= greatest(15 - kept, 0))"""


@query(
    "J1",
    "W1",
    sql=f"""
    WITH RECURSIVE {t.CHUNKS_SQL}, {t.QUESTIONS_SQL}, {LEXICAL_SQL}, {dense_sql(False)},
    {FUSED_SQL}
    SELECT plan_id, vector_id, dense_rank::INTEGER AS dense_rank,
      lexical_rank::INTEGER AS lexical_rank, round(fused_score, 9) AS fused_score,
      fused_rank::INTEGER AS fused_rank FROM fused""",
)
def rank_fusion(spark, folder):
    """Both ranked lists of every question, fused."""
    asked, chunks = queries_of(spark, folder), embedded_chunks(spark, folder)
    dense = nearest_chunks(asked, chunks, 15, query_id="plan_id")
    lexical = keyword_matches(asked, chunks, 15, "plan_id", "query_text")
    return fu.fuse_ranks(dense, lexical, "plan_id").select(
        "plan_id", "vector_id", "dense_rank", "lexical_rank",
        F.round("fused_score", 9).alias("fused_score"), "fused_rank",
    )


# A second ranking of the vectors by distance to the next label's mean gives two lists
# that agree often enough to fuse.
@query(
    "W2",
    sql=f"""
    WITH {CENTROIDS_SQL},
    dense AS (
      SELECT query_label::VARCHAR AS plan_id, vec_id::VARCHAR AS vector_id, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_label
          ORDER BY similarity DESC, vec_id::VARCHAR) AS rank FROM nearby WHERE similarity >= 0)
      WHERE rank <= 15),
    lexical AS (
      SELECT ((query_label + 1) % 10)::VARCHAR AS plan_id, vector_id, rank FROM (
        SELECT plan_id::INTEGER AS query_label, vector_id, rank FROM dense)),
    {FUSED_SQL},
    chunks AS (
      SELECT vec_id::VARCHAR AS vector_id, (label % 3)::VARCHAR AS source_name, '' AS content,
        0 AS session_id, '' AS source_type, '' AS image_url FROM embeddings),
    {SPREAD_SQL}
    SELECT plan_id, vector_id, fused_rank::INTEGER AS fused_rank FROM spread""",
)
def source_spread(spark, folder):
    """Pools of up to 30 vectors in three sources, spread over them."""
    vectors = t.table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("vector_id"), "label", "embedding"
    )
    asked = centroids(spark, folder).withColumn("plan_id", F.col("label").cast("string"))
    dense = materialize(nearest_chunks(asked, vectors, 15, query_id="plan_id"), "dense")
    shifted = ((F.col("plan_id").cast("int") + 1) % 10).cast("string")
    fused = fu.fuse_ranks(dense, dense.withColumn("plan_id", shifted), "plan_id")
    sourced = vectors.select("vector_id", (F.col("label") % 3).cast("string").alias("source_name"))
    pool = fused.join(sourced, "vector_id")
    return fu.spread_sources(pool, "plan_id").select("plan_id", "vector_id", "fused_rank")


def hybrid_sql(targets: bool = True) -> str:
    return f"""{t.CHUNKS_SQL}, {t.QUESTIONS_SQL}, {LEXICAL_SQL}, {dense_sql(targets)},
    {FUSED_SQL}, {SPREAD_SQL}"""


@query(
    "C4",
    "W2",
    sql=f"""
    WITH RECURSIVE {hybrid_sql()}
    SELECT plan_id, vector_id, source_name, round(fused_score, 9) AS fused_score,
      fused_rank::INTEGER AS fused_rank FROM spread""",
)
def hybrid_retrieval(spark, folder):
    """Vector and keyword search, fused and spread over sources."""
    found = pr.hybrid_retrieve(queries_of(spark, folder), embedded_chunks(spark, folder))
    return found.select(
        "plan_id", "vector_id", "source_name", F.round("fused_score", 9).alias("fused_score"),
        "fused_rank",
    )


# --- scoring, diverse selection and signal ranking of the retrieved pool.

COVERAGE_SQL = f"""scored AS (
  SELECT *, (1.0 / (1.0 + exp(-(8.0 * CASE WHEN len(qw) = 0 THEN 0.0
      ELSE len(list_intersect(qw, cw))::DOUBLE / len(qw) END - 4.0))))::FLOAT::DOUBLE
      AS semantic_score
  FROM (
    SELECT s.*, q.entity, q.target, q.session_id AS asking, q.request_id,
      {sc.WORDS_SQL.format("q.query_text")} AS qw, {sc.WORDS_SQL.format("s.content")} AS cw
    FROM {{pool}} s JOIN questions q USING (plan_id)))"""


def diverse_sql(n: int) -> str:
    """Greedy selection unrolled: one step per pick."""
    likeness = """pairs AS (
  SELECT a.plan_id, a.vector_id AS a, b.vector_id AS b,
    CASE WHEN len(a.cw) = 0 OR len(b.cw) = 0 THEN 0.0::DOUBLE
      ELSE len(list_intersect(a.cw, b.cw))::DOUBLE
        / len(list_distinct(list_concat(a.cw, b.cw))) END AS likeness
  FROM scored a JOIN scored b ON a.plan_id = b.plan_id AND a.vector_id <> b.vector_id)"""
    steps = [
        """pick_1 AS (
  SELECT plan_id, vector_id, 1 AS pick FROM (
    SELECT *, row_number() OVER (PARTITION BY plan_id
      ORDER BY semantic_score DESC, fused_rank) AS n FROM scored) WHERE n = 1)"""
    ]
    for k in range(2, n + 1):
        steps.append(f"""pick_{k} AS (
  SELECT plan_id, vector_id, pick FROM pick_{k - 1}
  UNION ALL
  SELECT plan_id, vector_id, {k} FROM (
    SELECT s.plan_id, s.vector_id, row_number() OVER (PARTITION BY s.plan_id
      ORDER BY 0.5::DOUBLE * s.semantic_score - 0.5::DOUBLE * m.nearest DESC,
        s.semantic_score DESC, s.fused_rank) AS n
    FROM scored s JOIN (
      SELECT p.plan_id, p.a, max(p.likeness) AS nearest
      FROM pairs p JOIN pick_{k - 1} c ON c.plan_id = p.plan_id AND c.vector_id = p.b
      GROUP BY ALL) m ON m.plan_id = s.plan_id AND m.a = s.vector_id
    WHERE NOT EXISTS (SELECT 1 FROM pick_{k - 1} c
      WHERE c.plan_id = s.plan_id AND c.vector_id = s.vector_id)) WHERE n = 1)""")
    return f"{likeness}, {', '.join(steps)}"


SIGNALS_SQL = """signed AS (
  SELECT *, semantic_score * (entity_boost * target_boost * session_boost) AS final_score FROM (
    SELECT s.*, p.pick,
      CASE WHEN contains(lower(s.source_name), s.entity) THEN 1.2 ELSE 0.8 END::DOUBLE
        AS entity_boost,
      CASE WHEN contains(lower(s.source_name), s.target) THEN 1.15 ELSE 1.0 END::DOUBLE
        AS target_boost,
      CASE WHEN s.owner = s.asking THEN 1.1 ELSE 1.0 END::DOUBLE AS session_boost
    FROM scored s JOIN pick_{n} p USING (plan_id, vector_id))),
ranked AS (
  SELECT * FROM (
    SELECT *, max(final_score) OVER (PARTITION BY plan_id) AS best,
      row_number() OVER (PARTITION BY plan_id ORDER BY final_score DESC, pick, vector_id)
        AS final_rank FROM signed)
  WHERE final_score >= greatest(best * 0.8, 0.1))"""


def signals_sql(n: int, targets: bool = True) -> str:
    """Signal ranking of the n picks; plans without targets get no target signal."""
    ranked = SIGNALS_SQL.format(n=n)
    return ranked if targets else ranked.replace("contains(lower(s.source_name), s.target)", "false")


def ranked_sql(targets: bool = True) -> str:
    return f"""{hybrid_sql(targets)}, {COVERAGE_SQL.format(pool="spread")}, {diverse_sql(5)},
    {signals_sql(5, targets)}"""


def scored_pool(spark, folder):
    asked, chunks = queries_of(spark, folder), embedded_chunks(spark, folder)
    pool = pr.hybrid_retrieve(asked, chunks)
    return materialize(score_pairs(pool.join(asked.select(*pr.PLAN_FIELDS, "query_text"), "plan_id")), "scored")


@query(
    "K2",
    "U1",
    sql=f"""
    WITH RECURSIVE {hybrid_sql()}, {COVERAGE_SQL.format(pool="spread")}
    SELECT plan_id, vector_id, round(semantic_score, 6) AS semantic_score FROM scored""",
)
def pair_scores(spark, folder):
    return scored_pool(spark, folder).select(
        "plan_id", "vector_id", F.round("semantic_score", 6).alias("semantic_score")
    )


@query(
    "K3",
    "K2",
    sql=f"""
    WITH RECURSIVE {hybrid_sql()}, {COVERAGE_SQL.format(pool="spread")}, {diverse_sql(5)}
    SELECT plan_id, vector_id, pick::INTEGER AS pick FROM pick_5""",
)
def diverse_selection(spark, folder):
    chosen = select_diverse(scored_pool(spark, folder), query_id="plan_id")
    return chosen.select("plan_id", "vector_id", "pick")


@query(
    "K4",
    "K5",
    sql=f"""
    WITH RECURSIVE {ranked_sql()}
    SELECT plan_id, vector_id, round(final_score, 6) AS final_score,
      final_rank::INTEGER AS final_rank,
      CASE WHEN entity_boost > 1 THEN entity ELSE '' END AS matched,
      'EntityBoost: ' || printf('%.2f', entity_boost) || ' | MetadataBoost: '
        || printf('%.2f', target_boost) || ' | SessionBoost: ' || printf('%.2f', session_boost)
        AS signals
    FROM ranked""",
)
def signal_ranking(spark, folder):
    chosen = select_diverse(scored_pool(spark, folder), query_id="plan_id")
    ranked = rank_candidates(chosen, "plan_id")
    return ranked.select(
        "plan_id",
        "vector_id",
        F.round("final_score", 6).alias("final_score"),
        "final_rank",
        F.array_join("matched_entities", ",").alias("matched"),
        F.regexp_extract("reasoning", r"EntityBoost: .*SessionBoost: [\d.]+", 0).alias("signals"),
    )


@query(
    "J5",
    sql=f"""
    WITH {t.UPLOADS_SQL}
    SELECT DISTINCT source_name, r_name AS name FROM uploads,
      (SELECT DISTINCT 'RC' || (n_nationkey % 12) || '_' || substr(lang, 1, 1) AS r_name
       FROM nation, (SELECT DISTINCT lang FROM documents))
    WHERE contains(source_name, replace(lower(r_name), '_', ' '))""",
)
def name_matches(spark, folder):
    """Names made of nations and languages that stand inside source names."""
    sources = t.uploads(spark, folder).select(t.source_name_of("file_name").alias("source_name"))
    numbers = t.table(spark, folder, "nation").select((F.col("n_nationkey") % 12).alias("n"))
    # A handful of languages: their initials fit one array.
    initials = t.table(spark, folder, "documents").select(
        F.collect_set(F.substring("lang", 1, 1)).alias("l")
    )
    names = numbers.distinct().select(
        "n", F.explode(initials.scalar()).alias("letter")
    ).select(F.concat(F.lit("RC"), F.col("n").cast("string"), F.lit("_"), "letter").alias("name"))
    return match_names(sources, names)


# --- quality, expansion, merging and composed retrieval.

QUALITY_SQL = """quality AS (
  SELECT plan_id, max(final_score) FILTER (final_rank = 1) AS top_score,
    avg(final_score) FILTER (final_rank <= 5) AS mean_top5, count(*) AS chunks,
    count(DISTINCT source_name) AS sources,
    max(final_score) FILTER (final_rank = 1) * 0.6::DOUBLE
      + avg(final_score) FILTER (final_rank <= 5) * 0.4::DOUBLE AS confidence
  FROM ranked GROUP BY 1)"""


def evidence_of(spark, folder):
    asked, chunks = queries_of(spark, folder), embedded_chunks(spark, folder)
    return asked, chunks, pr.retrieve_evidence(asked, chunks)


@query(
    "A4",
    sql=f"""
    WITH RECURSIVE {ranked_sql()}, {QUALITY_SQL}
    SELECT plan_id, round(top_score, 6) AS top_score, round(mean_top5, 6) AS mean_top5, chunks,
      sources, round(confidence, 6) AS confidence FROM quality""",
)
def retrieval_quality(spark, folder):
    _, _, evidence = evidence_of(spark, folder)
    quality = pr.retrieval_quality(evidence)
    return quality.select(
        "plan_id", "chunks", "sources",
        *[F.round(c, 6).alias(c) for c in ("top_score", "mean_top5", "confidence")],
    )


@query(
    "C6",
    sql=f"""
    WITH RECURSIVE {ranked_sql()}, {QUALITY_SQL}
    SELECT q.plan_id, CASE WHEN top_score IS NULL THEN 'EVIDENCE_MISSING'
      WHEN top_score > 0.8 THEN 'EVIDENCE_FOUND' WHEN top_score > 0.5 THEN 'PARTIAL_EVIDENCE'
      ELSE 'OUT_OF_SCOPE' END AS observation
    FROM questions q LEFT JOIN quality USING (plan_id)""",
)
def observations(spark, folder):
    asked, _, evidence = evidence_of(spark, folder)
    return pr.observations(asked, evidence).select("plan_id", "observation")


def prefixed(ctes: str, prefix: str, *more: str) -> str:
    """The same chain of named queries under other names, for a second round."""
    names = set(re.findall(r"(?:^|,|\n)\s*(\w+) AS \(", ctes)) | set(more)
    for name in sorted(names, key=len, reverse=True):
        ctes = re.sub(rf"(?<![.\w]){name}(?![\w(])", f"{prefix}_{name}", ctes)
    return ctes


# Both rounds in SQL: with targets, and for the weak ones without.
def both_rounds_sql() -> str:
    first = ranked_sql(True)
    tail = f"""{dense_sql(False).split(VECTOR_SQL + ",")[1]}, {FUSED_SQL}, {SPREAD_SQL},
    {COVERAGE_SQL.format(pool="spread")}, {diverse_sql(5)}, {signals_sql(5, False)}"""
    tail = prefixed(tail, "wide")
    return f"""{first}, {QUALITY_SQL}, {tail},
failing AS (
  SELECT q.plan_id, CASE WHEN y.confidence IS NULL THEN 'NO_RESULTS' ELSE 'LOW_CONFIDENCE' END
    AS reason
  FROM questions q LEFT JOIN quality y USING (plan_id)
  WHERE q.target IS NOT NULL AND (y.confidence IS NULL OR y.confidence < 0.42)),
evidence AS (
  SELECT plan_id, request_id, vector_id, source_name, content, final_score, final_rank, source_type
  FROM ranked WHERE plan_id NOT IN (SELECT plan_id FROM failing)
  UNION ALL
  SELECT plan_id, request_id, vector_id, source_name, content, final_score, final_rank, source_type
  FROM wide_ranked WHERE plan_id IN (SELECT plan_id FROM failing))"""


@query(
    "C5",
    sql=f"""
    WITH RECURSIVE {both_rounds_sql()}
    SELECT plan_id, vector_id, round(final_score, 6) AS final_score,
      final_rank::INTEGER AS final_rank FROM evidence""",
)
def expanded_retrieval(spark, folder):
    """Evidence of every question; weak targeted ones search everything."""
    evidence, _ = pr.retrieve_with_expansion(
        pr.plan_queries(t.questions(spark, folder)), embedded_chunks(spark, folder)
    )
    return evidence.select(
        "plan_id", "vector_id", F.round("final_score", 6).alias("final_score"), "final_rank"
    )


@query(
    "C5",
    sql=f"""
    WITH RECURSIVE {both_rounds_sql()}
    SELECT q.plan_id, f.reason IS NOT NULL AS expanded_scope, coalesce(f.reason, 'NONE') AS reason
    FROM questions q LEFT JOIN failing f USING (plan_id)""",
)
def expansion_status(spark, folder):
    _, status = pr.retrieve_with_expansion(
        pr.plan_queries(t.questions(spark, folder)), embedded_chunks(spark, folder)
    )
    return status.select("plan_id", "expanded_scope", "reason")


# Plans of one request: every fourth question belongs together.
MERGED_SQL = """tagged AS (
  SELECT plan_id::BIGINT // 4 AS request_id, plan_id::BIGINT % 4 AS plan_pos, plan_id, vector_id,
    final_rank, final_score,
    CASE plan_id::BIGINT // 4 % 3 WHEN 0 THEN 'UNION' WHEN 1 THEN 'COMPARE' ELSE 'NONE' END
      AS merge_op
  FROM ranked),
merged AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, vector_id
      ORDER BY plan_pos, final_rank) AS n FROM tagged) WHERE merge_op <> 'UNION' OR n = 1)"""


@query(
    "W9",
    "C1",
    "C2",
    "C8",
    sql=f"""
    WITH RECURSIVE {ranked_sql(False)}, {MERGED_SQL}
    SELECT request_id, plan_id, vector_id, 'Retrieval' AS purpose,
      plan_pos::BIGINT * 4294967296 + final_rank AS position FROM merged""",
)
def merged_evidence(spark, folder):
    """Four questions make one request; requests take turns in how they merge."""
    asked, chunks = queries_of(spark, folder), embedded_chunks(spark, folder)
    untargeted = asked.withColumns(
        {name: F.array().cast("array<string>") for name in ("targets", "target_documents")}
    )
    found = pr.retrieve_evidence(untargeted, chunks).withColumn(
        "target_documents", F.array().cast("array<string>")
    )
    plan = F.col("plan_id").cast("bigint")
    plans = asked.select(
        "plan_id",
        F.floor(plan / 4).alias("request_id"),
        (plan % 4).alias("plan_pos"),
        "purpose",
    )
    turn = F.col("request_id") % 3
    requests = plans.select("request_id").distinct().withColumn(
        "merge_op", F.when(turn == 0, "UNION").when(turn == 1, "COMPARE").otherwise("NONE")
    )
    merged = pr.merge_evidence(pr.attach_plan(found, plans), requests)
    return merged.select("request_id", "plan_id", "vector_id", "purpose", "position")


IMAGE_CHUNKS_SQL = (
    t.CHUNKS_SQL.replace("\nchunks AS (", "\nall_chunks AS (")
    + """,
chunks AS (SELECT * FROM all_chunks WHERE source_type IN ('IMAGE', 'PDF_IMAGE'))"""
)


@query(
    "C3",
    sql=f"""
    WITH RECURSIVE {IMAGE_CHUNKS_SQL}, {t.QUESTIONS_SQL}, {LEXICAL_SQL}, {dense_sql(True)},
    {FUSED_SQL}, {SPREAD_SQL}, {COVERAGE_SQL.format(pool="spread")}, {diverse_sql(3)},
    {signals_sql(3)}
    SELECT request_id, plan_id, 0 AS plan_pos, final_rank::INTEGER AS visual_rank,
      vector_id AS semantic_id, image_url, content AS caption, round(final_score, 6) AS score,
      source_name
    FROM ranked WHERE final_rank <= 3""",
)
def visual_evidence(spark, folder):
    """Image chunks for every question."""
    shown = pr.visual_evidence(queries_of(spark, folder), embedded_chunks(spark, folder))
    return shown.withColumn("score", F.round("score", 6))


@query(
    "P20",
    sql=f"""
    WITH {t.ATTACHMENTS_SQL}, r AS (
      SELECT url, user_id, attachment_id, row_number() OVER (PARTITION BY url, user_id
        ORDER BY attachment_id) AS n FROM attachments)
    SELECT url, user_id, attachment_id, 'IMG_' || lpad(n::VARCHAR, 2, '0')
      AS stable_id FROM r WHERE n <= 3""",
)
def stable_visual_ids(spark, folder):
    """The first three copies of a file per user as the visuals of one request."""
    copies = t.attachments(spark, folder).select("url", "user_id", "attachment_id", "file_name")
    first = top_k(copies, ["url", "user_id"], [F.col("attachment_id")], 3, "visual_rank")
    shown = first.select(
        F.struct("url", "user_id").alias("request_id"), "attachment_id", "visual_rank",
        F.lit("").alias("caption"), F.col("file_name").alias("source_name"),
    )
    return ev.stable_visuals(shown).select("request_id.*", "attachment_id", "stable_id")


@query(
    "K6",
    sql=f"""
    WITH RECURSIVE {t.CHUNKS_SQL}, {t.QUESTIONS_SQL}, r AS (
      SELECT q.plan_id, c.vector_id, row_number() OVER (PARTITION BY q.plan_id
        ORDER BY c.chunk_index, c.vector_id) AS document_rank
      FROM questions q JOIN chunks c ON lower(c.source_name) = q.target)
    SELECT plan_id, vector_id, document_rank::INTEGER AS document_rank,
      1.0::DOUBLE AS final_score, true AS whole_document_match FROM r WHERE document_rank <= 60""",
)
def whole_documents(spark, folder):
    """The first 60 chunks of the source a question names."""
    found = pr.whole_documents(
        queries_of(spark, folder), t.chunks(spark, folder), pr.WHOLE_DOCUMENT_CAP
    )
    return found.select(
        "plan_id", "vector_id", "document_rank", "final_score", "whole_document_match"
    )


NEXT_ROUND_SQL = prefixed(
    f"""{LEXICAL_SQL}, {dense_sql(False)}, {FUSED_SQL}, {SPREAD_SQL},
    {COVERAGE_SQL.format(pool="spread")}, {diverse_sql(5)}, {signals_sql(5, False)}""",
    "next",
    "questions",
)


@query(
    "C7",
    "U3",
    sql=f"""
    WITH RECURSIVE {ranked_sql()}, {QUALITY_SQL},
    next_questions AS (
      SELECT plan_id, request_id, entity, session_id, NULL::VARCHAR AS target,
        array_to_string({sc.WORDS_SQL.format("query_text")}, ' ') AS query_text
      FROM questions LEFT JOIN quality USING (plan_id)
      WHERE top_score IS NULL OR top_score <= 0.8),
    {NEXT_ROUND_SQL}
    SELECT plan_id, 1 AS iteration, vector_id, round(final_score, 6) AS final_score FROM ranked
    UNION ALL
    SELECT plan_id, 2, vector_id, round(final_score, 6) FROM next_ranked""",
)
def iterated_retrieval(spark, folder):
    """Two rounds with the rule that refines a question to its content words."""
    found = pr.iterate_retrieval(queries_of(spark, folder), embedded_chunks(spark, folder))
    return found.select(
        "plan_id", "iteration", "vector_id", F.round("final_score", 6).alias("final_score")
    )


# --- routing and dispatch.


def routed_requests(spark, folder):
    raw = sc.raw_answers(spark, folder)
    files = (
        t.uploads(spark, folder)
        .groupBy("session_id")
        .agg(F.min_by("file_name", "doc_id").alias("file"))
    )
    requests = raw.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.col("conv_id").alias("session_id"),
        "question",
        F.col("raw").alias("raw_routing"),
        F.col("turn"),
    ).join(files, "session_id", "left")
    uploads = F.when(F.col("file").isNotNull(), F.array("file")).otherwise(
        F.array().cast("array<string>")
    )
    lead = F.when(F.col("turn") == 2, "what files ").when(F.col("turn") == 5, "who are you ")
    return ro.routed(
        requests.withColumn("uploads", uploads).withColumn(
            "question", F.concat(F.coalesce(lead, F.lit("")), F.col("question"))
        )
    )


ROUTED_SQL = rf"""files_of AS (
  SELECT session_id, arg_min(file_name, doc_id) AS file FROM uploads GROUP BY 1),
asked AS (
  SELECT conv_id * 1000 + turn AS request_id, conv_id AS session_id, turn, f.file,
    CASE turn WHEN 2 THEN 'what files ' WHEN 5 THEN 'who are you ' ELSE '' END || text AS question,
    regexp_split_to_array(text, '\s+') AS w
  FROM conversations c LEFT JOIN files_of f ON f.session_id = c.conv_id),
cleaned AS (
  SELECT *, regexp_replace(lower(question), {sc.TRIM}) AS clean FROM asked),
planned AS (
  SELECT request_id, session_id, turn, file, question, clean,
    turn IN (2, 5) AS fast, turn = 6 AS broken,
    CASE WHEN turn IN (2, 5, 6) THEN 1 ELSE turn % 3 + 1 END AS n,
    CASE WHEN turn NOT IN (2, 5, 6) AND (turn % 3 = 0 OR turn % 3 + 1 > 1) THEN 'STATIC'
         ELSE 'DIRECT' END AS execution,
    turn % 5 = 4 AS about, w
  FROM cleaned),
plans AS (
  SELECT request_id, session_id, file, unnest(range(n))::INTEGER AS plan_pos, execution,
    CASE WHEN execution = 'STATIC' AND turn % 2 = 0 THEN 'UNION' ELSE 'NONE' END AS merge_op,
    CASE WHEN turn = 2 THEN 'SESSION_INFO' WHEN turn = 5 THEN 'BOT_QA'
         WHEN broken THEN 'Fallback Plan' WHEN about THEN 'BOT_QA' ELSE 'find' END AS purpose,
    CASE WHEN fast THEN clean
         WHEN broken THEN CASE WHEN regexp_matches(question, '\S') THEN question ELSE clean END
         WHEN regexp_matches(array_to_string(w, ' '), '\S') THEN array_to_string(w, ' ')
         ELSE clean END AS optimized_query,
    CASE WHEN fast OR broken THEN '' ELSE array_to_string(list_transform(w, lambda x: x || '.pdf'), ',') END AS targets,
    CASE WHEN fast OR (about AND NOT broken) THEN 'WHOLE_DOCUMENT' ELSE 'RANKED_RETRIEVAL' END AS mode,
    CASE WHEN fast OR (about AND NOT broken) THEN 'NONE'
         WHEN file IS NOT NULL AND regexp_matches(clean,
           '\A[^\n\r]*\b(this|that|the|given|uploaded|attached|above|provided)\b[^\n\r]*\z')
           THEN 'SPECIFIC_DOC'
         ELSE 'CORPUS' END AS scope
  FROM planned)"""


@query(
    "P12",
    "P10",
    sql=f"""
    WITH {t.UPLOADS_SQL}, {ROUTED_SQL}
    SELECT request_id, plan_pos, execution, merge_op, purpose, optimized_query, targets, mode, scope
    FROM plans""",
)
def normalized_plans(spark, folder):
    """Plans of every message from its raw routing answer."""
    plans = ro.plans_of(routed_requests(spark, folder))
    return plans.select(
        "request_id", "plan_pos", "execution", "merge_op", "purpose", "optimized_query",
        F.array_join("target_documents", ",").alias("targets"), "mode", "scope",
    )


DISPATCH_SQL = rf"""dispatched AS (
  SELECT *, CASE WHEN scope = 'NONE' AND purpose = 'BOT_QA' THEN 'GENERAL'
      WHEN scope = 'NONE' AND purpose = 'SESSION_INFO' THEN 'SESSION_INFO'
      WHEN execution = 'DIRECT' AND (scope = 'SPECIFIC_DOC' OR session_id % 4 = 1)
        AND (targets <> '' OR file IS NOT NULL) THEN 'DOCUMENT'
      ELSE 'SEARCH' END AS route,
    CASE WHEN targets <> '' THEN targets ELSE coalesce(file, '') END AS document
  FROM plans WHERE plan_pos = 0)"""


def asking_sessions(routed):
    """Sessions of the messages; every fourth is still indexing."""
    return routed.groupBy("session_id").agg(F.first("uploads").alias("uploads")).select(
        "session_id",
        "uploads",
        F.get("uploads", F.lit(0)).alias("active_document"),
        (F.col("session_id") % 4 == 1).alias("still_indexing"),
    )


def dispatched_requests(spark, folder):
    routed = routed_requests(spark, folder)
    first = ro.plans_of(routed).filter("plan_pos = 0")
    return ro.dispatch(first, asking_sessions(routed))


@query(
    "C11",
    sql=f"""
    WITH {t.UPLOADS_SQL}, {ROUTED_SQL}, {DISPATCH_SQL}
    SELECT request_id, route, document FROM dispatched""",
)
def dispatched_routes(spark, folder):
    """The route of every message; every fourth session is still indexing."""
    return dispatched_requests(spark, folder).select(
        "request_id", "route", F.array_join("documents", ",").alias("document")
    )


@query(
    "C11",
    "K6",
    sql=f"""
    WITH RECURSIVE {t.CHUNKS_SQL}, {ROUTED_SQL}, {DISPATCH_SQL}
    SELECT d.request_id, c.vector_id FROM dispatched d JOIN chunks c
      ON c.source_name = trim(lower(replace(replace(regexp_replace(d.document, '\\.[^.]+$', ''),
        '_', ' '), '-', ' ')))
    WHERE d.route = 'DOCUMENT'""",
)
def direct_documents(spark, folder):
    """Every chunk of the documents that messages read directly."""
    found = ro.direct_documents(
        dispatched_requests(spark, folder).withColumn("plan_id", F.col("request_id")),
        t.chunks(spark, folder),
    )
    return found.select(F.col("plan_id").alias("request_id"), "vector_id")


@query(
    "C11",
    sql=f"""
    WITH {t.UPLOADS_SQL}, {ROUTED_SQL}, {DISPATCH_SQL}
    SELECT request_id, route, CASE route WHEN 'GENERAL' THEN ''
      ELSE 'SESSION_INFO:' || chr(10) || 'Active session documents uploaded by the user:' || chr(10)
        || coalesce(file, 'No active documents in this session.') END AS context
    FROM dispatched WHERE route IN ('GENERAL', 'SESSION_INFO')""",
)
def fixed_contexts(spark, folder):
    return ro.fixed_contexts(dispatched_requests(spark, folder))


# --- citations and context blocks, over every upload as evidence.


CITED_SQL = (
    ag.SCORED_SQL
    + """,
cited AS (
  SELECT e.*, row_number() OVER (PARTITION BY e.request_id
    ORDER BY r.source_first, e.position) AS citation_no
  FROM evidence e JOIN relevant r USING (request_id, source_name))"""
)


@query(
    "C10",
    "P23",
    sql=f"""
    WITH {CITED_SQL}
    SELECT request_id, citation_no, source_name AS "sourceName", substr(content, 1, 200) || '…' AS excerpt,
      floor(CASE WHEN final_score = 0 THEN semantic_score ELSE final_score END
        * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS score,
      image_url IS NOT NULL AS "isImage", source_url AS url
    FROM cited""",
)
def citations(spark, folder):
    """Citations of every session's uploads."""
    cited = ev.citations(ag.upload_evidence(spark, folder))
    return cited.select(
        "request_id", "citation_no", "sourceName", "excerpt", "score", "isImage", "url"
    )


@query(
    "C10",
    sql=f"""
    WITH {CITED_SQL}
    SELECT request_id, (citation_no - 1) // 60 AS list_no, count(*) AS citations,
      min(citation_no) AS first_no
    FROM cited GROUP BY ALL""",
)
def citation_lists(spark, folder):
    """JSON lists of up to sixty citations, read back."""
    lists = ev.citation_lists(ev.citations(ag.upload_evidence(spark, folder)))
    entries = F.from_json("citations_json", ev.CITATION_SCHEMA)
    return lists.select(
        "request_id",
        "list_no",
        F.size(entries).cast("bigint").alias("citations"),
        (F.col("list_no") * 60 + 1).alias("first_no"),
    )


@query(
    "J8",
    sql=f"""
    WITH {CITED_SQL}, {sc.MARKED_SQL}, g AS (
      SELECT message_id, unnest(regexp_extract_all(
        regexp_replace(content, '(?s)```.*?```', ' ', 'g'),
        '(?i)\\[CITE:\\s*([\\d,\\s]+)\\]', 1)) AS ids FROM marked),
    n AS (SELECT message_id, trim(unnest(string_split(ids, ',')))::BIGINT AS cited_no FROM g)
    SELECT n.message_id, n.cited_no, c.source_name AS "sourceName"
    FROM n JOIN cited c ON c.request_id = n.message_id // 1000 AND c.citation_no = n.cited_no""",
)
def resolved_citations(spark, folder):
    """The source behind every marker; a session's uploads are the list of its messages."""
    cited = ev.citations(ag.upload_evidence(spark, folder)).select(
        "request_id", "citation_no", "sourceName"
    )
    markers = ev.citation_markers(sc.marked_messages(spark, folder), "message_id", "content")
    keyed = markers.withColumn("request_id", F.floor(F.col("message_id") / 1000))
    return ev.resolve_citations(keyed, cited, "request_id").drop("request_id")


@query(
    "C9",
    "A12",
    sql=f"""
    WITH {ag.SCORED_SQL}, placed AS (
      SELECT *, coalesce(purpose, 'General Retrieval') AS part,
        CASE WHEN merge_op = 'COMPARE' THEN min(position) OVER (PARTITION BY request_id,
          coalesce(purpose, 'General Retrieval')) END AS group_first
      FROM evidence),
    ranked AS (
      SELECT request_id, source_name, content,
        row_number() OVER (PARTITION BY request_id ORDER BY position) AS no
      FROM evidence WHERE source_type = 'IMAGE'),
    shown AS (
      SELECT request_id, no, CASE WHEN no = 1 THEN '=== Visual Evidence ===' || chr(10) ELSE '' END
        || 'Image ' || no || ' (shown above)' || chr(10) || 'Display Title: '
        || CASE WHEN regexp_matches(content, '^[^\n]*[]]') OR NOT contains(content, chr(10))
          THEN upper(substr(source_name, 1, 1)) || substr(source_name, 2)
          ELSE 'Image from ' || source_name END || chr(10)
        || 'Details: [Summary: This image of ' || source_name || '. ' || content || ']'
        || chr(10) || chr(10) AS block
      FROM ranked WHERE no <= 3),
    shifts AS (SELECT request_id, count(*) AS shift FROM shown GROUP BY 1),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY request_id
        ORDER BY coalesce(group_first, 0), position) AS no FROM placed),
    texts AS (
      SELECT request_id, no + coalesce(shift, 0) AS place,
        CASE WHEN no = 1 THEN '=== Text Evidence ===' || chr(10) ELSE '' END
        || CASE WHEN position = group_first THEN '--- Evidence for: ' || part || ' ---' || chr(10)
                ELSE '' END
        || '<CITATION id="' || no || '">' || chr(10) || 'Source: ' || source_name || ' | Type: '
        || source_type || chr(10) || content || chr(10) || '</CITATION>' || chr(10) || chr(10)
          AS block FROM numbered LEFT JOIN shifts USING (request_id)),
    blocks AS (
      SELECT request_id, place, (place - 1) // 60 AS segment_no, block FROM texts
      UNION ALL SELECT request_id, no, 0, block FROM shown),
    joined AS (
      SELECT request_id, segment_no, string_agg(block, '' ORDER BY place) AS text
      FROM blocks GROUP BY request_id, segment_no),
    marked AS (
      SELECT *, segment_no = max(segment_no) OVER (PARTITION BY request_id) AS is_last FROM joined)
    SELECT request_id, segment_no,
      md5(CASE WHEN is_last THEN regexp_replace(text, '\\s+$', '') ELSE text END) AS digest
    FROM marked
    UNION ALL
    SELECT conv_id, 0, md5('No relevant evidence found.')
    FROM (SELECT DISTINCT conv_id FROM conversations)
    WHERE conv_id NOT IN (SELECT request_id FROM evidence)""",
)
def context_blocks(spark, folder):
    """Context of every session from its uploads, its first three images shown; sessions without any say so."""
    evidence = ag.upload_evidence(spark, folder)
    requests = (
        t.sessions(spark, folder)
        .select(F.col("session_id").alias("request_id"))
        .unionByName(evidence.select("request_id"))
        .distinct()
    )
    images = evidence.filter("source_type = 'IMAGE'")
    caption = F.concat(F.lit("[Summary: This image of "), "source_name", F.lit(". "), "content", F.lit("]"))
    first = top_k(images, ["request_id"], [F.col("position")], 3, "visual_rank")
    shown = first.select("request_id", "visual_rank", caption.alias("caption"), "source_name")
    text = ev.context_blocks(requests, evidence, ev.stable_visuals(shown))
    return text.select("request_id", "segment_no", F.md5("text").alias("digest"))


@query("C11", "C9", "C5", "C12", "P26")
def question_prompts(spark, folder):
    """Every message from its raw routing answer to its prompt, over the chunks of all documents."""
    routed = routed_requests(spark, folder)
    requests = materialize(
        routed.select("request_id", "session_id", "question", "raw_routing", "uploads"), "requests"
    )
    contexts = an.question_contexts(
        requests, asking_sessions(requests), embedded_chunks(spark, folder)
    )
    contexts = materialize(contexts, "contexts")
    prompts = an.question_prompts(contexts, requests)
    return prompts.join(contexts.select("request_id", "segment_no", "route"), ["request_id", "segment_no"])
