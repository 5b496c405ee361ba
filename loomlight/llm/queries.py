"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.lineage import materialize
from loomlight.llm.decontamination import find_leaks
from loomlight.llm.fixity_audit import audit, build_tree, placed_records, record_hash, warc_records
from loomlight.llm.jaccard_join import similarity_classes
from loomlight.llm.language_id import identify_languages, remainder
from loomlight.llm.minhash import compare_neighbours
from loomlight.llm.page_text import extract_text
from loomlight.llm.quality_rules import judge_quality
from loomlight.llm.rows import documents
from loomlight.llm.source_divergence import divergence
from loomlight.llm.source_mixing import mix_sources
from loomlight.llm.substring_dedup import remove_repeated_words
from loomlight.llm.suffix_scoring import score_texts
from loomlight.llm.suffix_array_dedup import remove_repeated_bytes
from loomlight.llm.vector_codes import compress_vectors, with_label_error


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    return identify_languages(docs, F.coalesce(~held_out, F.lit(False))).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages"
    )


def op2_merkle_fixity_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as WARC records against a replica with known damage.

    Every 97th record has its letter e flipped to 3, every 193rd is lost.
    """
    docs = documents(spark, folder).select("doc_id", "text")
    records = warc_records(docs)
    # One pass hashes the records of both replicas; texts are not shuffled.
    number = F.col("n")
    damaged = F.when(F.pmod(number, F.lit(97)) == 13, F.translate("payload", "e", "3")).otherwise(F.col("payload"))
    size = F.octet_length("header") + F.octet_length("payload") + 4
    hashed = records.select(
        "file", "n", "record_id", size.cast("long").alias("size"),
        record_hash(F.col("header"), F.col("payload")).alias("hash"),
        record_hash(F.col("header"), damaged).alias("damaged"),
    )
    placed = materialize(placed_records(hashed), "records")
    first = build_tree(placed.drop("damaged"))
    replica = placed.filter(F.pmod(number, F.lit(193)) != 7)
    second = build_tree(replica.drop("hash").withColumnRenamed("damaged", "hash"))
    return audit(first, second)


OP2_SQL = """
with records as (
  select doc_id, doc_id >> 11 as file,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: ' || case when text is null then 'metadata' else 'resource' end
      || chr(13) || chr(10) || 'WARC-Record-ID: <urn:doc:' || doc_id || '>' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(coalesce(text, '')) || chr(13) || chr(10) || chr(13) || chr(10) as header,
    coalesce(text, '') as payload
  from documents
), placed as (
  select *, coalesce(sum(strlen(header) + strlen(payload) + 4) over (
      partition by file order by doc_id rows between unbounded preceding and 1 preceding), 0) as start_at
  from records
)
select file, cast(start_at as bigint) as "offset", cast(doc_id as varchar) as record_id,
  case when doc_id % 193 = 7 then 'missing' else 'altered' end as finding,
  sha256(header || payload) as first_hash,
  case when doc_id % 193 <> 7 then sha256(header || replace(payload, 'e', '3')) end as second_hash
from placed
where doc_id % 193 = 7 or (doc_id % 97 = 13 and contains(payload, 'e'))
"""


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeated_words(documents(spark, folder).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_suffix_tree_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    scored = score_texts(docs, ~held_out)
    return scored.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(documents(spark, folder).select("doc_id", "text", "source"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "epochs")


def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    classes = similarity_classes(documents(spark, folder).select("doc_id", "text"))
    return classes.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeated_bytes(documents(spark, folder).select("doc_id", "text"))
    return kept.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = find_leaks(documents(spark, folder).select("doc_id", "text"), benchmark)
    leaks = found.select("doc_id", F.explode("matches").alias("m"))
    return leaks.select("doc_id", "m.item_id", "m.distance", "m.start", "m.stop", "m.item_words")


def op9_host_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return extract_text(pages.select("page_id", "url", "html"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge_quality(documents(spark, folder).select("doc_id", "text", "lang"))
    return judged.withColumnRenamed("id", "doc_id")


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    coded, books = compress_vectors(vectors, "embedding", "vec_id", "label")
    return with_label_error(coded).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


def _op11_sql(rounds: int = 4) -> str:
    """Lloyd rounds, one after the other."""
    steps = ["book0 as (select position, n - 1 as entry, part from parts where n <= 256)"]
    for r in range(rounds + 1):
        steps.append(
            f"""near{r} as (
  select p.vec_id, p.position, min(struct_pack(d := list_sum(list_transform(list_zip(p.part, b.part),
      lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, e := b.entry)) as best
  from parts p join book{r} b using (position) group by 1, 2)"""
        )
        if r < rounds:
            steps.append(
                f"""flat{r} as (
  select position, best.e as entry, unnest(part) as x, generate_subscripts(part, 1) as i
  from near{r} join parts using (vec_id, position)),
mean{r} as (
  select position, entry, list(m order by i) as part from (
    select position, entry, i, floor(sum(x)::double / count(*))::bigint as m from flat{r} group by 1, 2, 3)
  group by 1, 2),
book{r + 1} as (
  select b.position, b.entry, coalesce(m.part, b.part) as part
  from book{r} b left join mean{r} m using (position, entry))"""
            )
    every = ",\n".join(steps)
    return f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v,
    row_number() over (order by vec_id) as n
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as (
  select vec_id, label, n, p as position, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] as part
  from kept, range(4) as r(p)
), {every},
coded as (
  select vec_id, string_agg(printf('%02x', best.e), '' order by position) as code, sum(best.d)::bigint as error
  from near{rounds} group by 1
), labelled as (
  select vec_id, label, code, error, sum(error) over (partition by label)::bigint as label_error
  from coded join kept using (vec_id)
), entries as (
  select position, entry, unnest(part) as x, generate_subscripts(part, 1) as i from book{rounds}
)
select vec_id, code, error, label_error,
  (select sha256(string_agg(x::varchar, ',' order by position, entry, i)) from entries) as codebooks_sha256
from labelled"""


def op12_minhash_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return compare_neighbours(docs).withColumnRenamed("id", "doc_id")


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(documents(spark, folder).select("text", "lang", "source"))


OP13_SQL = r"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents
), words as (
  select d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as (
  select lang, term from words group by 1, 2 having count(distinct d) >= 3
), groups as (
  select distinct lang, source from docs
), sizes as (
  select lang, count(*) as v from kept group by 1
), used as (
  select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by 1, 2, 3
), dense as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n from groups g join kept k using (lang)
    left join used u on u.lang = g.lang and u.source = g.source and u.term = k.term
), p as (
  select lang, source, term, n,
    1 + (1000000000::hugeint * (n + 1)) // (sum(n) over (partition by lang, source)::hugeint + v) as p
  from dense join sizes using (lang)
), langs as (
  select lang, term, sum(n) as n from dense group by 1, 2
), q as (
  select lang, term, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over (partition by lang)::hugeint + v) as q
  from langs join sizes using (lang)
), far as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source
), terms as (
  select lang, source, 'term' as part, term as item, ((p.p - q) * (p.p - q) // q)::bigint as value
  from p join q using (lang, term) where n > 0 and p.p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank
  from (select * from pairs union all select * from terms)
)
select * from ranked where part = 'pair' or rank <= 200"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: run for name, run in list(globals().items()) if name.startswith("op") and name[2].isdigit()
}
SQL: dict[str, str] = {
    "op2_merkle_fixity_audit": OP2_SQL,
    "op11_vector_codes": _op11_sql(),
    "op13_source_divergence": OP13_SQL,
}
