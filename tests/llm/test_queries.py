"""The registered queries over whole small tables, and the pipeline, stage by stage."""

import hashlib
import math
import re
import zlib
from collections import Counter
from html import unescape
from pathlib import Path

import pytest

import corpus_pipeline
from loomlight.lineage import materialize
from loomlight.llm.queries import QUERIES, SQL

from . import brute
from .test_mixing_and_leaks import filled, normal
from .test_text_models import reference_counts

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def result(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    return {r[0]: r for r in rows}, len(rows)


def test_op1(spark, docs):
    got, n = result(spark, "op1_language_id")
    assert n == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == docs[i].lang for i in held) >= 0.95 * len(held)


def test_op2(spark):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = duck.execute(SQL["op2_merkle_fixity_audit"]).fetchall()
    got = [tuple(r) for r in QUERIES["op2_merkle_fixity_audit"](spark, FOLDER).collect()]
    assert want and Counter(got) == Counter(want)


def test_op3(spark, docs):
    got, n = result(spark, "op3_substring_dedup")
    sequences = [brute.words(r.text) for r in docs.values()]
    for i, s, mark in zip(docs, sequences, brute.repeated_units(sequences, 35), strict=True):
        kept = b" ".join(w for w, m in zip(s, mark, strict=True) if not m)
        assert got[i][1:4] == (len(s), sum(mark), hashlib.sha256(kept).hexdigest())
    assert n == len(docs)


def test_op4(spark, docs):
    got, n = result(spark, "op4_suffix_tree_scoring")
    tokens = {i: (r.text or "").encode().translate(brute.LOWER).split() + [b"\n"] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total = sum(counts.values())
    scale = math.log10(total + 0.5 * (len(counts) + 1))
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(ws), total)
        assert r.n_known == sum(counts[w] > 0 for w in ws)
        assert math.isclose(r.base_score, sum(math.log10(counts[w] + 0.5) - scale for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert n == len(docs)


def test_op5(spark, docs):
    got, n = result(spark, "op5_source_mixing")
    size = {i: len(brute.words(r.text)) for i, r in docs.items()}
    sources = Counter()
    for i, r in docs.items():
        sources[r.source] += size[i]
    want, taken = filled(dict(sources)), Counter()
    for i, r in got.items():
        assert (r.size, r.source_size) == (size[i], sources[docs[i].source])
        assert abs(r.target - want[docs[i].source]) < 1e-6 and r.taken <= 3 * r.size
        taken[docs[i].source] += r.taken
    largest = {s: max(size[i] for i in docs if docs[i].source == s) for s in sources}
    assert n == len(docs) and all(abs(taken[s] - want[s]) <= largest[s] for s in sources)


def test_op6(spark, docs):
    got, n = result(spark, "op6_ngram_jaccard_join")
    rows = [(i, r.text) for i, r in docs.items()]
    for (i, text), component in zip(rows, brute.components(rows, 4, 85), strict=True):
        assert got[i][1:] == (len(brute.shingles(text, 4)), component)
    assert n == len(docs)


def test_op7(spark, docs):
    got, n = result(spark, "op7_suffix_array_dedup")
    sequences = [(r.text or "").encode() for r in docs.values()]
    for i, s, mark in zip(docs, sequences, brute.repeated_units(sequences, 400), strict=True):
        runs = sum(m and (j == 0 or not mark[j - 1]) for j, m in enumerate(mark))
        kept = bytes(b for b, m in zip(s, mark, strict=True) if not m)
        assert got[i][1:5] == (len(s), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    assert n == len(docs)


def leaks(spark, texts):
    items = {r.item_id: normal(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    runs = {i: {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)} for i, ws in items.items()}
    found = {}
    for d, text in texts.items():
        ws = normal(text)
        own = {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)}
        for i in items:
            if own & runs[i]:
                distance = brute.edit_distance_within(items[i], ws)
                if distance <= len(items[i]) // 5:
                    found[d, i] = distance
    return found


def test_op8(spark, docs):
    rows = QUERIES["op8_benchmark_decontamination"](spark, FOLDER).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in rows}
    want = leaks(spark, {i: r.text for i, r in docs.items()})
    assert set(got) <= set(want) and {k for k, v in want.items() if v == 0} <= set(got)
    assert len(rows) == len(got) >= 0.95 * len(want)


def test_op9(spark):
    got, n = result(spark, "op9_host_suffix_array")
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    for p in pages:
        inside = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S).group(1).replace("<b>", "").replace("</b>", "")
        blocks = [" ".join(unescape(b.replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (want, len(want))
    assert n == len(pages)


def test_op10(spark, docs):
    got, n = result(spark, "op10_quality_rules")
    for i, r in docs.items():
        g = got[i]
        counts = (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed)
        assert counts == reference_counts(r.text) and not (g.kept and g.base_failed)
    assert n == len(docs)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_source_divergence"])
def test_by_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    want = duck.sql(SQL[name]).select(", ".join(frame.columns)).fetchall()
    assert want and Counter(tuple(r) for r in frame.collect()) == Counter(want)


def test_op12(spark, docs):
    got, n = result(spark, "op12_minhash_fingerprints")
    order = sorted(docs, reverse=True)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        text, other = docs[i].text or "", docs[after].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, t in ((r.near_edited, edited), (r.near_next, other)):
            a, b = brute.shingles(text, 5), brute.shingles(t, 5)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert n == len(docs)


def test_pipeline(spark, docs):
    before = {i: r.text for i, r in docs.items()}
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = frame.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        frame = materialize(stage(spark, frame, FOLDER), "stage")
        kept.append({r.doc_id: r for r in frame.collect()})
        assert frame.columns[: len(names)] == names
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "substring_dedup", "decontamination", "source_mixing",
    ]
    spoken, unique, cut, clean, mixed = kept
    assert {i for i, t in before.items() if re.search(r"[^\W\d_]{3}", t or "")} <= set(spoken)
    rows = [(i, r.text) for i, r in spoken.items()]
    assert set(unique) == set(brute.components(rows, 5, 80))
    sequences = [brute.words(unique[i].text) for i in unique]
    for i, s, mark in zip(unique, sequences, brute.repeated_units(sequences, 35), strict=True):
        whole = b" ".join(w for w, m in zip(s, mark, strict=True) if not m).decode()
        assert cut[i].text == (whole if any(mark) else unique[i].text)
        assert cut[i].n_chars == len(cut[i].text)
    leaky = {d for d, _ in leaks(spark, {i: r.text for i, r in cut.items()})}
    assert {i: r.text for i, r in clean.items()} == {i: r.text for i, r in cut.items() if i not in leaky}
    sources = Counter()
    for r in clean.values():
        sources[r.source] += len(brute.words(r.text))
    want, taken = filled(dict(sources)), Counter()
    for i, r in mixed.items():
        assert r.text == clean[i].text and r.taken == r.epochs * len(brute.words(r.text)) > 0
        taken[r.source] += r.taken
    longest = max(len(brute.words(r.text)) for r in clean.values())
    assert all(abs(taken[s] - want[s]) <= longest for s in sources)
