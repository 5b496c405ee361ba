"""Vector codes, fingerprints and source divergence against plain versions."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from loomlight.llm import minhash
from loomlight.llm.minhash import compare_neighbours, similar_classes, text_signatures
from loomlight.llm.perfect_hash import PerfectHash
from loomlight.llm.queries import OP13_SQL
from loomlight.llm.source_divergence import divergence
from loomlight.llm.vector_codes import compress_vectors, with_label_error

from . import brute

duckdb = pytest.importorskip("duckdb")


def lloyd(rows, parts=4, entries=256, rounds=4):
    """(row number -> (code, error), books) in plain integers; rows are (id, vector)."""
    kept = [(k, i, v) for k, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for *_, v in kept), default=0) // parts)
    ints = [(k, i, [min(max(math.floor(1024 * x), -(1 << 25)), 1 << 25) for x in v]) for k, i, v in kept]
    ints = [(k, i, v + [0] * (parts * width - len(v))) for k, i, v in ints]
    ints.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    cut = [(k, [v[p * width : (p + 1) * width] for p in range(parts)]) for k, _, v in ints]
    books = [[part[p] for _, part in cut[:entries]] for p in range(parts)]

    def assign():
        out = {}
        for k, part in cut:
            out[k] = [min((sum((a - b) ** 2 for a, b in zip(part[p], e, strict=True)), n) for n, e in enumerate(books[p])) for p in range(parts)]
        return out

    for _ in range(rounds):
        best = assign()
        for p in range(parts):
            for n in range(len(books[p])):
                own = [part[p] for k, part in cut if best[k][p][1] == n]
                if own:
                    books[p][n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    final = assign()
    return {k: ("".join(f"{n:02x}" for _, n in b), sum(d for d, _ in b)) for k, b in final.items()}, books


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], i % 3 if i % 5 else None) for i in range(300)]
    rows += [(400 + i, rows[7][1], 1) for i in range(60)]  # a hot vector
    rows += [(7, rows[7][1], 2), (7, rows[9][1], 2), (None, [0.5] * 8, None)]
    rows += [(500, None, 1), (501, [None] + [0.1] * 7, 1), (502, [math.nan] + [0.1] * 7, 1), (503, [math.inf] + [0.0] * 7, 1)]
    rows += [(504, [1e30] + [0.0] * 7, 1), (505, [0.25] * 5, 2), (506, [], 2)]
    return rows


def test_vector_codes(spark, vectors):
    rows = [(i, v, label, "x", k) for k, (i, v, label) in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, row string, part int")
    for entries, rounds in ((256, 4), (5, 3)):
        coded, books = compress_vectors(frame, "embedding", "vec_id", "label", entries=entries, rounds=rounds)
        want, plain = lloyd([(i, v) for i, v, *_ in rows], entries=entries, rounds=rounds)
        got = sorted((str(r.id), str(r.label), r.code, r.error) for r in coded.collect())
        assert got == sorted((str(rows[k][0]), str(rows[k][2]), *w) for k, w in want.items())
        assert [b.tolist() for b in books.books] == plain
        text = ",".join(str(x) for b in plain for e in b for x in e)
        assert books.sha256() == hashlib.sha256(text.encode()).hexdigest()
    sums = {}
    for k, (_, error) in want.items():
        sums[rows[k][2]] = sums.get(rows[k][2], 0) + error
    assert all(r.label_error == sums[r.label] for r in with_label_error(coded).collect())


def test_vector_codes_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")
    coded, books = compress_vectors(none, "embedding", "vec_id")
    assert coded.collect() == [] and books.sha256() == hashlib.sha256(b"").hexdigest()
    assert with_label_error(coded).collect() == []


def test_perfect_hash_knows_its_keys():
    keys = [f"t{i}é" for i in range(5000)]
    table = PerfectHash(pa.array(keys))
    slots = table.slots(pa.array(keys))
    assert sorted(slots) == list(range(5000)) and table.keys.take(pa.array(slots)).to_pylist() == keys
    assert (table.slots(pa.array([f"u{i}" for i in range(5000)])) == -1).all()
    assert len(PerfectHash(pa.array([], pa.string()))) == 0


def test_divergence_by_sql(spark, messy):
    rng = random.Random(8)
    rows = [tuple(r) for r in messy.select("doc_id", "text", "lang", "source").collect()]
    words = "the The é漢 it's a1b x_y\x00z ÀÉ ﬁ 😀b".split(" ")
    for i in range(60):
        rows.append((1000 + i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["xx", "yy", None, ""]), rng.choice("abcd") if i % 7 else None))
    rows += [(2000, "only here", "zz", "a"), (2001, None, "zz", "b")]  # a language without terms
    rows += [(3000 + i, "the the é", "yy", f"many{i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 as rank", "'v' as value")
    db = duckdb.connect()
    db.register("documents", frame.toArrow())
    want = sorted(db.sql(OP13_SQL).select("lang, source, part, item, value, rank").fetchall())
    assert {w[2] for w in want} == {"pair", "term"}
    assert sorted(tuple(r) for r in divergence(frame).collect()) == want
    # Many shards, blocks and rounds say the same.
    from loomlight.llm import source_divergence as sd

    before = sd.ROUND_BYTES, sd.BLOCK_TERMS, sd.BLOCK_SOURCES
    try:
        sd.ROUND_BYTES, sd.BLOCK_TERMS, sd.BLOCK_SOURCES = 4000, 7, 5
        assert sorted(tuple(r) for r in divergence(frame, shard_terms=10).collect()) == want
    finally:
        sd.ROUND_BYTES, sd.BLOCK_TERMS, sd.BLOCK_SOURCES = before
    assert divergence(frame.limit(0)).collect() == []


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_neighbours(spark, messy, empty):
    rows = [(r.doc_id, r.text or "") for r in messy.collect()]
    hashes = {r.text: r.h for r in messy.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = []
    for k, (i, text) in enumerate(order):
        after = order[k - 1][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sets = [brute.shingles(t, 5) for t in (text, edited, after)]
        want.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(*sets[:2]), jaccard(sets[0], sets[2])))
    got = compare_neighbours(messy).collect()
    assert sorted((str(r.id), r.n_chars, r.edited_sha256) for r in got) == sorted(w[:3] for w in want)
    truth = {w[:3]: w[3:] for w in want}
    for r in got:
        near = truth[str(r.id), r.n_chars, r.edited_sha256]
        assert abs(r.near_edited - near[0]) < 0.2 and abs(r.near_next - near[1]) < 0.2
    texts = {}
    for r in got:
        texts.setdefault((str(r.id), r.n_chars), set()).add(r.fingerprint)
    assert compare_neighbours(empty).collect() == []
    one = compare_neighbours(spark.createDataFrame([("k", "a b c")], "doc_id string, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"a ba ").hexdigest() and one[0].near_next == 1.0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        a = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        b = list(a)
        b[: rng.integers(0, 400)] = [f"v{x}" for x in rng.integers(0, 10**6, 100)]
        ta, tb = " ".join(a), " ".join(b)
        s = text_signatures(pa.array([ta, tb]))
        errors.append(minhash.likeness(s[:1], s[1:])[0] - jaccard(brute.shingles(ta, 5), brute.shingles(tb, 5)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_similar_classes(spark, messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    got = sorted((str(r.id), str(r.class_id)) for r in similar_classes(messy).collect())
    want = brute.components(rows, 5, 80)
    alone = [i if not brute.shingles(t, 5) else c for (i, t), c in zip(rows, want, strict=True)]
    assert got == sorted((str(i), str(c)) for (i, _), c in zip(rows, alone, strict=True))
    assert similar_classes(empty).collect() == []


def test_similar_classes_in_slices(spark, monkeypatch):
    """Chains of near copies whose ends are unlike each other."""
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    monkeypatch.setattr(minhash, "SLICE", 8)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(60):
        rows.append((i, " ".join(base)))
        base[(2 * i) % 120] = rng.choice(words)
    rows += [(100 + i, " ".join(rng.choices(words, k=40))) for i in range(10)]
    got = {r.id: r.class_id for r in similar_classes(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute.components(rows, 5, 80)
