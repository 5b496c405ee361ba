"""What the review of round 4 found."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomlight.operators import cover, lexical, postings


def cover_brute(words, terms):
    spans = {(a, b) for a in range(len(words)) for b in range(a, len(words)) if set(terms) <= set(words[a : b + 1])}
    minimal = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return round(sum(0.1 / (1 + b - a + 1 - sum(w in terms for w in words[a : b + 1])) for a, b in sorted(minimal, key=lambda s: s[1])), 9)


def scored(sets, texts):
    """{(set, chunk): density} of all matches in a slice."""
    occurrences = cover.from_words(pa.array([t.split() for t in texts], pa.list_(pa.string())), sets.terms)
    part = cover._Slice(len(texts), len(sets.terms), *occurrences)
    found = [m for batch in cover._matches(sets, part) for m in zip(*(c.tolist() for c in batch))]
    assert len(found) == len({m[:2] for m in found})
    return {(int(sets.numbers[s]), c): d for s, c, d in found}


@pytest.mark.parametrize("few", [0, 8])
def test_matches_of_few_terms_are_scored_in_columns(monkeypatch, few):
    rng = random.Random(3)
    monkeypatch.setattr(cover, "FEW", few)
    monkeypatch.setattr(cover, "BLOCK", 50)
    general = cover._Slice._covers

    def counted(self, pairs, counts):
        assert not len(pairs) or pairs.shape[1] > 3 or counts.max() > cover.WIDTHS[-1] or self.place.max() >= cover.MOST_PLACE
        return general(self, pairs, counts)

    monkeypatch.setattr(cover._Slice, "_covers", counted)
    asked = [list(t) for t in ("a", "ab", "ba", "abc", "cde", "abcd", "z", "az", "bcf", "aef")]
    sets = cover.TermSets(pa.array(range(10, 20)), pa.array(asked))
    for letters, longest in (("abcdefgh", 14), ("aaaabcdef", 40), ("abcdefghijklm", 30)):
        texts = [" ".join(rng.choices(letters, k=rng.randint(0, longest))) for _ in range(150)]
        # More places than columns, and a place beyond 16 bits of a key.
        texts += ["a " * 17 + "b c", "b " + "x " * 1_500 + "a c"][: rng.randint(0, 2)]
        want = {
            (10 + i, n): cover_brute(t.split(), terms)
            for i, terms in enumerate(asked)
            for n, t in enumerate(texts)
            if set(terms) <= set(t.split()) and len(t) < 1_000
        }
        got = scored(sets, texts)
        assert want and {k: d for k, d in got.items() if len(texts[k[1]]) < 1_000} == pytest.approx(want, abs=1.1e-9)


def test_leaders_go_by_id_when_ids_do_not_ascend(monkeypatch):
    monkeypatch.setattr(cover, "HELD", 20)
    rng = random.Random(4)
    for ids in ([f"c{i:03d}" for i in range(200)], [f"c{i * 7 % 200:03d}" for i in range(200)]):
        best, rows = cover._Leaders(3, 4), []
        for at in range(0, 200, 25):
            best.name(pa.array(ids[at : at + 25]))
            for owner in range(3):
                held = [i for i in range(at, at + 25) if rng.random() < 0.6]
                density = [rng.choice([0.1, 0.05, 0.2]) for _ in held]
                best.add(np.full(len(held), owner), np.array(held, int), np.array(density))
                rows += [(owner, -d, ids[i]) for d, i in zip(density, held)]
        assert best.ascending == (ids == sorted(ids))
        want = [r for o in range(3) for r in sorted(x for x in rows if x[0] == o)[:4]]
        owner, names, density = best.best()
        assert sorted(zip(owner.tolist(), (-density).tolist(), names.to_pylist())) == sorted(want)


def test_an_index_is_written_where_it_is_made(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = [(f"{hashlib.sha256(b'%d' % (i // 4)).hexdigest()}-{i % 4:06d}", " ".join(rng.choices(words, k=40))) for i in range(200)]
    chunks = spark.createDataFrame(rows, "vector_id string, content string").coalesce(1)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    postings.add_postings(chunks, str(tmp_path), 0)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    folders = list(tmp_path.glob("postings/data/*/_bucket=*"))
    files = [f for folder in folders for f in folder.glob("*.parquet")]
    # Rows that are not shuffled leave a file per task and bucket, and stay chunk by chunk.
    assert 1 < len(folders) == len(files)
    held = [pq.ParquetFile(f).read(columns=["chunk_id"]).column(0).to_pylist() for f in files]
    assert sum(map(len, held)) == sum(len(set(text.split())) for _, text in rows)
    for ids in held:
        assert sum(a != b for a, b in zip(ids, ids[1:])) == len(set(ids)) - 1


@pytest.mark.parametrize("most", [100, 7])
def test_sets_come_in_rounds_by_their_number(spark, monkeypatch, most):
    """Long questions share a round as far as their terms go, many short ones as far as the held chunks go."""
    monkeypatch.setattr(cover, "NUMBERED_SETS", 5)
    monkeypatch.setattr(cover, "MOST_SETS", most)
    rounds = []
    general = cover._scored
    monkeypatch.setattr(cover, "_scored", lambda rows, sets, read, k: rounds.append(rows.schema["chunk"].dataType.simpleString()) or general(rows, sets, read, k))
    rng = random.Random(9)
    texts = {f"c{i * 7 % 90:02d}": " ".join(rng.choices("abcdefg", k=rng.randint(0, 12))) for i in range(90)}
    chunks = spark.createDataFrame(list(texts.items()), "vector_id string, content string").repartition(5)
    asked = {i: " ".join(rng.sample("abcdefg", 3)) for i in range(20)}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    got = {(r.query_id, r.rank): (r.vector_id, r.density) for r in lexical.keyword_matches(queries, chunks, 3).collect()}
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost
    want = {}
    for i, question in asked.items():
        held = sorted((-cover_brute(t.split(), question.split()), c) for c, t in texts.items() if set(question.split()) <= set(t.split()))
        want |= {(i, n): (c, -s) for n, (s, c) in enumerate(held[:3], 1)}
    assert got == want
    sets = len({frozenset(q.split()) for q in asked.values()})
    assert rounds == ["bigint"] * -(-sets // most)
