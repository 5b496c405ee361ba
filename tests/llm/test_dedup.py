"""Substring, suffix-array and n-gram Jaccard operators against brute force."""

from collections import Counter

import numpy as np
import pytest

from loomlight.llm.graph import components
from loomlight.llm.jaccard_join import PrefixTree, keep_one_per_group, similarity_classes
from loomlight.llm.substring_dedup import deep_nodes, remove_repeated_words
from loomlight.llm.suffix_array_dedup import remove_repeated_bytes

from . import brute


@pytest.mark.parametrize(("window", "prefix", "limit"), [(35, 8, 1000), (12, 3, 2), (5, 5, 1)])
def test_repeated_words(messy, window, prefix, limit):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    sequences = [brute.words(t) for _, t in rows]
    want = Counter()
    for (name, _), s, mark in zip(rows, sequences, brute.repeated_units(sequences, window), strict=True):
        want[name, len(s), sum(mark), b" ".join(w for w, m in zip(s, mark, strict=True) if not m).decode()] += 1
    got = remove_repeated_words(messy, window=window, prefix=prefix, group_limit=limit)
    assert got.columns == ["doc_id", "text", "lang", "source", "k1", "row", "n_words", "n_removed", "removed_spans"]
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()) == want


@pytest.mark.parametrize(("window", "q", "limit"), [(400, 32, 1000), (60, 8, 2), (20, 20, 1)])
def test_repeated_bytes(messy, window, q, limit):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    sequences = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (name, _), s, mark in zip(rows, sequences, brute.repeated_units(sequences, window), strict=True):
        runs = sum(m and (i == 0 or not mark[i - 1]) for i, m in enumerate(mark))
        want[name, len(s), sum(mark), runs, bytes(b for b, m in zip(s, mark, strict=True) if not m)] += 1
    got = remove_repeated_bytes(messy, window=window, q=q, group_limit=limit).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.removed_spans), bytes(r.kept_bytes)) for r in got) == want


@pytest.mark.parametrize(("size", "percent", "limit"), [(4, 85, 4000), (5, 80, 4), (2, 50, 3)])
def test_similarity_classes(messy, size, percent, limit):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    want = Counter(
        (name, len(brute.shingles(text, size)), component)
        for (name, text), component in zip(rows, brute.components(rows, size, percent), strict=True)
    )
    got = similarity_classes(messy, size=size, percent=percent, block_limit=limit).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == want


def test_one_per_group(messy):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    kept = keep_one_per_group(messy, size=5, percent=80)
    assert kept.columns == messy.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    groups = brute.components(rows, 5, 80)
    worded = {g for (_, text), g in zip(rows, groups, strict=True) if brute.words(text)}
    # The long texts of one id are two groups that share the least id.
    assert worded <= {name for name, _ in found}
    assert len(found) == len(set(found))
    assert {None, "", " \t\n "} <= {text for _, text in found}


def test_empty(empty):
    assert remove_repeated_words(empty).count() == 0
    assert remove_repeated_bytes(empty).count() == 0
    assert similarity_classes(empty).count() == 0
    assert keep_one_per_group(empty).count() == 0


def test_layout_of_untouched_texts(messy):
    before = {r.doc_id: r.text for r in messy.collect()}
    for r in remove_repeated_words(messy, keep_layout=True).filter("n_removed = 0 and doc_id not in (2, 3)").collect():
        assert r.doc_id is None or r.text == before[r.doc_id]


def test_deep_nodes():
    first, last = deep_nodes(np.array([3, 9, 9, 2, 8]), 8)
    assert (first.tolist(), last.tolist()) == ([1, 4], [3, 5])


def test_prefix_tree_finds_all_partners():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(30, rng.integers(1, 12), replace=False)) for _ in range(80)]
    tree = PrefixTree(sets)
    none = np.zeros(len(sets), bool)
    for member in sets:
        got = {tree.order[p] for p in tree.partners(member, none, 60)}
        want = {
            i for i, s in enumerate(sets) if 100 * len(set(s) & set(member)) >= 60 * len(set(s) | set(member))
        }
        assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
