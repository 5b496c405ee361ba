"""Source mixing, decontamination, page text and fixity operators."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlight.llm import decontamination, fixity_audit, page_text, source_mixing

from . import brute
from .conftest import prose


def filled(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by refilling until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(sizes)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = epochs * sizes[s]
            free.discard(s)
    return target


def test_mixture_targets(messy):
    rows = messy.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(brute.words(r.text))
    want = filled(dict(sizes))
    got = source_mixing.mix_sources(messy).collect()
    assert Counter((r.id, r.size) for r in got) == Counter((r.doc_id, len(brute.words(r.text))) for r in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.epochs * r.size and 0 <= r.epochs <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    # Complete passes come first: documents of a source differ by one at most.
    for s in sizes:
        epochs = {r.epochs for r in got if r.source == s and r.size}
        assert not epochs or max(epochs) - min(epochs) <= 1
    again = source_mixing.mix_sources(messy.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


@pytest.mark.parametrize("seed", range(3))
def test_targets_closed_form(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 50000]) for i in range(12)} | {None: 40}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in source_mixing.source_targets(frame, (5, 2, 1), 3).collect()}
    want = filled(sizes)
    assert set(got) == set(want)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mixture_rows(messy):
    docs = messy.withColumn("size", F.lit("clash"))
    mixed = source_mixing.mixture(docs)
    assert mixed.columns == [c for c in docs.columns if c != "size"] + list(source_mixing.RESULTS)
    assert mixed.filter("taken <= 0").count() == 0
    assert source_mixing.mixture(messy.limit(0)).count() == 0


def test_better_documents_come_first(spark):
    rows = [(i, "w " * 10, "s") for i in range(400)] + [(1000, "w " * 4000, "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weight = F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)
    got = source_mixing.mix_sources(docs, weights=(1, 7), quality_weight=weight).filter("source = 's'").collect()
    even = sum(r.taken for r in got if r.id % 2 == 0)
    odd = sum(r.taken for r in got if r.id % 2)
    assert 2 * odd < even


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 25, 12, 6, 3, 1, 40])] + [(7, None), (8, " ,. "), (9, None)]
    docs = []
    for k in range(120):
        i, text = items[k % 7]
        words = text.split()
        for _ in range(rng.randint(0, max(1, len(words) // 4))):
            at = rng.randrange(len(words))
            kind = rng.randrange(3)
            if kind == 0:
                words.insert(at, prose(rng, 1))
            elif kind == 1 and len(words) > 1:
                del words[at]
            else:
                words[at] = prose(rng, 1)
        docs.append((k, prose(rng, rng.randint(0, 40)) + "\n" + " ".join(words).upper() + "! " + prose(rng, rng.randint(0, 9))))
    docs += [(500, None), (501, ""), (502, "..."), (None, items[0][1]), (0, docs[0][1])]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("matches", F.lit("clash")),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )


def normal(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()


def test_leaks(leaky):
    docs, items = leaky
    item_words = {r.item_id: normal(r.text) for r in items.collect() if normal(r.text)}
    want = {}
    for d in docs.collect():
        for i, ws in item_words.items():
            distance = brute.edit_distance_within(ws, normal(d.text))
            if distance <= int(0.2 * len(ws)) and normal(d.text):
                want[d.doc_id, i] = distance
    found = decontamination.find_leaks(docs, items)
    assert found.columns == ["doc_id", "text", "matches"] and found.count() == docs.count()
    got = {(r.doc_id, m.item_id): m.distance for r in found.collect() for m in r.matches}
    assert all(k in want and got[k] == want[k] for k in got)  # exact: no false alarms
    assert len(got) >= 0.97 * len(want) and {k for k, v in want.items() if v == 0} <= set(got)


@pytest.mark.parametrize("size, copies", [(5, 60), (50, 30), (200, 12), (400, 8)])
def test_recall_at_the_largest_distance(spark, size, copies):
    rng = np.random.default_rng(size)
    items, docs = [], []
    for k in range(copies):
        words = rng.integers(0, 1 << 40, size)
        changed = decontamination.edited_copies(words.astype(np.uint64), size // 5, rng)
        items.append((k, " ".join(f"w{w}" for w in words)))
        docs.append((k, "before it " + " ".join(f"w{w}" for w in changed) + " behind"))
    found = decontamination.find_leaks(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    )
    got = {(r.doc_id, m.item_id) for r in found.collect() for m in r.matches}
    assert {(k, k) for k in range(copies)} <= got


def test_leaks_of_nothing(leaky):
    docs, items = leaky
    assert decontamination.find_leaks(docs.limit(0), items).count() == 0
    assert decontamination.find_leaks(docs, items.limit(0)).filter(F.size("matches") > 0).count() == 0


def test_window_distance():
    rng = np.random.default_rng(5)
    for _ in range(200):
        item, text = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        distance, a, b = decontamination.window_distance(item, text)
        assert distance == brute.edit_distance_within(item.tolist(), text.tolist())
        assert 0 <= a <= b <= len(text)


PAGES = [
    ("plain", '<body><nav>menu</nav><article><h1>A &amp;\n b</h1><p>one<br>two <b>three</p><p>four&nbsp;x</article><footer>f</footer>', "A & b\n\none two three\n\nfour x"),
    ("inside", '<main><header><h1>T</h1></header><p>x</p><aside>no</aside><div class="share-bar">no</div><form>no</form>'
     '<script>var a="</p><p>no";</script><style>no</style><!-- no --><p>y</p><section id="comments"><p>no</p></section></main>', "T\n\nx\n\ny"),
    ("none", "", ""),
    ("null", None, ""),
    ("text", "just text &lt;here&gt; &#233;", "just text <here> é"),
    ("attribute", '<article><p title="a > b">ok</p><p>5 < 6 and 7</p></article>', "ok\n\n5 < 6 and 7"),
    ("unclosed", "<article><p>a<p>b<div class='cookie notice'>no</div><ul><li>c<li>d</ul>", "a\n\nb\n\nc\n\nd"),
]


def test_page_blocks(spark):
    rows = [(i, f"http://{name}.example/", page) for i, (name, page, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = page_text.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in got.collect()}
    assert {i: found[i].text for i in found} == {i: want for i, (_, _, want) in enumerate(PAGES)}
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert page_text.extract_text(pages.limit(0)).count() == 0


def test_host_boilerplate(spark):
    rng = random.Random(8)
    notice, terms = prose(rng, 9), prose(rng, 4)
    rows, want = [], {}
    for i in range(40):
        own = [prose(rng, rng.randint(7, 30)) for _ in range(3)]
        host = "one.example" if i % 3 else f"h{i}.example"
        rows.append((i, f"https://{host}/{i}", f"<div>{notice}</div><div>{own[0]}</div><p>{own[1]} {notice}</p><p>{own[2]}</p><div>{terms}</div>"))
        blocks = [own[0], own[1], own[2]] if i % 3 else [notice, own[0], f"{own[1]} {notice}", own[2], terms]
        want[i] = "\n\n".join(blocks)
    rows.append((99, None, f"<div>{notice}</div>"))
    got = {r.page_id: r.text for r in page_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got.pop(99) == notice
    assert got == want


def tree(docs, **options):
    return fixity_audit.build_tree(fixity_audit.placed_records(fixity_audit.hashed_records(fixity_audit.warc_records(docs, **options))))


def test_audit(messy, spark):
    more = spark.createDataFrame(
        [(i, "x" * (i % 700), "xx", "s", 1, "k") for i in range(2000, 9000)] + [(-5, "neg", "xx", "s", 1, "k")], messy.schema
    )
    docs = messy.unionByName(more)
    payload = F.when(F.col("doc_id").isin(2, 2500, 8999), F.translate("text", "xa", "qq")).otherwise(F.col("text"))
    first, second = tree(docs), tree(docs, payload=payload)
    found = fixity_audit.audit(first, second).collect()
    changed = {str(r.doc_id) for r in docs.filter(F.col("doc_id").isin(2, 2500, 8999)).collect() if set("xa") & set(r.text)}
    assert {r.record_id for r in found} == changed and {r.finding for r in found} == {"altered"}
    assert fixity_audit.audit(first, tree(docs.repartition(7))).count() == 0
    placed = fixity_audit.placed_records(fixity_audit.hashed_records(fixity_audit.warc_records(docs)))
    lost = fixity_audit.build_tree(placed.filter("n <> 2600"))
    assert [(r.record_id, r.finding) for r in fixity_audit.audit(first, lost).collect()] == [("2600", "missing")]
    assert [(r.record_id, r.finding) for r in fixity_audit.audit(lost, first).collect()] == [("2600", "extra")]


def test_audit_of_nothing(messy):
    nothing, some = tree(messy.limit(0)), tree(messy)
    assert fixity_audit.audit(nothing, nothing).count() == 0
    assert fixity_audit.audit(some, nothing).count() == messy.count()
