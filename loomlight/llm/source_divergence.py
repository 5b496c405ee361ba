"""Divergence of sources: how far the terms of one lie from those of another.

Two passes over the texts. The first counts, exactly, in how many documents of
a language each term stands and keeps the frequent ones. These go into minimal
perfect hashes, one per shard of about ``SHARD_TERMS`` terms, each with its
terms stored by slot. The second pass looks every term up in the hashes it
holds, compares it with the stored one, and increments a dense row of slots per
(language, source). Hashes are broadcast in rounds of at most ``ROUND_BYTES``; a
vocabulary beyond that takes more rounds, each with a pass of its own.

Comparing sources takes the counts in blocks of ``BLOCK_TERMS`` slots and
``BLOCK_SOURCES`` sources on either side, so neither a language's vocabulary nor
its sources meet in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlight.lineage import materialize
from loomlight.llm import flat
from loomlight.llm.perfect_hash import PerfectHash, string_hashes
from loomlight.llm.rows import map_batches
from loomlight.ordering import top_k

LEAST_DOCUMENTS = 3
UNIT = 1_000_000_000
MOST_TERMS = 200
SHARD_TERMS = 1 << 15
ROUND_BYTES = 64 << 20
BLOCK_TERMS = 2048
BLOCK_SOURCES = 256
DENSE_BYTES = 96 << 20  # slots a task holds before it gives them on, of four bytes each
MOST_COUNTED = 1 << 30  # terms between two such times

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z in lower case, and the row of each."""
    data, starts, ends = flat.buffers(texts)
    if len(starts) == 0 or ends[-1] == starts[0]:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    low = int(starts[0])
    part = data[low : int(ends[-1])]
    inside = _LETTER[part]
    before = np.concatenate([[False], inside[:-1]])
    first = starts[(ends > starts)] - low
    before[first] = False  # a row starts anew
    begin = np.flatnonzero(inside & ~before)
    kept = flat.lower(part[inside])
    # Terms stand one after the other once all other bytes are gone.
    at = np.concatenate([[0], np.cumsum(inside)])[begin]
    offsets = np.concatenate([at, [len(kept)]]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(kept.tobytes()))
    return terms, np.searchsorted(ends - low, begin, side="right")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Rows of a batch with their terms, some at a time."""
    _, starts, ends = flat.buffers(batch.column("text"))
    for lo, hi in flat.row_slices(starts, ends, 1 << 22):
        part = batch.slice(lo, hi - lo)
        terms, row = terms_of(part.column("text"))
        if len(terms):
            encoded = terms.dictionary_encode()
            yield part, encoded, row


def document_counts(texts: DataFrame) -> DataFrame:
    """``lang``, ``term`` and ``n_docs``: in how many rows of a language a term stands."""

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, encoded, row in _slices(batch):
            codes = encoded.indices.to_numpy().astype(np.int64)
            names = encoded.dictionary
            size = len(names)
            once = np.unique(row * size + codes)  # a term counts once a document
            langs = part.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy().astype(np.int64)[once // size]
            pair, n = np.unique(lang * size + once % size, return_counts=True)
            yield {
                "lang": langs.dictionary.take(pa.array(pair // size)),
                "term": names.take(pa.array(pair % size)),
                "n_docs": n,
            }

    partial = map_batches(texts.select("lang", "text"), count, "lang string, term string, n_docs bigint")
    return partial.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"))


def build_shards(vocabulary: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Perfect hashes of the terms of each language: ``lang``, ``first`` slot, ``n``, ``packed``, ``round``.

    Terms are dealt to shards by hash, as many as the language needs. The slots
    of a language are those of its shards one after the other.
    """
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sizes = sizes.select("lang", F.ceil(F.col("v") / shard_terms).cast("int").alias("shards"))

    def name(batch: pa.RecordBatch) -> dict:
        names = string_hashes(batch.column("term")).view(np.int64)
        return {"lang": batch.column("lang"), "term": batch.column("term"), "name": names}

    named = map_batches(vocabulary.select("lang", "term"), name, "lang string, term string, name bigint")
    shard = F.pmod("name", F.col("shards").cast("bigint")).cast("int")
    dealt = named.join(sizes, "lang").select("lang", "shards", shard.alias("shard"), "term")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = PerfectHash(pa.array(rows["term"].tolist(), pa.string()))
        packed = pickle.dumps(table, protocol=pickle.HIGHEST_PROTOCOL)
        return pd.DataFrame({"lang": [key[0]], "shard": [key[1]], "shards": [key[2]], "n": [len(table)], "packed": [packed]})

    schema = "lang string, shard int, shards int, n bigint, packed binary"
    # Dealt by shard: what a join dealt by language would keep a language in one task.
    by_shard = dealt.repartition("lang", "shard").groupBy("lang", "shard", "shards")
    shards = materialize(by_shard.applyInPandas(build, schema), "shards")
    # A row per shard only, of tens of thousands of terms each.
    earlier = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("lang", "shard").rowsBetween(Window.unboundedPreceding, -1)
    sized = shards.select("lang", "shard", "n", F.octet_length("packed").alias("bytes"))
    placed = sized.select(
        "lang",
        "shard",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"),
        F.floor(F.coalesce(F.sum("bytes").over(upto), F.lit(0)) / ROUND_BYTES).cast("int").alias("round"),
    )
    return shards.join(placed, ["lang", "shard"])


def recount(texts: DataFrame, shards: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``slot``, ``term`` and ``n``: occurrences of kept terms.

    ``shards`` come in rounds of bounded size; every round reads all texts.
    """
    context = texts.sparkSession.sparkContext
    rounds = [r[0] for r in shards.select("round").distinct().orderBy("round").collect()]
    counted = []
    for number in rounds:
        rows = shards.filter(F.col("round") == number).select("lang", "shard", "shards", "first", "n", "packed").collect()
        held: dict[str, tuple[int, dict[int, tuple[int, int, bytes]]]] = {}
        for r in rows:
            held.setdefault(r.lang, (r.shards, {}))[1][r.shard] = (r["first"], r.n, bytes(r.packed))
        tables = context.broadcast(held)
        part = texts.select("lang", "source", "text").mapInArrow(
            _increment(tables), "lang string, source string, slot bigint, term string, n bigint"
        )
        counted.append(materialize(part.groupBy("lang", "source", "slot", "term").agg(F.sum("n").alias("n")), "counts"))
        tables.unpersist()
    if not counted:
        schema = "lang string, source string, slot bigint, term string, n bigint"
        return texts.sparkSession.createDataFrame([], schema)
    whole = counted[0]
    for more in counted[1:]:
        whole = whole.unionByName(more)
    return whole


def _increment(tables):
    """The second pass in a task: dense slots per (language, source), given on when full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = {
            lang: (shards, {s: (first, pickle.loads(packed)) for s, (first, _, packed) in own.items()})
            for lang, (shards, own) in tables.value.items()
        }
        lowest = {lang: min(first for first, _ in own.values()) for lang, (_, own) in langs.items()}
        length = {lang: max(first + len(h) for first, h in own.values()) - lowest[lang] for lang, (_, own) in langs.items()}
        dense: dict[tuple[str, str], np.ndarray] = {}
        held = counted = 0

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), row in dense.items():
                slots = np.flatnonzero(row)
                for first, table in langs[lang][1].values():
                    mine = slots[(slots >= first - lowest[lang]) & (slots < first - lowest[lang] + len(table))]
                    if len(mine):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang] * len(mine), pa.string()),
                                pa.array([source] * len(mine), pa.string()),
                                pa.array(mine + lowest[lang]),
                                table.keys.take(pa.array(mine + lowest[lang] - first)),
                                pa.array(row[mine].astype(np.int64)),
                            ],
                            names=["lang", "source", "slot", "term", "n"],
                        )
            dense.clear()

        for batch in batches:
            for part, encoded, row in _slices(batch):
                codes, names = encoded.indices.to_numpy(), encoded.dictionary
                groups = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], names=["lang", "source"])
                kinds: dict[tuple[str, str], int] = {}
                group = np.array([kinds.setdefault((g["lang"], g["source"]), len(kinds)) for g in groups.to_pylist()])
                slot_of = {lang: _lookup(langs[lang], names) for lang in {lang for lang, _ in kinds} & langs.keys()}
                of_term = group[row]
                for (lang, source), number in kinds.items():
                    if lang not in langs:
                        continue
                    slots = slot_of[lang][codes[of_term == number]]
                    slots = slots[slots >= 0] - lowest[lang]
                    if not len(slots):
                        continue
                    new = 0 if (lang, source) in dense else 4 * length[lang]
                    if dense and (held + new > DENSE_BYTES or counted + len(slots) > MOST_COUNTED):
                        yield from given()
                        held, counted, new = 0, 0, 4 * length[lang]
                    if new:
                        dense[lang, source] = np.zeros(length[lang], np.int32)
                        held += new
                    counted += len(slots)
                    np.add.at(dense[lang, source], slots, 1)
        yield from given()

    return run


def _lookup(tables: tuple[int, dict], names: pa.Array) -> np.ndarray:
    """The slot of each name in its language, -1 where it is not kept or not in this round."""
    shards, own = tables
    out = np.full(len(names), -1, np.int64)
    hashes = string_hashes(names)
    shard = hashes.view(np.int64) % shards
    for number, (first, table) in own.items():
        mine = np.flatnonzero(shard == number)
        if len(mine):
            slots = table.slots(names.take(pa.array(mine)), hashes[mine])
            out[mine] = np.where(slots >= 0, first + slots, -1)
    return out




def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * (n + 1) / total)``, three digits at a time, so that no product leaves 64 bits."""
    value, rest = (n + 1) // total, (n + 1) % total
    for _ in range(3):
        value = value * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return value + 1


def _share_sql(n: str, total: str) -> str:
    """The same of two columns."""
    value, rest = f"(({n} + 1) div {total})", f"(({n} + 1) % {total})"
    for _ in range(3):
        value = f"({value} * 1000 + ({rest} * 1000) div {total})"
        rest = f"(({rest} * 1000) % {total})"
    return f"({value} + 1)"


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Divergence of some sources from others over the slots of one block."""
    width = int(rows["width"].iloc[0])
    sides = []
    for side in (0, 1):
        own = rows[rows["side"] == side]
        heads = own[own["place"] < 0]
        names = heads["source"].to_numpy()
        at = {name: i for i, name in enumerate(names)}
        counts = np.zeros((len(names), width), np.int64)
        there = own[own["place"] >= 0]
        counts[there["source"].map(at).to_numpy(np.int64), there["place"].to_numpy(np.int64)] = there["n"].to_numpy(np.int64)
        sides.append((names, share(counts, heads["total"].to_numpy(np.int64)[:, None]) if width else counts))
    (left, p), (right, q) = sides
    out = []
    for name, own in zip(left, p, strict=True):
        far = own[None, :] - q
        value = (far * far // q).sum(axis=1) if width else np.zeros(len(right), np.int64)
        other = right != name
        out.append(pd.DataFrame({"lang": key[0], "source": name, "item": right[other], "value": value[other]}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})


def divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    most_terms: int = MOST_TERMS,
    shard_terms: int = SHARD_TERMS,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of every (language, source).

    Part ``pair`` measures a source against each other one of its language,
    part ``term`` lists the terms it uses more than its language does. Null
    texts, languages and sources count as empty strings; a group without terms
    still has its pairs. A row is a document, so repeated rows count each. Other
    columns are not read, so their names do not matter; an empty table gives no
    row.
    """
    empty = F.lit("")
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), empty).alias("source"),
        F.coalesce(F.col(text_col).cast("string"), empty).alias("text"),
    )
    frequent = document_counts(texts).filter(F.col("n_docs") >= least_documents).select("lang", "term")
    vocabulary = materialize(frequent, "vocabulary")
    counts = recount(texts, build_shards(vocabulary, shard_terms))

    kept = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    used = counts.groupBy("lang", "source").agg(F.sum("n").alias("used"))
    groups = texts.select("lang", "source").distinct().join(kept, "lang", "left").join(used, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("used", F.lit(0)).alias("used"))
    groups = materialize(groups.withColumn("total", F.col("used") + F.col("v")), "groups")

    pairs = _pairs(groups, counts)
    order = [F.col("value").desc(), F.col("item").asc()]
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    terms = top_k(_over_used(groups, counts), ["lang", "source"], order, most_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        ranked.withColumn("part", F.lit("pair"))
        .select(columns)
        .unionByName(terms.withColumn("part", F.lit("term")).select(columns))
    )


def _pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Every two sources of a language, compared block by block.

    Sources are dealt to blocks by hash; a row goes to as many tasks as its
    language has blocks of sources, one up to ``BLOCK_SOURCES`` of them.
    """
    langs = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SOURCES).cast("int").alias("tiles"))
    sized = groups.join(langs, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("int")
    heads = sized.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "lang", "source", "tiles", "tile", "v", "block", "total", F.lit(-1).alias("place"), F.lit(0).cast("bigint").alias("n")
    )
    cells = counts.join(sized, ["lang", "source"]).select(
        "lang", "source", "tiles", "tile", "v", F.floor(F.col("slot") / BLOCK_TERMS).cast("int").alias("block"), "total",
        F.pmod("slot", F.lit(BLOCK_TERMS)).cast("int").alias("place"), "n",
    )
    rows = heads.unionByName(cells).withColumn(
        "width", F.least(F.lit(BLOCK_TERMS), F.col("v") - F.col("block") * BLOCK_TERMS).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    value = ["source", "total", "width", "place", "n"]
    left = rows.select("lang", "block", F.col("tile").alias("a"), every.alias("b"), F.lit(0).alias("side"), *value)
    right = rows.select("lang", "block", every.alias("a"), F.col("tile").alias("b"), F.lit(1).alias("side"), *value)
    parts = left.unionByName(right).repartition("lang", "block", "a", "b").groupBy("lang", "block", "a", "b")
    compared = parts.applyInPandas(_compare, "lang string, source string, item string, value bigint")
    return compared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _over_used(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Terms that a source uses more than its language, with how far they lie apart."""
    whole = counts.groupBy("lang", "slot").agg(F.sum("n").alias("whole"))
    langs = groups.groupBy("lang").agg((F.sum("used") + F.first("v")).alias("lang_total"))
    rows = counts.join(whole, ["lang", "slot"]).join(langs, "lang").join(groups.select("lang", "source", "total"), ["lang", "source"])
    shared = rows.withColumns({"p": F.expr(_share_sql("n", "total")), "q": F.expr(_share_sql("whole", "lang_total"))})
    value = F.expr("((p - q) * (p - q)) div q")
    return shared.filter("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
