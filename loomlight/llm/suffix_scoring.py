"""Language-model scores by a probabilistic suffix tree.

A text is its words, A-Z in lower case, joined by one space and closed by an
end mark, so its bytes and its tokens say the same. The tree is learned from
the byte n-grams of the training rows:

* contexts of up to ``BASE`` bytes are all retained. Their counts are bounded
  by the alphabet, 256 ** (BASE + 1) numbers, and known to every task;
* longer ones, up to ``DEPTH`` bytes, are candidates if they occur ``LEAST``
  times, however large the corpus is. A candidate is retained if its next-byte
  distribution diverges from that of its longest proper suffix:
  count * KL > ``DIVERGENCE`` * log(count). Suffixes of retained contexts are
  retained with it;
* distributions are interpolated with their suffix's by Witten-Bell weights,
  down to the uniform one, and so sum to one.

The longer contexts are never in one place: they lie in buckets by a hash of
their last ``BASE + 1`` bytes, which hold a context together with its suffixes.
A batch of texts asks the buckets for its distinct words and grams, packed, with
their training counts; a bucket adds the counts up, grows its part of the tree
and answers with word counts and probabilities. No row per word or gram is made.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.lineage import materialize
from loomlight.llm import flat
from loomlight.llm.rows import map_batches, map_each_group, small_batches

U64 = np.uint64
DEPTH = 5  # at most 7: with the next byte, a context is a 64-bit code
BASE = 2
LEAST = 2
DIVERGENCE = 1.0
BATCH = 1 << 22
END = 10
_END_NAME = U64(0x5851F42D4C957F2D)


def token_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words of some rows as one canonical byte sequence.

    Returns (bytes with a blank after each word and an end mark after each row,
    row of each byte, first byte and end of each word, row of each word).
    """
    n = len(starts)
    base = int(starts[0])
    part = flat.lower(data[base : int(ends[-1])])
    begin, stop, row = flat.words(data, starts, ends)
    length = stop - begin
    words = np.bincount(row, minlength=n)
    # A word takes its bytes and a separator; a row without words only its end.
    space = np.bincount(row, weights=length + 1, minlength=n).astype(np.int64)
    total = np.where(words > 0, space, 1)
    row_end = np.cumsum(total)
    shift = np.cumsum(length + 1) - (length + 1)
    shift = shift + (np.cumsum(words == 0))[row] if len(row) else shift
    out = np.full(int(row_end[-1]), 32, np.uint8)
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[at + np.repeat(shift, length)] = part[at + np.repeat(begin, length)]
    out[row_end - 1] = END
    return out, np.repeat(np.arange(n), total), shift, shift + length, row


def gram_codes(tokens: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Each byte with the ``DEPTH`` before it; before a row stand end marks."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    starts = np.zeros(len(row), np.int64)
    starts[first] = first
    since = np.arange(len(row)) - np.maximum.accumulate(starts)
    code = tokens.astype(U64)
    for back in range(1, DEPTH + 1):
        before = np.full(len(tokens), END, U64)
        before[back:] = tokens[:-back] if back < len(tokens) else before[back:]
        before[since < back] = END
        code |= before << U64(8 * back)
    return code


def count_grams(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``code`` and ``n`` of all grams of the texts of ``rows``, with ``depth`` bytes of context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        fresh = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return every, np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            data, starts, ends = flat.buffers(batch.column(0))
            for lo, hi in flat.row_slices(starts, ends):
                tokens, row, *_ = token_bytes(data, starts[lo:hi], ends[lo:hi])
                parts.append(np.unique(_last(gram_codes(tokens, row), depth + 1), return_counts=True))
                fresh += len(parts[-1][0])
                if fresh > max(1 << 19, len(parts[0][0])):
                    parts, fresh = [merged()], 0
        if parts:
            codes, n = merged()
            for at in range(0, len(codes), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(codes[part].view(np.int64)), pa.array(n[part])], names=["code", "n"])

    return rows.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _last(codes: np.ndarray, length: int) -> np.ndarray:
    return codes & U64((1 << (8 * length)) - 1)


def _sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sum of their counts."""
    every, place = np.unique(codes, return_inverse=True)
    return every, np.bincount(place, weights=counts, minlength=len(every)).astype(np.int64)


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first gram of each context, number of each gram's context) of sorted grams."""
    context = codes >> U64(8)
    new = np.ones(len(codes), bool)
    new[1:] = context[1:] != context[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


class SuffixTree:
    """Retained contexts by length and their next-byte counts, in sorted arrays."""

    def __init__(self, zero: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        """``zero``: counts of each byte; ``levels``: (code of context and next, count) by length."""
        # Any byte may come: the empty context is smoothed by one half.
        self.zero = np.log((zero + 0.5) / (zero.sum() + 128))
        self.levels: list[tuple[np.ndarray, ...]] = []
        self._add(levels)

    def _add(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for codes, counts in levels:
            at, number = _runs(codes)
            total = np.add.reduceat(counts, at).astype(float) if len(at) else np.zeros(0)
            kinds = np.diff(np.concatenate([at, [len(codes)]]))
            self.levels.append((codes, counts / (total + kinds)[number], codes[at] >> U64(8), kinds / (total + kinds)))

    def deeper(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> SuffixTree:
        """This tree with further levels below; what it has is shared."""
        out = copy(self)
        out.levels = list(self.levels)
        out._add(levels)
        return out

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's last byte after the others."""
        p = np.exp(self.zero)[(codes & U64(255)).astype(np.int64)]
        for n, (grams, share, contexts, back) in enumerate(self.levels, 1):
            if not len(grams):
                continue
            part = _last(codes, n + 1)
            place = np.minimum(np.searchsorted(contexts, part >> U64(8)), len(contexts) - 1)
            kept = contexts[place] == part >> U64(8)
            at = np.minimum(np.searchsorted(grams, part), len(grams) - 1)
            p = np.where(kept, np.where(grams[at] == part, share[at], 0.0) + back[place] * p, p)
        return np.log10(p)


def base_tree(codes: np.ndarray, counts: np.ndarray) -> SuffixTree:
    """The tree of all contexts of up to ``BASE`` bytes, by the counts of (context, next)."""
    zero = np.zeros(256)
    np.add.at(zero, _last(codes, 1).astype(np.int64), counts)
    return SuffixTree(zero, [_sums(_last(codes, n + 1), counts) for n in range(1, BASE + 1)])


def grow(codes: np.ndarray, counts: np.ndarray, base: SuffixTree) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of the retained contexts longer than ``BASE``.

    With a gram, all grams whose last ``BASE`` + 2 bytes but one are the same
    must be there: a bucket, or the whole corpus.
    """
    grams, share, contexts, back = base.levels[-1]
    q = share / (1 - back[np.searchsorted(contexts, grams >> U64(8))])
    levels = []
    for n in range(BASE + 1, DEPTH + 1):
        above = grams
        grams, times = _sums(_last(codes, n + 1), counts)
        at, number = _runs(grams)
        total = np.add.reduceat(times, at) if len(at) else np.zeros(0, np.int64)
        share = times / total[number]
        ratio = share / q[np.searchsorted(above, _last(grams, n))] if len(grams) else share
        kl = np.bincount(number, weights=share * np.log(ratio), minlength=len(at))
        diverges = (total >= LEAST) & (total * kl > DIVERGENCE * np.log(np.maximum(total, 1)))
        levels.append((grams, times, grams[at] >> U64(8), number, diverges))
        q = share
    needed = np.zeros(0, U64)
    kept = []
    for n in range(DEPTH, BASE, -1):
        grams, times, contexts, number, keep = levels[n - BASE - 1]
        keep = keep | np.isin(contexts, needed)
        needed = np.unique(_last(contexts[keep], n - 1))
        kept.append((grams[keep[number]], times[keep[number]]))
    return kept[::-1]


def learn_tree(rows: DataFrame) -> SuffixTree:
    """The whole tree of the (text) rows, for a corpus whose grams one process holds."""
    table = count_grams(rows).toPandas()
    codes, counts = table["code"].to_numpy(np.int64).view(U64), table["n"].to_numpy(np.int64)
    base = base_tree(*_sums(_last(codes, BASE + 1), counts))
    return base.deeper(grow(codes, counts, base))


MESSAGE = "bucket bigint, shard bigint, kind int, payload binary"
#: Kinds of message: words or grams asked for, a shard's card, counts or
#: probabilities answered, distinct words of a bucket.
ASK, CARD, ANSWER, DISTINCT, ASK_GRAMS, ANSWER_GRAMS = 0, 1, 2, 3, 4, 5


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte: sorted ones compress well that way."""
    wide = values.itemsize
    return values.view(np.uint8).reshape(-1, wide).T.tobytes()


def _unplanes(raw: memoryview, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(kind).reshape(-1)


def _asking(values: np.ndarray, counts: np.ndarray) -> bytes:
    kind = b"\1" if not len(counts) or counts.max() < 256 else b"\4"
    planes = _planes(values) + _planes(counts.astype(f"<u{kind[0]}"))
    return kind + len(values).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def _asked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[1:5], "little")
    view = memoryview(pa.decompress(memoryview(raw)[5:], n * (8 + raw[0]), "zstd"))
    return _unplanes(view[: 8 * n], "<u8"), _unplanes(view[8 * n :], f"<u{raw[0]}").astype(np.int64)


def _dealt(values: np.ndarray, part: Callable[[np.ndarray], np.ndarray], buckets: int):
    """Distinct values by bucket, part and value; their buckets; the number of each value."""
    every, number = np.unique(values, return_inverse=True)
    key = part(every)
    bucket = (flat.mix(key) % U64(buckets)).astype(np.int64)
    order = np.lexsort((every, key, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return every[order], bucket[order], rank[number]


def _words_and_grams(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int):
    """For the words, ends included, and the grams of some rows: what ``_dealt`` gives, and the row of each."""
    begin, stop, owner = flat.words(tokens, starts, ends)
    n = len(starts)
    names = np.concatenate([np.full(n, _END_NAME), flat.word_hashes(tokens, begin, stop)]) if len(begin) else np.full(n, _END_NAME)
    row = np.repeat(np.arange(n), ends - starts)
    words = (*_dealt(names, lambda x: x, buckets), np.concatenate([np.arange(n), owner]))
    grams = (*_dealt(gram_codes(tokens, row), lambda x: (x >> U64(8)) & U64((1 << (8 * (BASE + 1))) - 1), buckets), row)
    return words, grams


def _edges(bucket: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))


def _ask(batch: pa.RecordBatch, buckets: int, turn: list[int]) -> Iterator[dict]:
    data, starts, ends = flat.buffers(batch.column("text"))
    ids = batch.column("id").to_pylist()
    train = np.array(batch.column("train").to_pylist(), bool)
    for lo, hi in flat.row_slices(starts, ends, BATCH):
        n = hi - lo
        parts, sizes = [], []
        for a, b in flat.row_slices(starts[lo:hi], ends[lo:hi]):
            part, row, *_ = token_bytes(data, starts[lo + a : lo + b], ends[lo + a : lo + b])
            parts.append(part)
            sizes.append(np.bincount(row, minlength=b - a))
        tokens, size = np.concatenate(parts), np.concatenate(sizes)
        stop = np.cumsum(size)
        turn[0] += 1
        mark = np.array([(TaskContext.get().partitionId() << 32) + turn[0]], U64)
        asked: list[tuple[int, int, bytes]] = []
        shard = 0
        for kind, (every, bucket, number, owner) in zip((ASK, ASK_GRAMS), _words_and_grams(tokens, stop - size, stop, buckets), strict=True):
            shard = shard or int((flat.mix(mark) ^ np.bitwise_xor.reduce(every)).view(np.int64)[0])
            count = np.bincount(number, weights=train[lo:hi][owner], minlength=len(every)).astype(np.int64)
            edge = _edges(bucket).tolist()
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                asked.append((int(bucket[a]), kind, _asking(every[a:b], count[a:b])))
        head = json.dumps({"ids": ids[lo:hi], "train": train[lo:hi].tolist(), "buckets": buckets}).encode()
        asked.append((shard % buckets, CARD, b"".join([len(head).to_bytes(8, "little"), head, size.astype("<i8").tobytes(), pa.compress(tokens, "zstd", asbytes=True)])))
        yield {
            "bucket": np.array([x[0] for x in asked]),
            "shard": np.full(len(asked), shard),
            "kind": np.array([x[1] for x in asked], np.int32),
            "payload": [x[2] for x in asked],
        }


def _answer(table: pa.Table, base: SuffixTree) -> Iterator[dict]:
    """Total counts of the words, and probabilities of the grams, each shard asks a bucket for."""
    bucket, shard = table.column("bucket").to_numpy(), table.column("shard").to_numpy()
    kind, payload = table.column("kind").to_numpy(), table.column("payload")
    for b in np.unique(bucket):
        for ask, answer in ((ASK, ANSWER), (ASK_GRAMS, ANSWER_GRAMS)):
            mine = np.flatnonzero((bucket == b) & (kind == ask))
            if not len(mine):
                continue
            parts = [_asked(payload[int(i)].as_py()) for i in mine]
            cuts = np.cumsum([len(p) for p, _ in parts])[:-1]
            every, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
            out = {"bucket": np.full(len(mine), b), "shard": shard[mine], "kind": np.full(len(mine), answer, np.int32)}
            if ask == ASK:
                answers = [a.tobytes() for a in np.split(total[place], cuts)]
                yield {
                    "bucket": np.append(out["bucket"], b),
                    "shard": np.append(out["shard"], shard[mine[0]]),
                    "kind": np.append(out["kind"], np.int32(DISTINCT)),
                    "payload": [*answers, int((total > 0).sum()).to_bytes(8, "little")],
                }
            else:
                seen = total > 0
                p = base.deeper(grow(every[seen], total[seen], base)).log10(every).astype(np.float32)
                yield {**out, "payload": [a.tobytes() for a in np.split(p[place], cuts)]}


SCORED = "id string, train boolean, n_tokens bigint, n_known bigint, logs double, score double, distinct_words bigint"


def _settle(table: pa.Table) -> Iterator[dict]:
    """Sums of each document's log counts and gram probabilities, and each bucket's distinct words."""
    shard, bucket = table.column("shard").to_numpy(), table.column("bucket").to_numpy()
    kind, payload = table.column("kind").to_numpy(), table.column("payload")
    for s in np.unique(shard):
        mine = np.flatnonzero(shard == s)
        of = {k: [(int(bucket[i]), payload[int(i)].as_py()) for i in mine if kind[i] == k] for k in (CARD, ANSWER, DISTINCT, ANSWER_GRAMS)}
        raw = of[CARD][0][1]
        start = 8 + int.from_bytes(raw[:8], "little")
        card = json.loads(raw[8:start])
        n = len(card["ids"])
        size = np.frombuffer(raw, "<i8", n, start)
        stop = np.cumsum(size)
        tokens = np.frombuffer(pa.decompress(memoryview(raw)[start + 8 * n :], int(size.sum()), "zstd"), np.uint8)
        (_, _, word, doc), (_, _, gram, row) = _words_and_grams(tokens, stop - size, stop, card["buckets"])
        # Answers in order of their buckets are in the order of what was asked.
        found = np.concatenate([np.frombuffer(x, np.int64) for _, x in sorted(of[ANSWER])])[word]
        p = np.concatenate([np.frombuffer(x, np.float32) for _, x in sorted(of[ANSWER_GRAMS])])[gram]
        yield {
            "id": [None if i is None else str(i) for i in card["ids"]],
            "train": card["train"],
            "n_tokens": np.bincount(doc, minlength=n),
            "n_known": np.bincount(doc, weights=found > 0, minlength=n).astype(np.int64),
            "logs": np.bincount(doc, weights=np.log10(found + 0.5), minlength=n),
            "score": np.bincount(row, weights=p, minlength=n),
            "distinct_words": np.zeros(n, np.int64),
        }
        if of[DISTINCT]:
            none = {"id": [None], "train": [None], "n_tokens": [0], "n_known": [0], "logs": [0.0], "score": [0.0]}
            yield {**none, "distinct_words": [sum(int.from_bytes(x, "little") for _, x in of[DISTINCT])]}


def score_texts(docs: DataFrame, train_on: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    One row per input row; a null text is empty and has one token, its end.
    ``train_on`` (null: no) says which rows teach. Scores are log10 of the
    probability of the whole text. Ids must be strings or whole numbers.
    """
    texts = docs.select(
        F.col(id_col).cast("string").alias("id"),
        F.coalesce(train_on, F.lit(False)).alias("train"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    spark = docs.sparkSession
    with small_batches(spark, 2000):
        # At most 256 ** (BASE + 1) rows, whatever the size of the corpus.
        table = count_grams(texts.filter("train").select("text"), BASE).toPandas()
    base = base_tree(*_sums(table["code"].to_numpy(np.int64).view(U64), table["n"].to_numpy(np.int64)))
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    turn = [0]  # of a task: each one gets a copy of its own
    with small_batches(spark, 2000):
        asked = materialize(map_batches(texts, lambda batch: _ask(batch, buckets, turn), MESSAGE), "asked")
    asks = asked.filter(F.col("kind").isin(ASK, ASK_GRAMS))
    answered = map_each_group(asks, "bucket", lambda table: _answer(table, base), MESSAGE)
    messages = answered.unionByName(asked.filter(F.col("kind") == CARD))
    with small_batches(spark, 1000):
        settled = materialize(map_each_group(messages, "shard", _settle, SCORED), "settled")
    whole = settled.agg(
        F.coalesce(F.sum(F.when(F.col("train"), F.col("n_tokens"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum("distinct_words"), F.lit(0)).alias("v"),
    ).first()
    scale = float(np.log10(whole["n"] + 0.5 * (whole["v"] + 1)))
    return settled.filter("train is not null").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias("id"),
        "train",
        "n_tokens",
        "n_known",
        F.lit(int(whole["n"])).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )
