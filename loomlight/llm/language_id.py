"""Language identification by inferring a mixture of languages per document.

Training counts letter trigrams per language (hashed to ``BUCKETS``). A word of
a document is one observation with a likelihood under every language, the
product of its trigrams' smoothed probabilities. Expectation-maximisation then
estimates the document's shares of the languages. The language set is chosen by
penalised likelihood: sets of the m strongest languages are refitted and the
one with the best log-likelihood less ``PENALTY`` log(words) / 2 for each
further language wins. The largest share is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlight.llm import flat
from loomlight.llm.rows import carried, map_batches, row_struct, with_results

BUCKETS = 1 << 16
#: Models; each is BUCKETS * 4 bytes. Rarer labels beyond share the last one.
MAX_LANGUAGES = 256
ROUNDS = 10
PENALTY = 4.0
RESULTS = ("lang_pred", "score", "languages")
UNKNOWN = "und"

_LETTER = np.full(256, 32, np.uint8)  # other bytes part words
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(bucket of each letter's trigram, first of each word, row of each word)."""
    base = int(starts[0])
    letters = _LETTER[data[base : int(ends[-1])]]
    begin, stop, row = flat.words(letters, starts - base, ends - base)
    length = stop - begin
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
    padded = np.concatenate([[32], letters, [32]]).astype(np.uint32)
    before, here, after = padded[at], padded[at + 1], padded[at + 2]
    first = np.cumsum(length) - length
    if len(first):  # another row's text is no neighbour
        before[first] = 32
        after[first + length - 1] = 32
    gram = (before << np.uint32(16)) | (here << np.uint32(8)) | after
    bucket = ((gram * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)
    return bucket, first, row


def folded_labels(labels: DataFrame, most: int) -> DataFrame:
    """The rows of ``lang`` and others with at most ``most`` labels left.

    Beyond that number the labels of fewest rows (ties: the greatest first) are
    folded into the most frequent of them, so every row still teaches a model.
    Null labels stay null.
    """
    order = F.desc("rows"), F.asc("lang")
    lang = F.col("lang")
    kept = labels.filter(lang.isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(*order).limit(most + 1).collect()
    if len(kept) <= most:
        return labels
    own = [r["lang"] for r in kept[:most]]
    return labels.withColumn("lang", F.when(lang.isNull() | lang.isin(own), lang).otherwise(own[-1]))


def train(rows: DataFrame, text_col: str, lang_col: str, most: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by bucket and language) from labelled rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, starts, ends = flat.buffers(batch.column(0))
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lo, hi in flat.row_slices(starts, ends):
                bucket, first, row = trigrams(data, starts[lo:hi], ends[lo:hi])
                owner = np.repeat(row, np.diff(np.concatenate([first, [len(bucket)]])))
                names, code = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                found = np.bincount(code[owner] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, mine in zip(names.tolist(), found, strict=True):
                    sums[name] = sums[name] + mine if name in sums else mine
        for name, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(mine[at])], names=["lang", "bucket", "n"]
            )

    labelled = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    labelled = folded_labels(labelled, most).select("text", "lang")
    counts = labelled.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most ``most`` * BUCKETS rows, however large the corpus.
    found = counts.toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((BUCKETS, max(len(langs), 1)), 0.2)
    if langs:
        code = np.searchsorted(np.array(langs), found["lang"].to_numpy(str))
        table[found["bucket"].to_numpy(), code] += found["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _fit(like: np.ndarray, first: np.ndarray, count: np.ndarray, share: np.ndarray, rounds: int):
    """(shares, log-likelihood) of each document after some rounds of EM.

    ``like`` has the words' likelihoods relative to each word's best language;
    languages that start with share 0 keep it.
    """
    owner = np.repeat(np.arange(len(count)), count)
    for _ in range(rounds):
        weight = share[owner] * like
        weight /= weight.sum(axis=1, keepdims=True)
        share = np.add.reduceat(weight, first, axis=0) / count[:, None]
    total = np.log((share[owner] * like).sum(axis=1))
    return share, np.add.reduceat(total, first)


def mixtures(like: np.ndarray, count: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Shares of each document in its selected languages; rows sum to one."""
    like = np.maximum(like, 1e-12)
    first = np.cumsum(count) - count
    n, k = len(count), like.shape[1]
    share, _ = _fit(like, first, count, np.full((n, k), 1 / k, np.float32), rounds)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    best = (rank == 0).astype(np.float32)
    _, score = _fit(like, first, count, best, 0)
    # More languages are tried where the next one has any share worth a word.
    open_ = np.arange(n)
    for m in range(1, k):
        hold = np.where(rank[open_] == m, share[open_], 0).max(axis=1) * count[open_] > 0.5
        open_ = open_[hold]
        if not len(open_):
            break
        part = count[open_]
        at = np.repeat(first[open_] - (np.cumsum(part) - part), part) + np.arange(int(part.sum()))
        start = np.where(rank[open_] <= m, share[open_], 0)
        tried, fit = _fit(like[at], np.cumsum(part) - part, part, (start / start.sum(axis=1, keepdims=True)).astype(np.float32), rounds // 2)
        fit = fit - penalty * m * np.log(part + 1) / 2
        better = fit > score[open_]
        score[open_[better]] = fit[better]
        best[open_[better]] = tried[better]
    return best


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _predict(batch: pa.RecordBatch, langs: list[str], table: np.ndarray) -> Iterator[dict]:
    data, starts, ends = flat.buffers(batch.column("text"))
    names = np.array([*langs, UNKNOWN], dtype=object)
    for lo, hi in flat.row_slices(starts, ends):
        n = hi - lo
        best = np.zeros((n, len(langs)), np.float32)
        bucket, first, row = trigrams(data, starts[lo:hi], ends[lo:hi])
        count = np.bincount(row, minlength=n)
        some = np.flatnonzero(count)
        if len(some) and langs:
            like = np.add.reduceat(table[bucket], first, axis=0)
            like = np.exp(like - like.max(axis=1, keepdims=True))
            best[some] = mixtures(like, count[some])
        # Bytes outside ASCII need not be letters.
        raw = data[int(starts[lo]) : int(ends[hi - 1])]
        plain = np.concatenate([[0], np.cumsum((raw | 32) - np.uint8(97) < 26)])
        low, high = starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]
        for i in np.flatnonzero((plain[high] == plain[low]) & (count > 0)).tolist():
            if not _has_letter(raw[int(low[i]) : int(high[i])].tobytes()):
                best[i] = 0
        score = best.max(axis=1) if langs else np.zeros(n)
        lang = np.where(score > 0, best.argmax(axis=1) if langs else 0, len(langs))
        parts = [[{"lang": langs[j], "share": float(b[j])} for j in np.argsort(-b, kind="stable") if b[j] > 0] for b in best]
        yield {
            "row": batch.column("row").slice(lo, n),
            "text": batch.column("text").slice(lo, n),
            "lang_pred": names[lang].tolist(),
            "score": np.minimum(score, 1).astype(np.float64),
            "languages": parts,
        }


def identify_languages(
    docs: DataFrame, train_on: Column, text_col: str = "text", lang_col: str = "lang", most: int = MAX_LANGUAGES
) -> DataFrame:
    """The input with ``lang_pred``, ``score`` and ``languages``.

    Rows where ``train_on`` holds and ``lang_col`` is not null teach the model;
    a prediction sees the text alone. ``languages`` lists the selected languages
    with their shares, largest first, and ``score`` is the largest. A null text,
    one without letters, or a table that teaches nothing gives ``und`` and 0.
    At most ``most`` labels have a model of their own; the rarest of more share
    the last one, under the name of its most frequent label.
    Result columns replace input columns of the same name.
    """
    langs, table = train(docs.filter(train_on), text_col, lang_col, most)
    beside = carried(docs, text_col)
    rows = docs.select(row_struct(beside), F.col(text_col).cast("string").alias("text"))
    share = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    schema = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("languages", T.ArrayType(share)),
        ]
    )
    done = map_batches(rows, lambda batch: _predict(batch, langs, table), schema)
    kept = [F.col("row").getField(c) if c in beside else F.col("text") for c in with_results(docs, RESULTS)]
    return done.select(*[c.alias(n) for c, n in zip(kept, with_results(docs, RESULTS), strict=True)], *RESULTS)


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))
