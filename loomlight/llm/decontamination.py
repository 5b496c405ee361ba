"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are word sequences (A-Z in lower case, ASCII punctuation
dropped). A passage leaks an item of n words if at most ``floor(0.2 n)`` word
edits turn one into the other.

1. A passage within that distance shares a run of ``seed_length`` words with
   the item (by the pigeonhole principle), so windows of the item's size are
   placed where a word run of some item occurs, aligned with it.
2. The random walk of Chakraborty, Goldenberg and Koucky embeds windows and
   items: step j copies the symbol it stands on and moves on if a random bit of
   (j, symbol) says so. Edit distance becomes Hamming distance.
3. Each repetition samples coordinates of the embedding; equal samples make a
   window a candidate. The repetitions of a size are those that found all
   ``COPIES`` or more of its items' copies at the largest distance, which bounds
   the recall, confirmed by as many other copies. Any other size is not sampled:
   every window with a word run of an item is a candidate for that item if it
   holds n - floor(0.2 n) of its words, which all its leaks do.
4. Candidates are verified by exact edit distance against the text around the
   window, so every reported leak is one.

Items come to the tasks in blocks of bounded size, the texts never move.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlight.llm import flat
from loomlight.llm.rows import carried, map_batches, row_struct, with_results

U64 = np.uint64
SEED = 3
EDIT_SHARE = 0.2
RECALL = 0.99
SAMPLED = 3
BLOCK_ITEMS = 20_000
MAX_REPEATS = 200  # sizes that need more are compared without sampling
COPIES = 320  # all found: with 95 % confidence a recall above 0.99
CELLS = 1 << 21  # words of windows compared together
WALKS = 8  # random walks that the repetitions share
CHUNK = 1 << 23  # bytes of text whose windows are embedded together
RESULTS = ("matches",)

_WORD = np.full(256, 32, np.uint8)
_WORD[48:58] = np.arange(48, 58)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(hash of each word, row of each) of rows lying one after the other."""
    base = int(starts[0])
    plain = _WORD[data[base : int(ends[-1])]]
    begin, stop, row = flat.words(plain, starts - base, ends - base)
    return flat.word_hashes(plain, begin, stop), row


def _steps(j: int, symbols: np.ndarray, walk: int) -> np.ndarray:
    return (flat.mix(symbols ^ U64((j * 0x9E3779B97F4A7C15 + walk * 0xD1B54A32D192ED03) % (1 << 64))) >> U64(63)).astype(np.int64)


def embed(symbols: np.ndarray, start: np.ndarray, size: int, walk: int) -> np.ndarray:
    """The 3 * size coordinates of each window's embedding by one random walk.

    A walk that has left the window reads blanks.
    """
    at = np.zeros(len(start), np.int64)
    out = np.zeros((3 * size, len(start)), U64)
    for j in range(3 * size):
        inside = at < size
        out[j] = np.where(inside, symbols[start + np.minimum(at, size - 1)], U64(0))
        at = at + _steps(j, out[j], walk)
    return out


def sampled_key(embedding: np.ndarray, size: int, repetition: int) -> np.ndarray:
    """Hash of a repetition's sampled coordinates of each embedding."""
    out = np.full(embedding.shape[1], U64(size))
    for coordinate in sampled_coordinates(size, repetition):
        out = flat.mix(out * U64(0x9E3779B97F4A7C15) + embedding[coordinate])
    return out


def sampled_coordinates(size: int, repetition: int) -> np.ndarray:
    # A walk moves on every other step, so late coordinates are mostly blanks,
    # on which everything would agree.
    rng = np.random.default_rng([size, repetition])
    reach = max(SAMPLED, 3 * size // 2)
    return np.sort(rng.choice(reach, SAMPLED, replace=False))


def edited_copies(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy of an item after so many random insertions, deletions, replacements."""
    words = item.tolist()
    for _ in range(edits):
        i = int(rng.integers(0, len(words))) if words else 0
        kind = int(rng.integers(0, 3))
        fresh = int(rng.integers(1, 1 << 62))
        if kind == 0 or not words:
            words.insert(i, fresh)
        elif kind == 1 and len(words) > 1:
            del words[i]
        else:
            words[i] = fresh
    return np.array(words, U64)


def seed_length(n: int) -> int:
    """Words in a row that an item of n words shares with every passage that leaks it."""
    edits = math.floor(EDIT_SHARE * n)
    return min(SEED, math.ceil((n - edits) / (edits + 1)))


def placed_copy(item: np.ndarray, copy: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The first window that seeds place on a copy in other text; there may be more."""
    n, size = len(item), seed_length(len(item))
    around = rng.integers(1, 1 << 62, 3 * n).astype(U64)
    text = np.concatenate([around[:n], copy, around[n:]])
    first = {gram: at for at, gram in reversed(list(enumerate(flat.Hashes(item).grams(size).tolist())))}
    shift = next((at - first[g] for at, g in enumerate(flat.Hashes(copy).grams(size).tolist()) if g in first), 0)
    start = max(n + shift, 0)
    return text[start : start + n]


def repetitions(items: list[np.ndarray], recall: float, share: float = EDIT_SHARE) -> int | None:
    """How many repetitions find copies of items of one size at the largest distance.

    ``None`` if the recall's lower bound (Wilson, 95 %) misses the target after
    ``MAX_REPEATS``. Every item has at least one copy.
    """
    n = len(items[0])
    edits = math.floor(share * n)
    if not edits:
        return 1
    originals = items * -(-COPIES // len(items))
    total = len(originals)

    def hits(seed: int):
        """Which copies were found so far, after each repetition."""
        rng = np.random.default_rng([seed, n])
        copies = [placed_copy(i, edited_copies(i, edits, rng), rng) for i in originals]
        joined = np.concatenate([*originals, *copies])
        walks = [embed(joined, np.arange(2 * total) * n, n, walk) for walk in range(WALKS)]
        hit = np.zeros(total, bool)
        for r in range(MAX_REPEATS):
            keys = sampled_key(walks[r % WALKS], n, r)
            hit |= keys[:total] == keys[total:]
            yield hit.mean()

    def least(rate: float, z: float = 1.645) -> float:
        spread = z * math.sqrt(rate * (1 - rate) / total + z * z / (4 * total * total))
        return (rate + z * z / (2 * total) - spread) / (1 + z * z / total)

    # Stopping at the first good number flatters it: other copies must confirm it.
    count = next((r for r, rate in enumerate(hits(7), 1) if least(rate) >= recall), None)
    if count is None or least(next(islice(hits(8), count - 1, None))) < recall:
        return None
    return count


def window_distance(item: np.ndarray, text: np.ndarray, limit: int | None = None) -> tuple[int, int, int]:
    """(least edit distance of the item to any run of the text, start, stop).

    With a ``limit`` it ends as soon as the distance is known to be above it,
    and is then only said to be ``limit`` + 1.
    """
    n, m = len(item), len(text)
    beyond = (n if limit is None else limit) + 1
    # Words of the item that the text lacks cost an edit each.
    if limit is not None and n - int(np.isin(item, text).sum()) > limit:
        return beyond, 0, 0
    cost = np.zeros(m + 1, np.int64)
    begin = np.arange(m + 1)
    step = np.arange(m + 1)
    for i in range(1, n + 1):
        swap = cost[:-1] + (text != item[i - 1])
        drop = cost[1:] + 1
        new = np.concatenate([[i], np.minimum(swap, drop)])
        came = np.concatenate([[0], np.where(swap <= drop, begin[:-1], begin[1:])])
        # Insertions run from left to right: least of (cost - place) so far.
        lead = new - step
        least = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == least, step, 0))
        cost = least + step
        begin = came[source]
        # The least cost of a row never falls.
        if limit is not None and i % 4 == 0 and cost.min() > limit:
            return beyond, 0, 0
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


class Items:
    """A block of items with their seeds and their buckets."""

    def __init__(self, ids: list, words: list[np.ndarray], recall: float):
        self.ids, self.words = ids, words
        by_size = defaultdict(list)
        for i, item in enumerate(words):
            by_size[len(item)].append(i)
        self.repeats = {n: repetitions([words[i] for i in members], recall) for n, members in by_size.items()}
        seeds: dict[tuple[bool, int], dict] = defaultdict(lambda: defaultdict(set))
        for i, item in enumerate(words):
            size = seed_length(len(item))
            exact = self.repeats[len(item)] is None
            for at, gram in enumerate(flat.Hashes(item).grams(size).tolist()):
                seeds[exact, size][gram].add((i if exact else len(item), at))
        self.seeds = {}
        for kind, grams in seeds.items():
            keys = np.array(sorted(grams), U64)
            places = [np.array(sorted(grams[int(k)])) for k in keys]
            counts = np.array([len(p) for p in places])
            self.seeds[kind] = (keys, np.cumsum(counts) - counts, counts, np.concatenate(places))
        self.buckets: dict[tuple[int, int], dict[int, list[int]]] = {}
        for n, members in by_size.items():
            joined = np.concatenate([words[i] for i in members])
            if self.repeats[n] is None:
                continue
            walks = [embed(joined, np.arange(len(members)) * n, n, walk) for walk in range(WALKS)]
            for r in range(self.repeats[n]):
                keys = sampled_key(walks[r % WALKS], n, r)
                table = defaultdict(list)
                for key, i in zip(keys.tolist(), members, strict=True):
                    table[key].append(i)
                self.buckets[n, r] = dict(table)

    def windows(self, symbols: np.ndarray, row: np.ndarray, exact: bool = False) -> np.ndarray:
        """(start, size or item, row) of windows placed by seeds, each once; starts may be negative."""
        found = []
        for (kind, size), (keys, first, counts, places) in self.seeds.items():
            if kind != exact:
                continue
            grams = flat.Hashes(symbols).grams(size)
            if not len(grams):
                continue
            low = (grams & U64(0xFFFFF)).astype(np.int64)
            mask = np.zeros(1 << 20, bool)
            mask[(keys & U64(0xFFFFF)).astype(np.int64)] = True
            at = np.flatnonzero(mask[low] & (row[: len(grams)] == row[size - 1 :]))
            place = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
            sure = keys[place] == grams[at]
            at, place = at[sure], place[sure]
            count = counts[place]
            pick = np.repeat(first[place] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            at = np.repeat(at, count)
            found.append(np.stack([at - places[pick, 1], places[pick, 0], row[at]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def _whole(self, symbols: np.ndarray, row: np.ndarray, edge: np.ndarray, best: dict) -> None:
        """Adds the leaks of the items whose size is not sampled."""
        placed = self.windows(symbols, row, True)
        placed = placed[np.argsort(placed[:, 1], kind="stable")]
        cut = np.flatnonzero(np.diff(placed[:, 1], prepend=-1, append=-1)) if len(placed) else np.zeros(0, np.int64)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            i = int(placed[a, 1])
            item = self.words[i]
            n = len(item)
            slack = math.floor(EDIT_SHARE * n)
            known = np.unique(item)
            step = max(1, CELLS // (n + 2 * slack))
            for c in range(a, b, step):
                start, owner = placed[c : min(c + step, b), 0], placed[c : min(c + step, b), 2]
                at = (start - slack)[:, None] + np.arange(n + 2 * slack)
                inside = (at >= edge[owner][:, None]) & (at < edge[owner + 1][:, None])
                word = symbols[np.clip(at, 0, len(symbols) - 1)]
                place = np.minimum(np.searchsorted(known, word), len(known) - 1)
                enough = ((known[place] == word) & inside).sum(axis=1) >= n - slack
                for first, text in zip(start[enough].tolist(), owner[enough].tolist(), strict=True):
                    if (text, i) in best and best[text, i][0] == 0:
                        continue
                    lo, hi = max(first - slack, int(edge[text])), min(first + n + slack, int(edge[text + 1]))
                    distance, x, y = window_distance(item, symbols[lo:hi], slack)
                    if distance <= slack:
                        found = (distance, lo + x - int(edge[text]), lo + y - int(edge[text]))
                        best[text, i] = min(best.get((text, i), found), found)

    def leaks(self, symbols: np.ndarray, row: np.ndarray, n_rows: int) -> list[list[dict]]:
        """Verified leaks of each row, one (the nearest) for each item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        windows = self.windows(symbols, row)
        edge = np.searchsorted(row, np.arange(n_rows + 1))
        self._whole(symbols, row, edge, best)
        blank = np.zeros(max((len(w) for w in self.words), default=1), U64)
        padded = np.concatenate([blank, symbols, blank])
        for n in np.unique(windows[:, 1]).tolist():
            start = np.unique(windows[windows[:, 1] == n, 0])
            repeats = self.repeats[n]
            walks = [embed(padded, start + len(blank), n, walk) for walk in range(min(WALKS, repeats))]
            tried: set[tuple[int, int]] = set()
            for r in range(repeats):
                keys = sampled_key(walks[r % WALKS], n, r)
                table = self.buckets[n, r]
                known = np.array(list(table), U64)
                for w in np.flatnonzero(np.isin(keys, known)).tolist():
                    # The word in the middle tells the row of a window at an edge.
                    owner = int(row[min(max(int(start[w]) + n // 2, 0), len(row) - 1)])
                    slack = math.floor(EDIT_SHARE * n)
                    lo = max(int(start[w]) - slack, int(edge[owner]))
                    hi = min(int(start[w]) + n + slack, int(edge[owner + 1]))
                    for i in table[int(keys[w])]:
                        if (w, i) in tried or (owner, i) in best and best[owner, i][0] == 0:
                            continue
                        tried.add((w, i))
                        distance, a, b = window_distance(self.words[i], symbols[lo:hi], slack)
                        if distance <= slack:
                            at = (distance, lo + a - int(edge[owner]), lo + b - int(edge[owner]))
                            best[owner, i] = min(best.get((owner, i), at), at)
        out: list[list[dict]] = [[] for _ in range(n_rows)]
        for (owner, i), (distance, a, b) in sorted(best.items()):
            out[owner].append({"item_id": self.ids[i], "distance": distance, "start": a, "stop": b, "item_words": len(self.words[i])})
        return out


def _mark(batch: pa.RecordBatch, items: Items) -> list[dict]:
    data, starts, ends = flat.buffers(batch.column("text"))
    before = batch.column("matches").to_pylist()
    out = []
    for lo, hi in flat.row_slices(starts, ends, CHUNK):
        parts = []
        for a, b in flat.row_slices(starts[lo:hi], ends[lo:hi]):
            part, owner = word_symbols(data, starts[lo + a : lo + b], ends[lo + a : lo + b])
            parts.append((part, owner + a))
        symbols, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        found = items.leaks(symbols, row, hi - lo) if len(symbols) else [[] for _ in range(hi - lo)]
        out.append(
            {
                "row": batch.column("row").slice(lo, hi - lo),
                "text": batch.column("text").slice(lo, hi - lo),
                "matches": [(a or []) + b for a, b in zip(before[lo:hi], found, strict=True)],
            }
        )
    return out


def item_blocks(benchmark: DataFrame, text_col: str, id_col: str, block: int = BLOCK_ITEMS):
    """The items in blocks of at most ``block``, in order of their id."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.filter(F.length("text") > 0).orderBy("id", "text")
    held: list = []
    for item in items.toLocalIterator():
        held.append(item)
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_text_col: str = "text",
    item_id_col: str = "item_id",
    recall: float = RECALL,
) -> DataFrame:
    """The input with ``matches``: item, word edits, word range, item's words.

    Null and wordless texts have none; null, wordless and repeated items are
    skipped or reported under each id. Positions count normalised words. A
    column called ``matches`` is replaced. Without items nothing matches.
    """
    kind = T.StructType(
        [
            T.StructField("item_id", benchmark.schema[item_id_col].dataType),
            *[T.StructField(n, T.LongType()) for n in ("distance", "start", "stop", "item_words")],
        ]
    )
    beside = carried(docs, text_col)
    done = docs.select(row_struct(beside), F.col(text_col).cast("string").alias("text"))
    done = done.withColumn("matches", F.lit(None).cast(T.ArrayType(kind)))
    for block in item_blocks(benchmark, item_text_col, item_id_col):
        texts = pa.array([r["text"] for r in block], pa.large_string())
        symbols, owner = word_symbols(*flat.buffers(texts))
        edge = np.searchsorted(owner, np.arange(len(block) + 1))
        some = [i for i in range(len(block)) if edge[i + 1] > edge[i]]
        if not some:
            continue
        items = Items([block[i]["id"] for i in some], [symbols[edge[i] : edge[i + 1]] for i in some], recall)
        done = map_batches(done, lambda batch, items=items: _mark(batch, items), done.schema)
    matches = F.coalesce("matches", F.array().cast(T.ArrayType(kind)))
    kept = [(F.col("row").getField(c) if c in beside else F.col("text")).alias(c) for c in with_results(docs, RESULTS)]
    return done.select(*kept, matches.alias("matches"))
