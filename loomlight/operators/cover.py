"""Which chunks hold every term of which queries, and how densely.

The distinct term sets of the queries travel to the chunks. A task takes a slice
of chunks, keeps one bit per wanted term and chunk, and the chunks that hold a
set are the conjunction of its terms' bits: a pair of query and chunk costs a
few bits until it is known to match. Matches are scored at once, in numpy, and
a search for the k best keeps only these, so matches are never rows of a sort.

The score is cover density (Clarke, Cormack and Tudhope, 2000): every minimal
span that holds all terms counts 1 / (1 + other words in it), scaled by 0.1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomlight.functions.terms import term_lists
from loomlight.lineage import materialize
from loomlight.ordering import top_k

# Fixed value.
TERM_WEIGHT = 0.1

SCORE_DIGITS = 9
SLICE_ROWS = 4_096
CHUNKS_PER_TASK = 262_144
# Sets of a round: a task holds up to k chunks of each. Above the lower number, ids are numbered first.
MOST_SETS = 150_000
NUMBERED_SETS = 20_000
# Cells of a block of sets and chunks, matches scored at a time, matches held before they are cut.
CELLS = 4_000_000
MATCHES = 500_000
HELD = 2_000_000
# Chunks of a set's rarest term that are asked one by one; more are met as bits.
FEW = 8
# Places of one term that are scored in columns, matches scored at a time.
WIDTHS = (1, 2, 4, 8, 16)
BLOCK = 1 << 14
# Below it, a place less the occurrences before it fits above their number in 16 bits.
MOST_PLACE = 1_000
NO_KEY = 0xFFFF


class TermSets:
    """Numbered sets of distinct terms as codes, grouped by size; made from (set_no, terms)."""

    def __init__(self, numbers: pa.Array, sets: pa.Array):
        named = sets.flatten().dictionary_encode()
        codes = named.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        sizes = _sizes(sets)
        first = np.cumsum(sizes) - sizes
        every = [np.flatnonzero(sizes == n) for n in np.unique(sizes[sizes > 0])]
        self.terms = named.dictionary
        self.numbers = numbers.to_numpy(zero_copy_only=False)[np.concatenate([*every, np.zeros(0, np.int64)])]
        self.groups = [codes[first[rows][:, None] + np.arange(sizes[rows[0]])] for rows in every]


#: Chunk (ascending), term code and place of every wanted occurrence in a slice; places of a term ascend.
Occurrences = tuple[np.ndarray, np.ndarray, np.ndarray]


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, … in every run of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _codes(words: pa.Array, terms: pa.Array) -> np.ndarray:
    found = pc.index_in(words, value_set=terms.cast(words.type))
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def from_words(words: pa.Array, terms: pa.Array) -> Occurrences:
    """Occurrences in lists of words."""
    sizes = _sizes(words)
    codes = _codes(words.flatten(), terms)
    wanted = codes >= 0
    return np.repeat(np.arange(len(sizes)), sizes)[wanted], codes[wanted], _within(sizes)[wanted]


def from_texts(texts: pa.Array, terms: pa.Array) -> Occurrences:
    """Occurrences in texts made by ``term_text``."""
    return from_words(term_lists(texts), terms)


def from_postings(held: pa.Array, terms: pa.Array) -> Occurrences:
    """Occurrences in lists of (term, places)."""
    sizes = _sizes(held)
    pairs = held.flatten()
    codes, places = _codes(pc.struct_field(pairs, 0), terms), pc.struct_field(pairs, 1)
    counts = _sizes(places)
    chunk = np.repeat(np.repeat(np.arange(len(sizes)), sizes), counts)
    codes, place = np.repeat(codes, counts), places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wanted = codes >= 0
    return chunk[wanted], codes[wanted], place[wanted]


@cache
def _merges(n: int, width: int) -> list[tuple[int, int]]:
    """Compare-exchanges that sort ``n`` (up to three) ascending runs of ``width``, a power of two.

    Batcher's odd-even merges of runs filled up to four; what lies beyond the runs is
    greatest and never moves.
    """
    pairs = []

    def merge(low: int, size: int, step: int) -> None:
        if 2 * step < size:
            merge(low, size, 2 * step)
            merge(low + step, size, 2 * step)
            pairs.extend((i, i + step) for i in range(low + step, low + size - step, 2 * step))
        else:
            pairs.append((low, low + step))

    if n > 1:
        merge(0, 2 * width, 1)
    if n > 2:
        merge(0, 4 * width, 1)
    return [(i, j) for i, j in pairs if j < n * width]


class _Slice:
    """Occurrences of wanted terms in a slice of chunks: by term, and as bits."""

    def __init__(self, n_chunks: int, n_terms: int, chunk: np.ndarray, code: np.ndarray, place: np.ndarray):
        order = np.argsort(code, kind="stable")
        self.n_chunks, self.place = n_chunks, place[order]
        pair = code[order] * n_chunks + chunk[order]
        self.start = np.flatnonzero(np.diff(pair, prepend=-1))
        pair = pair[self.start]
        self.n = np.diff(self.start, append=len(place))
        present, row = np.unique(pair // n_chunks, return_inverse=True)
        self.row = np.full(n_terms, -1)
        self.row[present] = np.arange(len(present))
        # Chunk of a posting, the first posting of a term and the chunks that hold it.
        self.at = pair % n_chunks
        self.chunks = np.bincount(row, minlength=len(present))
        self.first = np.cumsum(self.chunks) - self.chunks
        self.words = -(-n_chunks // 64)
        bits = np.zeros((len(present), self.words * 8), np.uint8)
        np.bitwise_or.at(bits, (row, self.at >> 3), (1 << (self.at & 7)).astype(np.uint8))
        self.bits = bits.view("<u8")
        # Postings before those of a word of bits: a posting's number is that and the bits before its own.
        held = np.bitwise_count(self.bits).ravel()
        self.before = np.cumsum(held, dtype=np.int64) - held
        self._pad()

    def _pad(self) -> None:
        """Places of a posting as keys, a few together; the rest of a few are greater than any key."""
        self.padded = {}
        if not len(self.place) or self.place.max() >= MOST_PLACE:
            return
        for width in WIDTHS[1:]:
            rows = np.flatnonzero(self.n <= width)
            n = self.n[rows]
            keys = np.full((len(self.n), width), NO_KEY, np.uint16)
            within = _within(n)
            place = self.place[np.repeat(self.start[rows], n) + within]
            keys.ravel()[np.repeat(rows * width, n) + within] = place << 2
            self.padded[width] = keys

    def rare_first(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which rows of ``codes`` have all terms here, the terms' rows, rarest first)."""
        rows = [self.row[column] for column in codes.T]
        live = np.flatnonzero(np.minimum.reduce(rows) >= 0)
        rows = [r[live] for r in rows]
        keys = [(self.chunks[r] << 32) | r for r in rows]
        if len(keys) > 3:
            keys = list(np.sort(np.stack(keys, axis=1), axis=1).T)
        else:
            for i, j in ((0, 1), (1, 2), (0, 1))[: (0, 1, 3)[len(keys) - 1]]:
                keys[i], keys[j] = np.minimum(keys[i], keys[j]), np.maximum(keys[i], keys[j])
        return live, np.stack(keys, axis=1) & 0xFFFFFFFF

    def holders(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``codes``, chunk) of every chunk that holds all terms of a row; chunks of a row ascend."""
        live, rows = self.rare_first(codes)
        few = self.chunks[rows[:, 0]] <= FEW
        for some, find, cells in ((few, self._by_postings, FEW), (~few, self._by_bits, self.n_chunks)):
            chosen = np.flatnonzero(some)
            step = max(1, CELLS // max(cells, 8 * codes.shape[1]))
            for at in range(0, len(chosen), step):
                part = chosen[at : at + step]
                owner, chunk = find(rows[part])
                if len(owner):
                    yield live[part[owner]], chunk

    def _by_postings(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of each rarest term, asked for the other terms."""
        n = self.chunks[rows[:, 0]]
        owner = np.repeat(np.arange(len(rows)), n)
        chunk = self.at[np.repeat(self.first[rows[:, 0]], n) + _within(n)]
        bits = self.bits.ravel()
        for j in range(1, rows.shape[1]):
            held = bits[rows[owner, j] * self.words + (chunk >> 6)] >> (chunk & 63).astype(np.uint64)
            kept = np.flatnonzero(held.astype(np.uint8) & 1)
            owner, chunk = owner[kept], chunk[kept]
        return owner, chunk

    def _by_bits(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.arange(len(rows))
        both = self.bits[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            both &= self.bits[rows[left, j]]
            # Most sets are out before their frequent terms are read.
            if j & (j + 1) == 0 or j % 8 == 0:
                some = both.any(axis=1)
                both, left = both[some], left[some]
        flat = both.ravel()
        word = np.flatnonzero(flat != 0)
        hit = np.flatnonzero(np.unpackbits(flat[word].view(np.uint8), bitorder="little").view(bool))
        word = word[hit >> 6]
        row = word // self.words
        return left[row], (word - row * self.words) * 64 + (hit & 63)

    def densities(self, codes: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """Rounded cover density of each row of terms in its chunk, which holds them all."""
        word, below = chunk >> 6, (np.uint64(1) << (chunk & 63).astype(np.uint64)) - np.uint64(1)
        pairs, counts, bits = [], [], self.bits.ravel()
        for column in codes.T:
            at = self.row[column] * self.words + word
            pairs.append(self.before[at] + np.bitwise_count(bits[at] & below))
            counts.append(self.n[pairs[-1]])
        most, hits = np.maximum.reduce(counts), np.add.reduce(counts)
        density = np.empty(len(chunk))
        widths = [w for w in WIDTHS if w in self.padded or w == 1] if self.padded and len(pairs) <= 3 else [1]
        # Matches with as many occurrences, in as many columns, are scored together.
        kind = (np.searchsorted(widths, most) << 6 | np.minimum(hits, 63)).astype(np.uint16)
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(len(widths) + 1) << 6)
        for i, width in enumerate(widths):
            for at in range(edges[i], edges[i + 1], BLOCK):
                some = order[at : min(at + BLOCK, edges[i + 1])]
                mine = [p[some] for p in pairs]
                if width == 1:
                    place = [self.place[self.start[p]] for p in mine]
                    others = np.maximum.reduce(place) - np.minimum.reduce(place) - (len(place) - 1)
                    density[some] = TERM_WEIGHT / (1 + others)
                else:
                    density[some] = self._columns(mine, width, int(hits[some[-1]]))
        rest = order[edges[len(widths)] :]
        density[rest] = self._covers(*(np.stack([c[rest] for c in cs], axis=1) for cs in (pairs, counts)))
        # Half up, as Spark rounds.
        return np.floor(density * 10**SCORE_DIGITS + 0.5) / 10**SCORE_DIGITS

    def _columns(self, pairs: list[np.ndarray], width: int, hits: int) -> np.ndarray:
        """As ``_covers``, for up to three terms of at most ``width`` places: the i-th occurrences of all matches are a column.

        A key is a place and, below it, its term. Of an occurrence, ``at`` holds its place less
        the occurrences before it (words that are no term) and, below it, its number from 1; it
        grows with the place, so the least of the terms' last ones is where a span starts.
        """
        n, size = len(pairs), len(pairs[0])
        held = self.padded[width if width > 2 else 4]
        keys = []
        for slot, p in enumerate(pairs):
            if width == 2:
                rows = held.view(np.uint32)[:, 0][p].view(np.uint16).reshape(size, 2)
            elif width == 4:
                rows = held.view(np.uint64)[:, 0][p].view(np.uint16).reshape(size, 4)
            else:
                rows = held[p]
            keys.extend(rows[:, i] | np.uint16(slot) for i in range(width))
        spare = np.empty(size, np.uint16)
        for i, j in _merges(n, width):
            low = np.minimum(keys[i], keys[j], out=spare)
            np.maximum(keys[i], keys[j], out=keys[j])
            keys[i], spare = low, keys[i]
        density, gain = np.zeros(size), np.empty(size)
        last = [np.zeros(size, np.uint16) for _ in range(n)]
        first, before = np.zeros(size, np.uint16), np.zeros(size, np.uint16)
        slot, at, mask = (np.empty(size, np.uint16) for _ in range(3))
        for i in range(hits):
            np.bitwise_and(keys[i], 3, out=slot)
            np.bitwise_and(keys[i], 0xFFFC, out=at)
            np.left_shift(at, 4, out=at)
            np.subtract(at, 63 * i - 1 & 0xFFFF, out=at)
            for s in range(n):
                # All ones where the term is ``s``: zero less one, shifted with its sign.
                np.bitwise_xor(slot, s, out=mask)
                np.subtract(mask, 1, out=mask)
                np.right_shift(mask.view(np.int16), 2, out=mask.view(np.int16))
                np.bitwise_and(mask, at, out=mask)
                np.maximum(last[s], mask, out=last[s])
            if i + 1 < n:
                continue
            first, before = before, first
            np.minimum(last[0], last[1] if n > 1 else last[0], out=first)
            if n > 2:
                np.minimum(first, last[2], out=first)
            new = first != before
            np.right_shift(at, 6, out=at)
            np.right_shift(first, 6, out=mask)
            np.subtract(at, mask, out=at)
            np.add(at, 1, out=gain)
            np.divide(TERM_WEIGHT, gain, out=gain)
            np.multiply(gain, new, out=gain)
            np.add(density, gain, out=density)
        return density

    def _covers(self, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum over minimal spans, in one pass over the places of all matches.

        For every end, the widest needed start is the earliest of the terms'
        last places; a span is minimal when its start has moved.
        """
        if not len(pairs):
            return np.empty(0)
        flat, n = counts.ravel(), pairs.shape[1]
        place = self.place[np.repeat(self.start[pairs].ravel(), flat) + _within(flat)]
        slot = np.repeat(np.tile(np.arange(n), len(pairs)), flat)
        hits = counts.sum(axis=1)
        match = np.repeat(np.arange(len(pairs)), hits)
        order = np.argsort(match * (place.max() + 1) + place)
        place, slot, at = place[order], slot[order], np.arange(len(place))
        first = at.copy()
        for s in range(n):
            first = np.minimum(first, np.maximum.accumulate(np.where(slot == s, at, -1)))
        begin = np.repeat(np.cumsum(hits) - hits, hits)
        new = np.flatnonzero((first >= begin) & (np.diff(first, prepend=-1) > 0))
        start = first[new]
        gain = TERM_WEIGHT / (1 + (place[new] - place[start]) - (new - start))
        return np.bincount(match[new], weights=gain, minlength=len(pairs))


class _Leaders:
    """The k best chunks so far of every set; only scores that reach a set's k-th are kept.

    Equal scores go by chunk id. Chunks come numbered, those of a set in ascending
    order; as long as their ids ascend, too, no id is looked at.
    """

    def __init__(self, n_sets: int, k: int):
        self.k, self.bar, self.limit, self.held, self.ascending = k, np.zeros(n_sets), HELD, 0, True
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list[pa.Array] = []

    def name(self, ids: pa.Array) -> None:
        """The ids of the next chunks."""
        if self.ascending:
            known = pa.concat_arrays([self.ids[-1].slice(len(self.ids[-1]) - 1), ids]) if self.ids else ids
            self.ascending = not known.null_count and pc.all(pc.less(known[:-1], known[1:])).as_py() is not False
        self.ids.append(ids)

    def add(self, owner: np.ndarray, chunk: np.ndarray, density: np.ndarray) -> None:
        keep = np.flatnonzero(density >= self.bar[owner])
        self.parts.append((owner[keep].astype(np.int32), chunk[keep].astype(np.int32), density[keep]))
        self.held += len(keep)
        if self.held > self.limit:
            self._cut()
            self.limit = 2 * self.held + HELD

    def _cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, chunk, density = (np.concatenate(c) for c in zip(*self.parts))
        if not self.ascending:
            used, at = np.unique(chunk, return_inverse=True)
            place = np.empty(len(used), np.int64)
            place[pc.sort_indices(pa.concat_arrays(self.ids).take(pa.array(used))).to_numpy()] = np.arange(len(used))
            first = np.argsort(place[at].astype(np.int32), kind="stable")
            owner, chunk, density = owner[first], chunk[first], density[first]
        # Scores are whole numbers of the last digit.
        worth = np.rint(density * 10**SCORE_DIGITS).astype(np.int64)
        if worth.max() < 1 << 39:
            order = np.argsort((owner.astype(np.int64) + 1 << 39) - worth, kind="stable")
        else:
            order = np.lexsort((-worth, owner))
        runs = np.flatnonzero(np.diff(owner[order], prepend=-1))
        nth = _within(np.diff(runs, append=len(order)))
        kth = order[nth == self.k - 1]
        self.bar[owner[kth]] = density[kth]
        kept = order[nth < self.k]
        self.parts, self.held = [(owner[kept], chunk[kept], density[kept])], len(kept)
        return self.parts[0]

    def best(self) -> tuple[np.ndarray, pa.Array, np.ndarray] | None:
        """(set, chunk id, density) of what is kept."""
        if not self.held:
            return None
        owner, chunk, density = self._cut()
        return owner, pa.concat_arrays(self.ids).take(pa.array(chunk)), density


def _matches(sets: TermSets, part: _Slice) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(set, chunk, density) of a slice, a bounded number at a time; chunks of a set ascend."""
    before = 0
    for codes in sets.groups:
        width = max(1, MATCHES // max(3, codes.shape[1]))
        held, n = [], 0

        def scored(before: int = before, codes: np.ndarray = codes, width: int = width) -> Iterator:
            owner, chunk = (np.concatenate(c) for c in zip(*held))
            for i in range(0, len(owner), width):
                o, c = owner[i : i + width], chunk[i : i + width]
                yield before + o, c, part.densities(codes[o], c)

        for found in part.holders(codes):
            held.append(found)
            n += len(found[0])
            if n >= width:
                yield from scored()
                held.clear()
                n = 0
        if n:
            yield from scored()
        before += len(codes)


def _scored(rows: DataFrame, sets: DataFrame, read: Callable[..., Occurrences], k: int | None) -> DataFrame:
    """(set_no, chunk, density) for all sets of a round; with ``k``, the k best of each in every task."""
    held = sets.select("set_no", "terms").toArrow().combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast(TermSets(*(_whole(held[c]) for c in held.column_names)))
    id_type = to_arrow_type(rows.schema[0].dataType)

    def given(owner: np.ndarray, ids: pa.Array, density: np.ndarray) -> pa.RecordBatch:
        numbers = pa.array(shared.value.numbers[owner])
        return pa.RecordBatch.from_arrays([numbers, ids.cast(id_type), pa.array(density)], names=["set_no", "chunk", "density"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shared.value
        leaders = _Leaders(len(sets.numbers), k) if k else None
        seen = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = part.column(0)
                occurrences = read(part.column(1), sets.terms)
                if not len(occurrences[0]):
                    continue
                if leaders:
                    leaders.name(ids)
                for owner, chunk, density in _matches(sets, _Slice(len(ids), len(sets.terms), *occurrences)):
                    if leaders:
                        leaders.add(owner, seen + chunk, density)
                    elif len(owner):
                        yield given(owner, ids.take(pa.array(chunk)), density)
                seen += len(ids) if leaders else 0
        best = leaders.best() if leaders else None
        if best is not None:
            for at in range(0, len(best[0]), MATCHES):
                yield given(*(c[at : at + MATCHES] for c in best))
        # Python workers serve many stages.
        pa.default_memory_pool().release_unused()

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(score, f"set_no bigint, chunk {kind}, density double")


@contextmanager
def _a_task_per_file(spark: SparkSession) -> Iterator[None]:
    """Files of about the same size, as many for every core, stay tasks of their own."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with a number, ``no``, that grows with the chunk id, dealt to tasks by it."""
    written = materialize(rows, "words")
    # As many files for every core, or the last ones keep few cores busy in every round.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-written.count() // (CHUNKS_PER_TASK * cores)))
    dealt = written.repartitionByRange(tasks, "chunk").sortWithinPartitions("chunk")
    return materialize(dealt.withColumn("no", F.monotonically_increasing_id()), "ordered")


def cover_scores(
    asked: DataFrame,
    rows: DataFrame,
    query_id: str,
    chunk_id: str,
    read: Callable[..., Occurrences],
    most_terms: int,
    k: int | None = None,
) -> DataFrame:
    """(query_id, chunk_id, density) where a chunk holds all ``terms`` of a query; with ``k``, the k best and their rank.

    ``rows`` are (chunk, what ``read`` takes occurrences from). Queries with the
    same terms are scored once. Up to ``most_terms`` terms of sets (four bytes each,
    and every distinct term) are on the driver and in a broadcast at a time; more come
    in rounds, whose results are written and are final, since no set is in two rounds.
    """
    spark = rows.sparkSession
    keyed = materialize(asked.select(query_id, F.array_sort("terms").alias("terms")), "asked")
    sets = materialize(keyed.select("terms").distinct().withColumn("set_no", F.monotonically_increasing_id()), "sets")
    members = materialize(keyed.join(sets, "terms").select(query_id, "set_no"), "members")
    terms, count = sets.agg(F.sum(F.size("terms")), F.count(F.lit(1))).first()
    rounds = max(-(-(terms or 0) // max(1, most_terms)), -(-count // MOST_SETS))

    def best(found: DataFrame) -> DataFrame:
        return found if k is None else top_k(found, ["set_no"], [F.col("density").desc(), F.col("chunk")], k)

    if rounds <= 1 and count <= NUMBERED_SETS:
        whole = best(_scored(rows, sets, read, k))
    else:
        # Numbers take the place of ids in what is shuffled.
        numbered = _ordered(rows)
        short = numbered.select(F.col("no").alias("chunk"), rows.columns[1])
        turn = F.pmod(F.xxhash64("set_no"), F.lit(rounds))
        with _a_task_per_file(spark):
            parts = [
                materialize(best(_scored(short, sets.filter(turn == i), read, k)), "matches") for i in range(rounds)
            ]
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        whole = whole.withColumnRenamed("chunk", "no").join(numbered.select("no", "chunk"), "no")
    shown = [query_id, F.col("chunk").alias(chunk_id), "density", *(() if k is None else ("rank",))]
    return whole.join(members, "set_no").select(*shown)
