"""Vector search: the k nearest chunks of every query, exactly.

The queries are the small side. They travel to the chunks as one matrix, and
each task scores a batch of chunks against it with one product, keeping only
its own best k per query, so no table of pairs ever exists and the shuffle
carries at most k rows per query and task. The matrix is broadcast only after
its rows are counted. A larger query table comes in rounds of bounded size, one
scan of the chunks for each; there, chunks are grouped around pivots, and a
group is not compared with queries it is too far from. Chunks are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomlight.lineage import materialize
from loomlight.ordering import top_k

# Fixed values.
DEFAULT_K = 5
MIN_SIMILARITY = 0.0

MAX_BROADCAST_QUERIES = 4096
SLICE_ROWS = 16_384
PIVOTS = 64
ROUND_BYTES = 32 << 20
ROUND_LEADERS = 500_000
SLACK = 1e-8  # above the rounding of scores
SCORE_DIGITS = 9
ROUNDING = 1e-9  # above what rounding adds to a score
ROUGH = 1.2e-7  # above the error of a product in single precision, per component
CELLS = 4_000_000
PAIRS = 65_536
HELD_IDS = 1_000_000
TREE_FROM_FILES = 512


class _Queries:
    """Unit query vectors and, per query, the sources it may see."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, targets: list[list[str] | None]):
        self.ids = ids
        self.unit = _unit(vectors)
        # Single precision finds what may count; its score is then taken in full.
        self.rough = self.unit.astype(np.float32)
        self.margin = ROUNDING + ROUGH * (vectors.shape[1] + 8)
        self.limited = np.array([t is not None and len(t) > 0 for t in targets], bool)
        by_source: dict[str, list[int]] = {}
        for row, names in enumerate(targets):
            for name in names or ():
                by_source.setdefault(name, []).append(row)
        # Rows ascend.
        self.by_source = {name: np.unique(np.array(rows, np.int32)) for name, rows in by_source.items()}

    def seeing(self, sources: np.ndarray) -> np.ndarray:
        """Which queries may see a chunk of any of these sources."""
        seen = ~self.limited
        for name in set(sources) & self.by_source.keys():
            seen[self.by_source[name]] = True
        return seen

    def allowed(self, sources: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Which of the queries ``asked`` (ascending) may see chunks of these sources."""
        names, codes = np.unique(sources, return_inverse=True)
        table = np.repeat(~self.limited[asked][None, :], len(names), axis=0)
        for code, name in enumerate(names):
            rows = self.by_source.get(name)
            if rows is not None and len(asked):
                rows = rows[np.searchsorted(rows, asked[0]) : np.searchsorted(rows, asked[-1], "right")]
                at = np.searchsorted(asked, rows)
                table[code, at[asked[at] == rows]] = True
        return table[codes]


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _names(part: pa.RecordBatch) -> np.ndarray:
    return np.array([s or "" for s in part.column(2).to_pylist()], object)


def _first_of_ties(scores: np.ndarray, k: int) -> np.ndarray:
    """Which k scores of every row are best, the first ones among equals."""
    kth = np.partition(scores, -k, axis=1)[:, -k, None]
    sure, tied = scores > kth, scores == kth
    room = k - np.count_nonzero(sure, axis=1)
    return sure | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= room[:, None]))


class _Leaders:
    """The k best chunks so far of every query.

    Memory is bounded by the product of one slice and a few k rows per query.
    Once a query has k chunks, only scores that reach its k-th are looked at.
    """

    def __init__(self, queries: _Queries, k: int, floor: float, filtered: bool):
        self.queries, self.k, self.filtered = queries, k, filtered
        self.bar = np.full(len(queries.ids), floor)
        # Query, number of the chunk among ``ids`` and score.
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list[pa.Array] = []
        self.held, self.seen, self.limit = 0, 0, HELD_IDS
        self.step = max(1, CELLS // len(queries.ids))

    def add(self, batch: pa.RecordBatch) -> None:
        for start in range(0, batch.num_rows, self.step):
            part = batch.slice(start, self.step)
            # By id, so the first of equal scores is the one to keep.
            part = part.take(pc.sort_indices(part.column(0)))
            self.ids.append(part.column(0))
            self._add(part)
            self.seen += part.num_rows
            if self.seen > self.limit:
                self._forget()

    def _crowded(self) -> bool:
        return self.held > 4 * self.k * len(self.queries.ids)

    def _add(self, part: pa.RecordBatch) -> None:
        self._meet(np.arange(part.num_rows), _unit(_matrix(part.column(1))), _names(part), None)

    def _meet(self, rows: np.ndarray, unit: np.ndarray, names: np.ndarray, reach: np.ndarray | None) -> None:
        """Chunks (ascending places in the slice) and the queries that may see one of them and are in reach."""
        near = np.ones(len(self.bar), bool) if reach is None else reach >= self.bar
        if self.filtered:
            near &= self.queries.seeing(names)
        live, rough = np.flatnonzero(near), unit.T.astype(np.float32)
        width = max(1, CELLS // max(1, len(rows)))
        for at in range(0, len(live), width):
            some = live[at : at + width]
            hit = self.queries.rough[some] @ rough >= (self.bar[some] - self.queries.margin)[:, None]
            if self.filtered and self.queries.limited[some].any():
                # Only for this block: a slice by all queries would be gigabytes.
                hit &= self.queries.allowed(names, some).T
            self._keep(rows, unit, some, hit)
            if self._crowded():
                self._shrink()

    def _keep(self, rows: np.ndarray, unit: np.ndarray, asked: np.ndarray, hit: np.ndarray) -> None:
        """Look at the queries ``asked`` (rows of ``hit``) and the chunks (columns) that may reach their bar."""
        owner, chunk = np.divmod(np.flatnonzero(hit), hit.shape[1])
        many = np.flatnonzero(np.bincount(owner, minlength=len(asked)) > self.k)
        if len(many):
            exact = np.round(self.queries.unit[asked[many]] @ unit.T, SCORE_DIGITS)
            hit[many] &= _first_of_ties(np.where(hit[many], exact, -np.inf), self.k)
            owner, chunk = np.divmod(np.flatnonzero(hit), hit.shape[1])
        for at in range(0, len(owner), PAIRS):
            q, c = asked[owner[at : at + PAIRS]], chunk[at : at + PAIRS]
            score = np.round(np.einsum("ij,ij->i", self.queries.unit[q], unit[c]), SCORE_DIGITS)
            kept = score >= self.bar[q]
            if kept.any():
                self.parts.append((q[kept].astype(np.int32), self.seen + rows[c[kept]], score[kept]))
                self.held += int(kept.sum())

    def _shrink(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(query, chunk id, score) of the k best of every query, best first; ties by id."""
        owner, chunk, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        used, at = np.unique(chunk, return_inverse=True)
        ids = pa.concat_arrays(self.ids).take(pa.array(used))
        place = np.empty(len(used), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(used))
        order = np.lexsort((place[at], -score, owner))
        runs = np.flatnonzero(np.diff(owner[order], prepend=-1))
        sizes = np.diff(runs, append=len(order))
        nth = np.arange(len(order)) - np.repeat(runs, sizes)
        kth = order[nth == self.k - 1]
        self.bar[owner[kth]] = score[kth]
        best = order[nth < self.k]
        self.parts, self.held = [(owner[best], chunk[best], score[best])], len(best)
        return owner[best], ids.take(pa.array(at[best])), score[best]

    def _forget(self) -> None:
        """Drop the ids of chunks that are not among the best; between two slices."""
        if self.parts:
            self._shrink()
            owner, chunk, score = self.parts[0]
            used, at = np.unique(chunk, return_inverse=True)
            self.ids, self.parts = [pa.concat_arrays(self.ids).take(pa.array(used))], [(owner, at, score)]
            self.seen = len(used)
        else:
            self.ids, self.seen = [], 0
        self.limit = 2 * self.seen + HELD_IDS

    def result(self, id_type: pa.DataType) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        owner, chunk, score = self._shrink()
        columns = [self.queries.ids.take(pa.array(owner)), chunk.cast(id_type), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=["_q", "_c", "_s"])


class _PivotLeaders(_Leaders):
    """The same for many queries: chunks near one pivot are ruled out together.

    On unit vectors the angle between a query and a chunk is at least the
    query's angle to the pivot less the group's radius, so a query whose k-th
    similarity is above the cosine of that needs no product with the group.
    """

    def __init__(self, queries: _Queries, k: int, floor: float, filtered: bool):
        super().__init__(queries, k, floor, filtered)
        self.step = SLICE_ROWS
        self.products = 0

    def _add(self, part: pa.RecordBatch) -> None:
        unit, names = _unit(_matrix(part.column(1))), _names(part)
        owner, pivots, radius = _groups(unit)
        for g in range(len(pivots)):
            rows = np.flatnonzero(owner == g)
            if len(rows):
                away = np.arccos(np.clip(self.queries.unit @ pivots[g], -1, 1))
                self._meet(rows, unit[rows], names[rows], np.cos(np.maximum(away - radius[g], 0)) + SLACK)

    def _keep(self, rows: np.ndarray, unit: np.ndarray, asked: np.ndarray, hit: np.ndarray) -> None:
        self.products += hit.size
        super()._keep(rows, unit, asked, hit)


def _groups(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each row, pivots, largest angle of a group's rows to its pivot)."""
    real = np.flatnonzero(np.abs(unit).sum(axis=1) > 0)
    if not len(real):
        return np.zeros(len(unit), np.int64), np.zeros((1, unit.shape[1])), np.array([np.pi])
    pivots = unit[real[np.unique(np.linspace(0, len(real) - 1, PIVOTS).astype(int))]]
    near = unit @ pivots.T
    owner = near.argmax(axis=1)
    angle = np.arccos(np.clip(near[np.arange(len(unit)), owner], -1, 1))
    # A vector without direction or with a component that is no number rules nothing out.
    angle[~np.isfinite(angle)] = np.pi
    angle[np.abs(unit).sum(axis=1) == 0] = np.pi
    radius = np.zeros(len(pivots))
    np.maximum.at(radius, owner, angle)
    return owner, pivots, radius


def nearest_chunks(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = DEFAULT_K,
    floor: float = MIN_SIMILARITY,
    query_id: str = "query_id",
    chunk_id: str = "vector_id",
    query_vector: str = "embedding",
    chunk_vector: str = "embedding",
    targets: str | None = None,
    source: str = "source_name",
    max_broadcast: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Cosine top-k per query: query_id, chunk_id, similarity, rank.

    Equal similarities (nine digits) are ordered by chunk id. With ``targets``,
    an array column of the queries, a query that lists sources sees only those.
    Further filters belong on ``chunks`` before the call, where they reach the
    scan.
    """
    filtered = targets is not None
    asked = queries.select(
        F.col(query_id).alias("q"),
        F.col(query_vector).alias("v"),
        (F.col(targets) if filtered else F.lit(None).cast("array<string>")).alias("t"),
    ).filter("v is not null")
    offered = chunks.select(
        F.col(chunk_id).alias("c"),
        F.col(chunk_vector).alias("v"),
        (F.col(source) if filtered else F.lit("")).alias("s"),
    ).filter("v is not null")
    q_type = asked.schema["q"].dataType.simpleString()
    c_type = offered.schema["c"].dataType.simpleString()
    schema = f"_c {c_type}, _s double"
    id_type = to_arrow_type(asked.schema["q"].dataType)
    chunk_type = to_arrow_type(offered.schema["c"].dataType)

    # At most one row above the bound reaches the driver.
    head = asked.limit(max_broadcast + 1).collect()
    if not head:
        scored = offered.sparkSession.createDataFrame([], f"_q {q_type}, {schema}")
    elif len(head) <= max_broadcast:
        held = _Queries(
            pa.array([r.q for r in head], id_type),
            np.array([r.v for r in head], np.float64),
            [r.t for r in head],
        )
        shared = offered.sparkSession.sparkContext.broadcast(held)

        def local_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaders = _Leaders(shared.value, k, floor, filtered)
            for batch in batches:
                leaders.add(batch)
            found = leaders.result(chunk_type)
            if found is not None:
                yield found

        scored = offered.mapInArrow(local_best, f"_q {q_type}, {schema}")
    else:
        scored = None

    wide = len(offered.inputFiles()) > TREE_FROM_FILES
    best = (
        _in_rounds(asked, offered, k, floor, filtered, schema, wide)
        if scored is None
        else _ranked(scored, k, wide)
    )
    return best.select(
        F.col("_q").alias(query_id),
        F.col("_c").alias(chunk_id),
        F.col("_s").alias("similarity"),
        "rank",
    )


def _in_rounds(
    asked: DataFrame, offered: DataFrame, k: int, floor: float, filtered: bool, schema: str, wide: bool
) -> DataFrame:
    """The k best of every query of a large table, round after round.

    Queries of one vector and the same targets are searched once. A round holds
    about ``ROUND_BYTES`` of queries and ``ROUND_LEADERS`` results; only that much
    is on the driver or in a broadcast at a time. Its results are final, since no
    query is in two rounds, and are written.
    """
    seen = F.coalesce("t", F.array().cast("array<string>")).alias("t")
    keyed = materialize(asked.select("q", "v", seen), "asked")
    sought = materialize(keyed.select("v", "t").distinct().withColumn("no", F.monotonically_increasing_id()), "sought")
    members = materialize(keyed.join(sought, ["v", "t"]).select("q", "no"), "members")
    size = F.size("v") * 8 + F.coalesce(F.length(F.array_join("t", "")), F.lit(0)) * 2 + 64
    whole = sought.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    rounds = max(-(-whole["bytes"] // ROUND_BYTES), -(-whole["n"] * k // ROUND_LEADERS))
    dealt = sought.withColumn("round", F.pmod(F.xxhash64("no"), F.lit(rounds)).cast("int"))
    dealt = materialize(dealt.repartition("round"), "rounds")
    chunk_type = to_arrow_type(offered.schema["c"].dataType)
    found = []
    for turn in range(rounds):
        rows = dealt.filter(F.col("round") == turn).collect()
        if not rows:
            continue
        held = _Queries(
            pa.array([r.no for r in rows], pa.int64()),
            np.array([r.v for r in rows], np.float64),
            [r.t for r in rows],
        )
        del rows
        shared = offered.sparkSession.sparkContext.broadcast(held)

        def local_best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            leaders = _PivotLeaders(shared.value, k, floor, filtered)
            for batch in batches:
                leaders.add(batch)
            best = leaders.result(chunk_type)
            if best is not None:
                yield best

        found.append(materialize(_ranked(offered.mapInArrow(local_best, f"_q bigint, {schema}"), k, wide), "nearest"))
        shared.unpersist()
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.withColumnRenamed("_q", "no").join(members, "no").withColumnRenamed("q", "_q")


def _ranked(scored: DataFrame, k: int, wide: bool) -> DataFrame:
    order = [F.col("_s").desc(), F.col("_c")]
    return top_k(scored, ["_q"], order, k, salt_by="_c" if wide else None)
