"""Exact n-gram Jaccard join by prefix trees.

Shingles are ordered over the whole table, rarest first. Two sets that reach
the threshold share a shingle within the first n - ceil(threshold * n) + 1 of
either, so only those meet:

1. Batches send the sorted names of their shingles to hash buckets, packed. A
   bucket counts the documents of each name and answers with the names that
   several documents hold; all others are rarer and fill the front of a set.
   Names that could fill a bucket alone (at most ``HOT_NAMES`` by their share)
   are known beforehand, are ordered last and are never gathered.
2. Each document lists the shared names inside its prefix, if any is left
   there. Sets that share one fall into one block; a block's sets meet once,
   not once per shared name.
3. A task stores the sets of a block in a prefix tree by the same order of
   rare first, and walks it with each set: paths that begin alike share their
   partial overlap, and a subtree ends the walk where the overlap so far plus
   the shorter remaining length falls short. Subtrees whose sets are all linked
   with the set already are skipped, so a group of copies costs about one walk.
   A block above ``block_limit`` sets is dealt to tasks as pairs of slices.
4. Links join sets to components. Documents with equal sets never meet; they
   are members of one set.

A set of shingles is named by 64 bits, and so is each shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.lineage import materialize
from loomlight.llm import flat
from loomlight.llm.graph import components
from loomlight.llm.repeats import word_pieces
from loomlight.llm.rows import KEYS, key_columns, map_batches, map_groups

U64 = np.uint64
SHINGLE = 4
PERCENT = 85
BLOCK_LIMIT = 4000
HOT_NAMES = 1000
BATCH = 1 << 21  # bytes of text whose names are sent together


def shingle_sets(batch: pa.RecordBatch, size: int):
    """(rows, sorted distinct shingles, owner of each) of slices of a batch.

    A text of fewer words is one shingle as a whole; one without words is empty.
    """
    column = batch.column("text")
    data, starts, ends = flat.buffers(column)
    lowered = pa.array([], pa.string())
    if len(starts):
        low = flat.lower(data[int(starts[0]) : int(ends[-1])])
        offsets = np.concatenate([starts - starts[0], [ends[-1] - starts[0]]]).astype(np.int64)
        lowered = pa.Array.from_buffers(
            pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low)]
        )
    view = pa.RecordBatch.from_arrays([lowered], names=["text"])
    for rows, hashes, start, end, _ in word_pieces(view, "text", BATCH):
        sums = flat.Hashes(hashes)
        count = np.where(end > start, np.maximum(end - start - size + 1, 1), 0)
        owner = np.repeat(np.arange(len(rows)), count)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]
        names = sums.of(first, np.minimum(first + size, end[owner]))
        order = np.lexsort((names, owner))
        owner, names = owner[order], names[order]
        new = np.ones(len(names), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (names[1:] != names[:-1])
        yield rows, names[new], owner[new]


def _signatures(names: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit name) of each of ``n`` sets."""
    size = np.bincount(owner, minlength=n)
    sums = np.zeros(len(names) + 1, U64)
    np.cumsum(flat.mix(names ^ U64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    stop = np.cumsum(size)
    return size, flat.mix(sums[stop] - sums[stop - size] + flat.mix(size.astype(U64)))


def _sets(batch: pa.RecordBatch, size: int) -> list[dict]:
    out = []
    k1, k2 = (batch.column(k).to_numpy() for k in KEYS)
    for rows, names, owner in shingle_sets(batch, size):
        n, sid = _signatures(names, owner, len(rows))
        out.append({"row": batch.column("row").take(pa.array(rows)), "k1": k1[rows], "k2": k2[rows], "n": n, "sid": sid.view(np.int64)})
    return out


def _frequent(batch: pa.RecordBatch, size: int) -> list[dict]:
    """Names that hold more than their share of a slice."""
    out = []
    for _, names, _owner in shingle_sets(batch, size):
        name, count = np.unique(names, return_counts=True)
        often = count * HOT_NAMES > len(names)
        often &= count > 64
        out.append({"name": name[often].view(np.int64), "count": count[often]})
    return out


MESSAGE = "bucket bigint, shard bigint, kind int, payload binary"


def _send(batch: pa.RecordBatch, size: int, buckets: int, hot: np.ndarray, turn: list[int]) -> list[dict]:
    """Packed (name, document) entries by bucket, and a card for each shard."""
    out = []
    k1 = batch.column("k1").to_numpy()
    k2 = batch.column("k2").to_numpy()
    for rows, all_names, all_owner in shingle_sets(batch, size):
        for lo in range(0, len(rows), 1 << 16):
            part = (all_owner >= lo) & (all_owner < lo + (1 << 16))
            names, owner = all_names[part], all_owner[part] - lo
            here = rows[lo : lo + (1 << 16)]
            n, sid = _signatures(names, owner, len(here))
            # Rows, task and turn name a shard: a task that runs again gives it the same name.
            keys = flat.mix(k1[here].view(U64) ^ flat.mix(k2[here].view(U64)) + np.arange(len(here), dtype=U64))
            turn[0] += 1
            place = np.array([(TaskContext.get().partitionId() << 32) + turn[0]], U64)
            shard = (np.bitwise_xor.reduce(keys) ^ flat.mix(place)).view(np.int64)[0]
            at_hot = np.searchsorted(hot, names) if len(hot) else np.zeros(len(names), np.int64)
            is_hot = hot[np.minimum(at_hot, len(hot) - 1)] == names if len(hot) else np.zeros(len(names), bool)
            card = [
                np.array([len(here), int(is_hot.sum())], np.int64),
                n.astype(np.int64),
                sid.view(np.int64),
                owner[is_hot].astype(np.int64),
                names[is_hot].view(np.int64),
            ]
            bucket = (names % U64(buckets)).astype(np.int64)
            # 48 bits of the name besides its bucket, and the document.
            entry = ((flat.mix(names) >> U64(16)) << U64(16)) | owner.astype(U64)
            bucket, entry = bucket[~is_hot], entry[~is_hot]
            order = np.lexsort((entry, bucket))
            bucket, entry = bucket[order], entry[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
            stop = np.concatenate([at[1:], [len(bucket)]]) if len(bucket) else bucket
            blobs = [entry[a:b].tobytes() for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
            out.append(
                {
                    "bucket": np.concatenate([bucket[at], [abs(int(shard)) % buckets]]),
                    "shard": np.full(len(at) + 1, shard),
                    "kind": np.concatenate([np.zeros(len(at), np.int32), [1]]).astype(np.int32),
                    "payload": [*blobs, b"".join(a.tobytes() for a in card)],
                }
            )
    return out


def _shared(table: pa.Table) -> list[dict]:
    """For each shard the entries whose name several documents hold, with the count."""
    bucket, shard = table.column("bucket").to_numpy(), table.column("shard").to_numpy()
    kind, payload = table.column("kind").to_numpy(), table.column("payload").to_pylist()
    cards = np.flatnonzero(kind == 1)
    out = []
    if len(cards):
        out.append({"bucket": bucket[cards], "shard": shard[cards], "kind": kind[cards], "payload": [payload[i] for i in cards]})
    sent = np.flatnonzero(kind == 0)
    for b in np.unique(bucket[sent]):
        mine = sent[bucket[sent] == b]
        parts = [np.frombuffer(payload[i], U64) for i in mine]
        entry = np.concatenate(parts)
        part = np.repeat(np.arange(len(mine)), [len(p) for p in parts])
        order = np.argsort(entry, kind="stable")
        entry, part = entry[order], part[order]
        name = entry >> U64(16)
        new = np.concatenate([[True], name[1:] != name[:-1]])
        number = np.cumsum(new) - 1
        count = np.bincount(number)[number]
        several = count > 1
        entry, part, count = entry[several], part[several], count[several]
        order = np.argsort(part, kind="stable")
        entry, part, count = entry[order], part[order], count[order]
        at = np.searchsorted(part, np.arange(len(mine) + 1))
        rows = [i for i in range(len(mine)) if at[i + 1] > at[i]]
        if rows:
            out.append(
                {
                    "bucket": np.full(len(rows), b),
                    "shard": shard[mine[rows]],
                    "kind": np.zeros(len(rows), np.int32),
                    "payload": [
                        entry[at[i] : at[i + 1]].tobytes() + count[at[i] : at[i + 1]].astype(np.int64).tobytes()
                        for i in rows
                    ],
                }
            )
    return out


def _prefixes(table: pa.Table, percent: int) -> list[dict]:
    """Names within the prefix of each set, where it reaches shared names."""
    shard, bucket = table.column("shard").to_numpy(), table.column("bucket").to_numpy()
    kind, payload = table.column("kind").to_numpy(), table.column("payload").to_pylist()
    out = []
    for s in np.unique(shard):
        mine = np.flatnonzero(shard == s)
        card = next(np.frombuffer(payload[i], np.int64) for i in mine if kind[i] == 1)
        docs, n_hot = int(card[0]), int(card[1])
        n, sid = card[2 : 2 + docs], card[2 + docs : 2 + 2 * docs]
        hot_owner = card[2 + 2 * docs : 2 + 2 * docs + n_hot]
        hot_name = card[2 + 2 * docs + n_hot :]
        owners, names, ranks = [hot_owner], [hot_name.view(U64)], [np.full(n_hot, np.iinfo(np.int64).max)]
        for i in mine:
            if kind[i] == 1:
                continue
            both = np.frombuffer(payload[i], np.int64)
            entry = both[: len(both) // 2].view(U64)
            owners.append((entry & U64(0xFFFF)).astype(np.int64))
            names.append(flat.mix((entry >> U64(16)) ^ flat.mix(np.full(1, bucket[i], U64))))
            ranks.append(both[len(both) // 2 :])
        owner, name, rank = np.concatenate(owners), np.concatenate(names), np.concatenate(ranks)
        order = np.lexsort((name, rank, owner))
        owner, name = owner[order], name[order]
        known = np.bincount(owner, minlength=docs)
        place = np.arange(len(owner)) - (np.cumsum(known) - known)[owner]
        # Names that are not listed stand in one document only and come first.
        prefix = n - -(-percent * n // 100) + 1
        within = place + (n - known)[owner] < prefix[owner]
        out.append({"name": name[within].view(np.int64), "sid": sid[owner[within]]})
    return out


class PrefixTree:
    """Sets of ranks, each ascending, stored by their common beginnings.

    A node is a path of ranks without a branch: ``lo:hi`` of one of its sets
    (``of``); ``sets`` end at or below it.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.order = order
        shared = [0]
        for a, b in zip(order, order[1:], strict=False):
            x, y = sets[a], sets[b]
            m = min(len(x), len(y))
            same = x[:m] == y[:m]
            shared.append(m if same.all() else int(same.argmin()))
        shared.append(0)
        self.lengths = np.array([len(sets[i]) for i in order])
        self.top = 2 + max((int(s[-1]) for s in sets if len(s)), default=0)
        self.root = self._node(0, len(order), 0, shared)

    def _node(self, first: int, stop: int, lo: int, shared: list[int]):
        """(set, lo, hi, leaves first, stop, shortest, longest, children), built without recursion."""
        root: list = []
        todo = [(first, stop, lo, root)]
        while todo:
            a, b, low, parent = todo.pop()
            inner = shared[a + 1 : b]
            high = min(inner) if inner else len(self.sets[self.order[a]])
            lengths = self.lengths[a:b]
            children: list = []
            parent.append((self.order[a], low, high, a, b, int(lengths.min()), int(lengths.max()), children))
            if b - a == 1:
                continue
            cuts = [a, *(a + 1 + i for i, v in enumerate(inner) if v == high), b]
            todo += [(c, d, high, children) for c, d in zip(cuts, cuts[1:], strict=False)]
        return root[0]

    def partners(self, member: np.ndarray, done: np.ndarray, percent: int):
        """Positions in ``order`` of sets that reach the threshold with ``member``.

        ``done`` marks positions that need no answer.
        """
        size = len(member)
        within = np.zeros(max(self.top, int(member[-1]) + 2 if size else 0), bool)
        within[member] = True
        before = np.concatenate([[0], np.cumsum(within)])
        left = np.concatenate([[0], np.cumsum(done)])
        todo = [(self.root, 0)]
        while todo:
            (of, lo, hi, a, b, shortest, longest, children), overlap = todo.pop()
            if left[b] - left[a] == b - a:
                continue
            if 100 * min(size, longest) < percent * max(size, shortest):
                continue
            path = self.sets[of][lo:hi]
            overlap += int(within[path].sum())
            # The overlap cannot exceed what is left of either, after this path.
            gone = int(before[path[-1] + 1]) if len(path) else 0
            reach = overlap + (min(size - gone, longest - hi) if len(path) else min(size, longest - hi))
            if (100 + percent) * reach < percent * (size + shortest):
                continue
            if b - a == 1:
                if (100 + percent) * overlap >= percent * (size + longest):
                    yield a
                continue
            todo += [(child, overlap) for child in children]


def _block_links(table: pa.Table, percent: int) -> dict | None:
    """Links that join the sets of each block to its components."""
    group = table.column("group").to_numpy()
    sid, half = table.column("sid").to_numpy(), table.column("half").to_numpy()
    column = table.column("names").combine_chunks()
    raw, starts, ends = flat.buffers(column)
    left, right = [], []
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        keys, at = np.unique(sid[a:b], return_index=True)
        if len(keys) < 2:
            continue
        rows = at + a
        names = [np.frombuffer(raw[int(starts[i]) : int(ends[i])].tobytes(), U64) for i in rows]
        every, number, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        rank = np.empty(len(every), np.int64)
        rank[np.lexsort((every, count))] = np.arange(len(every))
        number = rank[number]
        stops = np.cumsum([len(x) for x in names])
        sets = [np.sort(x) for x in np.split(number, stops[:-1])]
        tree = PrefixTree(sets)
        position = np.argsort(tree.order)
        root = np.arange(len(sets))  # by position in the tree's order
        halves = half[rows][tree.order]
        for i in range(len(sets)):
            p = int(position[i])
            # In a pair of slices only the sets of the other one matter.
            done = (root == root[p]) | ((halves == halves[p]) & (halves >= 0))
            if done.all():
                continue
            for q in tree.partners(sets[i], done, percent):
                if root[q] != root[p]:
                    left.append(keys[i])
                    right.append(keys[tree.order[q]])
                    root[root == root[q]] = root[p]
    if not left:
        return None
    return {"u": np.array(left), "v": np.array(right)}


def _set_names(batch: pa.RecordBatch, size: int) -> list[dict]:
    """The shingles of each text, packed."""
    out = []
    sid, block = batch.column("sid"), batch.column("block")
    for rows, names, owner in shingle_sets(batch, size):
        at = np.searchsorted(owner, np.arange(len(rows) + 1))
        take = pa.array(rows)
        out.append(
            {
                "sid": sid.take(take),
                "block": block.take(take),
                "names": [names[at[i] : at[i + 1]].tobytes() for i in range(len(rows))],
            }
        )
    return out


def link_blocks(docs: DataFrame, text_col: str, id_col: str, size: int, percent: int):
    """(rows with words, ``sid`` / ``block`` of sets that share a prefix name)."""
    spark = docs.sparkSession
    texts = docs.select(*key_columns(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    texts = texts.filter(F.length("text") > 0)
    often = (
        map_batches(texts, lambda batch: _frequent(batch, size), "name bigint, count bigint")
        .groupBy("name")
        .agg(F.sum("count").alias("count"))
        .orderBy(F.desc("count"), "name")
        .limit(HOT_NAMES)
    )
    hot = np.sort(np.array([r["name"] for r in often.collect()], np.int64).view(U64))
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    turn = [0]  # of a task: each one gets a copy of its own
    sent = map_batches(texts, lambda batch: _send(batch, size, buckets, hot, turn), MESSAGE)
    shared = map_groups(sent, "bucket", _shared, MESSAGE, rows=4000)
    prefixes = map_groups(
        shared, "shard", lambda table: _prefixes(table, percent), "name bigint, sid bigint", rows=2000
    )
    prefixes = materialize(prefixes.distinct(), "prefixes")
    heads = prefixes.groupBy("name").agg(F.min("sid").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = prefixes.join(heads, "name").select(F.col("sid").alias("u"), F.col("head").alias("v"))
    blocks = materialize(components(edges).select(F.col("node").alias("sid"), F.col("root").alias("block")), "blocks")
    return texts, blocks


def similarity_classes(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    size: int = SHINGLE,
    percent: int = PERCENT,
    block_limit: int = BLOCK_LIMIT,
) -> DataFrame:
    """``id``, ``k1``, ``k2``, ``n_shingles``, ``component_id`` and ``root`` of every row.

    ``component_id`` is the least id reachable by links, the own one included;
    ids that are null never count as least, unless all are. Rows with equal
    sets are linked. Null and wordless texts have no shingles, no links and no
    ``root``. An empty table gives an empty one.
    """
    texts, blocks = link_blocks(docs, text_col, id_col, size, percent)
    ids = docs.select(
        F.struct(F.col(id_col).alias("id")).alias("row"),
        *key_columns(id_col, text_col),
        F.col(text_col).cast("string").alias("text"),
    )
    fields = f"row {ids.schema['row'].dataType.simpleString()}, k1 bigint, k2 bigint, n bigint, sid bigint"
    members = materialize(map_batches(ids, lambda batch: _sets(batch, size), fields), "members")
    sets = (
        members.filter("n > 0")
        .groupBy("sid")
        .agg(F.min("row.id").alias("least"), F.min(F.struct("k1", "k2")).alias("k"))
    )
    chosen = blocks.join(sets.select("sid", "k.k1", "k.k2"), "sid")
    named = map_batches(
        texts.join(chosen, ["k1", "k2"]).select("sid", "block", "text"),
        lambda batch: _set_names(batch, size),
        "sid bigint, block bigint, names binary",
    )
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("members"))
    slices = F.ceil(F.col("members") / F.lit(block_limit / 2)).cast("int")
    cut = named.join(sizes, "block").withColumn("r", F.when(F.col("members") > block_limit, slices).otherwise(1))
    own = F.pmod(F.xxhash64("sid"), F.col("r")).cast("int")
    # Each slice of a block meets each other slice, and itself.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("r") - 1),
        lambda other: F.struct(
            F.xxhash64("block", F.least(other, own), F.greatest(other, own)).alias("group"),
            F.when(other == own, F.lit(-1)).otherwise((own > other).cast("int")).alias("half"),
        ),
    )
    dealt = cut.select("sid", "names", F.explode(pairs).alias("g")).select("g.group", "g.half", "sid", "names")
    links = map_groups(dealt, "group", lambda table: _block_links(table, percent), "u bigint, v bigint", rows=2000)
    roots = components(links)
    rooted = sets.join(roots, sets["sid"] == roots["node"], "left").select(
        "sid", F.coalesce("root", "sid").alias("root"), "least"
    )
    rooted = materialize(rooted, "sets")
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(by_root, "root").select("sid", "root", "component_id")
    return members.join(found.withColumnRenamed("sid", "set"), F.col("sid") == F.col("set"), "left").select(
        F.col("row.id").alias("id"),
        "k1",
        "k2",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "row.id").alias("component_id"),
        "root",
    )


def keep_one_per_group(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose text is the first, by id, of its group.

    Repeated rows (equal id and text) count as one. Rows without words belong
    to no group and stay.
    """
    classes = similarity_classes(docs, text_col, id_col, **options)
    grouped = classes.filter("root is not null")
    # Ids before none, then the least id; keys decide between equal ids.
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("k1"), F.col("k2"))
    first = grouped.groupBy("root").agg(F.min(order).alias("first")).select("first.k1", "first.k2")
    alone = classes.filter("root is null").select("k1", "k2").distinct()
    stay = materialize(first.unionByName(alone), "stay")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key_columns(id_col, text_col))
    kept = rows.join(stay, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
