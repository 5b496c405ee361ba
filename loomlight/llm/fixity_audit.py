"""Merkle fixity audit of record replicas.

A replica is a table of WARC records in files, each at an offset. A record's
hash covers its header and payload. Records that start in one range of
``2**RANGE_BITS`` bytes hash together, in order of offset; ``2**STEP_BITS``
such ranges hash into one, and so on up to the file's root; files in order of
their number hash on into the root of the collection. Two replicas compare
roots first. Where they differ, the audit descends level by level and follows
only the branches whose hashes mismatch, down to single records.

Everything is DataFrame code. A node holds at most a range's records or
``2**STEP_BITS`` children, so no group grows with the data; texts are hashed
where they are read and never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlight.lineage import materialize

FILE_BITS = 11  # ids of one file: 2**11, so at most as many distinct records
RANGE_BITS = 16
STEP_BITS = 4


def warc_records(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", payload: Column | None = None) -> DataFrame:
    """``file``, ``n``, ``record_id``, ``header``, ``payload``: one record per row.

    ``file`` is the id without its low bits (null ids: -1), ``n`` orders a file.
    A null text is a metadata record without payload, apart from an empty
    resource. ``payload`` replaces the text's bytes, its length included.
    """
    text = F.col(text_col).cast("string")
    body = F.coalesce(text if payload is None else payload, F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("none"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(text.isNull(), "metadata").otherwise("resource"),
        F.lit("\r\nWARC-Record-ID: <urn:doc:"),
        name,
        F.lit(">\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    number = F.col(id_col).cast("long")
    return docs.select(
        F.coalesce(F.shiftright(number, FILE_BITS), F.lit(-1)).cast("long").alias("file"),
        F.coalesce(number, F.lit(-1)).alias("n"),
        name.alias("record_id"),
        header.alias("header"),
        body.alias("payload"),
    )


def record_hash(header: Column, payload: Column) -> Column:
    return F.sha2(F.encode(F.concat(header, payload), "utf-8"), 256)


def hashed_records(records: DataFrame) -> DataFrame:
    """``file``, ``n``, ``record_id``, ``size`` in bytes and ``hash``; payloads end here."""
    size = F.octet_length("header") + F.octet_length("payload") + 4
    return records.select(
        "file", "n", "record_id", size.cast("long").alias("size"), record_hash(F.col("header"), F.col("payload")).alias("hash")
    )


def placed_records(hashed: DataFrame) -> DataFrame:
    """The same with ``offset``, where each record starts in its file.

    Only hashes and sizes are sorted. Records that agree in id and hash stand
    one after the other.
    """
    before = Window.partitionBy("file").orderBy("n", "record_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def _node(children: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(F.array_sort(children), lambda c: c["hash"])), 256)


def build_tree(records: DataFrame) -> list[DataFrame]:
    """Levels from the records to the root, of ``file``, ``position``, ``hash``, ``up_file``, ``up``.

    ``records`` needs file, offset, record_id and hash. (``up_file``, ``up``)
    names a node's parent; above the files' roots ``up_file`` is null. An empty
    replica has a root without children.
    """
    none = F.lit(None).cast("long")
    leaves = records.select(
        "file", F.col("offset").alias("position"), "record_id", "hash",
        F.col("file").alias("up_file"), F.shiftright("offset", RANGE_BITS).alias("up"),
    )
    leaves = materialize(leaves, "leaves")
    levels = [leaves]
    low = leaves.select("up_file", "up", F.struct("position", "record_id", "hash").alias("child"))
    deepest = leaves.agg(F.coalesce(F.max("up"), F.lit(0))).first()[0]
    while True:
        inside = deepest > 0
        nodes = low.groupBy(F.col("up_file").alias("file"), F.col("up").alias("position")).agg(
            _node(F.collect_list("child")).alias("hash")
        )
        if inside:
            up_file, up = F.col("file"), F.shiftright("position", STEP_BITS)
        else:
            up_file, up = none, F.shiftright("file", STEP_BITS)
        nodes = materialize(nodes.select("file", "position", "hash", up_file.alias("up_file"), up.alias("up")), "nodes")
        levels.append(nodes)
        child = F.struct(F.col("position") if inside else F.col("file").alias("position"), "hash").alias("child")
        low = nodes.select("up_file", "up", child)
        if not inside:
            break
        deepest >>= STEP_BITS
    span = nodes.agg(F.min("up"), F.max("up")).first()
    least, most = (span[0] or 0), (span[1] or 0)
    while least != most and (least, most) != (-1, 0):
        nodes = low.groupBy("up").agg(_node(F.collect_list("child")).alias("hash"))
        nodes = nodes.select(
            none.alias("file"), F.col("up").alias("position"), "hash", none.alias("up_file"), F.shiftright("up", STEP_BITS).alias("up")
        )
        nodes = materialize(nodes, "nodes")
        levels.append(nodes)
        low = nodes.select("up_file", "up", F.struct("position", "hash").alias("child"))
        least, most = least >> STEP_BITS, most >> STEP_BITS
    root = low.agg(_node(F.collect_list("child")).alias("hash"))
    levels.append(root.select(none.alias("file"), F.lit(0).cast("long").alias("position"), "hash", none.alias("up_file"), none.alias("up")))
    return levels


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    condition = a[names[0]].eqNullSafe(b[names[0]])
    for name in names[1:]:
        condition = condition & a[name].eqNullSafe(b[name])
    return condition


def audit(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """``file``, ``offset``, ``record_id``, ``finding``, ``first_hash``, ``second_hash``.

    ``finding`` is altered, missing (from the second replica) or extra. Equal
    roots end the audit after one comparison. Trees of different heights are
    compared from the height that both have; the taller one's top is skipped.
    """
    roots = [levels[-1].first()["hash"] for levels in (first, second)]
    height = min(len(first), len(second)) - 1
    a, b = first[:height], second[:height]
    if roots[0] == roots[1]:
        a, b = [a[0].limit(0)], [b[0].limit(0)]
    wrong: DataFrame | None = None
    for level in range(len(a) - 1, 0, -1):
        x, y = a[level], b[level]
        if wrong is not None:
            x = x.join(wrong, _same(x, wrong, "up_file", "up"), "left_semi")
            y = y.join(wrong, _same(y, wrong, "up_file", "up"), "left_semi")
        x = x.select("file", "position", F.col("hash").alias("x"))
        y = y.select(F.col("file").alias("f"), F.col("position").alias("p"), F.col("hash").alias("y"))
        both = x.join(y, x["file"].eqNullSafe(y["f"]) & (x["position"] == y["p"]), "full_outer")
        wrong = both.filter(~F.col("x").eqNullSafe(F.col("y"))).select(
            F.coalesce("file", "f").alias("up_file"), F.coalesce("position", "p").alias("up")
        )
        wrong = materialize(wrong, "mismatches")
    x, y = a[0], b[0]
    if wrong is not None:
        x = x.join(wrong, _same(x, wrong, "up_file", "up"), "left_semi")
        y = y.join(wrong, _same(y, wrong, "up_file", "up"), "left_semi")
    x = x.select("file", F.col("position").alias("offset"), "record_id", F.col("hash").alias("first_hash"))
    y = y.select(
        F.col("file").alias("f"), F.col("position").alias("o"), F.col("record_id").alias("r"), F.col("hash").alias("second_hash")
    )
    both = x.join(y, (x["file"] == y["f"]) & (x["offset"] == y["o"]) & (x["record_id"] == y["r"]), "full_outer")
    finding = F.when(F.col("second_hash").isNull(), "missing").when(F.col("first_hash").isNull(), "extra").otherwise("altered")
    return both.filter(~F.col("first_hash").eqNullSafe(F.col("second_hash"))).select(
        F.coalesce("file", "f").alias("file"),
        F.coalesce("offset", "o").alias("offset"),
        F.coalesce("record_id", "r").alias("record_id"),
        finding.alias("finding"),
        "first_hash",
        "second_hash",
    )
