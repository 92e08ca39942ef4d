"""Operator 5: sharding by k-d tree partitioning, with DataFrame functions only.

Law ``bytes``: the shards' sizes are nearly equal. Points are texts (equal texts are one point and so stay together),
weighted by the bytes of their rows; their metadata dimensions are size (log scale), source and language of the group's
rows. The tree splits a node of k leaves into k // 2 and the rest at the matching weighted quantile of its widest
dimension (its range as a share of the whole table's range), until every node is a leaf of about total / shards bytes.
Points that tie on the dimension are ordered by the hash of their text.

The quantile is distributed: bytes are summed by node and 16 bits of the sort key, the bin in which the quantile falls
is looked up by running sums over blocks of 256 bins and then inside a block, and only that bin is refined by the next
bits until its weight no longer matters. Of each node only the widths and the cut reach the driver, at most ``shards``
rows.

A group of copies heavier than ``PIECE`` of a shard (there are at most shards / PIECE such groups, so their list may be
broadcast) is dealt into pieces by a hash of the id. Pieces are neighbours in every order, so that such a group is
only divided where a shard's edge falls inside it.

Slots are gapless: rows are counted by shard and hash bucket, running sums of these few counts give each bucket's first
slot, and rows are numbered inside their buckets only.

Defined results: null texts have 0 bytes (size 8) and crc 0; an empty table gives no rows; repeated rows of an id each
get a slot; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.runtime import materialize

SHARDS = 24
PIECE = 0.01
FINE = 0.001
ROWS_IN_BUCKET = 100_000
DIMENSIONS = ("size", "source", "lang")
_Q, _HASH, _PIECES = 16, 35, 12  # bits of the sort key: dimension, text hash, piece


def _rows(df: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    pick = {c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string") for c in ("source", "lang")}
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit("")), F.octet_length(text)).alias("group"),
        pick["source"].alias("source"),
        pick["lang"].alias("lang"),
    )


def _key(dimension: str) -> Column:
    tie = F.shiftleft(F.shiftrightunsigned("group", 64 - _HASH), _PIECES) + F.col("piece")
    return F.shiftleft(F.col(f"q_{dimension}"), _HASH + _PIECES) + tie


class _Tree:
    """The splits found so far. A node is named by its first leaf, leaves are numbered from 0."""

    def __init__(self, shards: int):
        self.shards = shards
        self.leaves = {0: shards}  # first leaf: number of leaves
        self.cuts: dict[tuple[int, int], tuple[str, int]] = {}

    def open_nodes(self) -> dict[int, int]:
        return {first: count for first, count in self.leaves.items() if count > 1}

    def split(self, cuts: dict[int, tuple[str, int]]) -> None:
        """cuts: node to (dimension, last key of the left side)."""
        for first, count in self.open_nodes().items():
            self.cuts[first, count] = cuts[first]
            self.leaves[first], self.leaves[first + count // 2] = count // 2, count - count // 2

    @property
    def node(self) -> Column:
        """A point's node, one comparison for each level."""

        def build(first: int, count: int) -> Column:
            if (first, count) not in self.cuts:
                return F.lit(first)
            dimension, cut = self.cuts[first, count]
            half = count // 2
            return F.when(F.col(f"k_{dimension}") <= cut, build(first, half)).otherwise(build(first + half, count - half))

        return build(0, self.shards)


def _cuts(points: DataFrame, tree: _Tree, widths: dict[str, float], fine: float) -> dict[int, tuple[str, int]]:
    """The weighted quantile of the widest dimension of each open node."""
    nodes = tree.open_nodes()
    held = points.withColumn("node", tree.node).filter(F.col("node").isin(list(nodes)))
    stats = held.groupBy("node").agg(
        F.sum("bytes").alias("bytes"),
        *[(F.max(f"q_{d}") - F.min(f"q_{d}")).alias(d) for d in DIMENSIONS],
    )
    chosen, wanted = {}, {}
    for row in stats.collect():
        chosen[row.node] = max(DIMENSIONS, key=lambda d: row[d] / (widths[d] or 1))
        count = nodes[row.node]
        wanted[row.node] = row.bytes * (count // 2) / count
    for node in nodes:
        if node not in chosen:  # a node without points: any cut will do
            chosen[node], wanted[node] = DIMENSIONS[0], 0.0
    key = F.lit(None).cast("long")
    for node, dimension in chosen.items():
        key = F.when(F.col("node") == node, F.col(f"k_{dimension}")).otherwise(key)
    keyed = held.select("node", key.alias("key"), "bytes")
    low, before = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0.0)  # the bin's first key, bytes below it
    cuts: dict[int, tuple[str, int]] = {}
    bits = _Q + _HASH + _PIECES
    while bits > 0 and len(cuts) < len(nodes):
        bits = max(0, bits - _Q)
        live = [n for n in nodes if n not in cuts]
        inside, target = F.lit(False), F.lit(0.0)
        for n in live:
            span = low[n] + (1 << min(62, bits + _Q)) - 1
            mine = F.col("node") == n
            inside = inside | (mine & F.col("key").between(low[n], span))
            target = F.when(mine, F.lit(wanted[n] - before[n])).otherwise(target)
        bins = keyed.filter(inside).groupBy("node", F.shiftright("key", bits).alias("bin")).agg(F.sum("bytes").alias("bytes"))
        # running sums in two levels: over blocks of bins, then inside a block, so that no task sorts all bins of a node
        bins = bins.withColumn("block", F.shiftright("bin", _Q // 2))
        blocks = bins.groupBy("node", "block").agg(F.sum("bytes").alias("sum"))
        before_block = Window.partitionBy("node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("node", "block", F.coalesce(F.sum("sum").over(before_block), F.lit(0)).alias("behind"))
        running = Window.partitionBy("node", "block").orderBy("bin")
        summed = bins.withColumn("inner", F.sum("bytes").over(running)).join(F.broadcast(blocks), ["node", "block"])  # 256 rows a node at most
        summed = summed.select("node", "bin", "bytes", (F.col("behind") + F.col("inner")).alias("upto"))
        hit = summed.filter(F.col("upto") >= target).groupBy("node").agg(F.min(F.struct("bin", "bytes", "upto")).alias("hit"))
        found = {r.node: r.hit for r in hit.collect()}
        for n in live:
            if n not in found:
                cuts[n] = (chosen[n], low[n])
                continue
            hit_bin = found[n]
            first = hit_bin["bin"] << bits
            below = before[n] + hit_bin["upto"] - hit_bin["bytes"]
            if bits == 0 or hit_bin["bytes"] <= fine:
                over = below + hit_bin["bytes"] - wanted[n]
                take = over <= wanted[n] - below  # the nearer edge of the bin
                cuts[n] = (chosen[n], first + (1 << bits) - 1 if take else first - 1)
            else:
                low[n], before[n] = first, below
    return cuts


def assign(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard) of each row of ``df`` (doc_id, text and, if there, source and lang)."""
    rows = _rows(df)
    groups = materialize(
        rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.max("size").alias("size")),
        "groups",
    )
    total = groups.agg(F.sum("bytes")).head()[0] or 0
    share = max(1.0, total / shards)
    heavy = groups.filter(F.col("bytes") > PIECE * share).select("group", F.ceil(F.col("bytes") / (PIECE * share)).alias("pieces"))
    heavy = F.broadcast(heavy)  # at most shards / PIECE rows
    salt = F.pmod(F.xxhash64("doc_id"), F.least(F.coalesce("pieces", F.lit(1)), F.lit((1 << _PIECES) - 1))).cast("long").alias("piece")

    def hashed(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(1 << (_Q - 1)))

    parted = rows.select("group", "size", "doc_id").join(heavy, "group", "inner").select("group", salt, F.col("size").alias("bytes"))
    parted = parted.groupBy("group", "piece").agg(F.sum("bytes").alias("bytes"))
    whole = groups.join(heavy, "group", "left_anti").select("group", F.lit(0).cast("long").alias("piece"), "bytes")
    metadata = groups.select(
        "group",
        F.least(F.lit((1 << (_Q - 1)) - 1), (F.log2(F.col("size").cast("double")) * 800).cast("long")).alias("q_size"),
        hashed("source").alias("q_source"),
        hashed("lang").alias("q_lang"),
    )
    points = whole.unionByName(parted).join(metadata, "group")
    points = materialize(points.withColumns({f"k_{d}": _key(d) for d in DIMENSIONS}), "points")
    spans = points.agg(*[(F.max(f"q_{d}") - F.min(f"q_{d}")).alias(d) for d in DIMENSIONS]).head()
    tree = _Tree(shards)
    while total and tree.open_nodes():
        tree.split(_cuts(points, tree, spans.asDict(), FINE * share))
    placed = points.select("group", "piece", tree.node.cast("int").alias("shard"))
    salted = rows.join(heavy, "group", "left").select("doc_id", "size", "text_crc32", "group", salt)
    return salted.join(placed, ["group", "piece"]).select("doc_id", "size", "text_crc32", "shard")


def with_slots(placed: DataFrame) -> DataFrame:
    """``placed`` with ``slot``: gapless from 0 in each shard."""
    n = placed.count()
    buckets = max(1, -(-n // (SHARDS * ROWS_IN_BUCKET)), 8)
    rows = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(first, ["shard", "bucket"]).withColumn("slot", (F.col("first") + F.col("at")).cast("long")).drop("first", "at", "bucket")


def shards(df: DataFrame) -> DataFrame:
    """The contract columns of the query."""
    placed = materialize(assign(df), "placed")
    return with_slots(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
