"""Operator 8: approximate nearest neighbours by NN-descent and greedy graph search.

Nearness is the largest inner product. The neighbour graph is built over vectors with one component more,
sqrt(M^2 - |x|^2) for the largest norm M, which turns the largest inner product into the smallest distance.

Build. Vectors are first dealt into leaves of a few random-hyperplane trees, and each leaf (cut into pieces of at most
``LEAF`` by a hash, so that a crowd of equal vectors is no large leaf) links its members. Then rounds of joins: a
node's list meets its reverse list (at most ``DEGREE`` of it, picked by a hash that changes from round to round; a
group limit keeps that bounded before the shuffle), neighbours of a node are compared with one another if one of the
two is new to it, and what beats a node's worst neighbour is offered to it. Rounds end when few lists change.

Search. A query starts from its own list, keeps the ``BEAM`` best nodes seen and expands those not yet expanded, until
no better ones turn up or ``HOPS`` is reached. The last step scores the pool by the original vectors in double
precision and ranks by score, then smaller id.

Equal vectors are one node of the graph, their smallest id, so that a crowd of copies neither fills lists nor hides
what lies behind it. Queries with equal vectors are searched once. Of each of a query's ``k`` + 1 best nodes the ``k`` + 1
smallest ids are expanded at last, which ranks copies exactly.

The vectors travel to the workers as one table only while they take at most ``BROADCAST_BYTES``; beyond that every
step joins them in by id. No graph, list or vector of all nodes comes to the driver in that case.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors
whose length is not the table's most common one; of repeated ids the smallest vector counts; with fewer candidates
than ``k`` a query gets all of them; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.runtime import discard, materialize

K = 20
DEGREE = 36
LEAF = 96
TREES = 3
ROUNDS = 9
SETTLED = 0.01
OFFERS = 8
BEAM = 192
HOPS = 6
BROADCAST_BYTES = 64 << 20


def valid(df: DataFrame) -> DataFrame:
    """(node, vector array<double>) of the vectors that take part."""
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))  # no -0.0
    rows = df.select(F.col("vec_id").cast("long").alias("node"), vector.alias("vector")).filter(F.col("node").isNotNull() & F.col("vector").isNotNull())
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(sound & F.exists("vector", lambda x: x != 0))
    size = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").head()
    if size is None:
        return rows
    return rows.filter(F.size("vector") == size["size"]).groupBy("node").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


class _Vectors:
    """Where steps get vectors from: a broadcast table while it is small, else a join that adds them as a column."""

    def __init__(self, table: DataFrame, dim: int, count: int, limit: int):
        self.table, self.dim, self.shared = table, dim, None
        if count * (4 * dim + 8) <= limit:
            rows = table.select("node", "packed").toArrow().sort_by("node")
            ids = rows.column("node").to_numpy()
            self.shared = table.sparkSession.sparkContext.broadcast((ids, _matrix(rows.column("packed"), dim)))

    def attach(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with the packed vector of ``key``, or a null where workers look it up themselves."""
        if self.shared is not None:
            return df.withColumn(name, F.lit(None).cast("binary"))
        return df.join(self.table.select(F.col("node").alias(key), F.col("packed").alias(name)), key)

    def score(self, pairs: DataFrame, a: str, b: str, *kept: str) -> DataFrame:
        """``pairs`` with ``sim``, the inner product of the vectors of a and b, without the added component."""
        shared, dim = self.shared, self.dim
        rows = self.attach(self.attach(pairs.select(a, b, *kept), a, "va"), b, "vb").select(a, b, *kept, "va", "vb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if shared is not None:
                    ids, vectors = shared.value
                    left = vectors[np.searchsorted(ids, batch.column(0).to_numpy())]
                    right = vectors[np.searchsorted(ids, batch.column(1).to_numpy())]
                else:
                    left, right = _matrix(batch.column(batch.num_columns - 2), dim), _matrix(batch.column(batch.num_columns - 1), dim)
                sim = np.einsum("ij,ij->i", left[:, :-1], right[:, :-1])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sim, pa.float32())], names=[a, b, *kept, "sim"])

        fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-2])
        return rows.mapInArrow(run, f"{fields}, sim float")


def _best(edges: DataFrame, key: str, other: str, n: int) -> DataFrame:
    """The n best of each key."""
    order = Window.partitionBy(key).orderBy(F.desc("sim"), other)
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("rank")


def _local_join(groups: DataFrame, vectors: _Vectors, all_new: bool = False) -> DataFrame:
    """Offers (node, other, sim) out of groups (members: array of struct(node, fresh, worst, packed))."""
    shared, dim = vectors.shared, vectors.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            offsets = np.asarray(members.offsets) - members.offsets[0].as_py()
            flat = members.flatten()
            ids = flat.field("node").to_numpy()
            fresh = flat.field("fresh").to_numpy(zero_copy_only=False)
            worst = flat.field("worst").to_numpy()
            if shared is not None:
                known, table = shared.value
                matrix = table[np.searchsorted(known, ids)]
            else:
                matrix = _matrix(flat.field("packed"), dim)
            out_a, out_b, out_s = [], [], []
            for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
                m = hi - lo
                if m < 2:
                    continue
                block, new, bar = matrix[lo:hi], fresh[lo:hi], worst[lo:hi]
                sim = block @ block.T
                np.fill_diagonal(sim, -np.inf)
                if not all_new:
                    sim[~new[:, None] & ~new[None, :]] = -np.inf
                sim[sim <= bar[:, None]] = -np.inf
                take = min(DEGREE if all_new else OFFERS, m - 1)
                best = np.argpartition(-sim, take - 1, axis=1)[:, :take]
                rows = np.repeat(np.arange(m), take)
                columns = best.ravel()
                values = sim[rows, columns]
                good = np.isfinite(values)
                out_a.append(ids[lo:hi][rows[good]])
                out_b.append(ids[lo:hi][columns[good]])
                out_s.append(values[good])
            empty = np.zeros(0, np.int64)
            arrays = [np.concatenate(x) if x else empty.astype(t) for x, t in ((out_a, np.int64), (out_b, np.int64), (out_s, np.float32))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["node", "other", "sim"])

    return groups.select("members").mapInArrow(run, "node long, other long, sim float")


def _leaves(nodes: DataFrame, vectors: _Vectors, count: int) -> DataFrame:
    """Groups of at most about ``LEAF`` members: the leaves of ``TREES`` trees of random hyperplanes."""
    bits = max(0, int(np.ceil(np.log2(max(1, count / LEAF)))))
    draw = np.random.default_rng(11)
    out = None
    for tree in range(TREES):
        planes = draw.standard_normal((vectors.dim, max(1, bits))).astype(np.float32)  # fixed: dimension times bits

        def run(batches: Iterator[pa.RecordBatch], planes: np.ndarray = planes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                side = _matrix(batch.column(1), planes.shape[0]) @ planes > 0
                code = (side.astype(np.int64) << np.arange(planes.shape[1])).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code)], names=["node", "leaf"])

        if bits:
            rows = nodes.select("node", "packed").mapInArrow(run, "node long, leaf long")
        else:
            rows = nodes.select("node", F.lit(0).cast("long").alias("leaf"))
        rows = rows.withColumn("leaf", F.xxhash64(F.lit(tree), "leaf"))
        out = rows if out is None else out.unionByName(rows)
    sizes = out.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("pieces"))
    pieces = out.join(sizes, "leaf").withColumn("piece", F.pmod(F.xxhash64("node", "leaf"), F.col("pieces")))
    member = F.struct("node", F.lit(True).alias("fresh"), F.lit(float("-inf")).cast("float").alias("worst"), "packed")
    return vectors.attach(pieces, "node", "packed").groupBy("leaf", "piece").agg(F.collect_list(member).alias("members"))


def graph(nodes: DataFrame, vectors: _Vectors, count: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, other, sim): the neighbour lists, ``DEGREE`` for each node at most."""
    merged = _local_join(_leaves(nodes, vectors, count), vectors, all_new=True)
    edges = merged.groupBy("node", "other").agg(F.max("sim").alias("sim")).withColumn("fresh", F.lit(True))
    edges = materialize(_best(edges, "node", "other", DEGREE), "graph")
    for turn in range(rounds):
        worst = edges.groupBy("node").agg(F.when(F.count(F.lit(1)) >= DEGREE, F.min("sim")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
        forward = edges.select(F.col("node").alias("centre"), F.col("other").alias("node"), "fresh")
        some = Window.partitionBy("centre").orderBy(F.desc("fresh"), F.xxhash64("node", F.lit(turn)))
        backward = edges.select(F.col("other").alias("centre"), "node", "fresh")
        backward = backward.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= DEGREE).drop("rank")
        both = forward.unionByName(backward).groupBy("centre", "node").agg(F.max("fresh").alias("fresh"))
        rows = vectors.attach(both.join(worst, "node", "left").fillna(float("-inf"), ["worst"]), "node", "packed")
        member = F.struct("node", "fresh", "worst", "packed")
        groups = rows.groupBy("centre").agg(F.collect_list(member).alias("members")).filter(F.exists("members", lambda x: x["fresh"]))
        offers = _local_join(groups, vectors).withColumn("fresh", F.lit(True))
        merged = edges.withColumn("fresh", F.lit(False)).unionByName(offers)
        merged = merged.groupBy("node", "other").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        before, edges = edges, materialize(_best(merged, "node", "other", DEGREE), "graph")
        discard(before)
        changed = edges.agg(F.avg(F.col("fresh").cast("double"))).head()[0] or 0.0
        if changed < SETTLED:
            break
    return edges.select("node", "other", "sim")


def search(queries: DataFrame, edges: DataFrame, vectors: _Vectors, beam: int = BEAM, hops: int = HOPS) -> DataFrame:
    """(query, node): the pool of each query (rows of ``queries``: node) after the greedy search."""
    backward = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim")
    links = edges.unionByName(_best(backward, "node", "other", DEGREE)).select("node", "other").distinct()
    start = queries.select(F.col("node").alias("query")).join(edges.select(F.col("node").alias("query"), F.col("other").alias("node")), "query")
    pool = vectors.score(start, "query", "node").withColumn("done", F.lit(False))
    pool = materialize(pool, "pool")
    for _ in range(hops):
        frontier = pool.filter("not done").select("query", "node")
        reached = frontier.join(links, "node").select("query", F.col("other").alias("node")).filter("query != node").distinct()
        reached = reached.join(pool.select("query", "node"), ["query", "node"], "left_anti")
        scored = vectors.score(reached, "query", "node").withColumn("done", F.lit(False))
        before, pool = pool, materialize(_best(pool.withColumn("done", F.lit(True)).unionByName(scored), "query", "node", beam), "pool")
        discard(before)
        if pool.filter("not done").isEmpty():
            break
    return pool.select("query", "node")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(df: DataFrame, is_query: Column, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, among all other rows."""
    rows = valid(df)
    base = materialize(rows.groupBy("vector").agg(F.min("node").alias("node")).select("node", "vector"), "vectors")
    own = F.xxhash64("vector"), F.hash("vector")  # to find the class of a row; the vectors themselves are compared as well
    marked = base.select(own[0].alias("h0"), own[1].alias("h1"), F.col("node").alias("class"), F.col("vector").alias("same"))
    members = rows.select(own[0].alias("h0"), own[1].alias("h1"), "node", "vector").join(marked, ["h0", "h1"]).filter("vector = same").select("class", "node")
    members = materialize(members, "members")
    norm = F.sqrt(_dot("vector", "vector"))
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest"), F.max(F.size("vector")).alias("dim")).head()
    count, dim = stats["n"], (stats["dim"] or 0) + 1
    largest = stats["largest"] or 1.0
    scale = 1.0 / largest

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, dim - 1) * scale
            rest = np.sqrt(np.maximum(0.0, 1.0 - (values**2).sum(axis=1)))
            packed = np.concatenate([values, rest[:, None]], axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], names=["node", "packed"])

    nodes = materialize(base.mapInArrow(pack, "node long, packed binary"), "packed")
    vectors = _Vectors(nodes, dim, count, broadcast_bytes)
    queries = members.filter(is_query).select(F.col("node").alias("query_id"), "class")
    edges = graph(nodes, vectors, count)
    asked = queries.select(F.col("class").alias("node")).distinct()
    reached = search(asked, edges, vectors)
    pool = reached.unionByName(asked.select(F.col("node").alias("query"), "node"))  # its copies as well
    exact = pool.join(base.select(F.col("node").alias("query"), F.col("vector").alias("a")), "query")
    exact = exact.join(base.select("node", F.col("vector").alias("b")), "node").select("query", "node", _dot("a", "b").alias("sim"))
    # k + 1 nodes hold k candidates besides the query itself; ties go to the node of the smaller id
    best = materialize(_best(exact, "query", "node", k + 1), "best")
    discard(edges)
    discard(reached)
    first = Window.partitionBy("class").orderBy("node")
    few = members.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1).select("class", "node")
    held = best.select(F.col("query").alias("asked"), F.col("node").alias("class"), "sim").join(few, "class")
    wide = held.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "node"))).alias("found"))
    top = wide.select("asked", F.slice("found", 1, k + 1).alias("found"))  # at most (k + 1)^2 before the cut
    out = queries.join(top, queries["class"] == top["asked"]).select("query_id", F.filter("found", lambda x: x["node"] != F.col("query_id")).alias("found"))
    out = out.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.node").alias("vec_id"), (-F.col("x.far")).alias("score"))


def listing(df: DataFrame) -> DataFrame:
    """The contract columns of the query."""
    return nearest(df, F.col("node") % 20 == 0)
