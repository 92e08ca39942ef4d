"""Recommender preparation, similarity, collaborative filtering, factorisation and ranking metrics, in long form
(user, item, rating): an observed pair is a row, a missing one isn't."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.clean import dot
from tidemill.operators import sharing
from tidemill.operators.positions import label_encode
from tidemill.runtime import collect_shuffles, discard, materialize, table

CHUNK = 100_000  # ratings that are packed, and descend, at once
NARROW = 3  # ratings under which a wave isn't worth arrays


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' parts and bought quantities; repeated pairs are summed."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey)
    return joined.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("rating"))


def sparsity(ui: DataFrame) -> DataFrame:
    counts = ui.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("user").alias("users"), F.countDistinct("item").alias("items"))
    whole = F.col("users").cast("double") * F.col("items")
    return counts.withColumn("sparsity", F.round(1 - F.col("pairs") / F.nullif(whole, F.lit(0.0)), 6))


def macro_mean(ui: DataFrame) -> DataFrame:
    means = ui.groupBy("item").agg(F.avg("rating").alias("m"))
    return means.agg(F.round(F.avg("m"), 6).alias("macro_mean"))


def frequent_users(ui: DataFrame, least: int = 2) -> DataFrame:
    """Rows of users with at least so many rows."""
    users = ui.groupBy("user").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return ui.join(users, "user", "left_semi")


def known_pairs(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose user and item both occur in training."""
    return test.join(train.select("user").distinct(), "user", "left_semi").join(train.select("item").distinct(), "item", "left_semi")


def cosine(ui: DataFrame, entity: str, by: str, support: int = 1) -> DataFrame:
    """Cosine of two entities, missing counting as 0, for pairs that share at least ``support``: (a, b, shared, sim).
    Pairs that share nothing have 0 and no row; a higher support leaves out pairs of other than 0."""
    return sharing.pairs(ui, entity, by, support)


def item_cf(ui: DataFrame) -> DataFrame:
    """Sum of similarity times rating over sum of similarity, over the user's other items: (user, item, pred)."""
    sums = sharing.weighted(ui, "item", "user", centred=False)
    return sums.select(F.col("key").alias("user"), F.col("a").alias("item"), F.round(F.coalesce(F.col("top") / F.nullif(F.col("low"), F.lit(0.0)), F.lit(0.0)), 6).alias("pred"))


def user_cf(ui: DataFrame) -> DataFrame:
    """The user's mean plus the neighbours' weighted deviations from theirs: (user, item, pred)."""
    sums = sharing.weighted(ui, "user", "item", centred=True)
    pred = F.col("mean") + F.coalesce(F.col("top") / F.nullif(F.col("low"), F.lit(0.0)), F.lit(0.0))
    return sums.select(F.col("a").alias("user"), F.col("key").alias("item"), F.round(pred, 6).alias("pred"))


def bias_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """Overall mean plus user and item deviations; unknown users or items add nothing: (user, item, actual, pred)."""
    mu = train.agg(F.avg("rating").alias("mu"))
    users = train.groupBy("user").agg(F.avg("rating").alias("u"))
    items = train.groupBy("item").agg(F.avg("rating").alias("i"))
    joined = test.join(users, "user", "left").join(items, "item", "left").join(F.broadcast(mu))
    pred = F.col("mu") + F.coalesce(F.col("u") - F.col("mu"), F.lit(0.0)) + F.coalesce(F.col("i") - F.col("mu"), F.lit(0.0))
    return joined.select("user", "item", F.col("rating").alias("actual"), F.round(pred, 6).alias("pred"))


def top_k(df: DataFrame, k: int, score: str = "pred") -> DataFrame:
    order = Window.partitionBy("user").orderBy(F.desc(score), "item")
    return df.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def ranking_metrics(predictions: DataFrame, k: int = 3, scale: float = 50.0, test: DataFrame | None = None) -> DataFrame:
    """precision@k, recall@k, hit rate@k and NDCG@k, averaged over the users with predictions, in one pass over each
    user's rows. Relevant are all of the user's rows in ``test`` (user, item, rating), predicted or not; without ``test``
    those of (user, item, actual, pred). A user without gain counts 0 in NDCG."""
    if test is not None:
        held = test.select("user", "item", F.col("rating").alias("actual"))
        held = held.join(predictions.select("user").distinct(), "user", "left_semi")
        predictions = predictions.select("user", "item", "pred").join(held, ["user", "item"], "full")
    user = Window.partitionBy("user")
    gain = F.coalesce(F.pow(F.lit(2.0), F.col("actual") / scale) - 1, F.lit(0.0))

    def place(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.row_number().over(user.orderBy(F.desc_nulls_last(c), "item")))

    ranked = predictions.select("user", gain.alias("gain"), F.col("actual").isNotNull().alias("held"), place("pred").alias("p"), place("actual").alias("a"))
    top = (F.col("p") <= k) & F.col("held")

    def discounted(c: str) -> Column:
        return F.sum(F.when(F.col(c) <= k, F.col("gain") / F.log2(F.col(c) + 1.0)).otherwise(0.0))

    users = ranked.groupBy("user").agg(
        F.sum(F.when(top, 1.0).otherwise(0.0)).alias("hits"),
        F.count(F.when(F.col("held"), 1)).alias("n"),
        F.sum(F.when(top & (F.col("a") <= k), 1.0).otherwise(0.0)).alias("both"),
        discounted("p").alias("dcg"),
        discounted("a").alias("ideal"),
    )
    return users.agg(
        F.round(F.avg(F.col("hits") / k), 6).alias("precision_at_k"),
        F.round(F.avg(F.coalesce(F.col("hits") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))), 6).alias("recall_at_k"),
        F.round(F.avg(F.col("both") / k), 6).alias("hit_rate_at_k"),
        F.round(F.avg(F.coalesce(F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0)), F.lit(0.0))), 6).alias("ndcg_at_k"),
    )


def threshold_recall(predictions: DataFrame, k: int, least: float) -> DataFrame:
    """Recall@k among the rows rated at least so much: of a user's k best by rating, the share also in the k best by
    prediction, over k, averaged over all users with predictions."""
    user = Window.partitionBy("user")
    good = F.col("actual") >= least

    def place(c: str) -> Column:
        return F.when(good, F.row_number().over(user.orderBy(F.desc_nulls_last(F.when(good, F.col(c))), "item")))

    ranked = predictions.select("user", place("pred").alias("p"), place("actual").alias("a"))
    hits = F.sum(F.when((F.col("p") <= k) & (F.col("a") <= k), 1.0).otherwise(0.0)) / k
    return ranked.groupBy("user").agg(hits.alias("recall")).agg(F.round(F.avg("recall"), 6).alias("recall_at_k"))


def ndcg_vector(predictions: DataFrame, k: int, scale: float = 50.0) -> DataFrame:
    """(user, ndcg): NDCG of each user's vectors of ratings and scores, on arrays; fewer than k rows are all used, a user
    without gain has 0."""
    gains = F.struct((-F.col("pred")).alias("by"), "item", (F.pow(F.lit(2.0), F.col("actual") / scale) - 1).alias("gain"))
    users = predictions.groupBy("user").agg(F.transform(F.array_sort(F.collect_list(gains)), lambda x: x["gain"]).alias("gains"))

    def dcg(values: Column) -> Column:
        return F.aggregate(F.transform(F.slice(values, 1, k), lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)

    ideal = dcg(F.sort_array("gains", asc=False))
    return users.select("user", F.round(F.coalesce(dcg(F.col("gains")) / F.nullif(ideal, F.lit(0.0)), F.lit(0.0)), 6).alias("ndcg"))


def user_hits(predictions: DataFrame, user: int, k: int, least: float | None = None) -> DataFrame:
    """(hits, share): of one user's k best rows by rating, how many are among the k best by prediction."""
    own = predictions.filter(F.col("user") == user)
    own = own if least is None else own.filter(F.col("actual") >= least)
    best = own.orderBy(F.desc("actual"), "item").limit(k).select("item")
    found = own.orderBy(F.desc("pred"), "item").limit(k).select("item").join(best, "item", "left_semi")
    return found.agg(F.count(F.lit(1)).alias("hits"), F.round(F.count(F.lit(1)) / k, 6).alias("share"))


def top_p(predictions: DataFrame, p: int, user: int | str, names: DataFrame) -> DataFrame:
    """One user's p best items by prediction, with the user's name. The user is given by id, or by name as text;
    ``names`` has (user, name)."""
    wanted = names.filter(F.col("name" if isinstance(user, str) else "user") == user).select("user", "name")
    rows = predictions.join(F.broadcast(wanted), "user")  # one user
    return rows.orderBy(F.desc("pred"), "item").limit(p).select("name", "item", "pred", "actual")


def candidates(users: DataFrame, items: DataFrame, train: DataFrame) -> DataFrame:
    """(user, item): every item that the user doesn't have in training, for the given users only (a batch of a size the
    caller answers for, as each meets the whole item table)."""
    seen = train.join(users, "user", "left_semi").select("user", "item")
    return users.select("user").crossJoin(items.select("item")).join(seen, ["user", "item"], "left_anti")


def neighbour_candidates(ui: DataFrame, k: int, n: int) -> DataFrame:
    """(user, item, score, rank): from each user's ``k`` most similar users the items that the user lacks, scored by the
    sum of similarity times rating over the sum of similarity of those who have it; the ``n`` best."""
    if {ui.schema[c].dataType.typeName() for c in ("user", "item")} <= set(sharing.WHOLE):
        return sharing.candidates(ui, sharing.nearest(ui, "user", "item", k), k, n)
    codes = {c: materialize(label_encode(ui, c, f"{c}_code"), "codes") for c in ("user", "item")}  # in the ids' order
    rows = ui.join(codes["user"], "user").join(codes["item"], "item", "left").select(F.col("user_code").alias("user"), F.col("item_code").alias("item"), "rating")
    found = neighbour_candidates(materialize(rows, "ui"), k, n).withColumnsRenamed({"user": "user_code", "item": "item_code"})
    return found.join(codes["user"], "user_code").join(codes["item"], "item_code", "left").select("user", "item", "score", "rank")


def decompose(vector: Column, bias: float, linear: list[float], factors: list[list[float]]) -> list[Column]:
    """A factorisation machine's prediction by its parts: global bias, linear term, quadratic term and their sum."""
    weights = F.array(*[F.lit(float(x)) for x in linear])
    first, second = dot(vector, weights), fm_term(vector, factors)
    return [F.lit(bias).alias("global_bias"), F.round(first, 5).alias("linear_term"), F.round(second, 5).alias("quadratic_term"), F.round(F.lit(bias) + first + second, 5).alias("pred")]


def above_mean_metrics(predictions: DataFrame, k: int = 3) -> DataFrame:
    """precision@k and recall@k where only items above the user's mean rating are relevant."""
    user = Window.partitionBy("user")
    ranked = predictions.withColumn("relevant", (F.col("actual") > F.avg("actual").over(user)).cast("double"))
    ranked = ranked.withColumn("p", F.row_number().over(user.orderBy(F.desc("pred"), "item")))
    hits = F.sum(F.when(F.col("p") <= k, F.col("relevant")).otherwise(0.0))
    users = ranked.groupBy("user").agg((hits / k).alias("precision"), F.coalesce(hits / F.nullif(F.sum("relevant"), F.lit(0.0)), F.lit(0.0)).alias("recall"))
    return users.agg(F.round(F.avg("precision"), 6).alias("precision_at_k"), F.round(F.avg("recall"), 6).alias("recall_at_k"))


def rmse(predictions: DataFrame, *by: str) -> DataFrame:
    error = F.col("pred") - F.col("actual")
    return predictions.groupBy(*by).agg(F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"))


def _coded(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """``df`` with dense codes ``u`` and ``i``: the factorisation takes 32-bit ids only."""
    return df.join(users, "user").join(items, "item")


def als_predict(train: DataFrame, test: DataFrame, rank: int = 10, reg: float = 0.02, iterations: int = 5, seed: int = 42) -> DataFrame:
    """(user, item, actual, pred) of the test pairs whose user and item are known: alternating least squares on the
    residuals of the bias baseline, the distributed factorisation."""
    from pyspark.ml.recommendation import ALS

    users = label_encode(train, "user", "u").withColumn("u", F.col("u").cast("int"))
    items = label_encode(train, "item", "i").withColumn("i", F.col("i").cast("int"))
    rows = bias_baseline(train, train).select("user", "item", (F.col("actual") - F.col("pred")).cast("float").alias("residual"))
    model = ALS(rank=rank, regParam=reg, maxIter=iterations, userCol="u", itemCol="i", ratingCol="residual", seed=seed, coldStartStrategy="drop")
    out = model.fit(_coded(rows, users, items)).transform(_coded(bias_baseline(train, test), users, items))
    return out.select("user", "item", "actual", (F.col("pred") + F.col("prediction")).alias("pred"))


def _descend(ratings, p, q, mu: float, rate: float, reg: float) -> None:
    """One pass of biased factorisation over (user, item, rating) rows, in place: error, biases, the user's factors, the
    item's by the user's new ones. A vector's last entry is its bias."""
    for u, i, r in ratings:
        a, b = p[u], q[i]
        error = r - (a[:-1] @ b[:-1] + a[-1] + b[-1] + mu)
        a[-1] += rate * (error - reg * a[-1])
        b[-1] += rate * (error - reg * b[-1])
        a[:-1] += rate * (error * b[:-1] - reg * a[:-1])
        b[:-1] += rate * (error * a[:-1] - reg * b[:-1])


def _waves(u: list[int], i: list[int]) -> np.ndarray:
    """The wave of each rating, by dense codes of its user and its item: the one after those of the ratings before it of
    either. Ratings of one wave share neither users nor items."""
    of_user, of_item, waves = [0] * (max(u) + 1), [0] * (max(i) + 1), []
    for x, y in zip(u, i, strict=True):
        wave, other = of_user[x], of_item[y]
        if other > wave:
            wave = other
        of_user[x] = of_item[y] = wave = wave + 1
        waves.append(wave)
    return np.array(waves, np.int64)


def _descend_in_waves(u, i, r, waves, p, q, mu: float, rate: float, reg: float) -> None:
    """``_descend`` a wave at a time: each rating meets the factors that it would meet in its turn."""
    order = np.argsort(waves, kind="stable")
    u, i, r, waves = u[order], i[order], r[order], waves[order]
    edges = np.flatnonzero(np.r_[True, waves[1:] != waves[:-1], True]).tolist() if len(u) else []
    for lo, hi in zip(edges, edges[1:], strict=False):
        x, y = u[lo:hi], i[lo:hi]
        if hi - lo < NARROW:
            _descend(zip(x.tolist(), y.tolist(), r[lo:hi].tolist(), strict=True), p, q, mu, rate, reg)
            continue
        a, b = p[x], q[y]
        error = r[lo:hi] - ((a[:, :-1] * b[:, :-1]).sum(axis=1) + a[:, -1] + b[:, -1] + mu)
        by = error[:, None]
        mine = a + rate * (by * b - reg * a)
        mine[:, -1] = a[:, -1] + rate * (error - reg * a[:, -1])
        other = b + rate * (by * mine - reg * b)
        other[:, -1] = b[:, -1] + rate * (error - reg * b[:, -1])
        p[x], q[y] = mine, other


def _descend_cells(k: int, mu: float, rate: float, reg: float):
    """Cells in order, of each the users' factors, the items' and the ratings by user and item: the factors are held as
    arrays, the ratings pass by in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = {}, None

        def factors(kind):
            if not isinstance(held.get(kind), tuple):
                parts = held.get(kind) or [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, k + 1)))]
                held[kind] = []
                ids, block, f = (np.concatenate(c) for c in zip(*parts, strict=True))
                del parts
                order = np.argsort(ids, kind="stable")
                ids, block = ids[order], block[order]
                held[kind] = ids, block, f[order]
            return held[kind]

        def moved():
            for kind in "pq":
                ids, block, f = factors(kind)
                for lo in range(0, len(ids), 10_000):
                    part = slice(lo, lo + 10_000)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids[part]) + 1, dtype=np.int32) * (k + 1)), pa.array(f[part].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(ids[part])), pa.array(ids[part]), pa.array(block[part]), lists], ["kind", "id", "block", "f"])

        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])]) if len(cells) else []
            for lo, hi in zip(edges, [*edges[1:], len(cells)], strict=True):
                if cells[lo] != cell:
                    yield from moved()
                    held, cell = {}, cells[lo]
                rows, kind = batch.slice(lo, hi - lo), kinds[lo]
                ids = rows.column("id").to_numpy()
                if kind != "r":
                    f = rows.column("f").flatten().to_numpy().reshape(-1, k + 1)
                    held.setdefault(kind, []).append((ids.copy(), rows.column("block").to_numpy().copy(), f.copy()))
                    continue
                (users, _, p), (items, _, q) = factors("p"), factors("q")
                (some_users, u), (some_items, i) = (np.unique(x, return_inverse=True) for x in (ids, rows.column("item").to_numpy()))
                waves = _waves(u.tolist(), i.tolist())
                u, i = np.searchsorted(users, some_users)[u], np.searchsorted(items, some_items)[i]
                _descend_in_waves(u, i, rows.column("rating").to_numpy(), waves, p, q, mu, rate, reg)
        yield from moved()

    return run


def _pack_ratings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (stratum, cell, user, item, rating) to (stratum, cell, user, item, blob): chunks with their first pair."""
    held: list[list[np.ndarray]] = []

    def chunk():
        stratum, cell, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
        first = [pa.array([stratum[0]], pa.int32()), pa.array([cell[0]], pa.int32()), pa.array([columns[0][0]], pa.int64()), pa.array([columns[1][0]], pa.int64())]
        return pa.RecordBatch.from_arrays([*first, pa.array([sharing._joined(columns)], pa.binary())], ["stratum", "cell", "user", "item", "blob"])

    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        stratum, cell = columns[:2]
        edges = np.flatnonzero(np.r_[True, (stratum[1:] != stratum[:-1]) | (cell[1:] != cell[:-1])]) if len(cell) else []
        for lo, hi in zip(edges, [*edges[1:], len(cell)], strict=True):
            if held and ((held[-1][0][0], held[-1][1][0]) != (stratum[lo], cell[lo]) or sum(len(h[0]) for h in held) >= CHUNK):
                yield chunk()
                held.clear()
            held.append([c[lo:hi].copy() for c in columns])
    if held:
        yield chunk()


def _pack_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, id, block, f) to (kind, block, blob)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds, ids, blocks = (batch.column(c).to_numpy(zero_copy_only=c == "id") for c in ("kind", "id", "block"))
        f = batch.column("f").flatten().to_numpy().reshape(len(ids), -1)
        for kind in set(kinds):
            for block in np.unique(blocks[kinds == kind]):
                mine = (kinds == kind) & (blocks == block)
                blob = sharing._joined([ids[mine], f[mine].ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([block], pa.int32()), pa.array([blob], pa.binary())], ["kind", "block", "blob"])


def _unpack_cells(k: int):
    """Packed (cell, kind, block, blob) to the rows of ``_descend_cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                cell, kind, block, blob = (batch.column(c)[at].as_py() for c in ("cell", "kind", "block", "blob"))
                ids, *rest = sharing._split(blob)
                n = len(ids)
                none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.float64()))]
                if kind == "r":
                    columns = [pa.array(rest[0]), pa.array(rest[1].astype(np.float64)), none[2], none[3]]
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (k + 1)), pa.array(rest[0].astype(np.float64)))
                    columns = [none[0], none[1], pa.array(np.full(n, block, np.int32)), lists]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, cell, np.int32)), pa.array([kind] * n), pa.array(ids), *columns], ["cell", "kind", "id", "item", "rating", "block", "f"])

    return run


def _factors_of(packed: DataFrame, kind: str, k: int) -> DataFrame:
    """(id, block, f) of one kind."""
    rows = packed.filter(F.col("kind") == kind).select(F.lit(0).alias("cell"), "kind", "block", "blob")
    return rows.mapInArrow(lambda batches: (b.select(["id", "block", "f"]) for b in _unpack_cells(k)(batches)), "id long, block int, f array<double>")


def _first_factors(df: DataFrame, entity: str, k: int, seed: int, blocks: int) -> DataFrame:
    """(id, block, f): factors from 0 to 6 / k by a hash of the id, and a bias of 0."""
    draw = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.pmod(F.xxhash64("id", F.lit(entity), j, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) * 6.0 / k)
    ids = df.select(F.col(entity).cast("long").alias("id")).distinct()
    return ids.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.concat(draw, F.array(F.lit(0.0))).alias("f"))


def block_sgd(
    train: DataFrame, k: int = 10, rate: float = 0.001, reg: float = 0.02, epochs: int = 50, seed: int = 42, blocks: int = 8,
    valid: DataFrame | None = None, patience: int = 3,
) -> dict:
    """Biased factorisation by stochastic gradient descent over strata: users and items are dealt into ``blocks``, and a
    stratum is a set of cells that share neither users nor items, so its cells descend in parallel and row by row inside.
    An epoch goes through ``blocks`` strata; factors are written to the shared folder after each. A cell holds about
    1 / blocks^2 of the ratings: more blocks where that is too much for a task. With one block the order is that of the
    sequential algorithm. With ``valid`` the epoch of the least error is kept and ``patience`` epochs without a better one
    end the descent. Gives {"p", "q": (id, block, f), "mu", "errors"}."""
    cell_of = F.pmod(F.xxhash64("user"), F.lit(blocks)).cast("int")
    rows = train.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"), F.col("rating").cast("double").alias("rating"))
    rows = materialize(rows.withColumns({"cell": cell_of, "column": F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")}), "ratings")
    collect_shuffles(train.sparkSession)
    mu = rows.groupBy("item").agg(F.avg("rating").alias("m")).agg(F.avg("m")).head()[0] or 0.0
    first = [_first_factors(rows, e, k, seed, blocks).withColumn("kind", F.lit(kind)) for e, kind in (("user", "p"), ("item", "q"))]
    factors = materialize(first[0].unionByName(first[1]).mapInArrow(_pack_factors, "kind string, block int, blob binary"), "factors")
    ratings = rows.select(F.pmod(F.col("column") - F.col("cell"), F.lit(blocks)).alias("stratum"), "cell", "user", "item", "rating")
    ratings = ratings.repartitionByRange("user", "item").sortWithinPartitions("stratum", "cell", "user", "item", "rating")
    ratings = materialize(ratings.mapInArrow(_pack_ratings, "stratum int, cell int, user long, item long, blob binary"), "packed", by="stratum")
    discard(rows)
    collect_shuffles(train.sparkSession)
    slots = sharing._slots(train.sparkSession, blocks)  # each cell is a partition of its own
    slot_of = F.element_at(F.array(*[F.lit(int(x)) for x in slots]), F.col("cell") + 1)
    descend = _descend_cells(k, mu, rate, reg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack_factors(descend(_unpack_cells(k)(batches)))

    errors, best, kept = [], None, None
    none = F.lit(None)
    for _ in range(epochs):
        for stratum in range(blocks):
            of_kind = F.when(F.col("kind") == "p", F.col("block")).otherwise(F.pmod(F.col("block") - stratum, F.lit(blocks)))
            parts = [
                ratings.filter(F.col("stratum") == stratum).select("cell", F.lit("r").alias("kind"), none.cast("int").alias("block"), "user", "item", "blob"),
                factors.select(of_kind.alias("cell"), "kind", "block", none.cast("long").alias("user"), none.cast("long").alias("item"), "blob"),
            ]
            moved = parts[0].unionByName(parts[1]).withColumn("slot", slot_of)
            moved = moved.repartition(blocks, "slot").sortWithinPartitions("cell", "kind", "user", "item").select("cell", "kind", "block", "blob")
            moved = materialize(moved.mapInArrow(run, "kind string, block int, blob binary"), "factors")
            if factors is not kept:
                discard(factors)
            factors = moved
        if valid is not None:
            model = {"p": _factors_of(factors, "p", k), "q": _factors_of(factors, "q", k), "mu": mu}
            errors.append(rmse(block_sgd_predict(model, valid)).head()[0])
            if best is None or errors[-1] < min(errors[:-1]):
                if kept is not None:
                    discard(kept)
                best, kept = model, factors
            elif len(errors) - 1 - errors.index(min(errors)) >= patience:
                break
    discard(ratings)
    return {**(best or {"p": _factors_of(factors, "p", k), "q": _factors_of(factors, "q", k), "mu": mu}), "errors": errors}


def block_sgd_predict(model: dict, test: DataFrame) -> DataFrame:
    """(user, item, actual, pred): all four cases of known and unknown; unknown factors count as ones, unknown biases as 0;
    with neither known the mean."""
    p = model["p"].select(F.col("id").alias("user"), F.col("f").alias("fu"))
    q = model["q"].select(F.col("id").alias("item"), F.col("f").alias("fi"))
    rows = test.join(p, "user", "left").join(q, "item", "left")
    size = F.size(F.coalesce("fu", "fi"))
    stand_in = F.concat(F.array_repeat(F.lit(1.0), size - 1), F.array(F.lit(0.0)))
    rows = rows.withColumns({"a": F.coalesce("fu", stand_in), "b": F.coalesce("fi", stand_in)})
    k = F.size("a") - 1
    pred = dot(F.slice("a", F.lit(1), k), F.slice("b", F.lit(1), k)) + F.element_at("a", -1) + F.element_at("b", -1) + model["mu"]
    known = F.col("fu").isNotNull() | F.col("fi").isNotNull()
    return rows.select("user", "item", F.col("rating").alias("actual"), F.round(F.when(known, pred).otherwise(model["mu"]), 6).alias("pred"))


def svd(matrix: DataFrame, label: str, vector: str, k: int) -> DataFrame:
    """Truncated SVD of row vectors and the rank-k reconstruction: (label, vector, approximation). The Gram matrix is
    dimension squared, whatever the number of rows; it is summed on the executors."""
    size = matrix.select(F.max(F.size(vector))).head()[0] or 0
    cells = matrix.select(F.posexplode(vector).alias("i", "x"), F.col(vector).alias("v")).select("i", "x", F.posexplode("v").alias("j", "y"))
    gram = np.zeros((size, size))
    for row in cells.groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("g")).collect():
        gram[row.i, row.j] = row.g
    _, vectors = np.linalg.eigh(gram)
    basis = vectors[:, ::-1][:, :k]
    projection = basis @ basis.T
    columns = [F.array(*[F.lit(float(x)) for x in projection[:, j]]) for j in range(size)]
    approximation = F.array(*[dot(vector, c) for c in columns]) if size else F.array()
    return matrix.select(label, vector, approximation.alias("approximation"))


def fm_term(vector: Column, factors: list[list[float]]) -> Column:
    """The second-order term of a factorisation machine: half the sum over factors of (zV)^2 - z^2 V^2."""
    total = F.lit(0.0)
    for column in zip(*factors, strict=True):
        weights = F.array(*[F.lit(float(x)) for x in column])
        linear = dot(vector, weights)
        squares = F.aggregate(F.zip_with(vector, weights, lambda x, v: x.cast("double") * x * v * v), F.lit(0.0), lambda s, x: s + x)
        total = total + linear * linear - squares
    return total * 0.5
