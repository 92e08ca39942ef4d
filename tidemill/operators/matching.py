"""Matching by rules: scored candidates, venues within bounds, records with ids of their content, retrieval counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import sharing
from tidemill.operators.positions import label_encode
from tidemill.runtime import materialize

CELLS = 4_000_000  # users times days of a tile's mates


def best_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with ``rank``; the limit holds in each task before the shuffle as well."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col("rank") <= n)


def _to_tiles(slots: np.ndarray):
    """(user, day, from, to) to (slot, mates, blob): to the tiles of the user's row, and to those of its column as a mate."""
    across, down = slots.shape[1], slots.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            dealt = sharing._part(columns[0], down * across)
            for mate, place, n in ((False, dealt // across, down), (True, dealt % across, across)):
                for i in range(n):
                    mine = place == i
                    if mine.any():
                        blob = sharing._joined([c[mine] for c in columns])
                        for slot in slots[:, i] if mate else slots[i]:
                            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([mate]), pa.array([blob], pa.binary())], ["slot", "mates", "blob"])

    return run


def _best_mates(users: np.ndarray, mates: np.ndarray, least: int, first: int):
    """Of every user the ``first`` mates with most common minutes, ties to the smaller id: (user, mates, minutes, days).
    Rows are (user, day, from, to). A user's slot meets all mates' slots of the day at once."""
    ids, at = np.unique(mates[:, 0], return_inverse=True)
    days, day = np.unique(mates[:, 1], return_inverse=True)
    order = np.lexsort((mates[:, 2], day, at))
    at, day, rows = at[order], day[order], mates[order]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (day[1:] != day[:-1])])
    nth = np.arange(len(at)) - np.repeat(new, np.diff(np.r_[new, len(at)]))
    layers = int(nth.max()) + 1
    users = users[np.isin(users[:, 1], days)]
    users = users[np.lexsort((users[:, 1], users[:, 0]))]
    begin = np.flatnonzero(np.r_[True, users[1:, 0] != users[:-1, 0]]) if len(users) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(users)].astype(np.int64)
    low = int(min(rows[:, 2].min(), users[:, 2].min(initial=rows[0, 2])))
    span = int(max(rows[:, 3].max(), users[:, 3].max(initial=rows[0, 3]))) - low
    most = int((end - begin).max(initial=0)) * layers * span
    kind, far = (np.int16, 15_000) if most < 15_000 else (np.int64, 1 << 60)
    start, stop = np.full((len(days) * layers, len(ids)), far, kind), np.full((len(days) * layers, len(ids)), -far, kind)
    start[day * layers + nth, at], stop[day * layers + nth, at] = rows[:, 2] - low, rows[:, 3] - low
    minutes, common, other, enough = np.zeros(len(ids), kind), np.empty(len(ids), kind), np.empty(len(ids), kind), np.empty(len(ids), bool)
    for lo, hi in zip(begin, end, strict=True):
        user, own = users[lo, 0], np.searchsorted(days, users[lo:hi, 1])
        line = (own[:, None] * layers + np.arange(layers)).ravel()
        s, e = (np.repeat((users[lo:hi, c] - low).astype(kind), layers) for c in (2, 3))
        minutes[:] = 0
        for i in range(len(line)):
            np.minimum(stop[line[i]], e[i], out=common)
            np.maximum(start[line[i]], s[i], out=other)
            np.subtract(common, other, out=common)
            np.greater_equal(common, kind(least), out=enough)
            np.multiply(common, enough, out=common)
            np.add(minutes, common, out=minutes)
        me = np.searchsorted(ids, user)
        if me < len(ids) and ids[me] == user:
            minutes[me] = 0
        edge = np.partition(minutes, -first)[-first] if len(ids) > first else kind(0)
        best = np.flatnonzero(minutes > edge)
        if edge > 0:
            best = np.r_[best, np.flatnonzero(minutes == edge)[: first - len(best)]]
        if not len(best):
            continue
        met = np.minimum(stop[np.ix_(line, best)], e[:, None]) - np.maximum(start[np.ix_(line, best)], s[:, None]) >= least
        by_day = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) * layers
        yield user, ids[best], minutes[best].astype(np.int64), np.maximum.reduceat(met, by_day, axis=0).sum(axis=0)


def _from_tiles(least: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for slot, mate, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(slot, ([], []))[mate].append(np.stack(sharing._split(blob), axis=1))
        for slot in list(held):
            users, others = held.pop(slot)
            if not users or not others:
                continue
            found = []
            for row in _best_mates(np.concatenate(users), np.concatenate(others), least, first):
                found.append(row)
                if len(found) == 1000:
                    yield _rows_of(found)
                    found = []
            if found:
                yield _rows_of(found)

    return run


def _rows_of(found: list) -> pa.RecordBatch:
    user = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
    return pa.RecordBatch.from_arrays([pa.array(user), *(pa.array(np.concatenate([f[i] for f in found])) for i in (1, 2, 3))], ["user", "mate", "minutes", "days"])


def mates(slots: DataFrame, least: int, first: int = 50, last: int = 5) -> DataFrame:
    """(user, mate, minutes, days, rank) out of free times (user, day, free_from, free_to) with whole user ids: by rule
    the ``first`` with most common minutes (overlaps of at least ``least``), of these the ``last`` with most common days.
    Users meet mates in tiles that hold their slots and give ``first`` mates a user: no pair of a day is a row."""
    spark = slots.sparkSession
    rows = slots.filter((F.col("free_to") - F.col("free_from") >= least) & F.col("user").isNotNull())
    rows = materialize(rows.select(F.col("user").cast("long").alias("user"), "day", F.col("free_from").cast("long").alias("s"), F.col("free_to").cast("long").alias("e")), "slots")
    days = materialize(label_encode(rows, "day"), "days")
    users = rows.agg(F.countDistinct("user")).head()[0]
    across = -(-max(1, users * days.count()) // CELLS)
    down = max(1, min(2 * spark.sparkContext.defaultParallelism, users // 100))
    tiles = sharing._slots(spark, down * across).reshape(down, across)
    sent = rows.join(days, "day").select("user", F.col("code").alias("day"), "s", "e").mapInArrow(_to_tiles(tiles), "slot long, mates boolean, blob binary")
    scored = sent.repartition(down * across, "slot").mapInArrow(_from_tiles(least, first), "user long, mate long, minutes long, days long")
    chosen = best_per_group(scored, "user", [F.desc("minutes"), F.col("mate")], first).drop("rank")
    return best_per_group(chosen, "user", [F.desc("days"), F.desc("minutes"), F.col("mate")], last)


def venues(asked: DataFrame, places: DataFrame, n: int = 3) -> DataFrame:
    """For each request (request, budget, minutes; a small table) the ``n`` nearest places (place, distance, price) that
    its budget pays and that its minutes reach, nearer ones first, then cheaper ones."""
    fit = places.join(F.broadcast(asked), (F.col("price") <= F.col("budget")) & (F.col("distance") <= F.col("minutes")))
    return best_per_group(fit, "request", [F.col("distance"), F.col("price"), F.col("place")], n).select("request", "place", "distance", "price", "rank")


def content_id(*parts: Column) -> Column:
    """The same id for the same parts, whenever it is made; a null part differs from an empty one."""
    text = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *text).cast("binary"), 256)


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """``base`` with ``changes`` put in by key: of rows with one key the one of the largest ``order`` stays."""
    rows = base.unionByName(changes)
    kept = [c for c in base.columns if c != key]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*kept), F.col(order)).alias("row"))
    return latest.select(*[F.col(f"row.{c}") if c != key else F.col(c) for c in base.columns])


def match_counts(found: DataFrame, expected: DataFrame, key: str, item: str) -> DataFrame:
    """(key, matches, precision, recall): of the distinct items found for each key, how many are expected."""
    a = found.select(key, item).distinct().withColumn("f", F.lit(1))
    b = expected.select(key, item).distinct().withColumn("e", F.lit(1))
    joined = a.join(b, [key, item], "full").groupBy(key)
    counts = joined.agg(F.count(F.col("f") + F.col("e")).alias("matches"), F.count("f").alias("n_found"), F.count("e").alias("n_expected"))

    def share(n: str) -> Column:
        return F.round(F.coalesce(F.col("matches") / F.nullif(F.col(n), F.lit(0)), F.lit(0.0)), 6)

    return counts.select(key, "matches", share("n_found").alias("precision"), share("n_expected").alias("recall"))
