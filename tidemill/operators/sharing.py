"""Entities that share keys, row by row: each entity's lists meet in one task, so that no pair is shuffled, and what
leaves the task is a pair's similarity, an entity's nearest ones or a prediction.

Entities are dealt into ``parts`` by a hash, for pairs by ranges of ids with equal numbers of entries, so that what lies
together is written together. Lists and norms are packed once (about 3 bytes an entry) into the shared folder,
where each part's task reads all of them and holds the lists with one of its entities: nothing is sent, so disk doesn't grow
with the parts. Only beyond ``SCANS`` parts a list is sent to every part that owns one of its entities, by a hash always. A
part expands about ``PAIRS`` pairs at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.positions import label_encode
from tidemill.runtime import collect_shuffles, discard, materialize, materialize_in_passes

ENTRIES = 48_000_000  # of lists in a part
OWN = 1_000_000  # entries of a part's own entities
HELD = 4_000_000  # entries of a part's users and of their nearest ones
NONE = 2**63 - 1  # stands for no item, after all others
SCANS = 512  # parts up to which each reads all lists
SOME = 200_000  # entries packed at once
PAIRS = 500_000  # expanded at once
LEAST_TASK = 100_000  # entries, under which a part isn't worth a task
PASS = 150_000_000  # bytes of the tables read, joined at once
PASSES = 3  # at most, as each reads the tables again


def _pack(values: np.ndarray) -> list[bytes]:
    """Bytes by place, compressed: whole numbers as integers, others as they are."""
    whole = values.dtype.kind != "f"
    if not whole and np.isfinite(values).all() and (np.abs(values) < 2**53).all():
        ints = values.astype(np.int64)
        if (ints == values).all() and not np.signbit(values[values == 0]).any():
            values, whole = ints, True
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return [bytes([whole]), pa.compress(planes.tobytes(), codec="zstd", asbytes=True)]


def _unpack(whole: bytes, data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64 if whole[0] else np.float64).ravel()


def _joined(columns: list[np.ndarray]) -> bytes:
    parts = [x for c in columns for x in (len(c).to_bytes(8, "little"), *_pack(c))]
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _split(blob: bytes) -> list[np.ndarray]:
    parts, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 8], "little")
        parts.append(blob[at + 8 : at + 8 + size])
        at += 8 + size
    return [_unpack(parts[i + 1], parts[i + 2], int.from_bytes(parts[i], "little")) for i in range(0, len(parts), 3)]


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(parts)).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _messages(slots: np.ndarray, half: bool, keyed: bool):
    """Sorted (key, entity, rating) to (slot, blob): per part the lists that hold one of its entities; with ``half`` from
    the first of those on."""
    parts = len(slots)

    def emit(key, ent, rat):
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[edge, len(key)])
        of = np.repeat(np.arange(len(edge)), size)
        part = _part(ent, parts)
        order = np.lexsort((np.arange(len(part)), of, part)) if parts > 1 else np.arange(len(part))
        p, l = part[order], of[order]
        first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (l[1:] != l[:-1])])
        start = order[first] if half else edge[l[first]]
        long, p = (edge + size)[l[first]] - start, p[first]
        del order, l, of, part
        bounds = np.searchsorted(p, np.arange(parts + 1))
        for i in range(parts):
            lo, hi = bounds[i], bounds[i + 1]
            if lo == hi:
                continue
            n, at = long[lo:hi], _ranges(start[lo:hi], long[lo:hi])
            ids = ent[at]
            begin = np.cumsum(n) - n
            step = np.diff(ids, prepend=0)
            step[begin] = ids[begin]
            columns = [n.astype(np.int64), step, rat[at]] + ([key[start[lo:hi]]] if keyed else [])
            yield pa.RecordBatch.from_arrays([pa.array([slots[i]], pa.int64()), pa.array([False]), pa.array([_joined(columns)], pa.binary())], ["slot", "norms", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)])
            n += batch.num_rows
            if n < SOME:
                continue
            key, ent, rat = (np.concatenate(c) for c in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))  # the last list may go on
            if cut:
                yield from emit(key[:cut], ent[:cut], rat[:cut].astype(np.float64))
            held, n = [[key[cut:], ent[cut:], rat[cut:]]], 0
        if held:
            key, ent, rat = (np.concatenate(c) for c in zip(*held, strict=True))
            if len(key):
                yield from emit(key, ent, rat.astype(np.float64))

    return run


def _norms(slots: np.ndarray):
    """(entity, squares, mean) to every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, squares, mean = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.argsort(ids)
            blob = _joined([np.diff(ids[order], prepend=0), squares[order].astype(np.float64), mean[order].astype(np.float64)])
            for slot in slots:
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([True]), pa.array([blob], pa.binary())], ["slot", "norms", "blob"])

    return run


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves away from 0."""
    y = x * 1e6
    return np.trunc(y + np.copysign(np.nextafter(0.5, 0), y)) / 1e6


class _Grown:
    """Numbers added piece by piece, without a second copy of all."""

    def __init__(self, dtype):
        self.all, self.n = np.empty(0, dtype), 0

    def add(self, values: np.ndarray) -> None:
        dtype = np.result_type(self.all, values)
        if dtype != self.all.dtype:
            self.all = self.all.astype(dtype)
        if self.n + len(values) > len(self.all):
            self.all.resize(max(self.n + len(values), len(self.all) * 5 // 4), refcheck=False)
        self.all[self.n : self.n + len(values)] = values
        self.n += len(values)

    def done(self) -> np.ndarray:
        self.all.resize(self.n, refcheck=False)
        return self.all


def _small(values: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they take."""
    if values.dtype != np.int64 or not len(values):
        return values
    return values.astype(np.min_scalar_type(-max(abs(int(values.min())), abs(int(values.max()))) - 1))


def _unrolled(n: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The entities of lists of the given sizes from their steps."""
    total, begin = np.cumsum(step), np.cumsum(n) - n
    return total - np.repeat(total[begin] - step[begin], n)


class _Lists:
    """The lists that hold an entity of the part: entries as codes of the norm table and ratings, list by list. With ``half``
    a part is a range of ids with its share of the entries (the table has them as means), and its lists start there."""

    def __init__(self, norms: list[bytes], lists: Iterable[bytes], part: int, parts: int, half: bool = False):
        tables = []
        while norms:
            step, squares, mean = _split(norms.pop())
            tables.append((np.cumsum(step), squares.astype(np.float64), mean.astype(np.float64)))
        ids, squares, self.mean = (np.concatenate(c) for c in zip(*tables, strict=True))
        order = np.argsort(ids)
        self.ids, self.norm, self.mean = ids[order], np.sqrt(squares[order]), self.mean[order]
        if half:
            total = np.cumsum(self.mean)
            self.mine = ((total - self.mean / 2) * parts // total[-1]).astype(np.int64) == part
        else:
            self.mine = _part(self.ids, parts) == part
        least = int(np.argmax(self.mine)) if half else 0  # before it none is needed
        low, high = int(self.ids[0]), int(self.ids[-1])
        table = None
        if high - low < 8 * len(ids) + 1000:
            table = np.zeros(high - low + 1, np.int32)
            table[self.ids - low] = np.arange(len(ids), dtype=np.int32)
        code, rating, size, key = _Grown(np.int32), _Grown(np.int8), _Grown(np.int64), _Grown(np.int64)
        for blob in lists:
            n, step, rat, *keys = _split(blob)
            ent = _unrolled(n, step)
            codes = table[ent - low] if table is not None else np.searchsorted(self.ids, ent).astype(np.int32)
            held = np.logical_or.reduceat(self.mine[codes], np.cumsum(n) - n)
            if least or not held.all():
                entries = np.repeat(held, n) & (codes >= least)
                n = np.add.reduceat(entries, np.cumsum(n) - n, dtype=np.int64)[held]
                codes, rat, keys = codes[entries], rat[entries], [k[held] for k in keys]
            code.add(codes)
            rating.add(_small(rat))
            size.add(n)
            for k in keys:
                key.add(k)
        self.code, self.rating, self.size, self.key = code.done(), rating.done(), size.done(), key.done()
        self.end = np.cumsum(self.size)


def _rows(lists: _Lists, half: bool):
    """The owned entries in order of their entity, in chunks of whole entities of about PAIRS pairs, or of one entity in
    several pieces. Gives (entries, list of each, start, size) and whether the next chunk goes on with the entity."""
    own = np.flatnonzero(lists.mine[lists.code])
    own = own[np.argsort(lists.code[own], kind="stable")]
    of = np.searchsorted(lists.end, own, side="right")
    start = own + 1 if half else lists.end[of] - lists.size[of]
    size = lists.end[of] - start
    code = lists.code[own]
    edge = np.r_[np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), len(own)] if len(own) else np.array([0])
    total = np.r_[0, np.cumsum(size)]
    i = 0
    while i < len(edge) - 1:
        j = int(np.searchsorted(total[edge], total[edge[i]] + PAIRS, side="right")) - 1
        j = max(j, i + 1)
        lo, hi = int(edge[i]), int(edge[j])
        pieces = [(lo, hi)]
        if j == i + 1 and total[hi] - total[lo] > PAIRS:
            pieces, at = [], lo
            while at < hi:
                to = min(hi, max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1))
                pieces.append((at, to))
                at = to
        yield [(own[a:b], of[a:b], start[a:b], size[a:b]) for a, b in pieces]
        i = j


def _expanded(lists: _Lists, piece):
    """(entry of the piece, place) of every pair, without an entity and itself."""
    own, _, start, size = piece
    seg, at = np.repeat(np.arange(len(own)), size), _ranges(start, size)
    other = lists.code[own][seg] != lists.code[at]
    return seg[other], at[other]


def _sums(lists: _Lists, pieces):
    """Of a chunk: (a, b, shared, dot, ratings known) by pair as codes, sorted by a and b, and for each piece (entry, place, pair)."""
    n = len(lists.ids)
    if len(pieces) == 1:
        own = pieces[0][0]
        seg, at = _expanded(lists, pieces[0])
        product = lists.rating[own].astype(np.float64)[seg] * lists.rating[at]
        key = lists.code[own].astype(np.int64)[seg] * n + lists.code[at]
        order = np.argsort(key)
        ordered = key[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]] if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        shared = np.diff(np.r_[first, len(key)])
        known = ~np.isnan(product)
        full = bool(known.all())
        product = product[order] if full else np.where(known, product, 0.0)[order]
        dot = np.add.reduceat(product, first) if len(first) else np.zeros(0)
        least = shared if full else np.add.reduceat(known[order].astype(np.int64), first)
        pair = np.empty(len(key), np.int64)
        pair[order] = np.cumsum(new) - 1
        found = ordered[first]
        return found // n, found % n, shared, dot, least, [(pieces[0], seg, at, pair)]
    shared, least, dot = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for piece in pieces:  # one entity of many pairs: sums by every other one
        seg, at = _expanded(lists, piece)
        product = lists.rating[piece[0]].astype(np.float64)[seg] * lists.rating[at]
        known = ~np.isnan(product)
        b = lists.code[at]
        shared += np.bincount(b, minlength=n)
        least += np.bincount(b[known], minlength=n)
        dot += np.bincount(b[known], weights=product[known], minlength=n)
    b = np.flatnonzero(shared)
    place = np.cumsum(shared > 0) - 1

    def again():
        for piece in pieces:
            seg, at = _expanded(lists, piece)
            yield piece, seg, at, place[lists.code[at]]

    a = np.full(len(b), lists.code[pieces[0][0][0]], np.int64)
    return a, b, shared[b], dot[b], least[b], again()


def _similar(lists: _Lists, a, b, dot, least):
    """Cosines to six places; NaN and True where there is none."""
    with np.errstate(all="ignore"):
        norm = lists.norm[a] * lists.norm[b]
        none = (least == 0) | (norm == 0) | np.isnan(lists.norm[a]) | np.isnan(lists.norm[b])
        return np.where(none, np.nan, rounded(dot / norm)), none


def _best(a, value, k):
    """(places, ranks) of the ``k`` largest values (-2 to 2) of each run of ``a``, of equal ones the earlier: one pass a rank."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    size = np.diff(np.r_[first, len(a)])
    of, value, places, ranks = np.repeat(np.arange(len(first)), size), value.copy(), [], []
    for rank in range(1, min(k, int(size.max())) + 1):
        most = np.maximum.reduceat(value, first)
        at = np.flatnonzero((value == np.repeat(most, size)) & (value > -3))
        at = at[np.r_[True, of[at][1:] != of[at][:-1]]] if len(at) else at
        places.append(at)
        ranks.append(np.full(len(at), rank))
        value[at] = -3
    return np.concatenate(places), np.concatenate(ranks)


def _batches(columns: Iterable[list], names: list[str]) -> Iterator[pa.RecordBatch]:
    for found in columns:
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in found], names)


def _rest(first: list[bytes], rows: Iterator) -> Iterator[bytes]:
    """The lists held back and those still to come, each let go once it is read."""
    while first:
        yield first.pop()
    for _, _, blob in rows:
        yield blob


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bool, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()


def _tables_first(batches: Iterable[pa.RecordBatch], tables: int) -> tuple[list[bytes], Iterator[bytes]]:
    """The blobs of ``tables`` tables, wherever they come, and those of the lists."""
    rows, norms, held = _packed(batches), [], []
    while len(norms) < tables and (row := next(rows, None)):
        (norms if row[1] else held).append(row[2])
    return norms, _rest(held, rows)


def _visit(mode: str, k: int, support: int, centred: bool, slots: np.ndarray, part: int | None = None, tables: int = 0):
    """Messages of whole parts to (a, b, shared, sim), to (a, b, sim, rank) or to (key, a, top, low, mean). With ``part``
    all lists, of which that part takes its own, and ``tables`` blobs of norms."""
    parts, half = len(slots), mode == "pairs"
    part_of = {int(s): i for i, s in enumerate(slots)}

    def visit(lists: _Lists):
        for turn, pieces in enumerate(_rows(lists, half)):
            a, b, shared, dot, least, again = _sums(lists, pieces)
            sim, none = _similar(lists, a, b, dot, least)
            if mode == "predict":
                weight = np.where(none, 0.0, sim)
                for (own, of, _, _), seg, at, pair in again:
                    w = weight[pair]
                    value = lists.rating[at].astype(np.float64)
                    if centred:
                        value = value - lists.mean[lists.code[at]]
                    m = len(own)
                    product = w * np.where(np.isnan(value), 0.0, value)
                    top, low = np.bincount(seg, product, m), np.bincount(seg, np.abs(w) if centred else w, m)
                    some = np.bincount(seg, minlength=m) > 0
                    code = lists.code[own[some]]
                    yield [lists.key[of[some]], lists.ids[code], top[some], low[some], lists.mean[code]]
                continue
            if support > 1:
                a, b, shared, sim, none = (x[shared >= support] for x in (a, b, shared, sim, none))
            if mode == "pairs":
                if not turn:  # Parquet keeps a dictionary if it pays on the first page: that has equal cosines side by side
                    a, b, shared, sim, none = (x[np.argsort(sim, kind="stable")] for x in (a, b, shared, sim, none))
                yield [lists.ids[a], lists.ids[b], shared, pa.array(sim, mask=none)]
                continue
            best, rank = _best(a, np.where(none, -2.0, np.where(np.isnan(sim), 2.0, sim)), k)
            yield [lists.ids[a[best]], lists.ids[b[best]], pa.array(sim[best], mask=none[best]), rank]

    names = {"pairs": ["a", "b", "shared", "sim"], "nearest": ["a", "b", "sim", "rank"], "predict": ["key", "a", "top", "low", "mean"]}[mode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if part is not None:
            norms, blobs = _tables_first(batches, tables)
            if norms:
                yield from _batches(visit(_Lists(norms, blobs, part, parts, half)), names)
            return
        held: dict[int, tuple[list, list]] = {}
        for slot, norm, blob in _packed(batches):
            held.setdefault(part_of[slot], ([], []))[0 if norm else 1].append(blob)
        for i in list(held):
            norms, blobs = held.pop(i)
            if blobs:
                yield from _batches(visit(_Lists(norms, _rest(blobs, iter(())), i, parts)), names)

    return run


def _parts(spark, rows: DataFrame, by: str) -> int:
    """So many that a part's lists have about ENTRIES entries, OWN of them its own; for small tables a few tasks."""
    n, keys = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(by)).head()
    mean = n / max(1, keys)
    parts = max(1, min(2 * spark.sparkContext.defaultParallelism, n // LEAST_TASK), n // OWN)
    while n * (1 - (1 - 1 / parts) ** mean) > ENTRIES:  # entries that reach a part
        parts = parts * 5 // 4 + 1
    return parts


def _slots(spark, parts: int) -> np.ndarray:
    """A number for each part such that repartition deals each part to a partition of its own."""
    found: dict[int, int] = {}
    upto = 16 * parts + 64
    while len(found) < parts:
        for i, at in spark.range(upto).select("id", F.pmod(F.hash("id"), F.lit(parts))).collect():
            found.setdefault(at, i)
        upto *= 2
    return np.array([found[i] for i in range(parts)], np.int64)


WHOLE = ("byte", "short", "integer", "long")


BLOBS = "slot long, norms boolean, blob binary"


def _trimmed(run: Callable) -> Callable:
    """``run`` with freed memory given back to the system when a part ends: workers live on from part to part."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # other C libraries
            pass

    return wrapped


def _in_every_part(packed: DataFrame, parts: int, run: Callable[[int], Callable], schema: str) -> DataFrame:
    """``run(part)`` over all of ``packed``, a task for each part. A union of single partitions alone would be a single one
    (spark.sql.unionOutputPartitioning), so one child without rows has two."""
    fields = [field.split() for field in schema.split(", ")]
    none = packed.sparkSession.range(0, 0, 1, 2).select(*[F.lit(None).cast(kind).alias(name) for name, kind in fields])
    found = [packed.coalesce(1).mapInArrow(_trimmed(run(part)), schema) for part in range(parts)]
    while len(found) > 1:  # by halves, so that the plan isn't deep
        found = [found[i].unionByName(found[i + 1]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return found[0].unionByName(none)


def _lists_of(rows: DataFrame) -> DataFrame:
    return rows.filter("key IS NOT NULL AND entity IS NOT NULL").repartition("key").sortWithinPartitions("key", "entity")


def _passes(ui: DataFrame) -> int:
    """So many that one has about PASS bytes of the tables that ``ui`` reads; one if its rows may differ from pass to pass."""
    plan = ui._jdf.queryExecution().optimizedPlan()
    if not plan.deterministic():
        return 1
    leaves = plan.collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return max(1, min(PASSES, -(-size // PASS)))


def _coded(ui: DataFrame, entity: str, by: str, passes: int = 1) -> tuple[DataFrame, dict]:
    """(key, entity, rating) with whole numbers as ids, written once, and the codes of what isn't one. Passes go by items:
    they come from the longer table of a join, which then is dealt out once in all."""
    rows, codes = ui.select(F.col(by).alias("key"), F.col(entity).alias("entity"), F.col("rating").cast("double").alias("rating")), {}
    rows = materialize_in_passes(rows, "lists", "entity" if entity == "item" else "key", passes)
    named = rows
    for name, column in (("key", by), ("entity", entity)):
        if ui.schema[column].dataType.typeName() not in WHOLE:
            codes[name] = materialize(label_encode(rows, name), "codes")
            rows = rows.join(codes[name], name, "left").withColumn(name, F.col("code")).drop("code")
    rows = rows.select(F.col("key").cast("long").alias("key"), F.col("entity").cast("long").alias("entity"), "rating")
    if codes:
        rows = materialize(rows, "lists")
        discard(named)
        collect_shuffles(ui.sparkSession)
    return rows, codes


def _over_lists(ui: DataFrame, entity: str, by: str, mode: str, schema: str, k: int = 0, support: int = 1, centred: bool = False) -> DataFrame:
    spark, kinds = ui.sparkSession, dict(ui.dtypes)
    passes = _passes(ui)
    rows, codes = _coded(ui, entity, by, passes)
    parts = _parts(spark, rows, "key")
    slots = np.arange(parts) if parts <= SCANS else _slots(spark, parts)

    def stats(rows: DataFrame) -> DataFrame:
        other = {"predict": F.avg("rating"), "pairs": F.count(F.lit(1)).cast("double")}.get(mode, F.lit(0.0))
        return rows.filter("entity IS NOT NULL").groupBy("entity").agg(F.sum(F.col("rating") * F.col("rating")).alias("squares"), other.alias("mean"))

    if parts <= SCANS:
        once = np.zeros(1, np.int64)
        fewer = (passes + 1) // 2  # the join's rows are wider
        norms = materialize_in_passes(rows, "norms", "entity", fewer, lambda some: stats(some).mapInArrow(_norms(once), BLOBS))
        tables = norms.count()
        lists = materialize_in_passes(rows, "packed", "key", fewer, lambda some: _lists_of(some).mapInArrow(_messages(once, False, mode == "predict"), BLOBS))
        discard(rows)
        out = _in_every_part(norms.unionByName(lists), parts, lambda part: _visit(mode, k, support, centred, slots, part, tables), schema)
    else:
        sent = _lists_of(rows).mapInArrow(_messages(slots, mode == "pairs", mode == "predict"), BLOBS).unionByName(stats(rows).mapInArrow(_norms(slots), BLOBS))
        out = sent.repartition(parts, "slot").mapInArrow(_visit(mode, k, support, centred, slots), schema)
    for column, of in (("key", "key"), ("a", "entity"), ("b", "entity")):
        if column in out.columns and of in codes:
            names = codes[of].select(F.col("code").alias(column), F.col(of).alias("__name"))
            out = out.join(names, column).withColumn(column, F.col("__name")).drop("__name")
        elif column in out.columns:
            out = out.withColumn(column, F.col(column).cast(kinds[by if of == "key" else entity]))
    return out.select(*[c.split()[0] for c in schema.split(", ")])


def pairs(ui: DataFrame, entity: str, by: str, support: int = 1) -> DataFrame:
    """(a, b, shared, sim): every pair a < b that shares at least ``support`` keys, with its cosine to six places."""
    return _over_lists(ui, entity, by, "pairs", "a long, b long, shared long, sim double", support=support)


def nearest(ui: DataFrame, entity: str, by: str, k: int) -> DataFrame:
    """(a, b, sim, rank): of each entity the ``k`` others of the largest cosine, ties to the smaller id."""
    return _over_lists(ui, entity, by, "nearest", "a long, b long, sim double, rank long", k=k)


def weighted(ui: DataFrame, entity: str, by: str, centred: bool) -> DataFrame:
    """(key, a, top, low, mean): for each row the sum over the key's other entities of cosine times rating (``centred``:
    less that entity's mean), the sum of cosines (of their amounts), and the entity's own mean."""
    return _over_lists(ui, entity, by, "predict", "key long, a long, top double, low double, mean double", centred=centred)


def _pack_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sim) as a table's blobs."""
    for batch in batches:
        if batch.num_rows:
            blob = _joined([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([True]), pa.array([blob], pa.binary())], ["slot", "norms", "blob"])


class _Held:
    """A part's entities with their nearest ones, and the lists of all of them."""

    def __init__(self, near: list[bytes], lists: Iterable[bytes], part: int, parts: int):
        tables = []
        while near:
            a, b, sim = _split(near.pop())
            mine = _part(a, parts) == part
            tables.append((a[mine], b[mine], sim[mine].astype(np.float64)))
        a, b, sim = (np.concatenate(c) for c in zip(*tables, strict=True))
        order = np.lexsort((b, a))
        self.a, self.b, self.sim = a[order], b[order], sim[order]
        ids = np.unique(np.r_[self.a, self.b])
        item, rating, key, size = _Grown(np.int64), _Grown(np.int8), _Grown(np.int64), _Grown(np.int64)
        for blob in lists:
            n, step, rat, keys = _split(blob)
            held = np.zeros(len(n), bool) if not len(ids) else ids[np.minimum(np.searchsorted(ids, keys), len(ids) - 1)] == keys
            entries = np.repeat(held, n)
            item.add(_unrolled(n, step)[entries])
            rating.add(_small(rat[entries]))
            key.add(keys[held])
            size.add(n[held])
        self.item, self.rating, keys, sizes = item.done(), rating.done(), key.done(), size.done()
        place = np.searchsorted(ids, keys)
        self.ids, self.start, self.size = ids, np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        self.start[place], self.size[place] = np.cumsum(sizes) - sizes, sizes

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``ids``, place) of every entry of their lists."""
        at = np.searchsorted(self.ids, ids)
        return np.repeat(np.arange(len(ids)), self.size[at]), _ranges(self.start[at], self.size[at])


def _candidates(n: int, parts: int, part: int, tables: int):
    """Tables of nearest ones and all lists to (a, item, score, rank) of the part's entities."""

    def found(held: _Held):
        a, first = np.unique(held.a, return_index=True)
        last = np.r_[first[1:], len(held.a)]
        load = np.add.reduceat(held.size[np.searchsorted(held.ids, held.b)], first) + held.size[np.searchsorted(held.ids, a)]
        total, i = np.r_[0, np.cumsum(load)], 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, side="right")) - 1)
            rows = slice(first[i], last[j - 1])
            of, at = held.of(held.b[rows])
            mine, own = held.of(a[i:j])
            who = np.r_[np.searchsorted(a[i:j], held.a[rows])[of], mine]
            item = np.r_[held.item[at], held.item[own]]
            sim = np.r_[held.sim[rows][of], np.full(len(own), np.nan)]
            value = np.r_[held.sim[rows][of] * held.rating[at], np.full(len(own), np.nan)]
            has = np.r_[np.zeros(len(at), bool), np.ones(len(own), bool)]
            order = np.lexsort((item, who))
            who, item, sim, value, has = who[order], item[order], sim[order], value[order], has[order]
            start = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (item[1:] != item[:-1])])
            top, low = (np.add.reduceat(np.where(np.isnan(x), 0.0, x), start) for x in (value, sim))
            some = np.logical_or.reduceat(~np.isnan(value), start)
            lacks = ~np.logical_or.reduceat(has, start) | (item[start] == NONE)
            who, item, top, low, some = who[start][lacks], item[start][lacks], top[lacks], low[lacks], some[lacks]
            with np.errstate(all="ignore"):
                none = (low == 0) | ~some
                score = np.where(none, 0.0, rounded(top / low))
            order = np.lexsort((item, -score, none, who))
            who, item, score, none = who[order], item[order], score[order], none[order]
            edge = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])[: len(who)]
            rank = np.arange(len(who)) - np.repeat(edge, np.diff(np.r_[edge, len(who)])) + 1
            best = rank <= n
            yield [a[i:j][who[best]], item[best], pa.array(score[best], mask=none[best]), rank[best]]
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, lists = _tables_first(batches, tables)
        if near:
            held = _Held(near, lists, part, parts)
            if len(held.a):
                yield from _batches(found(held), ["a", "item", "score", "rank"])

    return run


def candidates(ui: DataFrame, near: DataFrame, k: int, n: int) -> DataFrame:
    """(user, item, score, rank) for whole-numbered ids: the ``n`` best items that the user lacks and one of the at most
    ``k`` nearest users (a, b, sim) has, by the sum of similarity times rating over the sum of similarity, null last, ties
    to the smaller item; no item is an item that nobody has. A part holds its users' and their neighbours' lists."""
    spark = ui.sparkSession
    once = np.zeros(1, np.int64)
    rows = ui.select(F.col("user").cast("long").alias("key"), F.coalesce(F.col("item").cast("long"), F.lit(NONE)).alias("entity"), F.col("rating").cast("double").alias("rating"))
    table = materialize(near.select(F.col("a").cast("long"), F.col("b").cast("long"), "sim").mapInArrow(_pack_near, BLOBS), "near")
    lists = materialize(_lists_of(rows).mapInArrow(_messages(once, False, True), BLOBS), "packed")
    collect_shuffles(spark)
    entries, tables = rows.count(), table.count()
    parts = max(1, min(2 * spark.sparkContext.defaultParallelism, entries // LEAST_TASK), (k + 1) * entries // HELD)
    out = _in_every_part(table.unionByName(lists), parts, lambda part: _candidates(n, parts, part, tables), "a long, item long, score double, rank long")
    kinds = dict(ui.dtypes)
    return out.select(F.col("a").cast(kinds["user"]).alias("user"), F.nullif(F.col("item"), F.lit(NONE)).cast(kinds["item"]).alias("item"), "score", "rank")
