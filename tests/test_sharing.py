import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemill.operators import sharing
from tidemill.plans import catalog


def brute(rows):
    norm, lists, dots, shared = defaultdict(float), defaultdict(list), defaultdict(float), defaultdict(int)
    for key, e, r in rows:
        norm[e] += r * r
        lists[key].append((e, r))
    for held in lists.values():
        for a, ra in held:
            for b, rb in held:
                if a != b:
                    dots[a, b] += ra * rb
                    shared[a, b] += 1
    sims = {(a, b): round(d / math.sqrt(norm[a] * norm[b]), 6) if norm[a] * norm[b] else None for (a, b), d in dots.items()}
    return sims, shared, lists


def run(rows, mode, slots, k=0, centred=False):
    """Messages and parts as the tasks make them, without Spark."""
    rows = sorted(rows)
    slots = np.array(slots)
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 7]], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], list("ker")) for at in range(0, len(rows), 7)]
    ids = sorted({r[1] for r in rows})
    own = {e: [r[2] for r in rows if r[1] == e] for e in ids}
    stats = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([sum(x * x for x in own[e]) for e in ids]), pa.array([sum(own[e]) / len(own[e]) for e in ids])], list("esm"))
    sent = [*sharing._messages(slots, mode == "pairs", mode == "predict")(iter(batches)), *sharing._norms(slots)(iter([stats]))]
    out = sharing._visit(mode, k, 1, centred, slots)(iter(sent))
    return [tuple(row.values()) for batch in out for row in batch.to_pylist()]


@pytest.mark.parametrize("pairs", [3, 40, 10**6])
@pytest.mark.parametrize("some", [5, 10**6])
@pytest.mark.parametrize("slots", [[4], [9, 2, 5]])
@pytest.mark.parametrize("kind", ["whole", "parts"])
def test_rows_against_plain_loops(monkeypatch, pairs, some, slots, kind):
    monkeypatch.setattr(sharing, "PAIRS", pairs)
    monkeypatch.setattr(sharing, "SOME", some)
    draw = np.random.default_rng(7)
    cells = sorted({(int(u), int(i) * 1000 - 5000) for u, i in zip(draw.integers(0, 12, 90), draw.integers(0, 14, 90) ** 2 // 14, strict=True)})
    rows = [(u, i, float(draw.integers(0, 200)) if kind == "whole" else float(draw.normal())) for u, i in cells]
    sims, shared, lists = brute(rows)
    got = {(a, b): (n, s) for a, b, n, s in run(rows, "pairs", slots)}
    assert set(got) == {p for p in sims if p[0] < p[1]}
    for p, (n, s) in got.items():
        assert n == shared[p] and (s == sims[p] or abs(s - sims[p]) < 2e-6)
    near = defaultdict(list)
    for (a, b), (_, s) in got.items():
        near[a].append((-s, b))
        near[b].append((-s, a))
    want = {(a, b, -s, r + 1) for a, held in near.items() for r, (s, b) in enumerate(sorted(held)[:3])}
    assert set(run(rows, "nearest", slots, k=3)) == want
    mean = {e: np.mean([r for _, x, r in rows if x == e]) for e in near}
    for centred in (False, True):
        got = {(u, a): (top, low) for u, a, top, low, _ in run(rows, "predict", slots, centred=centred)}
        assert set(got) == {(u, a) for u, held in lists.items() for a, _ in held if len(held) > 1}
        for (u, a), (top, low) in got.items():
            others = [(sims[a, b], r - mean[b] if centred else r) for b, r in lists[u] if b != a]
            assert top == pytest.approx(sum(s * r for s, r in others), abs=1e-3) and low == pytest.approx(sum(abs(s) if centred else s for s, _ in others), abs=1e-4)


def test_ties_and_nulls():
    assert sharing.rounded(np.array([0.0000005, -0.0000005, 0.1234565])).tolist() == [1e-06, -1e-06, 0.123457]
    places, ranks = sharing._best(np.array([1, 1, 1, 2]), np.array([0.5, -2.0, 0.5, -2.0]), 2)
    assert sorted(zip(places.tolist(), ranks.tolist(), strict=True)) == [(0, 1), (2, 2), (3, 1)]


def test_names_as_ids(spark):
    ui = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0), ("y", "b", 2.0), ("y", "c", None)], "user string, item string, rating double")
    assert {(r.a, r.b, r.shared, r.sim) for r in sharing.pairs(ui, "item", "user").collect()} == {("a", "b", 1, 0.707107), ("b", "c", 1, None)}


def no_join_of_pairs(spark, small, name):
    plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_item_neighbours_shuffles_no_pairs(spark, small):
    no_join_of_pairs(spark, small, "item_neighbours")


def test_neighbour_top_n_shuffles_no_pairs(spark, small):
    """Lists of neighbours are joined, rows of pairs are not; candidates aren't shuffled again."""
    plan = catalog.QUERIES["neighbour_top_n"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "MapInArrow" in plan


def test_item_cf_predict_shuffles_no_pairs(spark, small):
    no_join_of_pairs(spark, small, "item_cf_predict")


def test_user_cf_predict_shuffles_no_pairs(spark, small):
    no_join_of_pairs(spark, small, "user_cf_predict")


def test_item_cosine_shuffles_no_pairs(spark, small):
    no_join_of_pairs(spark, small, "item_cosine")


def test_user_cosine_shuffles_no_pairs(spark, small):
    no_join_of_pairs(spark, small, "user_cosine")


@pytest.mark.parametrize("mode", ["pairs", "nearest", "predict"])
def test_parts_read_all_lists_and_send_none(spark, monkeypatch, mode):
    """Each part is a task of its own and reads every list from the shared folder: no shuffle is left in the plan."""
    monkeypatch.setattr(sharing, "LEAST_TASK", 20)
    draw = np.random.default_rng(3)
    cells = sorted({(int(u), int(i)) for u, i in zip(draw.integers(0, 30, 300), draw.integers(0, 25, 300), strict=True)})
    ui = spark.createDataFrame([(u, i, float(draw.integers(1, 50))) for u, i in cells], "user long, item long, rating double")
    schema = {"pairs": "a long, b long, shared long, sim double", "nearest": "a long, b long, sim double, rank long", "predict": "key long, a long, top double, low double, mean double"}[mode]
    few = sharing._over_lists(ui, "item", "user", mode, schema, k=3)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    assert few.rdd.getNumPartitions() >= sharing._parts(spark, ui, "user") > 4
    monkeypatch.setattr(sharing, "SCANS", 0)
    sent = sharing._over_lists(ui, "item", "user", mode, schema, k=3)
    assert "Exchange" in sent._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.collect())) == [pytest.approx(tuple(r)) for r in sorted(map(tuple, sent.collect()))]


def test_neighbour_top_n_sends_no_lists_to_users(spark, monkeypatch):
    """Neighbours' lists are read where users are; against plain loops, with names as ids too."""
    from tidemill.operators import recommend

    monkeypatch.setattr(sharing, "LEAST_TASK", 20)
    monkeypatch.setattr(sharing, "PAIRS", 50)
    draw = np.random.default_rng(5)
    cells = sorted({(int(u), int(i)) for u, i in zip(draw.integers(0, 30, 200), draw.integers(0, 25, 200), strict=True)})
    rows = [(u, i, float(draw.integers(1, 50))) for u, i in cells] + [(99, 999, 4.0)]
    near = brute([(i, u, r) for u, i, r in rows])[0]
    held, want = defaultdict(dict), set()
    for u, i, r in rows:
        held[u][i] = r
    for u in held:
        best = sorted((-s, b) for (a, b), s in near.items() if a == u)[:3]
        top, low = defaultdict(float), defaultdict(float)
        for s, b in best:
            for i, r in held[b].items():
                top[i], low[i] = top[i] - s * r, low[i] - s
        scores = sorted((-round(top[i] / low[i], 6), i) for i in top if i not in held[u])[:2]
        want |= {(u, i, -s, at + 1) for at, (s, i) in enumerate(scores)}
    ui = spark.createDataFrame(rows, "user long, item long, rating double")
    got = recommend.neighbour_candidates(ui, 3, 2)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r[0], r[3])
    assert sorted(map(tuple, got.collect()), key=key) == [(u, i, pytest.approx(s, abs=2e-6), at) for u, i, s, at in sorted(want, key=key)]
    named = recommend.neighbour_candidates(ui.selectExpr("format_string('u%03d', user) AS user", "format_string('i%03d', item) AS item", "rating"), 3, 2)
    assert {(int(r[0][1:]), int(r[1][1:]), r[3]) for r in named.collect()} == {(u, i, at) for u, i, _, at in want}


def test_neighbour_without_an_item(spark):
    """A null item is a candidate, also of a user with one, as in the SQL; a user without id has no neighbours."""
    from tidemill.operators import recommend

    ui = spark.createDataFrame([(1, 5, 1.0), (1, None, 2.0), (2, 5, 3.0), (2, None, 4.0), (2, 6, 4.0), (None, 5, 1.0)], "user long, item long, rating double")
    got = {tuple(r) for r in recommend.neighbour_candidates(ui, 3, 3).collect()}
    assert got == {(1, 6, 4.0, 1), (1, None, 4.0, 2), (2, None, 2.0, 1)}


def test_passes_give_the_rows_of_one(spark, monkeypatch):
    """Rows of null ids stay in the norms and each row is in one pass, with numbers and with names as ids."""
    draw = np.random.default_rng(11)
    cells = sorted({(int(u), int(i)) for u, i in zip(draw.integers(0, 20, 150), draw.integers(0, 18, 150), strict=True)})
    rows = [(u, i, float(draw.integers(1, 50))) for u, i in cells] + [(None, 3, 7.0), (4, None, 2.0), (None, None, 1.0), (50, 3, None)]
    ui = spark.createDataFrame(rows, "user long, item long, rating double")
    named = ui.selectExpr("format_string('u%03d', user) AS user", "format_string('i%03d', item) AS item", "rating")
    for frame, entity, by in ((ui, "item", "user"), (named, "user", "item")):
        found = []
        for passes in (1, 3):
            monkeypatch.setattr(sharing, "_passes", lambda _, n=passes: n)
            found.append(sorted(map(str, sharing.pairs(frame, entity, by).collect())))
        assert found[0] == found[1] and found[0]


def test_passes_grow_with_the_tables(spark, small, monkeypatch):
    """Each pass of a join by items takes its share of the longer table before it is dealt out."""
    from pyspark.sql import functions as F

    from tidemill.operators import recommend

    ui = recommend.interactions(spark, small)
    assert sharing._passes(ui) == 1
    monkeypatch.setattr(sharing, "PASS", 40_000)
    assert 1 < sharing._passes(ui) <= sharing.PASSES
    assert sharing._passes(ui.withColumn("rating", F.rand())) == 1
    plan = ui.filter("pmod(xxhash64(item), 3) = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("xxhash64") < plan.index("l_orderkey", plan.index("xxhash64"))


@pytest.mark.parametrize("name", ["user_cf_predict", "item_cosine", "user_cosine"])
def test_no_shuffle_files_are_left(spark, small, monkeypatch, name):
    """Once a query's lists are packed, only they take disk: the shuffle files of every step are gone."""
    import gc
    import glob
    import time

    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    tops = [store.localDirs()[i].getPath() for i in range(len(store.localDirs()))]
    files = lambda: {f for top in tops for f in glob.glob(f"{top}/*/shuffle_*.data")}
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)
    before = files()
    monkeypatch.setattr(sharing, "_passes", lambda _: 3)
    got = catalog.QUERIES[name](spark, small)
    time.sleep(1)
    assert not files() - before
    assert got.count()


def written(frame, path):
    """Of each file, the bytes of a row and whether cosines stay in a dictionary."""
    import glob

    import pyarrow.parquet as pq

    frame.write.parquet(path)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    at = next(i for i in range(4) if groups[0].column(i).path_in_schema == "sim")
    return sum(g.total_byte_size for g in groups) / sum(m.num_rows for m in files), all("PLAIN" not in g.column(at).encodings for g in groups)


@pytest.mark.parametrize("name", ["item_cosine", "user_cosine"])
def test_written_pairs_are_small(spark, tmp_path, name):
    """Cosines repeat: as a dictionary they take about two bytes each instead of eight."""
    size, dictionary = written(catalog.QUERIES[name](spark, "/root/testdata/sf0.01"), f"{tmp_path}/out")
    assert dictionary and size < 6.5


def test_parts_of_pairs_are_ranges(spark, monkeypatch):
    """Tenants that share nothing lie in few parts each, with their share of the entries; hot ids and null keys too."""
    monkeypatch.setattr(sharing, "LEAST_TASK", 150)
    monkeypatch.setattr(sharing, "PAIRS", 40)
    draw = np.random.default_rng(2)
    cells = sorted({(t * 100 + int(u), t * 1000 + int(i)) for t in range(6) for u, i in zip(draw.integers(0, 20, 200), draw.integers(0, 30, 200) ** 2 // 30, strict=True)})
    rows = [(u, i, float(draw.integers(1, 50))) for u, i in cells] + [(None, 3, 2.0), (7, None, 2.0)]
    ui = spark.createDataFrame(rows, "user long, item long, rating double")
    sims, shared, _ = brute([(u, i, r) for u, i, r in rows if u is not None and i is not None and i != 3])
    got = sharing.pairs(ui, "item", "user")
    found = [list(p) for p in got.rdd.mapPartitions(lambda p: [[(r.a, r.b, r.shared, r.sim) for r in p]]).collect()]
    found = [p for p in found if p]
    assert len(found) > 4
    assert all(len({r[1] // 1000 for r in p}) <= 3 for p in found)
    ends = sorted((min(r[0] for r in p), max(r[0] for r in p)) for p in found)
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))
    all_rows = {(a, b): (n, s) for p in found for a, b, n, s in p if 3 not in (a, b)}
    assert set(all_rows) == {p for p in sims if p[0] < p[1] and 3 not in p}
    assert all(n == shared[p] and s == pytest.approx(sims[p], abs=2e-6) for p, (n, s) in all_rows.items())
    assert sum(map(len, found)) == len({(a, b) for p in found for a, b, *_ in p})
