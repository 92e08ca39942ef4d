import numpy as np
import pyarrow as pa
import pytest

from tidemill.operators import recommend


def batch(kind, ids, item=None, rating=None, f=None):
    n = len(ids)
    null = [None] * n
    return pa.RecordBatch.from_arrays(
        [pa.array([0] * n, pa.int32()), pa.array([kind] * n), pa.array(ids, pa.int64()), pa.array(null if item is None else item, pa.int64()), pa.array(null if rating is None else rating, pa.float64()),
         pa.array([0] * n, pa.int32()), pa.array(null if f is None else list(f), pa.list_(pa.float64()))],
        ["cell", "kind", "id", "item", "rating", "block", "f"],
    )


@pytest.mark.parametrize("hot", [False, True])
def test_ratings_descend_in_waves(monkeypatch, hot):
    """The factors of one rating after the other, though hardly any goes alone; with one item of every user as well."""
    draw = np.random.default_rng(7)
    pairs = {(int(u), int(i)) for u, i in zip(draw.integers(0, 900, 12_000), draw.integers(1, 1500, 12_000), strict=True)} | ({(u, 0) for u in range(900)} if hot else set())
    rows = [(u, i, float((3 * u + i) % 5)) for u, i in sorted(pairs)]
    p, q = draw.random((900, 4)), draw.random((1500, 4))
    one, alone = recommend._descend, []

    def counted(ratings, *more):
        alone.extend(ratings := list(ratings))
        one(ratings, *more)

    monkeypatch.setattr(recommend, "_descend", counted)
    # factors of a kind may come in any order
    sent = [batch("p", range(450, 900), f=p[450:]), batch("p", range(450), f=p[:450]), batch("q", range(1500), f=q)]
    sent += [batch("r", *zip(*[(u, i) for u, i, _ in part], strict=True), [r for _, _, r in part]) for part in (rows[:5000], rows[5000:5001], rows[5001:])]
    got = {(r["kind"], r["id"]): r["f"] for b in recommend._descend_cells(3, 1.5, 0.01, 0.02)(iter(sent)) for r in b.to_pylist()}
    one(rows, p, q, 1.5, 0.01, 0.02)
    assert len(alone) < (0.1 if hot else 0.02) * len(rows)
    assert np.allclose([got["p", u] for u in range(900)], p, rtol=1e-11) and np.allclose([got["q", i] for i in range(1500)], q, rtol=1e-11)


def test_chunks_keep_the_order(monkeypatch):
    """Chunks hold rows of one cell in their order, at most ``CHUNK`` and a batch, and know their first pair."""
    monkeypatch.setattr(recommend, "CHUNK", 70)
    rows = sorted((s, c, u, u * 7 % 5, u / 4) for s in range(2) for c in range(3) for u in range(50 * c + s))
    names = ["stratum", "cell", "user", "item", "rating"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 30], strict=True), kinds, strict=True)], names) for lo in range(0, len(rows), 30)]
    found = []
    for b in recommend._pack_ratings(iter(batches)):
        stratum, cell, user, item, blob = b.to_pylist()[0].values()
        sent = pa.RecordBatch.from_arrays([pa.array([cell]), pa.array(["r"]), pa.array([None], pa.int32()), pa.array([blob], pa.binary())], ["cell", "kind", "block", "blob"])
        inside = [(stratum, r["cell"], r["id"], r["item"], r["rating"]) for out in recommend._unpack_cells(2)(iter([sent])) for r in out.to_pylist()]
        assert inside[0][2:4] == (user, item) and len(inside) <= 100
        found += inside
    assert found == rows


def test_descent_leaves_only_its_factors(spark, tmp_path, monkeypatch):
    """Ratings and factors of former strata go from the shared folder; the kept epoch's stay readable."""
    from pathlib import Path

    from tidemill import runtime

    monkeypatch.setattr(runtime, "shared_dir", lambda spark: f"file://{tmp_path}")
    train = spark.createDataFrame([(u, i, float((u + i) % 3)) for u in range(20) for i in range(9)], "user long, item long, rating double")
    model = recommend.block_sgd(train, k=2, rate=0.9, epochs=4, blocks=2, valid=train, patience=2)
    assert {p.name.split("-")[0] for p in Path(tmp_path, "tidemill").iterdir()} == {"factors"} and len(list(Path(tmp_path, "tidemill").iterdir())) <= 2
    assert model["p"].count() == 20 and model["q"].count() == 9
