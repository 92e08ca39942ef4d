import numpy as np
import pyarrow as pa

from tidemill.operators import recommend


def batch(cell, kind, ids, item=None, rating=None, f=None):
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array([cell] * n, pa.int32()), pa.array([kind] * n), pa.array(ids, pa.int64()), pa.array(item or [None] * n, pa.int64()), pa.array(rating or [None] * n, pa.float64()),
         pa.array([cell] * n, pa.int32()), pa.array(f or [None] * n, pa.list_(pa.float64()))],
        ["cell", "kind", "id", "item", "rating", "block", "f"],
    )


def test_cells_one_after_another_and_ratings_in_batches():
    """Two cells in one partition, one without ratings; ratings of earlier batches aren't kept."""
    first = [[0.1 * i, 0.2, 0.0] for i in range(40)]
    alive = []

    def sent():
        yield batch(0, "p", [500], f=[[1.0, 2.0, 0.0]])
        yield batch(1, "p", list(range(40)), f=first)
        yield batch(1, "q", [7, 9], f=[[0.3, 0.1, 0.0], [0.2, 0.5, 0.0]])
        base = pa.total_allocated_bytes()
        for u in range(40):
            yield batch(1, "r", [u] * 1000, [7, 9] * 500, [float(u % 5)] * 1000)
            alive.append(pa.total_allocated_bytes() - base)

    got = {(r["kind"], r["id"]): r["f"] for b in recommend._descend_cells(2, 1.5, 0.01, 0.02)(sent()) for r in b.to_pylist()}
    p, q = np.array(first), {7: np.array([0.3, 0.1, 0.0]), 9: np.array([0.2, 0.5, 0.0])}
    recommend._descend([(u, i, float(u % 5)) for u in range(40) for i in [7, 9] * 500], p, q, 1.5, 0.01, 0.02)
    assert got["p", 500] == [1.0, 2.0, 0.0] and len(got) == 43
    assert all(np.allclose(got["p", u], p[u]) for u in range(40)) and all(np.allclose(got["q", i], q[i]) for i in q)
    assert max(alive) < 4 * batch(1, "r", [1] * 1000, [7] * 1000, [1.0] * 1000).nbytes
