from collections import defaultdict

import numpy as np
import pytest

from tidemill.operators import matching
from tidemill.plans import catalog


@pytest.mark.parametrize("span", [200, 4000])
def test_best_mates_against_plain_loops(span):
    """Several slots a day, ties, users without mates; small and wide numbers."""
    draw = np.random.default_rng(3)
    start = draw.integers(0, span, 160)
    rows = np.unique(np.stack([draw.integers(0, 20, 160), draw.integers(0, 4, 160), start // 20 * 20, start // 20 * 20 + draw.integers(2, 6, 160) * 20], axis=1), axis=0)
    minutes, days = defaultdict(int), defaultdict(set)
    for u, d, s, e in rows.tolist():
        for v, other, x, y in rows.tolist():
            if u != v and d == other and min(e, y) - max(s, x) >= 30:
                minutes[u, v] += min(e, y) - max(s, x)
                days[u, v].add(d)
    want = {}
    for u in {p[0] for p in minutes}:
        best = sorted((-m, v) for (a, v), m in minutes.items() if a == u)[:4]
        want[u] = sorted((v, -m, len(days[u, v])) for m, v in best)
    got = {int(u): sorted(zip(v.tolist(), m.tolist(), d.tolist(), strict=True)) for u, v, m, d in matching._best_mates(rows, rows, 30, 4)}
    assert got == want


def test_mates_makes_no_row_a_pair(spark, small):
    plan = catalog.QUERIES["mates"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "MapInArrow" in plan


def test_tiles(spark, small, monkeypatch):
    """Several blocks of mates give what one gives."""
    slots = catalog._slots(spark, small)
    one = {tuple(r) for r in matching.mates(slots, 200).collect()}
    monkeypatch.setattr(matching, "CELLS", 200)
    assert one and {tuple(r) for r in matching.mates(slots, 200).collect()} == one
