"""Pair sums and cells against brute force."""

import math
import random

import pytest

from brightloom.operators import particles as P

SCHEMA = "pid long, px double, py double, vx double, vy double, mass double"


def cloud(n, seed=3):
    r = random.Random(seed)
    near = [(i, 0.5 + r.gauss(0, 1e-3), 0.5 + r.gauss(0, 1e-3), 0.1, 0.0, 1.0 + i % 3) for i in range(n // 3)]  # a third in one spot
    return near + [(i, r.random(), r.random(), 0.0, 0.1, 1.0) for i in range(n // 3, n)]


def brute(ps, below):
    out = {}
    for a in ps:
        ax = ay = 0.0
        for b in ps:
            if a[0] != b[0]:
                dx, dy = a[1] - b[1], a[2] - b[2]
                r = math.hypot(dx, dy)
                ax, ay = ax - b[5] * dx / below(r), ay - b[5] * dy / below(r)
        out[a[0]] = (ax, ay)
    return out


@pytest.mark.parametrize("block", [7, 1000])
def test_blocked_sums(spark, block):
    ps = cloud(40)
    df = spark.createDataFrame(ps, SCHEMA)
    for kind, below in (("plummer", lambda r: r * (r * r + 0.01)), ("softened", lambda r: (r + 0.1) ** 3)):
        want = brute(ps, below)
        got = {r.pid: (r.ax, r.ay) for r in P.pair_force(df, kind, 0.1, block_rows=block).collect()}
        assert got.keys() == want.keys()
        for k, (x, y) in want.items():
            assert math.isclose(got[k][0], x, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(got[k][1], y, rel_tol=1e-9, abs_tol=1e-9)
    row = P.pair_potential(df, block_rows=block).first()
    want = -sum(a[5] * b[5] / math.hypot(a[1] - b[1], a[2] - b[2]) for i, a in enumerate(ps) for b in ps[i + 1 :])
    assert math.isclose(row.potential, want, rel_tol=1e-9) and row.pairs == 40 * 39 // 2


@pytest.mark.parametrize("levels", [3, 12])
def test_multipole_without_tolerance_is_exact(spark, levels):
    ps = cloud(60)
    df = spark.createDataFrame(ps, SCHEMA)
    want = brute(ps, lambda r: r * (r * r + 0.01))
    got = {r.pid: r for r in P.multipole_force(df, 0.0, 0.1, levels).collect()}
    for k, (x, y) in want.items():
        assert math.isclose(got[k].ax, x, rel_tol=1e-8, abs_tol=1e-8) and math.isclose(got[k].ay, y, rel_tol=1e-8, abs_tol=1e-8)
        assert got[k].n_terms == 59
    rough = {r.pid: r for r in P.multipole_force(df, 1.0, 0.1, levels).collect()}
    assert sum(r.n_terms for r in rough.values()) < 60 * 59


def test_cells(spark):
    df = spark.createDataFrame(cloud(60), SCHEMA)
    total = df.groupBy().sum("mass").first()[0]
    cells = P.quadtree_cells(df, 6).groupBy("level").sum("mass", "n").collect()
    assert len(cells) == 7 and all(math.isclose(r["sum(mass)"], total) and r["sum(n)"] == 60 for r in cells)
    # the exact centre belongs to the lower-left child
    one = P.quadtree_cells(spark.createDataFrame([(1, 0.5, 0.5, 0.0, 0.0, 1.0)], SCHEMA), 1, box=(0.0, 1.0, 0.0, 1.0))
    assert [(r.cx, r.cy) for r in one.filter("level = 1").collect()] == [(0, 0)]
