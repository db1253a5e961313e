"""The radius join in cells of several radii against brute force, and how few rows it deals out."""

import random

import pytest

from brightloom.config import DispatchRules
from brightloom.functions import geo
from brightloom.operators import assignment as S
from tests.test_assignment import PLACES, all_pairs, frames, km, world


def points(place, n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lat, lon = r.choice(PLACES[place])
        out.append((i, max(-90.0, min(90.0, lat + r.uniform(-2, 2))), (lon + r.uniform(-2, 2) + 540) % 360 - 180))
    return [*out, (n, 90.0, 0.0), (n + 1, -90.0, 100.0), (n + 2, 0.3, 180.0), (n + 3, 0.1, -180.0), (n + 4, None, 1.0)]


@pytest.mark.parametrize("radius", [60.0, 300.0, 5000.0])
@pytest.mark.parametrize("place", PLACES)
def test_near_cells_hold_every_near_pair_once(spark, place, radius):
    a, b = points(place, 80, 1), points(place, 80, 2)
    left = spark.createDataFrame(a, "i long, y1 double, x1 double").selectExpr("*", "cos(radians(y1)) AS c1")
    right = spark.createDataFrame(b, "j long, y2 double, x2 double").selectExpr("*", "cos(radians(y2)) AS c2")
    near = geo.explode_near(left, "y1", "x1", radius, 4 * radius)
    cells = right.selectExpr("*", f"inline(array({geo.grid_cell('y2', 'x2', 4 * radius)}))")
    test = geo.surely_within("y1", "x1", "c1", "y2", "x2", "c2", radius)
    got = [(r.i, r.j) for r in near.join(cells, ["band", "cell"]).filter(test).collect()]
    want = {(i, j) for i, y1, x1 in a for j, y2, x2 in b if None not in (y1, y2) and km(y1, x1, y2, x2) <= radius}
    assert len(got) == len(set(got)) and set(got) == want


def test_feasible_pairs_equal_brute_force_and_deal_out_few_rows(spark):
    data = world(31, PLACES["town"], n_dispatches=300, n_technicians=60)
    rules = DispatchRules(rows_per_salt=50)
    want = {(p.dispatch_id, p.technician_id) for p in all_pairs(spark, data) if p.constraint_level == "ALL_CONSTRAINTS_MET"}
    got = [(r.dispatch_id, r.technician_id) for r in S.feasible_pairs(*frames(spark, data), rules=rules).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r.dispatch_id for r in S.dispatches_with_feasible(*frames(spark, data), rules=rules).collect()} == {d for d, _ in want}
    dispatches, calendar, technicians = frames(spark, data)
    pool, days = S._stocked(dispatches, calendar, technicians, rules)
    counted = S._with_days(dispatches, days)
    reach, _ = S._near_sides(counted, pool, days, rules.hard_max_km)
    # nine cells each before
    assert reach.count() < 4 * dispatches.count()


def test_technicians_on_one_spot_are_counted_but_met_once(spark):
    dispatches, calendar, technicians = world(37, PLACES["town"], n_dispatches=60, n_technicians=30)
    technicians = [(i + 100 * c, *row) for c in range(5) for i, *row in technicians]
    calendar = [(i + 100 * c, day, free) for c in range(5) for i, day, free in calendar]
    data = dispatches, calendar, technicians
    rules = DispatchRules(rows_per_salt=20)
    want = {}
    for p in all_pairs(spark, data):
        want[p.dispatch_id, p.constraint_level] = want.get((p.dispatch_id, p.constraint_level), 0) + 1
    levels = S.candidate_levels(*frames(spark, data), rules=rules)
    got = {(r.dispatch_id, r.constraint_level): r.n_candidates for r in levels.collect() if r.constraint_level != "NO_DATE_MATCH"}
    assert got == want
    assert "n_here" in levels._jdf.queryExecution().optimizedPlan().toString()
