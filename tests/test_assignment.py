"""The blocked search and the counts against brute force over all pairs, on awkward data."""

import datetime as dt
import math
import random

import pytest

from brightloom.config import CONSTRAINT_LEVELS, DispatchRules
from brightloom.functions import scoring
from brightloom.operators import assignment as S
from brightloom.operators import radius

DAY = dt.date(2024, 5, 1)


def km(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def world(seed, places, n_dispatches=150, n_technicians=60, hot=0.6):
    """Most dispatches on one day; points around ``places``; some without coordinates."""
    r = random.Random(seed)

    def point():
        lat, lon = r.choice(places)
        return max(-90.0, min(90.0, lat + r.uniform(-2, 2))), (lon + r.uniform(-2, 2) + 540) % 360 - 180

    technicians = [
        (i, f"T{i}", r.choice(["A", "B", "C", None]), r.choice(["x", "y"]), "s", *(point() if r.random() > 0.08 else r.choice([(None, None), (40.0, None)])), 4 + i % 3, r.randrange(6))
        for i in range(n_technicians)
    ]
    calendar = [(i, DAY + dt.timedelta(days=d), r.randrange(2)) for i in range(n_technicians) for d in range(3) if r.random() < 0.7]
    dispatches = []
    for i in range(n_dispatches):
        day = 0 if r.random() < hot else r.randrange(5)
        lat, lon = point() if r.random() > 0.1 else r.choice([(None, None), (None, 3.0), (40.0, None)])
        start = dt.datetime.combine(DAY, dt.time(9)) + dt.timedelta(days=day)
        dispatches.append((i, "Order", "repair", r.choice(["Critical", "Medium", "Low"]), r.choice(["A", "B", "C", "D"]), r.choice(["x", "y"]), "s", lat, lon, start, 30 * r.randint(1, 6)))
    return dispatches, calendar, technicians


def frames(spark, data):
    d, c, t = data
    return (
        spark.createDataFrame(d, "dispatch_id long, ticket_type string, order_type string, priority string, required_skill string, city string, state string, customer_latitude double, customer_longitude double, appointment_start timestamp, duration_min long"),
        spark.createDataFrame(c, "technician_id long, date date, available int"),
        spark.createDataFrame(t, "technician_id long, name string, primary_skill string, city string, state string, latitude double, longitude double, workload_capacity long, current_assignments long"),
    )


def all_pairs(spark, data):
    """Every (dispatch, technician of the day), scored, collected: only for small tests."""
    d, c, t = frames(spark, data)
    pairs = d.join(c, d.appointment_start.cast("date") == c.date).join(S.rename_technicians(t), "technician_id")
    return scoring.score_pairs(pairs, scoring.linear_scorer()).collect()


PLACES = {
    "town": [(40.0, -75.0)],
    "far apart": [(40.0, -75.0), (42.0, -75.0), (-33.0, 151.0)],
    "date line": [(10.0, 179.5), (-17.0, -179.0)],
    "poles": [(89.0, 10.0), (-89.5, -120.0)],
}


@pytest.mark.parametrize("place", PLACES)
def test_best_and_counts_equal_brute_force(spark, place):
    data = world(len(place), PLACES[place])
    # a tiny salt threshold splits the hot day over several keys
    rules = DispatchRules(rows_per_salt=20)
    pairs = all_pairs(spark, data)
    rank = {n: i for i, n in enumerate(CONSTRAINT_LEVELS)}
    want, counts, by_score = {}, {}, {}
    for p in pairs:
        cost = math.inf if p.final_score is None else round(-p.final_score, 6)
        key = (rank[p.constraint_level], cost, p.technician_id)
        want[p.dispatch_id] = min(want.get(p.dispatch_id, key), key)
        counts[p.dispatch_id, p.constraint_level] = counts.get((p.dispatch_id, p.constraint_level), 0) + 1
        by_score.setdefault(p.dispatch_id, []).append((cost, p.technician_id))
    for row in data[0]:
        if row[0] not in want:
            counts[row[0], "NO_DATE_MATCH"] = 1
    args = frames(spark, data)
    got = {r.dispatch_id: r.technician_id for r in S.best_technician(*args, rules=rules).collect()}
    assert got == {k: v[2] for k, v in want.items()}
    levels = {(r.dispatch_id, r.constraint_level): r.n_candidates for r in S.candidate_levels(*args, rules=rules).collect()}
    assert levels == counts
    top = {(r.dispatch_id, r.score_rank): r.technician_id for r in S.top_technicians(*args, k=3, rules=rules).collect()}
    assert top == {(d, i + 1): t for d, rows in by_score.items() for i, (_, t) in enumerate(sorted(rows)[:3])}


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("by_profile", [True, False])
def test_large_pools_equal_brute_force(spark, place, by_profile):
    """Every pool counts as large, so that probes, radii and summaries decide."""
    data = world(11 + len(place), PLACES[place], n_dispatches=120, n_technicians=150, hot=0.8)
    rules = DispatchRules(rows_per_salt=50, small_pool=1)
    exact = scoring.linear_scorer()
    scorer = exact if by_profile else lambda df: exact(df)
    rank = {n: i for i, n in enumerate(CONSTRAINT_LEVELS)}
    want, by_score = {}, {}
    for p in all_pairs(spark, data):
        cost = math.inf if p.final_score is None else round(-p.final_score, 6)
        want.setdefault(p.dispatch_id, []).append((rank[p.constraint_level], cost, p.technician_id))
        by_score.setdefault(p.dispatch_id, []).append((cost, p.technician_id))
    args = frames(spark, data)
    got = {r.dispatch_id: r.technician_id for r in S.best_technician(*args, scorer=scorer, rules=rules).collect()}
    assert got == {d: min(rows)[2] for d, rows in want.items()}
    top = {(r.dispatch_id, r.score_rank): r.technician_id for r in S.top_technicians(*args, k=3, scorer=scorer, rules=rules).collect()}
    assert top == {(d, i + 1): t for d, rows in by_score.items() for i, (_, t) in enumerate(sorted(rows)[:3])}


def test_scored_pairs_follow_the_input_not_its_square(spark):
    """Four times the dispatches and technicians on the same map: about four times the pairs."""

    def scored(times):
        data = world(3, PLACES["town"], n_dispatches=100 * times, n_technicians=1500 * times, hot=1.0)
        dispatches, calendar, technicians = frames(spark, data)
        rows = S._stored_pool(calendar, technicians)
        days = S._days(dispatches, rows, 10**9)
        wanted = S._with_days(dispatches, days).selectExpr(*S._SEARCH_COLUMNS, "appointment_date", "salt", "'any' AS pool")
        pool = S._salt_pool(rows.selectExpr(*[c for c in rows.columns if c != "kind"], "'any' AS pool"), days)
        probes, met = S.searched_pairs(wanted, pool, scoring.linear_scorer(), DispatchRules(), 1, False)
        return probes.count() + met.count()

    few, many = scored(1), scored(4)
    assert few < 100 * 1000 / 4 and many < 6 * few


@pytest.mark.parametrize("place", PLACES)
def test_neighbour_counts_equal_brute_force(spark, place):
    _, _, technicians = world(7, PLACES[place], n_technicians=150)
    points = [(t[0], t[5], t[6]) for t in technicians] + [(900 + i, 40.0, -75.0) for i in range(20)]  # a crowd on one spot
    got = {r.k: r.n_within for r in radius.neighbour_counts(spark.createDataFrame(points, "k long, latitude double, longitude double"), "k", 60.0).collect()}
    want = {
        k: sum(1 for j, lat2, lon2 in points if j != k and None not in (lat, lat2, lon, lon2) and km(lat, lon, lat2, lon2) <= 60.0) for k, lat, lon in points
    }
    assert got == want


def test_tie_goes_to_the_lower_id(spark):
    t = [(i, f"T{i}", "A", "x", "s", 40.0, -75.0, 4, 1) for i in (9, 4, 7)]
    c = [(i, DAY, 1) for i in (9, 4, 7)]
    d = [(1, "Order", "repair", "Low", "A", "x", "s", 40.1, -75.0, dt.datetime.combine(DAY, dt.time(9)), 60)]
    assert S.best_technician(*frames(spark, (d, c, t))).first().technician_id == 4


def test_search_bound_holds():
    assert scoring.least_travel_cost(30) == 0.5 * 30 + 2 * 10
    assert scoring.least_travel_cost(10) == 5.0
