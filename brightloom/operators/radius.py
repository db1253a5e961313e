"""How many neighbours lie within a radius, without listing pairs where a count will do.

Points fall into a fine grid. A pair of cells that is near enough as a whole contributes the
product of its counts; only cells that straddle the radius compare their points. A crowded
cell therefore costs one row, not the square of its points.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.geo import KM_PER_DEGREE, explode_reach, grid_cell, haversine_km


def neighbour_counts(points: DataFrame, key: str, radius_km: float, cells_per_radius: int = 8) -> DataFrame:
    """(key, n_within): other points within ``radius_km`` of each point; 0 without coordinates.

    Coarse cells of the radius say which fine cells can matter at all. Distances between the
    corners of two fine boxes bound the distances of their points from both sides.
    """
    step = radius_km / cells_per_radius / KM_PER_DEGREE
    p = points.selectExpr(
        key, "latitude", "longitude", f"CAST(floor((latitude + 90) / {step}D) AS INT) AS fy",
        f"CAST(floor((longitude + 180) / {step}D) AS INT) AS fx",
        f"{grid_cell('latitude', 'longitude', radius_km)} AS at",
    )
    known = p.filter("at IS NOT NULL")
    # a box: the true extent of the points in a fine cell (and one coarse cell)
    boxes = known.groupBy("at", "fy", "fx").agg(
        *[F.expr(f"{f}({c}) AS {n}") for f, c, n in (
            ("min", "latitude", "s"), ("max", "latitude", "n"), ("min", "longitude", "w"), ("max", "longitude", "e"), ("count", "*", "size"),
        )]
    )
    a = boxes.selectExpr("at", "fy", "fx", "s", "n", "w", "e", "(s + n) / 2 AS my", "(w + e) / 2 AS mx")
    half = f"greatest({haversine_km('my', 'mx', 's', 'w')}, {haversine_km('my', 'mx', 'n', 'w')}, {haversine_km('my', 'mx', 's', 'e')}, {haversine_km('my', 'mx', 'n', 'e')})"
    a = a.selectExpr("at", "fy", "fx", "my", "mx", f"{half} AS r", "s", "n", "w", "e")
    # every point of a box lies within r of its middle, for boxes far smaller than the sphere;
    # the reach is widened by the largest possible r
    slack = 2 * math.sqrt(2) * radius_km / cells_per_radius
    left = explode_reach(
        a.selectExpr("at AS at1", "fy AS fy1", "fx AS fx1", "my AS my1", "mx AS mx1", "r AS r1"), "my1", "mx1", radius_km + 2 * slack
    )
    right_cells = a.selectExpr(
        "at AS at2", "fy AS fy2", "fx AS fx2", "my AS my2", "mx AS mx2", "r AS r2",
        f"inline(array({grid_cell('my', 'mx', radius_km + 2 * slack)}))",
    )
    sizes = boxes.selectExpr("at AS at2", "fy AS fy2", "fx AS fx2", "size")
    near = left.join(right_cells, ["band", "cell"]).selectExpr(
        "at1", "fy1", "fx1", "at2", "fy2", "fx2", f"{haversine_km('my1', 'mx1', 'my2', 'mx2')} AS d", "r1", "r2",
    ).filter(f"d - r1 - r2 <= {radius_km}D")
    inside = near.filter(f"d + r1 + r2 <= {radius_km * (1 - 1e-9)}D")
    edge = near.filter(f"d + r1 + r2 > {radius_km * (1 - 1e-9)}D")
    whole = inside.join(sizes, ["at2", "fy2", "fx2"]).groupBy("at1", "fy1", "fx1").agg(F.expr("sum(size) AS n_whole"))
    p1 = known.selectExpr(key, "at AS at1", "fy AS fy1", "fx AS fx1", "latitude AS y1", "longitude AS x1")
    p2 = known.selectExpr("at AS at2", "fy AS fy2", "fx AS fx2", "latitude AS y2", "longitude AS x2")
    by_hand = (
        p1.join(edge.select("at1", "fy1", "fx1", "at2", "fy2", "fx2"), ["at1", "fy1", "fx1"])
        .join(p2, ["at2", "fy2", "fx2"])
        .filter(f"{haversine_km('y1', 'x1', 'y2', 'x2')} <= {radius_km}D")
        .groupBy(key)
        .agg(F.expr("count(*) AS n_edge"))
    )
    counted = p1.join(whole, ["at1", "fy1", "fx1"], "left").join(by_hand, key, "left").selectExpr(
        key, "coalesce(n_whole, 0L) + coalesce(n_edge, 0L) - 1 AS n_within"  # minus the point itself
    )
    return points.select(key).join(counted, key, "left").fillna(0, ["n_within"])
