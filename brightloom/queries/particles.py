"""Particle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brightloom import adapters as A
from brightloom.operators import particles as P
from brightloom.queries.base import query
from brightloom.queries.dispatch import r4, r4s
from brightloom.queries.views_sql import view, with_views

LEVELS, THETA, SOFT, G = 12, 1.0, 0.1, 0.5

PAIRS = "particles a JOIN particles b ON a.pid <> b.pid"
R = "sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2))"


@query(
    "pair_potential",
    with_views("particles", f"SELECT round(sum(-a.mass * b.mass / {R}) / 2, 4) AS potential, CAST(count(*) / 2 AS BIGINT) AS pairs FROM {PAIRS}"),
)
def pair_potential(spark: SparkSession, sf: str) -> DataFrame:
    return P.pair_potential(A.particles(spark, sf), block_rows=256).selectExpr("round(potential, 4) AS potential", "pairs")


def _force_sql(below: str, g: str) -> str:
    return with_views("particles", f"""SELECT pid, {r4s('ax', 'ay')} FROM (SELECT a.pid, sum(-{g} * b.mass * (a.px - b.px) / ({below})) AS ax,
      sum(-{g} * b.mass * (a.py - b.py) / ({below})) AS ay FROM {PAIRS} GROUP BY a.pid) f""")


@query("pair_force_plummer_like", _force_sql(f"{R} * (pow({R}, 2) + 0.01)", "1"))
def pair_force_plummer_like(spark: SparkSession, sf: str) -> DataFrame:
    return P.pair_force(A.particles(spark, sf), "plummer", SOFT, block_rows=256).selectExpr("pid", *r4("ax", "ay"))


@query("pair_force_softened", _force_sql(f"pow({R} + 0.1, 3)", "0.5"))
def pair_force_softened(spark: SparkSession, sf: str) -> DataFrame:
    return P.pair_force(A.particles(spark, sf), "softened", SOFT, G, block_rows=256).selectExpr("pid", *r4("ax", "ay"))


view("box", "particles", """SELECT min(px) - CAST(0.1 AS DOUBLE) AS x0, max(px) + CAST(0.1 AS DOUBLE) AS x1,
  min(py) - CAST(0.1 AS DOUBLE) AS y0, max(py) + CAST(0.1 AS DOUBLE) AS y1 FROM particles""")
view("placed", "particles box", """SELECT p.*, l.level, pow(2, l.level) AS side, x0, y0, (x1 - x0) / pow(2, l.level) AS w, (y1 - y0) / pow(2, l.level) AS h,
  CAST(greatest(0, ceil((px - x0) / (x1 - x0) * pow(2, l.level)) - 1) AS INT) AS cx, CAST(greatest(0, ceil((py - y0) / (y1 - y0) * pow(2, l.level)) - 1) AS INT) AS cy
  FROM particles p, box, (SELECT CAST(unnest(range(0, 13)) AS INT) AS level) l""")
view("cells", "placed", """SELECT level, cx, cy, x0, y0, w, h, count(*) AS n, sum(mass) AS mass, sum(mass * px) / sum(mass) AS mx, sum(mass * py) / sum(mass) AS my
  FROM placed GROUP BY 1, 2, 3, 4, 5, 6, 7""")
DR = "sqrt(pow(p.px - c.mx, 2) + pow(p.py - c.my, 2))"
ACT = f"""CASE WHEN (c.cx = CAST(greatest(0, ceil((p.px - c.x0) / (c.w * pow(2, c.level)) * pow(2, c.level)) - 1) AS INT)
  AND c.cy = CAST(greatest(0, ceil((p.py - c.y0) / (c.h * pow(2, c.level)) * pow(2, c.level)) - 1) AS INT)) OR (p.px >= c.x0 + c.cx * c.w AND p.px <= c.x0 + c.cx * c.w + c.w AND p.py >= c.y0 + c.cy * c.h AND p.py <= c.y0 + c.cy * c.h + c.h)
  THEN CASE WHEN c.n = 1 THEN 'self' ELSE 'open' END WHEN c.n = 1 OR greatest(c.w, c.h) < {THETA} * {DR} THEN 'take' ELSE 'open' END"""


@query(
    "pair_force_multipole",
    with_views("cells", f"""WITH RECURSIVE walk AS (
      SELECT p.pid, p.px, p.py, c.level, c.cx, c.cy, c.mass, c.mx, c.my, {ACT} AS act FROM particles p JOIN cells c ON c.level = 0
      UNION ALL SELECT p.pid, p.px, p.py, c.level, c.cx, c.cy, c.mass, c.mx, c.my, {ACT} AS act FROM walk p JOIN cells c
        ON p.act = 'open' AND c.level = p.level + 1 AND c.cx // 2 = p.cx AND c.cy // 2 = p.cy),
    terms AS (SELECT pid, px, py, mass, mx, my FROM walk WHERE act = 'take' UNION ALL
      SELECT w.pid, w.px, w.py, q.mass, q.px, q.py FROM walk w JOIN placed q ON w.act = 'open' AND w.level = {LEVELS} AND q.level = {LEVELS} AND q.cx = w.cx AND q.cy = w.cy AND q.pid <> w.pid)
    SELECT pid, {r4s('ax', 'ay')}, n_terms FROM (SELECT pid, sum(-mass * (px - mx) / (d * (d * d + 0.01))) AS ax, sum(-mass * (py - my) / (d * (d * d + 0.01))) AS ay, count(*) AS n_terms
      FROM (SELECT *, sqrt(pow(px - mx, 2) + pow(py - my, 2)) AS d FROM terms) t GROUP BY pid) f"""),
)
def pair_force_multipole(spark: SparkSession, sf: str) -> DataFrame:
    return P.multipole_force(A.particles(spark, sf), THETA, SOFT, LEVELS).selectExpr("pid", *r4("ax", "ay"), "n_terms")


@query("agg_quadtree_cells", with_views("cells", f"SELECT level, cx, cy, n, {r4s('mass', 'mx', 'my')} FROM cells"))
def agg_quadtree_cells(spark: SparkSession, sf: str) -> DataFrame:
    return P.quadtree_cells(A.particles(spark, sf), LEVELS).selectExpr("level", "cx", "cy", "n", *r4("mass", "mx", "my"))


@query("agg_bounding_box", with_views("box", f"SELECT {r4s('x0', 'x1', 'y0', 'y1')} FROM box"))
def agg_bounding_box(spark: SparkSession, sf: str) -> DataFrame:
    return P.bounding_box(A.particles(spark, sf)).selectExpr(*r4("x0", "x1", "y0", "y1"))


@query("agg_kinetic_energy", with_views("particles", "SELECT round(sum(mass * (vx * vx + vy * vy)) / 2, 4) AS kinetic FROM particles"))
def agg_kinetic_energy(spark: SparkSession, sf: str) -> DataFrame:
    return P.kinetic_energy(A.particles(spark, sf)).selectExpr("round(kinetic, 4) AS kinetic")


CENTROID = ", ".join(f"round(sum(mass * {c}) / sum(mass) + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS {c}" for c in ("px", "py", "vx", "vy"))


@query("agg_weighted_centroid", with_views("particles", f"SELECT {CENTROID}, sum(mass) AS mass FROM particles"))
def agg_weighted_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return P.weighted_centroid(A.particles(spark, sf)).selectExpr(*r4("px", "py", "vx", "vy"), "mass")


@query(
    "agg_radial_density",
    with_views("particles", """SELECT bin, n, round(n / (sum(n) OVER () * CAST(0.04 AS DOUBLE)), 4) AS density FROM
    (SELECT CAST(least(49, floor(r2 / CAST(0.04 AS DOUBLE))) AS INT) AS bin, count(*) AS n FROM (SELECT px * px + py * py AS r2 FROM particles) r WHERE r2 BETWEEN 0 AND 2 GROUP BY 1) c"""),
)
def agg_radial_density(spark: SparkSession, sf: str) -> DataFrame:
    return P.radial_density(A.particles(spark, sf), 50, 0.0, 2.0).selectExpr("bin", "n", "round(density, 4) AS density")


@query(
    "agg_drift_pct",
    """SELECT o_custkey, round(100 * abs(f - l) / (-f), 4) AS drift_pct FROM (SELECT o_custkey, arg_min(-o_totalprice, (o_orderdate, o_orderkey)) AS f,
    arg_max(-o_totalprice, (o_orderdate, o_orderkey)) AS l FROM orders GROUP BY 1) e""",
)
def agg_drift_pct(spark: SparkSession, sf: str) -> DataFrame:
    # a customer's orders in time are one series
    series = A.table(spark, sf, "orders").selectExpr("o_custkey", "o_orderdate", "o_orderkey", "-o_totalprice AS energy")
    return P.drift_pct(series, ["o_custkey"], "struct(o_orderdate, o_orderkey)", "energy").selectExpr(
        "o_custkey", "round(drift_pct, 4) AS drift_pct"
    )
