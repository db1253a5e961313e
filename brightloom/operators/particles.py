"""Sums over particle pairs, and the cell hierarchy that makes them affordable.

Particles are ``(pid, px, py, vx, vy, mass)``. Exact pair sums are quadratic by definition:
they run block against block, where a task holds two blocks and gives back one partial sum per
particle, so no pair is ever a row. For large sets ``multipole_force`` walks a cell hierarchy
level by level instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.session import cut_lineage



def _blocked(
    particles: DataFrame, block_rows: int, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Each particle meets each block once: as a target in its block's row, as a source in its column.

    Blocks are a hash of the unique id, so they are even whatever the positions are.
    """
    blocks = max(1, -(-particles.count() // block_rows))
    b = particles.selectExpr("*", f"CAST(pmod(xxhash64(pid), {blocks}) AS INT) AS block")
    every = f"explode(sequence(0, {blocks - 1}))"
    targets = b.selectExpr("pid", "px", "py", "mass", "block AS ti", f"{every} AS si")
    sources = b.selectExpr("pid", "px", "py", "mass", f"{every} AS ti", "block AS si")
    return targets.groupBy("ti", "si").cogroup(sources.groupBy("ti", "si")).applyInPandas(kernel, schema)


def _differences(t: pd.DataFrame, s: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dx = t["px"].to_numpy()[:, None] - s["px"].to_numpy()[None, :]
    dy = t["py"].to_numpy()[:, None] - s["py"].to_numpy()[None, :]
    r = np.sqrt(dx * dx + dy * dy)
    # a particle does not act on itself, and coincident ones have no direction
    r[(t["pid"].to_numpy()[:, None] == s["pid"].to_numpy()[None, :]) | (r == 0)] = np.inf
    return dx, dy, r


def pair_force(particles: DataFrame, kind: str, a: float, g: float = 1.0, block_rows: int = 1024) -> DataFrame:
    """(pid, ax, ay): acceleration from all other particles; ``kind`` is ``plummer`` or ``softened``."""

    def kernel(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if t.empty or s.empty:
            return pd.DataFrame({"pid": [], "ax": [], "ay": []})
        dx, dy, r = _differences(t, s)
        below = r * (r * r + a * a) if kind == "plummer" else (r + a) ** 3
        pull = -g * s["mass"].to_numpy()[None, :] / below
        return pd.DataFrame({"pid": t["pid"], "ax": (pull * dx).sum(axis=1), "ay": (pull * dy).sum(axis=1)})

    parts = _blocked(particles, block_rows, kernel, "pid long, ax double, ay double")
    return parts.groupBy("pid").agg(F.sum("ax").alias("ax"), F.sum("ay").alias("ay"))


def pair_potential(particles: DataFrame, block_rows: int = 1024) -> DataFrame:
    """One row: sum over unordered pairs of -m1·m2/r, and the number of pairs."""

    def kernel(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if t.empty or s.empty:
            return pd.DataFrame({"potential": [], "pairs": []})
        _, _, r = _differences(t, s)
        e = -(t["mass"].to_numpy()[:, None] * s["mass"].to_numpy()[None, :]) / r
        return pd.DataFrame({"potential": [e.sum()], "pairs": [int(np.isfinite(r).sum())]})

    parts = _blocked(particles, block_rows, kernel, "potential double, pairs long")
    # every pair was met from both sides
    return parts.agg(F.expr("sum(potential) / 2 AS potential"), F.expr("CAST(sum(pairs) / 2 AS BIGINT) AS pairs"))


def bounding_box(particles: DataFrame, pad: float = 0.1) -> DataFrame:
    return particles.agg(
        F.expr(f"min(px) - {pad}D AS x0"), F.expr(f"max(px) + {pad}D AS x1"),
        F.expr(f"min(py) - {pad}D AS y0"), F.expr(f"max(py) + {pad}D AS y1"),
    )


def kinetic_energy(particles: DataFrame) -> DataFrame:
    return particles.agg(F.expr("sum(mass * (vx * vx + vy * vy)) / 2 AS kinetic"))


def weighted_centroid(particles: DataFrame) -> DataFrame:
    means = [F.expr(f"sum(mass * {c}) / sum(mass) AS {c}") for c in ("px", "py", "vx", "vy")]
    return particles.agg(*means, F.expr("sum(mass) AS mass"))


def radial_density(particles: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """Density histogram of r2 = px² + py² (the squared radius) over a fixed range, last bin closed."""
    width = (high - low) / bins
    r2 = particles.selectExpr("px * px + py * py AS r2").filter(f"r2 BETWEEN {low}D AND {high}D")
    counts = r2.groupBy(
        F.expr(f"CAST(least({bins - 1}, floor((r2 - {low}D) / {width!r}D)) AS INT) AS bin")
    ).agg(F.expr("count(*) AS n"))
    # at most ``bins`` rows meet in the window
    return counts.selectExpr("bin", "n", f"n / (sum(n) OVER () * {width!r}D) AS density")


def drift_pct(series: DataFrame, ids: list[str], order: str, value: str) -> DataFrame:
    """100·|first - last| / (-first) per series."""
    ends = series.groupBy(*ids).agg(
        F.expr(f"min_by({value}, {order}) AS first_value"), F.expr(f"max_by({value}, {order}) AS last_value")
    )
    return ends.selectExpr(*ids, "100 * try_divide(abs(first_value - last_value), -first_value) AS drift_pct")


# --- cells -------------------------------------------------------------------------------------------
def _box(particles: DataFrame, pad: float) -> tuple[float, float, float, float]:
    b = bounding_box(particles, pad).first()
    return b.x0, b.x1, b.y0, b.y1


def cell_index(position: str, low: float, high: float, level: int) -> str:
    """Cell of a coordinate; a point on an inner edge belongs to the lower cell."""
    return f"CAST(greatest(0, ceil(({position} - {low!r}D) / {high - low!r}D * {1 << level}D) - 1) AS INT)"


def quadtree_cells(particles: DataFrame, levels: int, pad: float = 0.1, box: tuple | None = None) -> DataFrame:
    """(level, cx, cy, n, mass, mx, my) of every occupied cell at levels 0..levels.

    The particles are aggregated once, at the finest level. Coarser cells are sums of those
    rows: a cell's parent is its index halved.
    """
    x0, x1, y0, y1 = box or _box(particles, pad)
    finest = particles.groupBy(
        F.expr(f"{cell_index('px', x0, x1, levels)} AS fx"), F.expr(f"{cell_index('py', y0, y1, levels)} AS fy")
    ).agg(
        F.expr("count(*) AS n"), F.expr("sum(mass) AS mass"), F.expr("sum(mass * px) AS sx"), F.expr("sum(mass * py) AS sy")
    )
    up = finest.selectExpr("*", f"explode(sequence(0, {levels})) AS level")
    return (
        up.groupBy("level", F.expr(f"shiftright(fx, {levels} - level) AS cx"), F.expr(f"shiftright(fy, {levels} - level) AS cy"))
        .agg(F.expr("sum(n) AS n"), F.expr("sum(mass) AS mass"), F.expr("sum(sx) AS sx"), F.expr("sum(sy) AS sy"))
        .selectExpr("level", "cx", "cy", "n", "mass", "sx / mass AS mx", "sy / mass AS my")
    )


def multipole_force(particles: DataFrame, theta: float, a: float, levels: int = 16, pad: float = 0.1) -> DataFrame:
    """(pid, ax, ay, n_terms): pull of cells seen under an angle below ``theta``, and of single particles.

    A cell that is far enough acts as one mass at its centre; a nearer one is opened into its at
    most four children. All particles go down one level per round, by a join on the cell key.
    What is still open at the last level meets its particles one by one, so nothing is cut off.
    """
    x0, x1, y0, y1 = box = _box(particles, pad)
    cells = cut_lineage(quadtree_cells(particles, levels, pad, box))
    dr = "sqrt(pow(px - mx, 2) + pow(py - my, 2))"
    pull = f"-mass / ({dr} * (pow({dr}, 2) + {a * a!r}D))"
    opened = particles.selectExpr("pid", "px", "py", "0 AS pcx", "0 AS pcy")
    taken = []
    for level in range(levels + 1):
        w, h = (x1 - x0) / (1 << level), (y1 - y0) / (1 << level)
        side = cells.filter(f"level = {level}").selectExpr(
            "cx", "cy", "shiftright(cx, 1) AS pcx", "shiftright(cy, 1) AS pcy", "n", "mass", "mx", "my"
        )
        # 4^6 = 4096 cells at the most; finer levels are joined by shuffle
        side = F.broadcast(side) if level <= 6 else side
        left, low = f"{x0!r}D + cx * {w!r}D", f"{y0!r}D + cy * {h!r}D"
        # closed edges; its own cell by index, whatever rounding does to the edge
        own = f"cx = {cell_index('px', x0, x1, level)} AND cy = {cell_index('py', y0, y1, level)}"
        inside = f"({own}) OR (px >= {left} AND px <= {left} + {w!r}D AND py >= {low} AND py <= {low} + {h!r}D)"
        met = opened.join(side, ["pcx", "pcy"]).selectExpr(
            "pid", "px", "py", "cx", "cy", "mass", "mx", "my",
            f"""CASE WHEN {inside} THEN CASE WHEN n = 1 THEN 'self' ELSE 'open' END
                WHEN n = 1 OR {max(w, h)!r}D < {theta}D * {dr} THEN 'take' ELSE 'open' END AS act""",
        ).filter("act <> 'self'")
        met = cut_lineage(met)
        taken.append(met.filter("act = 'take'").selectExpr("pid", f"{pull} * (px - mx) AS ax", f"{pull} * (py - my) AS ay"))
        opened = met.filter("act = 'open'").selectExpr("pid", "px", "py", "cx AS pcx", "cy AS pcy")
        if opened.isEmpty():
            break
    else:
        alone = particles.selectExpr(
            "pid AS other", "px AS mx", "py AS my", "mass",
            f"{cell_index('px', x0, x1, levels)} AS pcx", f"{cell_index('py', y0, y1, levels)} AS pcy",
        )
        near = opened.join(alone, ["pcx", "pcy"]).filter(f"pid <> other AND {dr} > 0")
        taken.append(near.selectExpr("pid", f"{pull} * (px - mx) AS ax", f"{pull} * (py - my) AS ay"))
    return reduce(DataFrame.unionByName, taken).groupBy("pid").agg(
        F.sum("ax").alias("ax"), F.sum("ay").alias("ay"), F.expr("count(*) AS n_terms")
    )
