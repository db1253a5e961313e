"""Spectral cubes as long tables.

A cube is ``(…ids, w, y, x, flux)``, an image ``(…ids, y, x, f)``. Everything is a filter, a
join on small axis frames, or a grouped aggregate, so one huge cube and a million small ones
run the same way. ``ids`` names the columns that tell cubes apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.config import LIGHT_SPEED_KM_S, VELOCITY_GRID_KM_S
from brightloom.session import broadcast_if_small, cut_lineage, small_side


def wave_index(wave: str, wave_min: str, step: str) -> str:
    """Channel of a wavelength: truncated toward zero."""
    return f"CAST(({wave} - {wave_min}) / {step} AS INT)"


def velocity(wave: str, center: float) -> str:
    return f"{LIGHT_SPEED_KM_S}D * ({wave} - {center}D) / {center}D"


def _to_grid(v: float) -> int:
    """Nearest multiple of 10 km/s; Python's round is half-even."""
    return int(round(v / VELOCITY_GRID_KM_S) * VELOCITY_GRID_KM_S)


# --- element operators -------------------------------------------------------------------------
def crop_scale(cube: DataFrame, y0: int, y1: int, x0: int, x1: int, factor: float = 10.0) -> DataFrame:
    """Rows y0..y1-1 and columns x0..x1-1, re-based to 0, flux times ``factor``."""
    kept = cube.filter(f"y >= {y0} AND y < {y1} AND x >= {x0} AND x < {x1}")
    return kept.withColumns({"y": F.expr(f"y - {y0}"), "x": F.expr(f"x - {x0}"), "flux": F.expr(f"flux * {factor}D")})


def drop_first_plane(cube: DataFrame) -> DataFrame:
    return cube.filter("w >= 1").withColumn("w", F.expr("w - 1"))


def mask_box(image: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Blank rows y0..y1-1 and columns x0..x1-1."""
    return image.withColumn("f", F.expr(f"CASE WHEN NOT (y >= {y0} AND y < {y1} AND x >= {x0} AND x < {x1}) THEN f END"))


def log_clamp(image: DataFrame) -> DataFrame:
    return image.withColumn("f", F.expr("CASE WHEN f <= 0 THEN 0.01D ELSE f END"))


def gaussian2d(h: str, cx: str, cy: str, wx: str, wy: str, x: str = "x", y: str = "y") -> str:
    return f"{h} * exp(-0.5D * (pow(({cx} - {x}) / {wx}, 2) + pow(({cy} - {y}) / {wy}, 2)))"


def flip_augment(
    images: DataFrame, id_column: str, ny: int, nx: int, seed: int, keys: tuple[str, str] | None = None
) -> DataFrame:
    """Left-right and up-down flips of ny x nx images, each for half of the images, chosen by seeded hash.

    ``keys``: two integer expressions to choose by instead; an image is flipped where its key is even.
    """
    lr, ud = (f"({k}) % 2 = 0" for k in keys or (f"xxhash64({id_column}, {seed})", f"xxhash64({id_column}, {seed}, 1)"))
    return images.selectExpr(
        id_column, f"CASE WHEN {ud} THEN {ny} - 1 - y ELSE y END AS y", f"CASE WHEN {lr} THEN {nx} - 1 - x ELSE x END AS x", "f"
    )


# --- aggregates ------------------------------------------------------------------------------------
def sum_range(cube: DataFrame, start: int, end: int, ids: list[str], factor: float = 1.0) -> DataFrame:
    """Image: sum of the planes start..end, both included."""
    return cube.filter(f"w BETWEEN {start} AND {end}").groupBy(*ids, "y", "x").agg(F.expr(f"sum(flux) * {factor}D AS f"))


def spectrum(cube: DataFrame, start: int, end: int, wave_min: float, step: float, scale: float, ids: list[str]) -> DataFrame:
    """Total flux per channel over ``scale``, with its wavelength."""
    totals = cube.filter(f"w BETWEEN {start} AND {end}").groupBy(*ids, "w").agg(F.expr(f"sum(flux) / {scale}D AS flux"))
    return totals.selectExpr(*ids, "w", f"{wave_min}D + {step}D * w AS wavelength", "flux")


def spectrum_lines(spec: DataFrame) -> DataFrame:
    return spec.selectExpr("w", "format_string('%.2f %.6f', wavelength, round(flux, 6)) AS value")


def check_sum(vcube: DataFrame, center: float, low: float, high: float, ids: list[str]) -> DataFrame:
    """Image: sum of the velocity planes between two rounded velocities, both included."""
    lo, hi = (_to_grid(LIGHT_SPEED_KM_S * (wave - center) / center) for wave in (low, high))
    return vcube.filter(f"v BETWEEN {lo} AND {hi}").groupBy(*ids, "y", "x").agg(F.expr("sum(flux) AS f"))


def background_stats(image: DataFrame, y0: int, y1: int, x0: int, x1: int, ids: list[str]) -> DataFrame:
    """Median of the positive pixels and deviation of all pixels in a box (y1, x1 included)."""
    box = image.filter(f"y BETWEEN {y0} AND {y1} AND x BETWEEN {x0} AND {x1}")
    stats = [F.expr("median(f) FILTER (WHERE f > 0) AS median"), F.expr("stddev_pop(f) AS std")]
    return box.groupBy(*ids).agg(*stats) if ids else box.agg(*stats)


def threshold_mask(image: DataFrame, stats: DataFrame, n: float, ids: list[str]) -> DataFrame:
    """Blank pixels at or below median + n·std; ``stats`` has one row per image."""
    joined = image.join(small_side(stats), ids)
    return joined.withColumn("f", F.expr(f"CASE WHEN f > median + {n}D * std THEN f END")).drop("median", "std")


def histogram(image: DataFrame, bins: int = 100, value_range: tuple[float, float] | None = None) -> DataFrame:
    """Counts in equal bins, the last one closed; the range defaults to the data's own."""
    if value_range is None:
        ends = image.agg(F.expr("min(f) AS lo"), F.expr("max(f) AS hi")).first()
        if ends.lo is None:  # no values, no bins
            return image.filter("false").selectExpr("CAST(NULL AS INT) AS bin", "CAST(NULL AS BIGINT) AS n")
        lo, hi = ends.lo, ends.hi
    else:
        lo, hi = value_range
    width = (hi - lo) / bins
    inside = image.filter(f"f >= {lo!r}D AND f <= {hi!r}D")
    at = f"CAST(least({bins - 1}, floor((f - {lo!r}D) / {width!r}D)) AS INT)" if width else "0"
    return inside.groupBy(F.expr(f"{at} AS bin")).agg(F.expr("count(*) AS n"))


def mean_exposures(cube: DataFrame, over: str, ids: list[str]) -> DataFrame:
    """Voxel-wise mean over the ``over`` column."""
    keys = [c for c in [*ids, "w", "y", "x"] if c != over]
    return cube.groupBy(*keys).agg(F.expr("avg(flux) AS flux"))


def moments(image: DataFrame, ids: list[str]) -> DataFrame:
    """Height, centroid and widths along the centre row and column of each image.

    First axis (y) centroid ``cy``, second axis (x) centroid ``cx``. The width along an axis is
    taken about the other axis' centre: a start value for a fit, kept as it is defined.
    """
    centre = image.groupBy(*ids).agg(
        F.expr("sum(f) AS total"), F.expr("sum(y * f) / sum(f) AS cy"), F.expr("sum(x * f) / sum(f) AS cx"), F.expr("max(f) AS height")
    )
    lines = image.join(small_side(centre), ids)  # one row per image on the right
    return lines.groupBy(*ids).agg(
        F.expr("first(total) AS total"), F.expr("first(height) AS height"), F.expr("first(cy) AS cy"), F.expr("first(cx) AS cx"),
        F.expr("sqrt(abs(sum(CASE WHEN x = floor(cx) THEN pow(y - cx, 2) * f END) / sum(CASE WHEN x = floor(cx) THEN f END))) AS width_y"),
        F.expr("sqrt(abs(sum(CASE WHEN y = floor(cy) THEN pow(x - cy, 2) * f END) / sum(CASE WHEN y = floor(cy) THEN f END))) AS width_x"),
    )


# --- velocity grid -----------------------------------------------------------------------------------
def velocity_axis(spark: SparkSession, center: float, low: float, high: float, wave_min: float, step: float) -> tuple[DataFrame, float]:
    """(v, w) of the 10 km/s grid: the channel nearest to each grid velocity; plus the old step.

    Velocity is linear in wavelength, so the nearest channel follows from rounding; a tie goes
    to the lower channel, and the ends of the line's range clamp. One row per grid velocity,
    a few hundred at most.
    """
    first = round((low - wave_min) / step)
    count = int(round((high - low) / step)) + 1
    v = [LIGHT_SPEED_KM_S * (low + i * step - center) / center for i in range(count)]
    v_step = ((v[1] - v[0]) + (v[-1] - v[-2])) / 2
    lo, hi = _to_grid(v[0]), _to_grid(v[-1])
    per = LIGHT_SPEED_KM_S * step / center
    grid = spark.range(lo, hi + VELOCITY_GRID_KM_S, VELOCITY_GRID_KM_S).selectExpr(
        "CAST(id AS INT) AS v",
        f"{first} + CAST(greatest(0, least({count - 1}, ceil((id - {v[0]!r}D) / {per!r}D - 0.5D))) AS INT) AS w",
    )
    return grid, v_step


def regrid_nearest(cube: DataFrame, center: float, low: float, high: float, wave_min: float, step: float, weights: DataFrame | None = None) -> DataFrame:
    """The cube on the 10 km/s grid, flux scaled to the new step; optional weight per channel."""
    grid, v_step = velocity_axis(cube.sparkSession, center, low, high, wave_min, step)
    ids = [c for c in cube.columns if c not in ("w", "flux")]
    flux = "flux"
    if weights is not None:
        cube, flux = cube.join(broadcast_if_small(weights), "w"), "weight * flux"
    # one row per grid velocity of the line: its length is known here
    return cube.join(F.broadcast(grid), "w").selectExpr(*ids, "v", f"{flux} * {VELOCITY_GRID_KM_S}D / {v_step!r}D AS flux")


def align_add(cubes: list[DataFrame], ids: list[str]) -> DataFrame:
    """Element-wise sum over the common velocities of two or more cubes."""
    keys = [*ids, "v", "y", "x"]
    named = [c.withColumnRenamed("flux", f"flux{i}") for i, c in enumerate(cubes)]
    joined = reduce(lambda a, b: a.join(b, keys), named)
    return joined.selectExpr(*keys, " + ".join(f"flux{i}" for i in range(len(cubes))) + " AS flux")


def axis_step(axis: DataFrame, value: str, ids: list[str]) -> DataFrame:
    """Mean of the first and the last step of each axis (one row per channel)."""
    part = f"PARTITION BY {', '.join(ids)} " if ids else ""
    steps = axis.selectExpr(
        *ids, f"lead({value}) OVER ({part}ORDER BY w) - {value} AS step",
        f"row_number() OVER ({part}ORDER BY w) AS up", f"row_number() OVER ({part}ORDER BY w DESC) AS down",
    ).filter("step IS NOT NULL AND (up = 1 OR down = 2)")
    both = [F.expr("(max_by(step, -up) + max_by(step, up)) / 2 AS step")]
    return steps.groupBy(*ids).agg(*both) if ids else steps.agg(*both)


# --- images ------------------------------------------------------------------------------------------
def image_ratio(top: DataFrame, bottom: DataFrame, ids: list[str]) -> DataFrame:
    """Element-wise ratio; NULL where either is blank or the divisor is 0."""
    keys = [*ids, "y", "x"]
    return top.withColumnRenamed("f", "a").join(bottom.withColumnRenamed("f", "b"), keys).selectExpr(
        *keys, "try_divide(a, b) AS f"
    )


def mask_overlay(filtered: DataFrame, mask3: DataFrame, mask4: DataFrame, ids: list[str], blank_rows: tuple[int, ...] = (7, 8)) -> DataFrame:
    """Where both masked ratios agree keep them, else the filtered value; some rows are blank."""
    keys = [*ids, "y", "x"]
    joined = (
        filtered.join(mask3.withColumnRenamed("f", "m3"), keys, "left").join(mask4.withColumnRenamed("f", "m4"), keys, "left")
    )
    rows = ", ".join(map(str, blank_rows))
    return joined.selectExpr(*keys, f"CASE WHEN y IN ({rows}) THEN NULL WHEN m3 = m4 THEN m4 ELSE f END AS f")


TILE = 64


def median_filter(image: DataFrame, ids: list[str], size: int = 8, tile: int = TILE) -> DataFrame:
    """Sliding ``size`` x ``size`` median with mirrored edges; the upper one of the two middles.

    The window of a pixel reaches size/2 back and size/2 - 1 ahead. The image is cut into tiles, each
    with a rim of the pixels around it, mirrored at the edges; so a group has a bounded size and a
    pixel away from the tiles' rims is sent once. Blank and absent pixels stay out of the median.
    """
    back, ahead = size // 2, size - size // 2 - 1
    extent = image.groupBy(*ids).agg(F.expr("max(y) + 1 AS ny"), F.expr("max(x) + 1 AS nx"))

    def places(p: str, n: str) -> str:
        """Where a pixel stands in the mirrored image, as far as windows reach; once more for each period of 2n."""
        turns = f"sequence(-({size} DIV (2 * {n}) + 1), {size} DIV (2 * {n}) + 1)"
        both = f"flatten(transform({turns}, k -> array({p} + 2 * k * {n}, 2 * k * {n} - 1 - {p})))"
        return f"filter({both}, q -> q >= -{back} AND q < {n} + {ahead})"

    def tiles(q: str, n: str) -> str:
        """The tiles in whose rim or inside a place lies."""
        first, last = f"greatest(0D, floor(({q} - {ahead}) / {tile}))", f"least(({n} - 1) DIV {tile}, floor(({q} + {back}) / {tile}))"
        return f"sequence(CAST({first} AS INT), CAST({last} AS INT))"

    pixels = image.select(*ids, "y", "x", "f").join(small_side(extent), ids)
    across = pixels.selectExpr(*ids, "y", "x", "f", "ny", "nx", f"explode({places('y', 'ny')}) AS py")
    spread = across.selectExpr("*", f"explode({places('x', 'nx')}) AS px").selectExpr(
        *ids, "py", "px", "py = y AND px = x AS own", "f", f"{tiles('py', 'ny')} AS tys", f"{tiles('px', 'nx')} AS txs"
    )
    spread = spread.selectExpr(*ids, "py", "px", "own", "f", "explode(tys) AS ty", "txs")
    spread = spread.selectExpr(*ids, "py", "px", "own", "f", "ty", "explode(txs) AS tx")
    kinds = {f.name: f.dataType.simpleString() for f in image.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in ids), f"y {kinds['y']}", f"x {kinds['x']}", "f double"])

    def medians(group):
        import numpy as np
        import pandas as pd

        ty, tx = int(group["ty"].iloc[0]) * tile, int(group["tx"].iloc[0]) * tile
        wide = tile + size - 1
        values = np.full((wide, wide), np.nan)
        row, column = group["py"].to_numpy() - ty + back, group["px"].to_numpy() - tx + back
        values[row, column] = group["f"].to_numpy(dtype="float64")
        inner = group["own"].to_numpy() & (row >= back) & (row < back + tile) & (column >= back) & (column < back + tile)
        row, column = row[inner] - back, column[inner] - back
        near = np.lib.stride_tricks.sliding_window_view(values, (size, size))[row, column].reshape(len(row), size * size)
        near = np.sort(near, axis=1)  # blanks come last
        known = (~np.isnan(near)).sum(axis=1)
        middle = near[np.arange(len(row)), np.minimum(known // 2, size * size - 1)]
        out = {c: [group[c].iloc[0]] * len(row) for c in ids}
        return pd.DataFrame({**out, "y": row + ty, "x": column + tx, "f": np.where(known > 0, middle, np.nan)})

    found = spread.groupBy(*ids, "ty", "tx").applyInPandas(medians, schema)
    return found.selectExpr(*ids, "y", "x", "nanvl(f, NULL) AS f")


def gaussian_fit(images: DataFrame, ids: list[str], tolerance: float = 1e-9, max_rounds: int = 100, cut_every: int = 4) -> DataFrame:
    """Least-squares 2-D Gaussian per image: height, cy, cx, width_y, width_x, loss, converged.

    Every round is one grouped aggregate of the 5 x 5 normal equations of all images at once;
    the small systems are solved in the executors. Steps are damped when a round would make the
    fit worse. An image has converged once a step no longer improves its loss by more than the share
    ``tolerance``; the rounds go on until all have. One that has not after ``max_rounds`` says so.
    """
    import numpy as np
    import pandas as pd

    names = ["height", "cy", "cx", "width_y", "width_x"]
    params = moments(images, ids).selectExpr(*ids, *names, "1e-3D AS damping", "CAST(NULL AS DOUBLE) AS loss", "false AS converged",
                                             *[f"{n} AS best_{n}" for n in names])
    g = "exp(-0.5D * (pow((cy - y) / width_y, 2) + pow((cx - x) / width_x, 2)))"
    slopes = {
        "j0": "g", "j1": "-height * g * (cy - y) / pow(width_y, 2)", "j2": "-height * g * (cx - x) / pow(width_x, 2)",
        "j3": "height * g * pow(cy - y, 2) / pow(width_y, 3)", "j4": "height * g * pow(cx - x, 2) / pow(width_x, 3)",
    }
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in params.schema.fields)
    columns = params.columns

    def step(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                a = np.array([[row[f"a{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)])
                b = np.array([row[f"b{i}"] for i in range(5)])
                now = np.array([row[n] for n in names])
                best = np.array([row[f"best_{n}"] for n in names])
                better = row["loss"] is None or np.isnan(row["loss"]) or row["new_loss"] <= row["loss"]
                gain = np.inf if row["loss"] is None or np.isnan(row["loss"]) else abs(row["loss"] - row["new_loss"])
                done = bool(row["converged"]) or gain <= tolerance * abs(row["new_loss"]) + 1e-18
                damping = row["damping"] / 5 if better else row["damping"] * 10
                if better:
                    best, loss = now, row["new_loss"]
                    move = np.linalg.lstsq(a + damping * np.diag(np.diag(a) + 1e-12), b, rcond=None)[0]
                    now = best + move
                else:
                    loss, now = row["loss"], (best + now) / 2
                rest = {k: row[k] for k in ids}
                rest.update({n: float(v) for n, v in zip(names, now)}, damping=damping, loss=loss, converged=done)
                rest.update({f"best_{n}": float(v) for n, v in zip(names, best)})
                out.append(rest)
            yield pd.DataFrame(out, columns=columns)

    for turn in range(1, max_rounds + 1):
        rows = images.join(params, ids).selectExpr("*", f"{g} AS g").selectExpr(
            "*", "f - height * g AS res", *[f"{e} AS {n}" for n, e in slopes.items()]
        )
        sums = [F.expr(f"sum(j{i} * j{j}) AS a{i}{j}") for i in range(5) for j in range(i, 5)]
        sums += [F.expr(f"sum(j{i} * res) AS b{i}") for i in range(5)] + [F.expr("sum(res * res) AS new_loss")]
        now = [F.expr(f"any_value({c}) AS {c}") for c in columns if c not in ids]
        params = rows.groupBy(*ids).agg(*sums, *now).mapInPandas(step, schema)
        if turn % cut_every == 0:
            params = cut_lineage(params)
            if params.filter("NOT converged").isEmpty():
                break
    return params.selectExpr(*ids, *[f"best_{n} AS {n}" for n in names], "loss", "converged")
