"""Cube queries over the two-exposure cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom import adapters as A
from brightloom.operators import cube as C
from brightloom.queries.base import query
from brightloom.queries.dispatch import r4, r4s
from brightloom.queries.views_sql import view, with_views
from brightloom.session import fresh_path
from brightloom.sources import cubes as sources

WAVE_MIN, STEP = 3715.0, 0.25
BOX = (2, 6, 3, 9)
ID = ["exposure"]
# The two lines of the doublet, within the cube's wavelength range.
LINE_A = (3726.05, 3717.0, 3727.0)
LINE_B = (3728.80, 3719.75, 3729.75)
AREA = (1, 12, 2, 16)


def sums(spark: SparkSession, sf: str, start: int = 5, end: int = 9) -> DataFrame:
    return C.sum_range(A.cube(spark, sf), start, end, ID)


view("img", "cube", "SELECT exposure, y, x, sum(flux) AS f FROM cube WHERE w BETWEEN 5 AND 9 GROUP BY 1, 2, 3")
view("header", "", """SELECT CAST(3715 AS DOUBLE) AS crval3, CAST(0.25 AS DOUBLE) AS cd3_3, 2.44053529605E-05 AS cd1_1, 9.10819745106E-05 AS cd2_1,
  3.91006768990E-05 AS cd1_2, -1.04769997120E-05 AS cd2_2""")


def grid_sql(line: tuple[float, float, float], src: str = "cube", weight: str = "1") -> str:
    """Nearest channel by rank over all channels of the line, not by arithmetic."""
    center, low, high = line
    return f"""SELECT c.exposure, g.v, c.y, c.x, {weight} * c.flux * 10 / g.v_step AS flux FROM {src} c JOIN (
      SELECT v, w, v_step FROM (SELECT g.v, a.w, (SELECT avg(d) FROM (SELECT v1 - lag(v1) OVER (ORDER BY w) AS d, row_number() OVER (ORDER BY w) AS up,
          row_number() OVER (ORDER BY w DESC) AS down FROM ax_{int(center)}) s WHERE up = 2 OR down = 1) AS v_step,
        row_number() OVER (PARTITION BY g.v ORDER BY round(abs(a.v1 - g.v), 9), a.w) AS rn
        FROM ax_{int(center)} a JOIN (SELECT CAST(unnest(range(CAST((SELECT round_even(min(v1) / 10, 0) * 10 FROM ax_{int(center)}) AS BIGINT),
          CAST((SELECT round_even(max(v1) / 10, 0) * 10 FROM ax_{int(center)}) AS BIGINT) + 10, 10)) AS INT) AS v) g ON TRUE) r WHERE rn = 1) g ON c.w = g.w"""


for line in (LINE_A, LINE_B):
    view(f"ax_{int(line[0])}", "", f"""SELECT w, 299792.458 * (wave - {line[0]}) / {line[0]} AS v1 FROM (SELECT w, 3715.0 + CAST(0.25 AS DOUBLE) * w AS wave
      FROM (SELECT CAST(unnest(range(0, 64)) AS INT) AS w) n) m WHERE wave BETWEEN {line[1]} - 0.001 AND {line[2]} + 0.001""")
WEIGHT_SQL = "(1 / (1 + CAST(0.01 AS DOUBLE) * c.w))"
view("grid_a", "cube ax_3726", grid_sql(LINE_A))
view("grid_b", "cube ax_3728", grid_sql(LINE_B))
view("wgrid_a", "cube ax_3726", grid_sql(LINE_A, weight=WEIGHT_SQL))
view("wgrid_b", "cube ax_3728", grid_sql(LINE_B, weight=WEIGHT_SQL))


def weights(spark: SparkSession) -> DataFrame:
    return spark.range(64).selectExpr("CAST(id AS INT) AS w", "1 / (1 + 0.01D * id) AS weight")


def grid(spark: SparkSession, sf: str, line: tuple[float, float, float], weighted: bool = False) -> DataFrame:
    return C.regrid_nearest(A.cube(spark, sf), *line, WAVE_MIN, STEP, weights(spark) if weighted else None)


VOXEL = ["exposure", "w", "y", "x"]
GRID = ["exposure", "v", "y", "x"]


@query("src_cube_long", with_views("cube", f"SELECT exposure, w, y, x, {r4s('flux')} FROM cube"))
def src_cube_long(spark: SparkSession, sf: str) -> DataFrame:
    return A.cube(spark, sf).selectExpr(*VOXEL, *r4("flux"))


def _headers(spark: SparkSession, cube: DataFrame) -> DataFrame:
    h = sources.VELOCITY_HEADER
    return cube.select("cube_id").distinct().selectExpr(
        "cube_id", f"{WAVE_MIN}D AS crval3", f"{STEP}D AS cd3_3", *[f"CAST('{h[k.upper()]}' AS DOUBLE) AS {k}" for k in ("cd1_1", "cd2_1", "cd1_2", "cd2_2")]
    )


AXIS = ["wave_min", "wave_max", "wave_step", "xlen", "ylen"]


@query(
    "cube_axis_info",
    with_views("cube header", """SELECT exposure AS cube_id, crval3 AS wave_min, crval3 + (max(w)) * cd3_3 AS wave_max, cd3_3 AS wave_step,
    round(sqrt(cd1_1 * cd1_1 + cd2_1 * cd2_1) * (max(x) + 1) * 3600, 4) AS xlen, round(sqrt(cd1_2 * cd1_2 + cd2_2 * cd2_2) * (max(y) + 1) * 3600, 4) AS ylen
    FROM cube, header GROUP BY exposure, crval3, cd3_3, cd1_1, cd2_1, cd1_2, cd2_2"""),
)
def cube_axis_info(spark: SparkSession, sf: str) -> DataFrame:
    named = A.cube(spark, sf).withColumnRenamed("exposure", "cube_id")
    return sources.axis_info(named, _headers(spark, named)).selectExpr("cube_id", "wave_min", "wave_max", "wave_step", *r4("xlen", "ylen"))


@query(
    "sink_cube",
    with_views("cube", f"SELECT exposure AS cube_id, w - 1 AS w, y, x, {r4s('flux')}, '10.0' AS cd3_3, 19 AS n_keys FROM cube WHERE w >= 1"),
)
def sink_cube(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "cube")
    named = A.cube(spark, sf).withColumnRenamed("exposure", "cube_id")
    sources.write_cube(named, path, sources.VELOCITY_HEADER, drop_first_plane=True)
    voxels, headers = sources.read_stored_cube(spark, path)
    return voxels.join(headers, "cube_id").selectExpr(
        "cube_id", "w", "y", "x", *r4("flux"), "header['CD3_3'] AS cd3_3", "size(header) AS n_keys"
    )


@query("cube_wave_to_index", with_views("cube", "SELECT w, CAST(trunc((3715.0 + CAST(0.27 AS DOUBLE) * w - 3715.0) / CAST(0.25 AS DOUBLE)) AS INT) AS pixel, count(*) AS voxels FROM cube GROUP BY 1, 2"))
def cube_wave_to_index(spark: SparkSession, sf: str) -> DataFrame:
    # wavelengths off the grid, so that truncation shows
    wave = f"({WAVE_MIN}D + 0.27D * w)"
    return A.cube(spark, sf).selectExpr("w", f"{C.wave_index(wave, f'{WAVE_MIN}D', f'{STEP}D')} AS pixel").groupBy("w", "pixel").agg(
        F.expr("count(*) AS voxels")
    )


@query("cube_velocity_axis", with_views("cube", "SELECT DISTINCT w, round(299792.458 * (3715.0 + CAST(0.25 AS DOUBLE) * w - 3726.05) / 3726.05, 4) + CAST(0 AS DOUBLE) AS v FROM cube"))
def cube_velocity_axis(spark: SparkSession, sf: str) -> DataFrame:
    return A.cube(spark, sf).select("w").distinct().selectExpr("w", f"round({C.velocity(f'({WAVE_MIN}D + {STEP}D * w)', LINE_A[0])} + 1e-9D, 4) + 0D AS v")


@query("cube_axis_step", with_views("ax_3726", "SELECT round(avg(d), 4) AS step FROM (SELECT v1 - lag(v1) OVER (ORDER BY w) AS d, row_number() OVER (ORDER BY w) AS up, row_number() OVER (ORDER BY w DESC) AS down FROM ax_3726) s WHERE up = 2 OR down = 1"))
def cube_axis_step(spark: SparkSession, sf: str) -> DataFrame:
    wave = f"({WAVE_MIN}D + {STEP}D * w)"
    axis = A.cube(spark, sf).select("w").distinct().filter(f"{wave} BETWEEN {LINE_A[1]}D - 0.001D AND {LINE_A[2]}D + 0.001D")
    return C.axis_step(axis.selectExpr("w", f"{C.velocity(wave, LINE_A[0])} AS v"), "v", []).selectExpr("round(step, 4) AS step")


@query("cube_crop_scale", with_views("cube", f"SELECT exposure, w, y - {AREA[0]} AS y, x - {AREA[2]} AS x, round(flux * 10 + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS flux FROM cube WHERE y >= {AREA[0]} AND y < {AREA[1]} AND x >= {AREA[2]} AND x < {AREA[3]}"))
def cube_crop_scale(spark: SparkSession, sf: str) -> DataFrame:
    return C.crop_scale(A.cube(spark, sf), *AREA).selectExpr(*VOXEL, *r4("flux"))


@query("cube_drop_first_plane", with_views("cube", f"SELECT exposure, w - 1 AS w, y, x, {r4s('flux')} FROM cube WHERE w >= 1"))
def cube_drop_first_plane(spark: SparkSession, sf: str) -> DataFrame:
    return C.drop_first_plane(A.cube(spark, sf)).selectExpr(*VOXEL, *r4("flux"))


@query("cube_mean_exposures", with_views("cube", "SELECT w, y, x, round(avg(flux) + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS flux FROM cube GROUP BY 1, 2, 3"))
def cube_mean_exposures(spark: SparkSession, sf: str) -> DataFrame:
    return C.mean_exposures(A.cube(spark, sf), "exposure", ID).selectExpr("w", "y", "x", *r4("flux"))


@query("cube_sum_range", with_views("img", f"SELECT exposure, y, x, {r4s('f')} FROM img"))
def cube_sum_range(spark: SparkSession, sf: str) -> DataFrame:
    return sums(spark, sf).selectExpr("exposure", "y", "x", *r4("f"))


SPEC_SQL = "SELECT w, 3715.0 + CAST(0.25 AS DOUBLE) * w AS wavelength, sum(flux) / CAST(1000 AS DOUBLE) AS flux FROM cube WHERE w BETWEEN 0 AND 63 GROUP BY 1"


@query("cube_spectrum", with_views("cube", f"SELECT w, wavelength, {r4s('flux')} FROM ({SPEC_SQL}) s"))
def cube_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return C.spectrum(A.cube(spark, sf), 0, 63, WAVE_MIN, STEP, 1000, []).selectExpr("w", "wavelength", *r4("flux"))


@query("sink_spectrum_text", with_views("cube", f"SELECT printf('%.2f', wavelength) || ' ' || printf('%.6f', round(flux, 6)) AS value FROM ({SPEC_SQL}) s"))
def sink_spectrum_text(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "spectrum")
    lines = C.spectrum_lines(C.spectrum(A.cube(spark, sf), 0, 63, WAVE_MIN, STEP, 1000, []))
    # one line per channel
    lines.orderBy("w").select("value").coalesce(1).write.text(path)
    return spark.read.text(path)


@query("cube_mask_box", with_views("img", f"SELECT exposure, y, x, CASE WHEN NOT (y >= 2 AND y < 6 AND x >= 3 AND x < 9) THEN round(f + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) END AS f FROM img"))
def cube_mask_box(spark: SparkSession, sf: str) -> DataFrame:
    return C.mask_box(sums(spark, sf), 2, 6, 3, 9).selectExpr("exposure", "y", "x", *r4("f"))


@query("cube_log_clamp", with_views("cube", "SELECT exposure, w, y, x, round(CASE WHEN flux <= 0 THEN CAST(0.01 AS DOUBLE) ELSE flux END + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS f FROM cube"))
def cube_log_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return C.log_clamp(A.cube(spark, sf).withColumnRenamed("flux", "f")).selectExpr(*VOXEL, *r4("f"))


view("back", "img", f"""SELECT exposure, median(CASE WHEN f > 0 THEN f END) AS median, stddev_pop(f) AS std FROM img
  WHERE y BETWEEN {BOX[0]} AND {BOX[1]} AND x BETWEEN {BOX[2]} AND {BOX[3]} GROUP BY 1""")


@query("cube_background_stats", with_views("back", f"SELECT exposure, {r4s('median', 'std')} FROM back"))
def cube_background_stats(spark: SparkSession, sf: str) -> DataFrame:
    return C.background_stats(sums(spark, sf), *BOX, ID).selectExpr("exposure", *r4("median", "std"))


def masked(image: DataFrame, n: float) -> DataFrame:
    return C.threshold_mask(image, C.background_stats(image, *BOX, ID), n, ID)


@query("cube_threshold_mask", with_views("img back", "SELECT i.exposure, y, x, CASE WHEN round(f, 9) > round(median + 1 * std, 9) THEN round(f + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) END AS f FROM img i JOIN back b ON i.exposure = b.exposure"))
def cube_threshold_mask(spark: SparkSession, sf: str) -> DataFrame:
    return masked(sums(spark, sf), 1).selectExpr("exposure", "y", "x", *r4("f"))


@query(
    "agg_histogram",
    with_views("img", """SELECT CAST(least(99, floor((round(f, 6) - lo) / ((hi - lo) / 100))) AS INT) AS bin, count(*) AS n FROM img,
    (SELECT min(round(f, 6)) AS lo, max(round(f, 6)) AS hi FROM img) e GROUP BY 1"""),
)
def agg_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return C.histogram(sums(spark, sf).withColumn("f", F.expr("round(f, 6)")))


@query(
    "cube_moments",
    with_views("img", f"""WITH c AS (SELECT exposure, sum(f) AS total, sum(y * f) / sum(f) AS cy, sum(x * f) / sum(f) AS cx, max(f) AS height FROM img GROUP BY 1)
    SELECT exposure, {r4s('total', 'height', 'cy', 'cx')}, round(sqrt(abs(sum(CASE WHEN x = floor(cx) THEN pow(y - cx, 2) * f END) / sum(CASE WHEN x = floor(cx) THEN f END))), 4) AS width_y,
    round(sqrt(abs(sum(CASE WHEN y = floor(cy) THEN pow(x - cy, 2) * f END) / sum(CASE WHEN y = floor(cy) THEN f END))), 4) AS width_x
    FROM (SELECT i.*, c.total, c.cy, c.cx, c.height FROM img i JOIN c ON i.exposure = c.exposure) j GROUP BY exposure, total, height, cy, cx"""),
)
def cube_moments(spark: SparkSession, sf: str) -> DataFrame:
    return C.moments(sums(spark, sf), ID).selectExpr("exposure", *r4("total", "height", "cy", "cx", "width_y", "width_x"))


@query("fn_gaussian2d", with_views("img", "SELECT exposure, y, x, round(CAST(7 AS DOUBLE) * exp(CAST(-0.5 AS DOUBLE) * (pow((CAST(9.5 AS DOUBLE) - x) / 3, 2) + pow((CAST(5.5 AS DOUBLE) - y) / 2, 2))), 6) AS g FROM img"))
def fn_gaussian2d(spark: SparkSession, sf: str) -> DataFrame:
    return sums(spark, sf).selectExpr("exposure", "y", "x", f"round({C.gaussian2d('7D', '9.5D', '5.5D', '3D', '2D')}, 6) AS g")


@query(
    "fn_flip_augment",
    with_views("cube", """SELECT image, CASE WHEN (image // 2) % 2 = 0 THEN (SELECT max(y) FROM cube) - y ELSE y END AS y,
    CASE WHEN image % 2 = 0 THEN (SELECT max(x) FROM cube) - x ELSE x END AS x, round(flux + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS f
    FROM (SELECT *, 2 * w + CASE WHEN exposure = 'exp2' THEN 1 ELSE 0 END AS image FROM cube) c"""),
)
def fn_flip_augment(spark: SparkSession, sf: str) -> DataFrame:
    images = A.cube(spark, sf).selectExpr(
        "2 * w + CASE WHEN exposure = 'exp2' THEN 1 ELSE 0 END AS image", "y", "x", "flux AS f"
    )
    ny, nx = images.agg(F.expr("max(y) + 1"), F.expr("max(x) + 1")).first()
    return C.flip_augment(images, "image", ny, nx, seed=5, keys=("image", "image DIV 2")).selectExpr("image", "y", "x", *r4("f"))


@query("cube_regrid_nearest", with_views("grid_a", f"SELECT exposure, v, y, x, {r4s('flux')} FROM grid_a"))
def cube_regrid_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return grid(spark, sf, LINE_A).selectExpr(*GRID, *r4("flux"))


@query("cube_regrid_weighted", with_views("wgrid_a", f"SELECT exposure, v, y, x, {r4s('flux')} FROM wgrid_a"))
def cube_regrid_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return grid(spark, sf, LINE_A, weighted=True).selectExpr(*GRID, *r4("flux"))


@query(
    "cube_align_add",
    with_views("grid_a grid_b wgrid_a", """SELECT a.exposure, a.v, a.y, a.x, round(a.flux + b.flux + c.flux + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS flux
    FROM grid_a a JOIN grid_b b ON a.exposure = b.exposure AND a.v = b.v AND a.y = b.y AND a.x = b.x
    JOIN wgrid_a c ON a.exposure = c.exposure AND a.v = c.v AND a.y = c.y AND a.x = c.x"""),
)
def cube_align_add(spark: SparkSession, sf: str) -> DataFrame:
    three = [grid(spark, sf, LINE_A), grid(spark, sf, LINE_B), grid(spark, sf, LINE_A, weighted=True)]
    return C.align_add(three, ID).selectExpr(*GRID, *r4("flux"))


CHECK = (LINE_A[0], 3720.0, 3724.0)


def _check_sql(src: str, line: tuple[float, float, float]) -> str:
    c, lo, hi = line
    return f"""SELECT exposure, y, x, sum(flux) AS f FROM {src} WHERE v BETWEEN round_even(299792.458 * ({lo} - {c}) / {c} / 10, 0) * 10
      AND round_even(299792.458 * ({hi} - {c}) / {c} / 10, 0) * 10 GROUP BY 1, 2, 3"""


view("chk", "grid_a", _check_sql("grid_a", CHECK))


@query("cube_check_sum", with_views("chk", f"SELECT exposure, y, x, {r4s('f')} FROM chk"))
def cube_check_sum(spark: SparkSession, sf: str) -> DataFrame:
    return C.check_sum(grid(spark, sf, LINE_A), *CHECK, ID).selectExpr("exposure", "y", "x", *r4("f"))


view("img2", "cube", "SELECT exposure, y, x, sum(flux) AS f FROM cube WHERE w BETWEEN 20 AND 24 GROUP BY 1, 2, 3")


@query("cube_image_ratio", with_views("img img2", "SELECT a.exposure, a.y, a.x, CASE WHEN b.f <> 0 THEN round(a.f / b.f + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) END AS f FROM img a JOIN img2 b ON a.exposure = b.exposure AND a.y = b.y AND a.x = b.x"))
def cube_image_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return C.image_ratio(sums(spark, sf), sums(spark, sf, 20, 24), ID).selectExpr("exposure", "y", "x", *r4("f"))


def median_sql(src: str, size: int = 8) -> str:
    """Every pixel's window by offsets, with mirrored positions."""
    m = lambda p, n: f"CASE WHEN (({p}) % (2 * {n}) + 2 * {n}) % (2 * {n}) < {n} THEN (({p}) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - (({p}) % (2 * {n}) + 2 * {n}) % (2 * {n}) END"
    return f"""SELECT exposure, y, x, f FROM (SELECT q.exposure, q.y, q.x, s.f, row_number() OVER (PARTITION BY q.exposure, q.y, q.x ORDER BY s.f) AS rn,
      count(*) OVER (PARTITION BY q.exposure, q.y, q.x) AS n FROM (
      SELECT p.exposure, p.y, p.x, {m('p.y + dy.d', 'e.ny')} AS sy, {m('p.x + dx.d', 'e.nx')} AS sx FROM {src} p
      JOIN (SELECT exposure, max(y) + 1 AS ny, max(x) + 1 AS nx FROM {src} GROUP BY 1) e ON p.exposure = e.exposure
      JOIN (SELECT CAST(unnest(range(-{size // 2}, {size - size // 2})) AS INT) AS d) dy ON TRUE
      JOIN (SELECT CAST(unnest(range(-{size // 2}, {size - size // 2})) AS INT) AS d) dx ON TRUE) q
      JOIN {src} s ON s.exposure = q.exposure AND s.y = q.sy AND s.x = q.sx WHERE s.f IS NOT NULL) r WHERE rn = n // 2 + 1"""


@query("cube_median_filter", with_views("img", f"SELECT exposure, y, x, {r4s('f')} FROM ({median_sql('img')}) m"))
def cube_median_filter(spark: SparkSession, sf: str) -> DataFrame:
    return C.median_filter(sums(spark, sf), ID).selectExpr("exposure", "y", "x", *r4("f"))


# --- ratio flow: weighted regrids, line sums, masks, ratios, median fill ------------------------------------
SUM_A, SUM_B = (LINE_A[0], 3719.0, 3726.0), (LINE_B[0], 3722.0, 3728.5)
view("cropped", "cube", f"""SELECT 'mean' AS exposure, w, y - {AREA[0]} AS y, x - {AREA[2]} AS x, avg(flux) * 10 AS flux FROM cube
  WHERE y >= {AREA[0]} AND y < {AREA[1]} AND x >= {AREA[2]} AND x < {AREA[3]} GROUP BY 1, 2, 3, 4""")
view("cg_a", "cropped ax_3726", grid_sql(LINE_A, "cropped", WEIGHT_SQL))
view("cg_b", "cropped ax_3728", grid_sql(LINE_B, "cropped", WEIGHT_SQL))
view("s_a", "cg_a", _check_sql("cg_a", SUM_A))
view("s_b", "cg_b", _check_sql("cg_b", SUM_B))
for side in ("a", "b"):
    view(f"bk_{side}", f"s_{side}", f"SELECT exposure, median(CASE WHEN f > 0 THEN f END) AS median, stddev_pop(f) AS std FROM s_{side} WHERE y BETWEEN {BOX[0]} AND {BOX[1]} AND x BETWEEN {BOX[2]} AND {BOX[3]} GROUP BY 1")
    for n in (1, 2):
        view(f"m{n}_{side}", f"s_{side} bk_{side}", f"SELECT i.exposure, y, x, CASE WHEN f > median + {n} * CAST(0.5 AS DOUBLE) * std THEN f END AS f FROM s_{side} i JOIN bk_{side} b ON i.exposure = b.exposure")
RATIO_SQL = "SELECT a.exposure, a.y, a.x, CASE WHEN b.f <> 0 THEN a.f / b.f END AS f FROM {0} a JOIN {1} b ON a.exposure = b.exposure AND a.y = b.y AND a.x = b.x"
view("ratio", "s_a s_b", RATIO_SQL.format("s_b", "s_a"))
view("ratio1", "m1_a m1_b", RATIO_SQL.format("m1_b", "m1_a"))
view("ratio2", "m2_a m2_b", RATIO_SQL.format("m2_b", "m2_a"))
view("med", "ratio", median_sql("ratio"))
OVERLAY_SQL = """SELECT f.exposure, f.y, f.x, round(CASE WHEN f.y IN (7, 8) THEN NULL WHEN a.f = b.f THEN b.f ELSE f.f END + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS f
  FROM {0} f LEFT JOIN {1} a ON f.exposure = a.exposure AND f.y = a.y AND f.x = a.x LEFT JOIN {2} b ON f.exposure = b.exposure AND f.y = b.y AND f.x = b.x"""


@query("pipe_cube_ratio", with_views("med ratio1 ratio2", OVERLAY_SQL.format("med", "ratio1", "ratio2")))
def pipe_cube_ratio(spark: SparkSession, sf: str) -> DataFrame:
    mean = C.mean_exposures(C.crop_scale(A.cube(spark, sf), *AREA), "exposure", ID).selectExpr("'mean' AS exposure", "w", "y", "x", "flux")
    regrid = lambda line: C.regrid_nearest(mean, *line, WAVE_MIN, STEP, weights(spark))
    a, b = C.check_sum(regrid(LINE_A), *SUM_A, ID), C.check_sum(regrid(LINE_B), *SUM_B, ID)
    ratio = C.image_ratio(b, a, ID)
    loose, strict = (C.image_ratio(masked(b, n), masked(a, n), ID) for n in (0.5, 1.0))
    return C.mask_overlay(C.median_filter(ratio, ID), loose, strict, ID).selectExpr("exposure", "y", "x", *r4("f"))


view("med_img", "img", median_sql("img"))
view("hi1", "img back", "SELECT i.exposure, y, x, CASE WHEN f > median + CAST(0.5 AS DOUBLE) * std THEN f END AS f FROM img i JOIN back b ON i.exposure = b.exposure")
view("hi2", "img back", "SELECT i.exposure, y, x, CASE WHEN f > median + CAST(1 AS DOUBLE) * std THEN f END AS f FROM img i JOIN back b ON i.exposure = b.exposure")


@query("cube_mask_overlay", with_views("med_img hi1 hi2", OVERLAY_SQL.format("med_img", "hi1", "hi2")))
def cube_mask_overlay(spark: SparkSession, sf: str) -> DataFrame:
    image = sums(spark, sf)
    return C.mask_overlay(C.median_filter(image, ID), masked(image, 0.5), masked(image, 1.0), ID).selectExpr("exposure", "y", "x", *r4("f"))


@query("cube_gaussian_fit")
def cube_gaussian_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The brightest area of each exposure's summed image; centre in full-image coordinates."""
    y0, y1, x0, x1 = 1, 7, 2, 12
    part = sums(spark, sf).filter(f"y BETWEEN {y0} AND {y1} AND x BETWEEN {x0} AND {x1}").selectExpr("exposure", f"y - {y0} AS y", f"x - {x0} AS x", "f")
    fit = C.gaussian_fit(part, ID)
    return fit.selectExpr("exposure", "height", f"cy + {y0} AS cy", f"cx + {x0} AS cx", "width_y", "width_x", "loss", "converged")
