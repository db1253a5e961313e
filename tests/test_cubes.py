"""Cube files, sliding median, Gaussian fit, regrid."""

import math

import numpy as np

from brightloom.operators import cube as C
from brightloom.sources import cubes as sources


def write_block_file(path, data, cards):
    header = [f"{k:<8}= {v:>20}".ljust(80) for k, v in cards] + ["END".ljust(80)]
    text = "".join(header)
    body = data.astype(">f4").tobytes()
    pad = lambda b, c: b + c * (-len(b) % 2880)
    path.write_bytes(pad(text.encode(), b" ") + pad(body, b"\0"))


def test_cube_file(spark, tmp_path):
    data = np.arange(7 * 13 * 29, dtype="float32").reshape(7, 13, 29)
    data[3, 2, 1] = np.nan
    f = tmp_path / "c.fits"
    write_block_file(f, data, [("SIMPLE", "T"), ("BITPIX", -32), ("NAXIS", 3), ("NAXIS1", 29), ("NAXIS2", 13), ("NAXIS3", 7),
                               ("CRVAL3", 3715.0), ("CD3_3", 0.25), ("CD1_1", 3e-5), ("CD2_1", 4e-5), ("CD1_2", 4e-5), ("CD2_2", -3e-5)])
    long, header = sources.read_cube(spark, str(f), "a")
    rows = long.collect()
    assert len(rows) == data.size and header["CRVAL3"] == 3715.0
    for r in rows[:: 97]:
        want = data[r.w, r.y, r.x]
        assert (r.flux is None) if np.isnan(want) else r.flux == want
    assert sum(r.flux is None for r in rows) == 1
    headers = spark.createDataFrame([("a", 3715.0, 0.25, 3e-5, 4e-5, 4e-5, -3e-5)], "cube_id string, crval3 double, cd3_3 double, cd1_1 double, cd2_1 double, cd1_2 double, cd2_2 double")
    info = sources.axis_info(long, headers).first()
    assert info.wave_max == 3715.0 + 6 * 0.25
    assert math.isclose(info.xlen, 5e-5 * 29 * 3600) and math.isclose(info.ylen, 5e-5 * 13 * 3600)


def test_labelled_binary_arrays(spark, tmp_path):
    for name, k in (("bogus", 2), ("real", 1), ("other", 1)):
        (tmp_path / name).mkdir()
        for i in range(k):
            np.save(tmp_path / name / f"{i}.npy", np.full((2, 3), i + 0.5))
    rows = sources.read_labeled_arrays(spark, str(tmp_path), ["bogus", "real", "platypus"]).collect()
    assert sorted(r.label for r in rows) == [0, 0, 1]
    assert all(r.shape == [2, 3] and len(r.pixels) == 6 for r in rows)


def brute_median(img, size=8):
    ny, nx = img.shape
    mirror = lambda p, n: p % (2 * n) if p % (2 * n) < n else 2 * n - 1 - p % (2 * n)
    out = np.full(img.shape, np.nan)
    for y in range(ny):
        for x in range(nx):
            near = [img[mirror(y + a, ny), mirror(x + b, nx)] for a in range(-size // 2, size // 2) for b in range(-size // 2, size // 2)]
            near = sorted(v for v in near if not np.isnan(v))
            out[y, x] = near[len(near) // 2] if near else np.nan
    return out


def test_median_filter(spark):
    rng = np.random.default_rng(1)
    pictures = {0: rng.normal(size=(17, 11)), 1: rng.normal(size=(3, 2)), 2: rng.normal(size=(9, 9))}
    pictures[2][4, 3:6] = np.nan
    rows = [(i, y, x, None if np.isnan(p[y, x]) else float(p[y, x])) for i, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    got = C.median_filter(spark.createDataFrame(rows, "id int, y int, x int, f double"), ["id"]).collect()
    want = {i: brute_median(p) for i, p in pictures.items()}
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.f, want[r.id][r.y, r.x])


def test_gaussian_fit_finds_planted_centres(spark):
    truth = {1: (50.0, 6.3, 8.1, 2.0, 3.0), 2: (20.0, 9.0, 5.5, 3.0, 1.5)}
    rows = [
        (i, y, x, h * math.exp(-0.5 * (((cy - y) / wy) ** 2 + ((cx - x) / wx) ** 2)))
        for i, (h, cy, cx, wy, wx) in truth.items() for y in range(16) for x in range(16)
    ]
    fits = C.gaussian_fit(spark.createDataFrame(rows, "id int, y int, x int, f double"), ["id"]).collect()
    for r in fits:
        assert r.converged
        h, cy, cx, wy, wx = truth[r.id]
        assert abs(r.height - h) < 1e-3 and abs(r.cy - cy) < 1e-3 and abs(r.cx - cx) < 1e-3
        assert abs(abs(r.width_y) - wy) < 1e-3 and abs(abs(r.width_x) - wx) < 1e-3


def test_regrid_takes_the_nearest_channel(spark):
    center, low, high, wave_min, step = 3726.05, 3717.0, 3727.0, 3715.0, 0.25
    grid, v_step = C.velocity_axis(spark, center, low, high, wave_min, step)
    waves = [low + i * step for i in range(41)]
    v = [299792.458 * (w - center) / center for w in waves]
    assert math.isclose(v_step, v[1] - v[0], rel_tol=1e-9)
    rows = grid.collect()
    for r in rows:
        best = min(range(41), key=lambda i: (round(abs(v[i] - r.v), 9), i))
        assert r.w == best + 8


def test_align_add_is_commutative(spark):
    a = spark.range(50).selectExpr("CAST(id AS INT) * 10 AS v", "0 AS y", "0 AS x", "CAST(id AS DOUBLE) AS flux", "1 AS c")
    b = a.selectExpr("v + 100 AS v", "y", "x", "flux * 2 AS flux", "c")
    one = sorted(map(tuple, C.align_add([a, b], ["c"]).collect()))
    two = sorted(map(tuple, C.align_add([b, a], ["c"]).collect()))
    assert one == two and len(one) == 40


def test_median_filter_across_tiles(spark):
    rng = np.random.default_rng(4)
    pictures = {0: rng.normal(size=(13, 30)), 1: rng.normal(size=(1, 21)), 2: rng.normal(size=(5, 5))}
    pictures[0][rng.random((13, 30)) < 0.3] = np.nan
    rows = [(i, y, x, None if np.isnan(p[y, x]) else float(p[y, x])) for i, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    got = C.median_filter(spark.createDataFrame(rows, "id int, y int, x int, f double"), ["id"], tile=5).collect()
    want = {i: brute_median(p) for i, p in pictures.items()}
    assert len(got) == len(rows)
    for r in got:
        w = want[r.id][r.y, r.x]
        assert (r.f is None and math.isnan(w)) or math.isclose(r.f, w)


def test_histogram_of_nothing(spark):
    assert C.histogram(spark.createDataFrame([], "y int, x int, f double")).count() == 0


def test_scaled_integer_cube(spark, tmp_path):
    from brightloom.sources import cubes

    cards = ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    3", "NAXIS1  =                    3",
             "NAXIS2  =                    2", "NAXIS3  =                    2", "BSCALE  =                  0.5", "BZERO   =                 10.0", "BLANK   =                   -1"]
    header = "".join(c.ljust(80) for c in cards + ["COMMENT x"] * 3000 + ["END"]).encode()
    data = np.arange(12, dtype=">i2")
    data[4] = -1
    body = data.tobytes()
    path = tmp_path / "c.fits"
    path.write_bytes(header + b" " * (-len(header) % 2880) + body + b"\0" * (-len(body) % 2880))
    cube, _ = cubes.read_cube(spark, str(path), "c")
    got = [r.flux for r in cube.orderBy("w", "y", "x").collect()]
    assert got == [None if i == 4 else i * 0.5 + 10 for i in range(12)]
