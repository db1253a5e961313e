"""Great-circle distance and a latitude/longitude grid for radius joins, as SQL expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from brightloom.config import EARTH_RADIUS_KM

KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle km. Any NULL coordinate gives NULL; a root that rounding lifts above 1 counts as 1."""
    return (
        f"{2 * EARTH_RADIUS_KM}D * nanvl(asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))), {math.pi / 2}D)"
    )


def _band_height(radius_km: float | str) -> str:
    if isinstance(radius_km, str):
        return f"({radius_km} * {1.000001 / KM_PER_DEGREE}D)"
    return f"{radius_km / KM_PER_DEGREE * 1.000001}D"


def _band(lat: str, radius_km: float | str) -> str:
    return f"CAST(floor(({lat} + 90) / {_band_height(radius_km)}) AS INT)"


def _cells_in_band(band: str, radius_km: float | str) -> str:
    """Longitude cells in a band, each at least as wide as the radius spans anywhere near it."""
    h = _band_height(radius_km)
    edge = f"greatest(abs(({band} - 1) * {h} - 90), abs(({band} + 2) * {h} - 90))"
    half = 2 * EARTH_RADIUS_KM
    sine = f"sin({radius_km} / {half}D)" if isinstance(radius_km, str) else f"{math.sin(radius_km / half)}D"
    width = f"degrees(2 * asin(least(1D, {sine} / cos(radians(least({edge}, 89.9D))))))"
    return f"CASE WHEN {edge} >= 89.9D THEN 1 ELSE CAST(greatest(1, floor(360 / {width})) AS INT) END"


def _cell(lon: str, cells: str) -> str:
    return f"least({cells} - 1, CAST(floor(pmod({lon} + 180, 360D) / 360 * {cells}) AS INT))"


def grid_cell(lat: str, lon: str, radius_km: float | str) -> str:
    """The one cell ``(band, cell)`` that holds the point; NULL without coordinates. The radius may be a column."""
    band = _band(lat, radius_km)
    cell = _cell(lon, _cells_in_band(band, radius_km))
    return f"CASE WHEN {lat} IS NOT NULL AND {lon} IS NOT NULL THEN named_struct('band', {band}, 'cell', {cell}) END"


def explode_reach(df: DataFrame, lat: str, lon: str, radius_km: float | str, band: str = "band", cell: str = "cell") -> DataFrame:
    """Each row once per distinct cell that can hold a point within ``radius_km``, across the date line too.

    Plain arithmetic in three projections, so it stays inside code generation. Rows without
    coordinates have no cells.
    """
    steps = (-1, 0, 1)
    home = df.filter(f"{lat} IS NOT NULL AND {lon} IS NOT NULL").selectExpr("*", f"{_band(lat, radius_km)} AS _home")
    cells = home.selectExpr("*", *[f"{_cells_in_band(f'(_home + {s})', radius_km)} AS _n{i}" for i, s in enumerate(steps)])
    mids = cells.selectExpr("*", *[f"{_cell(lon, f'_n{i}')} AS _m{i}" for i in range(3)])
    # with fewer than three cells in a band, the neighbours coincide
    reach = ", ".join(
        f"named_struct('{band}', _home + {s}, '{cell}', CASE WHEN {keep} THEN {at} END)"
        for i, s in enumerate(steps)
        for at, keep in ((f"_m{i}", "true"), (f"pmod(_m{i} + 1, _n{i})", f"_n{i} > 1"), (f"pmod(_m{i} - 1, _n{i})", f"_n{i} > 2"))
    )
    return mids.selectExpr(*df.columns, f"inline(array({reach}))").filter(f"{cell} IS NOT NULL")


def explode_near(df: DataFrame, lat: str, lon: str, radius_km: float, cell_km: float) -> DataFrame:
    """Each row once per distinct cell (``band``, ``cell``) of a grid of ``cell_km`` that can hold a point within ``radius_km``.

    Cells of several radii: most rows are in one or two of them. ``cell_km`` is at least four times the radius.
    """
    reach = f"{radius_km / KM_PER_DEGREE * 1.000002}D"
    half = 2 * EARTH_RADIUS_KM
    home = df.filter(f"{lat} IS NOT NULL AND {lon} IS NOT NULL")
    bands = home.selectExpr("*", f"explode(array_distinct(array({_band(f'({lat} - {reach})', cell_km)}, {_band(f'({lat} + {reach})', cell_km)}))) AS band")
    edge = f"greatest(abs((band - 1) * {_band_height(cell_km)} - 90), abs((band + 2) * {_band_height(cell_km)} - 90))"
    side = f"degrees(2 * asin(least(1D, {math.sin(radius_km / half)}D / cos(radians(least({edge}, 89.9D)))))) * 1.000002D"
    wide = bands.selectExpr("*", f"{_cells_in_band('band', cell_km)} AS _n", f"{side} AS _side")
    at = ", ".join(_cell(f"({lon} + {sign} * _side)", "_n") for sign in (-1, 0, 1))
    return wide.selectExpr(*df.columns, "band", f"explode(array_distinct(array({at}))) AS cell")


def surely_within(lat1: str, lon1: str, cos1: str, lat2: str, lon2: str, cos2: str, radius_km: float) -> str:
    """Whether the great-circle distance is at most ``radius_km``; ``cos1`` and ``cos2`` are the cosines of the latitudes.

    x*x/4 - x*x*x*x/48 <= sin(x/2)**2 <= x*x/4 decides all pairs but those on the very rim, for which the distance is worked out.
    """
    limit, r = math.sin(min(radius_km / (2 * EARTH_RADIUS_KM), math.pi / 2)) ** 2, math.pi / 180
    y, x, c = f"({lat2} - {lat1})", f"({lon2} - {lon1})", f"{cos1} * {cos2}"
    most = f"{r * r / 4}D * ({y} * {y} + {c} * {x} * {x})"
    less = f"{r**4 / 48}D * ({y} * {y} * {y} * {y} + {c} * {x} * {x} * {x} * {x})"
    return (
        f"CASE WHEN {most} <= {limit * (1 - 1e-9)}D THEN true WHEN {most} - {less} > {limit * (1 + 1e-9)}D THEN false "
        f"ELSE {haversine_km(lat1, lon1, lat2, lon2)} <= {radius_km}D END"
    )
