"""Cube files, labelled image files and cube sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Block and card length of the file format, and its number types.
BLOCK = 2880
CARD = 80
NUMBER_TYPES = {-64: ">f8", -32: ">f4", 64: ">i8", 32: ">i4", 16: ">i2", 8: ">u1"}


def _blocks(spark: SparkSession, path: str):
    """(byte offset, block) pairs: the file is split over tasks, whatever its size."""
    return spark.sparkContext.newAPIHadoopFile(
        path,
        "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable",
        conf={"fixedlengthinputformat.record.length": str(BLOCK)},
    )


def read_header(spark: SparkSession, path: str) -> tuple[dict[str, object], int]:
    """Header keys of the first array in the file, and the byte offset of its data."""
    header: dict[str, object] = {}
    for offset, block in _blocks(spark, path).toLocalIterator():  # reads on until END, however long the header
        text = bytes(block).decode("ascii")
        for at in range(0, BLOCK, CARD):
            card = text[at : at + CARD]
            key = card[:8].strip()
            if key == "END":
                return header, int(offset) + BLOCK
            if card[8:10] == "= ":
                raw = card[10:]
                if raw.lstrip().startswith("'"):
                    header[key] = raw.split("'")[1].rstrip()
                else:
                    word = raw.split("/")[0].strip()
                    try:
                        header[key] = float(word.replace("D", "E"))
                    except ValueError:
                        header[key] = word
    raise ValueError(f"no END card in {path}")


def read_cube(spark: SparkSession, path: str, cube_id: str) -> tuple[DataFrame, dict[str, object]]:
    """A long table (cube_id, w, y, x, flux) and the header.

    Stored numbers are scaled by BSCALE and BZERO; BLANK, in integer cubes, and NaN become NULL.
    """
    header, start = read_header(spark, path)
    kind = NUMBER_TYPES[int(header["BITPIX"])]
    nx, ny, nw = (int(header[f"NAXIS{i}"]) for i in (1, 2, 3))
    width, total = np.dtype(kind).itemsize, nx * ny * nw
    scale, zero = float(header.get("BSCALE", 1.0)), float(header.get("BZERO", 0.0))
    blank = header.get("BLANK") if np.dtype(kind).kind != "f" else None

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            per_block = BLOCK // width
            first = (frame["offset"].to_numpy() - start) // width
            at = (first[:, None] + np.arange(per_block)).ravel()
            stored = np.frombuffer(b"".join(b.ljust(BLOCK, b"\0") for b in frame["block"]), dtype=kind)
            stored, at = stored[at < total], at[at < total]
            flux = stored.astype("float64") * scale + zero
            if blank is not None:
                flux[stored == int(blank)] = np.nan
            yield pd.DataFrame(
                {"w": at // (nx * ny), "y": at // nx % ny, "x": at % nx, "flux": flux}
            ).astype({"w": "int32", "y": "int32", "x": "int32"})

    data = (
        _blocks(spark, path)
        .map(lambda kv: (int(kv[0]), bytes(kv[1])))
        .filter(lambda kv: start <= kv[0] < start + total * width)
    )
    blocks = spark.createDataFrame(data, "offset long, block binary")
    long = blocks.mapInPandas(decode, "w int, y int, x int, flux double")
    return long.selectExpr(f"'{cube_id}' AS cube_id", "w", "y", "x", "nanvl(flux, NULL) AS flux"), header


def axis_info(cube: DataFrame, headers: DataFrame) -> DataFrame:
    """Wavelength range and field of view per cube, from its extent and header numbers."""
    extent = cube.groupBy("cube_id").agg({"w": "max", "y": "max", "x": "max"}).selectExpr(
        "cube_id", "`max(w)` + 1 AS nw", "`max(y)` + 1 AS ny", "`max(x)` + 1 AS nx"
    )
    return extent.join(headers, "cube_id").selectExpr(
        "cube_id", "crval3 AS wave_min", "crval3 + (nw - 1) * cd3_3 AS wave_max", "cd3_3 AS wave_step",
        "sqrt(cd1_1 * cd1_1 + cd2_1 * cd2_1) * nx * 3600 AS xlen", "sqrt(cd1_2 * cd1_2 + cd2_2 * cd2_2) * ny * 3600 AS ylen",
    )


# Axis header of a velocity cube.
VELOCITY_HEADER = {
    "CUNIT1": "deg", "CUNIT2": "deg", "CUNIT3": "km/s",
    "CNAME1": "KCWI RA", "CNAME2": "KCWI DEC", "CNAME3": "KCWI Velocity",
    "CRVAL1": "290.123", "CRVAL2": "11.0336", "CRVAL3": "-300",
    "CRPIX1": "10.1", "CRPIX2": "36.0", "CRPIX3": "1.0",
    "CD1_1": "2.44053529605E-05", "CD2_1": "9.10819745106E-05", "CD1_2": "3.91006768990E-05", "CD2_2": "-1.04769997120E-05",
    "CD3_3": "10.0", "LONPOLE": "180.0", "LATPOLE": "0.0",
}


def write_cube(cube: DataFrame, path: str, header: dict[str, str], drop_first_plane: bool = False) -> None:
    """Voxels partitioned by cube, and one header row per cube."""
    planes = cube.filter("w >= 1").selectExpr("cube_id", "w - 1 AS w", "y", "x", "flux") if drop_first_plane else cube
    planes.write.partitionBy("cube_id").parquet(f"{path}/voxels")
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in header.items())
    cube.select("cube_id").distinct().selectExpr("cube_id", f"map({pairs}) AS header").write.parquet(f"{path}/headers")


def read_stored_cube(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    voxels = spark.read.option("basePath", f"{path}/voxels").parquet(f"{path}/voxels")
    return voxels, spark.read.parquet(f"{path}/headers")


def read_labeled_arrays(spark: SparkSession, path: str, classes: list[str], pattern: str = "*.npy") -> DataFrame:
    """One row per file below a class folder: path, integer label, shape and flat pixels.

    ``<class>/<file>.npy`` holds a binary array, ``<class>/<file>.txt`` one row of numbers per
    line; a folder may also be named ``class=<class>``.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for frame in frames:
            arrays = [
                np.load(io.BytesIO(c), allow_pickle=False) if p.endswith(".npy") else np.loadtxt(io.BytesIO(c), ndmin=2)
                for p, c in zip(frame["path"], frame["content"])
            ]
            yield pd.DataFrame(
                {
                    "path": frame["path"],
                    "label": frame["label"],
                    "shape": [list(a.shape) for a in arrays],
                    "pixels": [a.astype("float64").ravel().tolist() for a in arrays],
                }
            )

    cases = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(classes))
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    labelled = files.selectExpr("path", f"CASE regexp_extract(path, '([^/=]+)/[^/]+$', 1) {cases} END AS label", "content")
    return labelled.filter("label IS NOT NULL").mapInPandas(
        decode, "path string, label int, shape array<int>, pixels array<double>"
    )
