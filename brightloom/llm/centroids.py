"""Centroid clustering of integer vectors, with nearest centroids by a progressive Walsh-Hadamard search.

Vectors are turned into integers and then into their Walsh-Hadamard coefficients, in the order of
sequency. The transform H is exact in integers and keeps distances up to a factor: |Hx - Hc|^2 is
``size`` times |x - c|^2. The sum of squared coefficient differences over the coarse coefficients
is thus a lower bound that only grows as finer ones are added.

For each vector the coarsest coefficients name a leader, whose distance is finished at once.
Levels of finer coefficients follow for the others; a centroid whose partial sum is strictly above
the leader's whole one cannot win and is dropped, and who is left at the end has all coefficients
summed up. Nothing is rounded, so ties are real ties and go to the smaller number.

A round is one scan: a task adds up the coefficients of the vectors of each centroid, and a
grouping adds up the tasks. The driver gets one row per centroid and coefficient, whatever the
size of the table, and turns the sums back (the transform is linear).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.session import fresh_path

BLOCK_ROWS = 4096
# coefficients up to here have squared differences that add up within 64 bits
NARROW = 1 << 26
LARGEST = 1 << 52


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix, in its natural order; exact for integers."""
    n, size = x.shape
    h = 1
    while h < size:
        y = x.reshape(n, size // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, size)
        h *= 2
    return x


def coarse_first(size: int) -> np.ndarray:
    """Natural positions of the coefficients by sequency, the number of sign changes of their row."""
    rows = walsh_hadamard(np.eye(size, dtype=np.int64))
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")


def coefficients(x: np.ndarray) -> np.ndarray:
    return walsh_hadamard(x)[:, coarse_first(x.shape[1])]


def components(coefs: np.ndarray) -> np.ndarray:
    """The vectors, or sums of vectors, that have these coefficients."""
    size = coefs.shape[1]
    natural = np.empty_like(coefs)
    natural[:, coarse_first(size)] = coefs
    return walsh_hadamard(natural) // size


def nearest_centroids(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest row of ``c`` for each row of ``x``, both given as
    coefficients, and how many coefficient differences were taken."""
    size, taken, owner, best = x.shape[1], 0, [], []
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) >= NARROW:
        x, c = x.astype(object), c.astype(object)  # Python integers

    def add(rows: np.ndarray, cents: np.ndarray, lo: int, hi: int) -> np.ndarray:
        nonlocal taken
        taken += len(rows) * (hi - lo)
        d = part[rows, lo:hi] - c[cents, lo:hi]
        return (d * d).sum(axis=1)

    for at in range(0, len(x), BLOCK_ROWS):
        part = x[at : at + BLOCK_ROWS]
        n = len(part)
        level = min(4, size)
        rows, cents = np.repeat(np.arange(n), len(c)), np.tile(np.arange(len(c)), n)
        total = add(rows, cents, 0, level)
        leader = np.argmin(total.reshape(n, len(c)), axis=1)
        bound = total.reshape(n, len(c))[np.arange(n), leader] + add(np.arange(n), leader, level, size)
        while level < size:
            keep = (total <= bound[rows]) & (cents != leader[rows])
            rows, cents, total = rows[keep], cents[keep], total[keep]
            total = total + add(rows, cents, level, 2 * level)
            level *= 2
        rows, cents = np.concatenate([rows, np.arange(n)]), np.concatenate([cents, leader])
        total = np.concatenate([total, bound])
        # per row the smallest sum, then the smallest number
        order = np.lexsort((cents, rows))
        rows, cents, total = rows[order], cents[order], total[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        least = np.minimum.reduceat(total, first)
        hit = np.flatnonzero(total == least[rows])
        hit = hit[np.unique(rows[hit], return_index=True)[1]]
        owner.append(cents[hit])
        best.append(least // size)
    return np.concatenate(owner), np.concatenate(best), taken


def _usable(vector: str, size: int) -> str:
    # a NULL component makes the whole test NULL or false, so the row goes
    return f"size({vector}) = {size} AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"


def _rows(col: pa.Array, size: int) -> np.ndarray:
    raw = b"".join(col.to_pylist())
    return np.frombuffer(raw, "<i8").reshape(-1, size)


@dataclass(frozen=True)
class Clusters:
    """``rows``: (key, _c) with the coefficients of every kept vector; ``centroids``: integer components."""

    rows: DataFrame
    key: str
    centroids: np.ndarray

    def assign(self) -> DataFrame:
        """(key, cluster, distance) of every kept vector."""
        coefs, size, key = coefficients(self.centroids), self.centroids.shape[1], self.key

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    owner, best, _ = nearest_centroids(_rows(b.column(1), size), coefs)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array(owner, pa.int32()), pa.array(best.tolist(), pa.int64())], names=[key, "cluster", "distance"]
                    )

        schema = self.rows.select(key).schema.add("cluster", "integer").add("distance", "long")
        return self.rows.mapInArrow(each, schema)

    def step(self) -> Clusters:
        """Every centroid that has vectors moves to the floor of their mean."""
        coefs, size = coefficients(self.centroids), self.centroids.shape[1]

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(coefs), np.int64), np.zeros((len(coefs), size), np.int64)
            for b in batches:
                if len(b):
                    x = _rows(b.column(1), size)
                    owner = nearest_centroids(x, coefs)[0]
                    count += np.bincount(owner, minlength=len(coefs))
                    for c in np.unique(owner):
                        total[c] += x[owner == c].sum(axis=0)
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(count[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))], names=["c", "n", "v"]
            )

        sums = self.rows.mapInArrow(gather, "c int, n long, v array<long>").selectExpr("c", "n", "posexplode(v) AS (i, v)")
        moved = self.centroids.copy()
        found: dict[int, list] = {}
        for r in sums.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
            found.setdefault(r.c, [r.n, [0] * size])[1][r.i] = r.v
        for c, (n, v) in found.items():
            exact = components(np.array([v], dtype=object))[0]
            moved[c] = [int(t // n) for t in exact]
        return Clusters(self.rows, self.key, moved)


def start(df: DataFrame, key: str, vector: str, size: int, k: int, scale: int, salt: str) -> Clusters | None:
    """The usable vectors as coefficients, stored once, and the first centroids; None without any vector."""
    spark = df.sparkSession

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                values = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                whole = np.floor(scale * values).reshape(-1, size)
                if np.abs(whole).max() >= LARGEST:
                    raise OverflowError(f"a component of {vector} is too large for exact distances")
                coefs = coefficients(whole.astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in coefs.astype("<i8")], pa.binary())], names=[key, "_c"])

    kept = df.filter(_usable(vector, size)).select(key, vector)
    path = fresh_path(spark, "coefficients")
    schema = kept.select(key).schema.add("_c", "binary")
    kept.mapInArrow(each, schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    digest = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "_c").limit(k).select("_c").collect()
    if not first:
        return None
    coefs = np.stack([np.frombuffer(bytes(r[0]), "<i8") for r in first])
    return Clusters(rows, key, components(coefs))


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:"
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``size`` finite components.

    ``size`` is a power of two. Components become floor(``scale`` * x). The first centroids are the
    ``k`` vectors with the smallest SHA-256 of ``salt`` and the key. Vectors that are NULL, of another
    length, or hold NULL or a non-finite component take no part; a table without any vector that does
    gives no rows, one with fewer than ``k`` as many centroids as vectors. Repeated rows count each
    time; rows without a key take part and are chosen as first centroids last; other columns are not
    read. Components of 2^52 or more after scaling, and distances or sums that are no 64-bit
    integers, raise an error, as sums do in Spark.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = df.sparkSession
    now = start(df, key, vector, size, k, scale, salt)
    if now is None:
        schema = df.select(key).schema
        for n, t in (("cluster", "integer"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")):
            schema = schema.add(n, t)
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        now = now.step()
    path = fresh_path(spark, "clusters")
    assigned = now.assign()
    assigned.write.parquet(path)
    stored = spark.read.schema(assigned.schema).parquet(path)
    sums = {r.cluster: int(r.s) for r in stored.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = {c: hashlib.sha256(",".join(str(int(x)) for x in now.centroids[c]).encode()).hexdigest() for c in sums}
    # one entry per centroid, so both maps stay as small as k
    of = lambda found, kind: F.element_at(F.create_map(*[F.lit(x).cast(t) for c, v in found.items() for x, t in ((c, "int"), (v, kind))]), F.col("cluster"))
    return stored.withColumns({
        "cluster_inertia": of(sums, "long"), "inertia": F.lit(sum(sums.values())).cast("long"), "centroid_sha256": of(digests, "string"),
    })
