"""Registry of the runnable queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightloom import adapters as A
from brightloom.config import DEFAULT_RULES
from brightloom.operators import assignment
from brightloom.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
RUN_AT = "2025-11-12 00:00:00"
_WRITTEN: dict[tuple[str, str, str], str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def written(spark: SparkSession, sf_dir: str, name: str, build: Query) -> DataFrame:
    """A result table, written once per session to the shared folder and then read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = fresh_path(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def since_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispatches from the floor date on; appointments are on the order's day, so the scan skips the rest."""
    orders = assignment.on_or_after(A.table(spark, sf_dir, "orders"), DEFAULT_RULES.date_floor, "o_orderdate")
    return A.dispatches(spark, sf_dir, orders)


def optimize(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Open dispatches from the floor date on get a technician; all of them are in the result.

    ``only`` (dispatch_id) limits the run to some dispatches before anything is matched.
    """
    since = since_floor(spark, sf_dir)
    if only is not None:
        since = since.join(only, "dispatch_id", "left_semi")
    best = assignment.best_technician(
        assignment.unoptimized(since), A.tech_calendar(spark, sf_dir), A.technicians(spark, sf_dir)
    )
    return assignment.overlay_result(since, best, RUN_AT)


def optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "optimized", optimize)


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best technician of every dispatch, whether or not it already has one."""
    return written(
        spark, sf_dir, "best",
        lambda s, d: assignment.best_technician(A.dispatches(s, d), A.tech_calendar(s, d), A.technicians(s, d)),
    )
