"""Table scans, sinks and keyed updates on plain parquet folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, name: str, catalog: str | None = None, schema: str | None = None) -> DataFrame:
    """``catalog.schema.table`` of the session's catalog."""
    return spark.table(".".join(p for p in (catalog, schema, name) if p))


def row_counts(named: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of several tables; parquet answers from its footers."""
    parts = [df.agg(F.expr(f"'{n}' AS table_name"), F.expr("count(*) AS n_rows")) for n, df in named.items()]
    return reduce(DataFrame.unionByName, parts)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch: repeating a batch replaces its own rows and nothing else."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def overwrite(df: DataFrame, path: str, version: int) -> None:
    """Replace a table: write a whole new version folder, then name it in the manifest.

    Readers keep seeing the old version until its successor is complete, and a job may read
    the table it replaces.
    """
    target = f"{path}/data/v{version:08d}"
    df.write.mode("errorifexists").parquet(target)
    named = df.sparkSession.range(1).selectExpr(f"{version}L AS version", f"'{target}' AS location")
    named.write.mode("append").parquet(f"{path}/manifest")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    latest = spark.read.parquet(f"{path}/manifest").agg(F.expr("max_by(location, version) AS location")).first()
    return spark.read.parquet(latest.location)


def keyed_update(current: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``UPDATE … SET columns WHERE key`` as a join: rows without an update stay as they are.

    ``updates`` has one row per key.
    """
    u = updates.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = current.join(u, F.col(key) == F.col("_k"), "left")
    return joined.selectExpr(
        *[f"CASE WHEN _hit THEN _{c} ELSE {c} END AS {c}" if c in columns else c for c in current.columns]
    )


def read_matrix(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Whitespace-separated numbers, one row per line, as double columns."""
    parts = spark.read.text(path).filter("trim(value) <> ''").selectExpr("split(trim(value), '\\\\s+') AS p")
    return parts.selectExpr(*[f"try_cast(try_element_at(p, {i}) AS DOUBLE) AS {n}" for i, n in enumerate(names, 1)])


def write_matrix(df: DataFrame, path: str) -> None:
    df.selectExpr(f"concat_ws(' ', {', '.join(df.columns)}) AS value").write.text(path)
