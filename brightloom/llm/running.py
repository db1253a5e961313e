"""Running totals over a global order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.session import fresh_path


def part_bases(totals: DataFrame, part: str, amount: str) -> DataFrame:
    """(part, base): the total of all earlier parts, from one row per part."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("long").alias("base"))


def running_starts(df: DataFrame, order: list[str], amount: str, start: str = "start") -> DataFrame:
    """Add ``start``: the sum of ``amount`` over all rows before a row in the order of ``order``.

    The rows are dealt out by ranges of the order and each task adds up its own range; then the
    totals of the ranges, one row each, are added up. ``order`` should have no ties, and a NULL
    amount counts as 0.
    """
    spark = df.sparkSession
    amount_at = df.columns.index(amount)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.asarray(b.column(amount_at).fill_null(0).cast(pa.int64()))
            local = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(n), part, dtype=np.int64)), pa.array(local)],
                names=[*b.schema.names, "_part", "_local"],
            )

    schema = df.schema.add("_part", "long").add("_local", "long")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add_up, schema)
    path = fresh_path(spark, "running")
    ranged.write.parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    totals = stored.groupBy("_part").agg(F.sum(amount).alias("_total"))
    bases = part_bases(totals, "_part", "_total")
    return stored.join(bases, "_part").withColumn(start, F.col("base") + F.col("_local")).drop("_part", "_local", "base")
