"""Adding up vectors that tasks gather, in two steps, so that the driver gets a few rows at most."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FAN_IN = 8


def sum_vectors(df: DataFrame, gather: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``gather(batch)``, a double vector of fixed ``size``, over all batches of ``df``.

    A task sends one vector; ``FAN_IN`` tasks add those up. An empty table gives zeros.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                v = gather(b)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column(0).to_pylist():
                v = np.frombuffer(raw, "<f8")
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    rows = df.mapInArrow(each, "v binary").repartition(FAN_IN).mapInArrow(add, "v binary").collect()
    return sum((np.frombuffer(bytes(r.v), "<f8") for r in rows), np.zeros(size))
