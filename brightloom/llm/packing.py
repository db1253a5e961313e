"""Packing along a space-filling curve: documents that are alike share sequences.

A document's token ids are hashed into a signed count vector, projected to three dimensions and
placed on a Hilbert curve. In the order of the curve all ids form one stream, which is cut every
``length`` ids; only the last sequence of the whole table is padded.

A missing text counts as empty, and an empty one still has its end id. Equal texts have equal keys
and follow each other by doc_id; repeated rows are packed as often as they occur. An empty table
gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from brightloom.llm.running import running_starts
from brightloom.llm.tokens import encoder
from brightloom.session import fresh_path

SIDES, BITS, HASHED = 3, 10, 256


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows) with ``bits`` bits a side."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns from the coarsest cell down
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """Hilbert key of each document's hashed ids."""
    if not ids:
        return np.zeros(0, dtype=np.int64)
    flat = np.concatenate(ids).astype(np.uint64)
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    mixed = (flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    slot = (mixed >> np.uint64(56)).astype(np.int64)
    sign = np.where((mixed >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    v = np.bincount(doc * HASHED + slot, sign, minlength=len(ids) * HASHED).reshape(len(ids), HASHED)
    v = np.sign(v) * np.sqrt(np.abs(v))
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    y = (v / np.where(size == 0, 1, size)) @ np.random.default_rng(seed).standard_normal((HASHED, SIDES))
    share = np.vectorize(lambda t: 0.5 * (1 + math.erf(t / math.sqrt(2))))(y)
    return hilbert_keys(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """row_id, doc_id, n, curve, ids (little-endian 32-bit) of each document, written once."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                raw = [x + end for x in enc.encode(part.column(1))]
                ids = [np.frombuffer(x, "<u4") for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(raw))), part.column(0),
                        pa.array([len(x) for x in ids], pa.int64()), pa.array(curve_keys(ids)),
                        pa.array(raw, pa.binary()),
                    ],
                    names=["row_id", "doc_id", "n", "curve", "ids"],
                )
                row += len(raw)

    path = fresh_path(spark, "encoded")
    schema = "row_id long, doc_id long, n long, curve long, ids binary"
    encoded = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(encode, schema)
    encoded.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def cut_pieces(placed: DataFrame, length: int) -> DataFrame:
    """Cut each document's ids where the stream of all ids passes a multiple of ``length``."""
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long"
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, curve, at, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                n, view, start = len(raw) // 4, memoryview(raw), 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    crc = zlib.crc32(view[4 * start : 4 * (start + size)])
                    rows.append((doc_id, start, size, crc, n, sequence, offset, curve))
                    start += size
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return placed.select("doc_id", "curve", "at", "ids").mapInArrow(cut, schema)


def pack(docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` ids.

    Columns: doc_id, start (in the document), length, ids_crc32, doc_tokens, sequence_id, offset (in
    the sequence), curve (the document's key).
    """
    encoded = encode_documents(docs, vocabulary, end_id)
    placed = running_starts(encoded.select("row_id", "doc_id", "n", "curve"), ["curve", "doc_id", "row_id"], "n", "at")
    return cut_pieces(encoded.select("row_id", "ids").join(placed, "row_id"), length)
