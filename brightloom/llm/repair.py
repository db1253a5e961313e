"""Token shards compressed by Re-Pair: frequent pairs of ids become nonterminals, shard by shard.

A shard file holds, after a JSON header of known length: the rules (left, right), the length
to which each rule expands, the start and the number of ids of each document, and the
compressed sequence. No rule spans the end of a document, so a document can be decoded by
itself: look up where its symbols start and expand them.

Empty and missing texts give documents of the end id alone. Documents are written in ascending
``doc_id`` order (a missing doc_id first, equal ones by a hash of the text); an empty table gives no shard.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.llm.files import open_random, write_new
from brightloom.llm.running import part_bases
from brightloom.llm.tokens import encoder
from brightloom.session import fresh_path

MAGIC = b"REPAIR01"
SHARD_IDS = 1 << 20
SHARDS_PER_TASK = 4
_SLOT_BITS = 18
_NARROW = 1 << 16


def _slots(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOT_BITS)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)


def compress(ids: np.ndarray, ends: np.ndarray, first_free: int, min_count: int = 32, per_round: int = 4096):
    """Replace frequent pairs by nonterminals until no new pair occurs ``min_count`` times.

    Each round counts all neighbouring pairs, turns the most frequent ones into rules and
    replaces them from left to right without overlap. ``ends``: position behind each document's
    last id. Returns the symbols, the ends among them, and the rules as (left, right) rows.
    """
    # with ids of two bytes the nonterminals share the rest of the 16 bits, and a pair is one 32-bit key
    narrow = first_free < _NARROW * 15 // 16
    key_type, half = (np.uint32, np.uint32(16)) if narrow else (np.uint64, np.uint64(32))
    most = _NARROW if narrow else 1 << 32
    seq, ends, rules = ids.astype(key_type), ends.astype(np.int64), []
    free = first_free
    while len(seq) > 1 and free < most:
        keys = (seq[:-1] << half) | seq[1:]
        across = ends[(ends > 0) & (ends < len(seq))] - 1
        order = np.sort(np.delete(keys, across))  # no pair spans two documents
        if not len(order):
            break
        starts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        counts = np.diff(np.append(starts, len(order)))
        often = counts >= min_count
        pairs, counts = order[starts[often]], counts[often]
        if not len(pairs):
            break
        pairs = pairs[np.argsort(-counts, kind="stable")][: min(per_round, most - free)]
        slot = _slots(pairs)
        _, first = np.unique(slot, return_index=True)
        pairs = pairs[np.sort(first)]  # pairs that meet in a slot wait for the next round
        table_key = np.zeros(1 << _SLOT_BITS, dtype=key_type)
        table_sym = np.zeros(1 << _SLOT_BITS, dtype=key_type)
        table_key[_slots(pairs)] = pairs
        table_sym[_slots(pairs)] = np.arange(free, free + len(pairs), dtype=key_type)
        if not table_sym[0]:
            table_key[0] = 1  # the pair (0, 0) alone looks into slot 0, and an empty slot must not look like it
        hit = table_key[_slots(keys)] == keys
        hit[across] = False
        pos = np.flatnonzero(hit)
        if not len(pos):
            break
        # in a chain of hits at neighbouring positions every second one is taken
        head = np.concatenate([[True], pos[1:] != pos[:-1] + 1])
        chain = np.maximum.accumulate(np.where(head, np.arange(len(pos)), 0))
        pos = pos[(np.arange(len(pos)) - chain) % 2 == 0]
        seq[pos] = table_sym[_slots(keys[pos])]
        ends = ends - np.searchsorted(pos + 1, ends)
        stays = np.ones(len(seq), dtype=bool)
        stays[pos + 1] = False
        seq = seq[stays]
        rules.append(np.stack([pairs >> half, pairs & ((key_type(1) << half) - key_type(1))], axis=1).astype(np.uint32))
        free += len(pairs)
        if len(pairs) < per_round // 64:
            break  # what is left saves less than its rules and another pass cost
    return seq, ends, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)


def expansion_lengths(rules: np.ndarray, first_free: int) -> np.ndarray:
    """Ids that each rule stands for. A rule only names symbols that came before it."""
    lengths = np.ones(len(rules), dtype=np.uint32)
    done = 0
    while done < len(rules):
        known = first_free + done
        ready = done + int(np.argmax(np.append((rules[done:] >= known).any(axis=1), True)))
        for side in (0, 1):
            sym = rules[done:ready, side].astype(np.int64)
            part = np.where(sym >= first_free, lengths[np.maximum(sym - first_free, 0)], 1)
            lengths[done:ready] = part if side == 0 else lengths[done:ready] + part
        done = ready
    return lengths


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_free: int) -> np.ndarray:
    """The ids behind symbols: rules are expanded one level at a time, each id moving to its place."""
    sym = symbols.astype(np.int64)
    size = np.where(sym >= first_free, lengths[np.maximum(sym - first_free, 0)].astype(np.int64) if len(lengths) else 1, 1)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=np.uint32)
    while len(sym):
        done = sym < first_free
        out[at[done]] = sym[done]
        sym, at = sym[~done] - first_free, at[~done]
        left, right = rules[sym, 0].astype(np.int64), rules[sym, 1].astype(np.int64)
        width = np.where(left >= first_free, lengths[np.maximum(left - first_free, 0)].astype(np.int64) if len(lengths) else 1, 1)
        sym, at = np.concatenate([left, right]), np.concatenate([at, at + width])
    return out


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray], first_free: int) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
    sizes = np.array([len(x) for x in ids], dtype=np.uint32)
    symbols, ends, rules = compress(flat, np.cumsum(sizes, dtype=np.int64), first_free)
    lengths = expansion_lengths(rules, first_free)
    top = first_free + len(rules)
    width = "<u2" if top <= 1 << 16 else "<u4"
    head = json.dumps({
        "docs": len(ids), "ids": len(flat), "symbols": len(symbols), "rules": len(rules), "first_free": first_free,
        "width": width, "doc_ids": doc_ids,
    }).encode()
    parts = [rules.astype("<u4"), lengths.astype("<u4"), ends.astype("<u4"), sizes.astype("<u4"), symbols.astype(width)]
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *(p.tobytes() for p in parts)])


class Shard:
    """A shard file, opened for whole or random access: only the symbols that are asked for are read."""

    def __init__(self, path: str):
        self.file = open_random(path)
        start = self.file.read_at(12, 0)
        if start[:8] != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        size = int.from_bytes(start[8:], "little")
        h = self.head = json.loads(self.file.read_at(size, 12))
        at = 12 + size
        tables = self.file.read_at(12 * h["rules"] + 8 * h["docs"], at)
        self.rules = np.frombuffer(tables, "<u4", 2 * h["rules"]).reshape(-1, 2)
        self.lengths = np.frombuffer(tables, "<u4", h["rules"], 8 * h["rules"])
        self.ends = np.frombuffer(tables, "<u4", h["docs"], 12 * h["rules"]).astype(np.int64)
        self.sizes = np.frombuffer(tables, "<u4", h["docs"], 12 * h["rules"] + 4 * h["docs"]).astype(np.int64)
        self.symbols_at = at + len(tables)

    def _read(self, first: int, last: int) -> np.ndarray:
        w = np.dtype(self.head["width"])
        raw = self.file.read_at((last - first) * w.itemsize, self.symbols_at + first * w.itemsize)
        return expand(np.frombuffer(raw, w), self.rules, self.lengths, self.head["first_free"])

    def document(self, i: int) -> np.ndarray:
        return self._read(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def all_ids(self) -> np.ndarray:
        return self._read(0, self.head["symbols"])


MANIFEST = "part long, shard long, file string, docs long, ids long, bytes long"


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int, first_free: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``text`` of ``docs`` (doc_id, text), append ``end_id`` to each and write compressed shards.

    Documents are dealt out by ranges of doc_id. A shard is closed once it holds ``shard_ids`` ids
    (one document is never cut, so a longer one makes a longer shard). Returns the manifest that
    Spark commits below ``folder``; shards that it does not name belong to lost tasks.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = encoder(vocabulary), TaskContext.get().partitionId(), 0
        names, held, total = [], [], 0
        end = np.array([end_id], dtype=np.uint32)

        def close() -> pa.RecordBatch:
            data = pack_shard(names, held, first_free)
            file = write_new(f"{folder}/shards", ".repair", data)
            row = [[part], [shard], [file], [len(held)], [total], [len(data)]]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in row], names=["part", "shard", "file", "docs", "ids", "bytes"])

        for b in batches:
            texts = b.column(1)
            doc_ids = b.column(0).to_pylist()
            for at in range(0, len(texts), 1024):
                for doc_id, raw in zip(doc_ids[at : at + 1024], enc.encode(texts.slice(at, 1024)), strict=True):
                    names.append(doc_id)
                    held.append(np.concatenate([np.frombuffer(raw, "<u4"), end]))
                    total += len(held[-1])
                    if total >= shard_ids:
                        yield close()
                        names, held, total, shard = [], [], 0, shard + 1
        if held:
            yield close()

    order = ["doc_id", "_hash"]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: the ids of all earlier shards."""
    bases = part_bases(manifest.groupBy("part").agg(F.sum("ids").alias("_ids")), "part", "_ids")
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    local = manifest.withColumn("_local", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    return local.join(bases, "part").withColumn("start", F.col("base") + F.col("_local")).drop("base", "_local")


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decode the shards that a manifest names: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    starts = shard_starts(manifest).select("file", "start")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(file)
                ids = shard.all_ids().astype("<u4")
                last = np.cumsum(shard.sizes)
                first = last - shard.sizes
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(first.tolist(), last.tolist(), strict=True)]
                cols = [pa.array(shard.head["doc_ids"], pa.int64()), pa.array(start + first), pa.array(shard.sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[a:z].tolist() for a, z in zip(first.tolist(), last.tolist(), strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    # a number of its own, as the rows are few and the work behind each is large
    tasks = -(-manifest.count() // SHARDS_PER_TASK)
    return starts.repartition(max(1, tasks), "file").mapInArrow(read, schema)


def token_shards(docs: DataFrame, vocabulary: str, end_id: int = 1, first_free: int = 49408) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read them back."""
    folder = fresh_path(docs.sparkSession, "token-shards")
    return read_shards(write_shards(docs, folder, vocabulary, end_id, first_free))
