"""Repeated passages: lines, sentences inside long lines, and windows that stood in an earlier place already.

A text is cut at line ends and, within a line, at the first sentence end behind at least
``MIN_WORDS`` words; a unit of fewer words is never matched. Windows of ``WINDOW`` words are units as
well, whatever lines they cross: of each ``WINDOW`` neighbouring ones that with the smallest hash. So
two texts that share a stretch take the same windows from it wherever it stands: of 2 * ``WINDOW`` - 1
shared words on, all but fewer than ``WINDOW`` words at either end lie in equal units. A unit that
overlaps an equal one of its own text is left out. Units are compared in lower case with single spaces. Of equal units the one with the smallest doc_id, then the first place, stays; the
others are removed, with their places in the original text (code points, end exclusive).

Documents without a doc_id rank last. Rows that repeat a doc_id and text are one document. Missing
and empty texts have no units; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.ngram_join import id_filter, marked
from brightloom.session import cut_lineage, fresh_path

MIN_WORDS, WINDOW = 8, 16
_LINE = re.compile(r"[^\n\r]+")
_WORD = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"[.!?…]+(?=\s|$)")
_UNITS = "doc_id long, d1 long, d2 long, start int, end int"
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WINDOW + 1)], dtype=np.uint64)


def sentences(text: str | None, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int]]:
    """Places of the lines, and of the sentences of long lines, that have enough words."""
    for line in _LINE.finditer(text or ""):
        start, stop = line.span()
        while start < stop:
            end = stop
            for m in _SENTENCE_END.finditer(text, start, stop):
                if len(text[start : m.end()].split()) >= min_words:
                    end = m.end()
                    break
            a, z = start, end
            while a < z and text[a].isspace():
                a += 1
            while a < z and text[z - 1].isspace():
                z -= 1
            if len(text[a:z].split()) >= min_words:
                yield a, z
            start = end


def windows(text: str | None) -> list[tuple[int, int]]:
    """Places of the windows with the smallest hash among ``WINDOW`` neighbours."""
    words = text.lower().split() if text else []
    n = len(words) - WINDOW + 1
    if n < WINDOW:
        return []
    code = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    codes = np.fromiter(map(code.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        h += codes[k : k + n] * _POWERS[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(axis=1)
    spans = [m.span() for m in _WORD.finditer(text)]
    return [(spans[p][0], spans[p + WINDOW - 1][1]) for p in np.unique(least + np.arange(len(least))).tolist()]


def digested(text: str | None, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """Places and digests of all units, from left to right; of equal ones that overlap the first."""
    free: dict[tuple[int, int], int] = {}
    for a, z in sorted({*sentences(text, min_words), *windows(text)}):
        d = digest(text[a:z])
        if free.get(d, 0) <= a:
            free[d] = z
            yield a, z, d


def units(text: str | None, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int]]:
    """Places of the units."""
    return ((a, z) for a, z, _ in digested(text, min_words))


def digest(unit: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(" ".join(unit.lower().split()))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def find_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Digest and place of every unit, stored once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(doc_id, *d, a, z) for a, z, d in digested(text, min_words)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "d1", "d2", "start", "end"]
            )

    path = fresh_path(docs.sparkSession, "passage-units")
    docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(find, _UNITS).write.parquet(path)
    return docs.sparkSession.read.schema(_UNITS).parquet(path)


def may_repeat(found: DataFrame, groups: DataFrame) -> DataFrame:
    """The units whose digest is among those of ``groups``, and a few others: nearly all that stand alone are dropped without a shuffle."""
    shared = found.sparkSession.sparkContext.broadcast(id_filter(groups, "d1"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = pa.array(marked(shared.value, np.asarray(b.column(5))))
            yield b.select([0, 1, 2, 3, 4]).filter(hit)

    return found.selectExpr("doc_id", "d1", "d2", "start", "end", "xxhash64(d1) AS h").mapInArrow(pick, _UNITS)


def _repeats(docs: DataFrame, min_words: int) -> DataFrame:
    """Every unit that stood in an earlier place, with its digest and that place, ``kept``."""
    found = find_units(docs, min_words)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start", "end")
    # stored, so that the join below has an exchange of its own, whose large partitions Spark can split
    groups = cut_lineage(
        found.groupBy("d1", "d2")
        .agg(F.min(place).alias("kept"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("d1", "d2", F.expr("struct(kept.doc_id, kept.start, kept.end) AS kept"))
    )
    return may_repeat(found, groups).join(groups, ["d1", "d2"]).filter("NOT (doc_id <=> kept.doc_id AND start = kept.start)")


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start and end of every unit to remove, with the place that stays: kept_doc_id, kept_start, kept_end."""
    return (
        _repeats(docs, min_words)
        .selectExpr("doc_id", "start", "end", "kept.doc_id AS kept_doc_id", "kept.start AS kept_start", "kept.end AS kept_end")
        .distinct()
    )


def remove(text: str, places: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, z in sorted(places):
        if z > at:
            out.append(text[at : max(at, a)])
            at = z
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the units to remove; ``n_chars``, if there, follows the new text.

    A place is cut only where the text has the unit's digest, as several texts can share a doc_id or have none.
    """
    unit = F.struct("start", "end", "d1", "d2")
    found = _repeats(docs, min_words).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set(unit).alias("__units"))
    names, at = docs.columns, docs.columns.index("text")
    joined = docs.join(found, F.expr("CAST(doc_id AS BIGINT) <=> __doc"), "left").select(*[docs[c] for c in names], "__units")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, marked = b.column(at).to_pylist(), b.column(len(names)).to_pylist()
            places = [
                [(u["start"], u["end"]) for u in x or [] if t and digest(t[u["start"] : u["end"]]) == (u["d1"], u["d2"])]
                for t, x in zip(old, marked, strict=True)
            ]
            texts = [remove(t, x) if x else t for t, x in zip(old, places, strict=True)]
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                n = [len(t) if x else c for t, x, c in zip(texts, places, columns[k].to_pylist(), strict=True)]
                columns[k] = pa.array(n, b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, docs.schema)
