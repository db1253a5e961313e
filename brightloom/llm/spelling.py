"""Words that differ by a single edit, and the frequent form that each variant leads to.

Counting is one pass: a task counts the words of its texts in a table of bounded size that it
empties when full, and a grouping adds up the tasks.

Two words are one edit apart when common prefix and common suffix together reach the longer
length minus one. The pair's edit then stands at one place ``e`` of the longer word, and what lies
left and right of any segment that holds ``e`` is equal in both. So words meet in blocks: frame
length (of the longer word), segment, and the text outside the segment. Segments start as halves.
A block of more than ``BLOCK_ROWS`` words is dealt again by the halves of its segment, down to
single code points if need be, where a block is no larger than the alphabet. No pair is lost, none
appears twice (its ``e`` is in one segment only), and no block grows with the data.

Blocks are laid behind each other and cut into tiles of ``TILE`` words. A tile is a padded matrix
of code points; tiles of one block are compared pair by pair, column by column, for all prefix
and suffix lengths at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.session import broadcast_if_small, cut_lineage, fresh_path

COUNT_ROWS = 200_000
BLOCK_ROWS = 2048
TILE = 128
# the runs' alphabet has one byte per code point in this encoding; other characters become "?"
_RUNS = re.compile(rb"[a-z\xc0-\xff]+")


def _runs(text: str) -> Counter:
    return Counter(_RUNS.findall(text.encode("latin-1", "replace").lower()))


def garbled(run: bytes, seed: int, every: int) -> bytes:
    """``run`` (Latin-1), less one code point where ``every`` divides the checksum of seed and run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, min_length: int = 6, min_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n) of the runs of letters of all texts, garbled as ``garbled`` says with ``<doc_id>:``.

    A NULL doc_id reads as empty; NULL and empty texts have no words.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, c in _runs(text or "").items():
                    if len(run) >= min_length:
                        word = garbled(run, seed, every)
                        if len(word) >= min_length:
                            total[word] += c
                if len(total) >= COUNT_ROWS:
                    yield out()
                    total.clear()
        yield out()

    rows = docs.selectExpr("CAST(doc_id AS STRING)", "CAST(text AS STRING)").mapInArrow(each, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def code_points(words: list[str], pad: int) -> np.ndarray:
    """Words as rows of code points, filled up with ``pad``."""
    out = np.full((len(words), max(map(len, words), default=0)), pad, dtype=np.uint32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), "<u4")
    return out


def common_prefixes(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the common prefix of every word of ``a`` with every word of ``b``."""
    x, y = code_points(a, 0x110000), code_points(b, 0x110001)  # the two fillers never match
    same = np.ones((len(a), len(b)), bool)
    length = np.zeros((len(a), len(b)), np.int32)
    for c in range(min(x.shape[1], y.shape[1])):
        same &= x[:, c, None] == y[None, :, c]
        if not same.any():
            break
        length += same
    return length


def single_edits(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of different words of ``a`` and ``b`` that are one edit apart, the longer length, and the edit's place in it."""
    before = common_prefixes(a, b)
    after = common_prefixes([w[::-1] for w in a], [w[::-1] for w in b])
    la, lb = np.array(list(map(len, a)), np.int32)[:, None], np.array(list(map(len, b)), np.int32)[None]
    longer = np.maximum(la, lb)
    near = (before + after >= longer - 1) & (before < longer)  # a whole prefix of the longer length is the same word
    i, j = np.nonzero(near)
    return i, j, longer[i, j], np.minimum(before[i, j], longer[i, j] - 1)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, m, a, b, word, n), sorted by key, to (word, n, other, other_n), both ways."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, m, a, b, n = (t.column(c).to_numpy() for c in ("_key", "m", "a", "b", "n"))
        words = t.column("word").to_pylist()
        for s in range(0, len(words), TILE):
            left = words[s : s + TILE]
            r = s
            # this tile against itself, then against the ones that its last block reaches into
            while r < len(words) and (r == s or key[r] == key[min(s + TILE, len(words)) - 1]):
                i, j, longer, place = single_edits(left, words[r : r + TILE])
                i, j = i + s, j + r
                fits = (key[i] == key[j]) & (longer == m[i]) & (place >= a[i]) & (place < b[i]) & (i < j)
                i, j = i[fits], j[fits]
                if len(i):
                    w, v = [words[x] for x in i], [words[x] for x in j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w + v, pa.string()), pa.array(np.r_[n[i], n[j]]), pa.array(v + w, pa.string()), pa.array(np.r_[n[j], n[i]])],
                        names=["word", "n", "other", "other_n"],
                    )
                r += TILE

    held = None  # the rows of the last block so far: the next batch may go on with it
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        key = t.column("_key").to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        yield from compare(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None:
        yield from compare(held)


_KEY = "xxhash64(m, a, b, substring(word, 1, a), substring(word, length(word) - (m - b) + 1, m - b))"


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every pair of different words one edit apart, in both directions.

    ``words`` has unique words and should be a stored table, as it is read once per refinement.
    """
    framed = words.selectExpr("word", "n", "explode(array(length(word), length(word) + 1)) AS m", "0 AS a", "m AS b")
    rows, done = framed, []
    while True:
        split = rows.selectExpr("word", "n", "m", "a AS a0", "b AS b0", "CAST((a + b) div 2 AS INT) AS mid", "explode(array(0, 1)) AS half")
        dealt = split.filter("half = 0 OR mid < b0").selectExpr(
            "word", "n", "m", "CASE WHEN half = 0 THEN a0 ELSE mid END AS a", "CASE WHEN half = 1 THEN b0 ELSE mid END AS b"
        ).filter("a < b").selectExpr("*", f"{_KEY} AS _key")
        # a block without a word of the frame's length has no pair of this frame
        sizes = dealt.groupBy("_key", "m", "a", "b").agg(F.expr("count(*) AS size"), F.expr("count_if(length(word) = m) AS whole"))
        large = cut_lineage(sizes.filter(f"size > {BLOCK_ROWS} AND whole > 0 AND b - a > 1").select(F.col("_key").alias("_large")).distinct())
        if large.isEmpty():
            done.append(dealt)
            break
        hot = broadcast_if_small(large)
        done.append(dealt.join(hot, F.col("_key") == F.col("_large"), "left_anti"))
        rows = dealt.join(hot, F.col("_key") == F.col("_large"), "left_semi").drop("_key")
    blocks = done[0]
    for more in done[1:]:
        blocks = blocks.unionByName(more)
    # a number, so that few bytes with much work behind them are not put into a few tasks
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = blocks.select("_key", "m", "a", "b", "word", "n").repartition(parts, "_key").sortWithinPartitions("_key")
    return in_order.mapInArrow(_tiles, "word string, n long, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following ``form`` to its end; every step reads the step before twice as far."""
    roots = cut_lineage(forms.selectExpr("word", "form AS root"))
    while True:
        ahead = roots.selectExpr("word AS _at", "root AS _next")
        step = cut_lineage(roots.join(ahead, F.expr("root = _at"), "left").selectExpr("word", "coalesce(_next, root) AS root", "_next IS NOT NULL AS moved"))
        roots = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return roots


def group_spellings(docs: DataFrame, min_length: int = 6, min_count: int = 5, every: int = 199, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word that is long and frequent enough.

    ``form`` is the near word of the largest n (ties: the smallest in code-point order) if that is at
    least ``ratio`` times the word's; ``root`` the end of the chain of forms, the word itself without
    one. NULL and empty texts have no words, a repeated row counts again, an empty table gives no
    rows, words of any length are compared whole, and only ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "words")
    count_words(docs, min_length, min_count, every).write.parquet(path)
    words = spark.read.schema("word string, n long").parquet(path)
    best = near_words(words).groupBy("word").agg(
        F.expr("count(*) AS n_near"), F.expr("min(struct(-other_n AS less, other)) AS best"), F.expr("max(n) AS own")
    )
    summary = cut_lineage(best.selectExpr(
        "word", "n_near", f"CASE WHEN -best.less >= {ratio} * own THEN best.other END AS form", f"CASE WHEN -best.less >= {ratio} * own THEN -best.less END AS form_n"
    ))
    roots = _roots(summary.filter("form IS NOT NULL"))
    return words.join(summary, "word", "left").join(roots, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) AS n_near", "form", "form_n", "coalesce(root, word) AS root"
    )
