"""Similarity join on sets of word n-grams, by prefix filtering with the rarest n-grams first.

Documents with equal sets form one class from the start, and only a class's first document goes on.
A class is indexed by its prefix: so many of its rarest n-grams that two similar sets must share one.
How rare an n-gram is comes from a table of document counts per hash bucket, counted over all
documents; its size is fixed, and any order, if all use the same, keeps every pair. Where two classes
share a prefix n-gram, a pair must pass

* the length filter: sizes too different cannot be similar;
* the positional filter: what stands behind the shared n-gram must suffice for the overlap;
* the suffix filter: the parities of the sets in 256 buckets, and then in at least four buckets per
  n-gram, differ in no more places than the sets.

Each pair that is left is verified at most once, on the whole sets. To keep large groups of near copies
from being listed pair by pair, the classes of each prefix n-gram are first compared with one of them
(its pivot); then only pairs that are not connected yet are listed. Of the pairs of a list each class
brings one to be verified first, and the rest only where that left them in different components, so a
set travels a few times and not once per pair. No link that joins two components is lost; links inside
a component are not all listed.

Words are runs of anything but space and tab to carriage return, A-Z in lower case. A text with fewer
words than ``width`` has one n-gram, all of it. Missing texts and texts without words have none, and
link with nothing. Rows that share a doc_id are one document; rows without one take no part. n-grams
are 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.graph import components
from brightloom.session import cut_lineage, fresh_path

KEPT_WORDS = 250_000
COUNT_BITS, CHUNK_BITS = 22, 16
FILTER_BITS = 20, 28  # least and most; at most 32 MB are sent to the tasks
_POWERS = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(1, 65)], dtype=np.uint64)


class _WordCodes(dict):
    def __missing__(self, w: bytes) -> int:
        self[w] = c = xxhash.xxh3_64_intdigest(w)
        return c


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_set(text: str | None, width: int, codes: dict[bytes, int]) -> np.ndarray:
    """The distinct n-grams of a text as sorted 64-bit codes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(codes) > KEPT_WORDS:
        codes.clear()
    w = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        h += w[k : k + n] * _POWERS[k]
    return np.unique(_mix(h))


_DOC = "doc_id long, n int, d1 long, d2 long, chunk int, counts binary"


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Per document the size and digest of its set; per task its part of the count table (``chunk`` set)."""
    names = [f.split()[0] for f in _DOC.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, table = _WordCodes(), np.zeros(1 << COUNT_BITS, dtype=np.uint32)
        for b in batches:
            ids, sizes, d1, d2 = b.column(0).to_pylist(), [], [], []
            for t in b.column(1):
                s = ngram_set(t.as_py(), width, codes)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                sizes.append(len(s))
                d1.append((d >> 64) - (1 << 63))
                d2.append((d & ((1 << 64) - 1)) - (1 << 63))
                np.add.at(table, s & np.uint64((1 << COUNT_BITS) - 1), np.uint32(1))
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([ids, sizes, d1, d2, none, none], kinds, strict=True)], names=names)
        for c, part in enumerate(table.reshape(-1, 1 << CHUNK_BITS)):
            if part.any():
                row = [[None], [None], [None], [None], [c], [zlib.compress(part.tobytes(), 1)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

    path = fresh_path(docs.sparkSession, "ngram-docs")
    docs.mapInArrow(scan, _DOC).write.parquet(path)
    return docs.sparkSession.read.schema(_DOC).parquet(path)


def count_levels(described: DataFrame) -> np.ndarray:
    """Per hash bucket how frequent its n-grams are, in half octaves: one byte for each of a fixed number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.uint32)
                sums[c] = sums[c] + part if c in sums else part.astype(np.uint64)
        for c, total in sums.items():
            level = np.floor(2 * np.log2(total + 1.0)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(level.tobytes())], pa.binary())], names=["chunk", "level"])

    parts = described.filter("chunk IS NOT NULL").select("chunk", "counts")
    rows = parts.repartition(1 << (COUNT_BITS - CHUNK_BITS - 2), "chunk").mapInArrow(add, "chunk int, level binary").collect()
    out = np.zeros(1 << COUNT_BITS, dtype=np.uint8)
    for r in rows:
        out[r.chunk << CHUNK_BITS : (r.chunk + 1) << CHUNK_BITS] = np.frombuffer(zlib.decompress(bytes(r.level)), np.uint8)
    return out


_PREFIX = "doc_id long, n int, s0 long, s1 long, s2 long, s3 long, prefix array<long>, wide binary"


def wide_parities(grams: np.ndarray) -> bytes:
    """Parities of a set in buckets by its lowest bits: a power of two of at least four per n-gram."""
    buckets = 1 << max(8, int(4 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def parities_differ(x: bytes, y: bytes) -> int:
    """In how many buckets two such tables differ, the larger folded to the size of the smaller."""
    a, b = sorted((np.frombuffer(t, np.uint8) for t in (x, y)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def prefixes(docs: DataFrame, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """Per document its rarest n-grams, rarest first, and the parities of its set in 256 and in more buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(levels.tobytes())
    names = [f.split()[0] for f in _PREFIX.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, level = _WordCodes(), np.frombuffer(shared.value, np.uint8)
        for b in batches:
            ids, sizes, parity, lists, wide = [], [], [], [], []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = ngram_set(t.as_py(), width, codes)
                n = len(s)
                if not n or doc_id is None:
                    continue
                rank = (level[s & np.uint64((1 << COUNT_BITS) - 1)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                size = n - (percent * n + 99) // 100 + 1
                first = np.argpartition(rank, size - 1)[:size]
                first = first[np.lexsort((s[first], rank[first]))]
                odd = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) & 1
                ids.append(doc_id)
                sizes.append(n)
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                lists.append(s[first].view(np.int64))
                wide.append(wide_parities(s))
            bits = np.stack(parity) if parity else np.zeros((0, 4), np.int64)
            ends = np.cumsum([0, *map(len, lists)])
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(bits[:, i]) for i in range(4)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(wide, pa.binary())],
                names=names,
            )

    return docs.mapInArrow(scan, _PREFIX)


def _passes(percent: int) -> str:
    """Length, positional and suffix filter of a pair of postings ``l`` and ``r``."""
    need = f"((l.n + r.n) * {percent} + {100 + percent - 1}) DIV {100 + percent}"
    differ = " + ".join(f"bit_count(l.s{i} ^ r.s{i})" for i in range(4))
    return (
        f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) "
        f"AND 1 + least(l.n - l.pos - 1, r.n - r.pos - 1) >= {need} AND {differ} <= l.n + r.n - 2 * ({need})"
    )


def id_filter(ids: DataFrame, column: str) -> bytes:
    """A bit for each hash value that occurs among (stored) ids, which lets most others be skipped.

    It has 32 to 64 bits per id, up to 2 ** FILTER_BITS[1]; beyond that it lets more others pass, but
    drops none of the ids. Tasks fill in pieces of it, so that the driver gets no more than its length.
    """
    low, high = FILTER_BITS
    bits = min(max(low, (32 * ids.count()).bit_length()), high)
    piece = 13  # 8 KB

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for b in batches:
            h = np.sort(np.asarray(b.column(0)))
            starts = np.flatnonzero(np.diff(h >> (piece + 3), prepend=-1))
            for part in np.split(h, starts[1:]) if len(h) else []:
                table = pieces.setdefault(int(part[0] >> (piece + 3)), np.zeros(1 << piece, np.uint8))
                np.bitwise_or.at(table, (part >> 3) & ((1 << piece) - 1), (1 << (part & 7)).astype(np.uint8))
        names, kinds = ["piece", "bits"], [pa.int64(), pa.binary()]
        columns = [list(pieces), [t.tobytes() for t in pieces.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    hashed = ids.selectExpr(f"xxhash64({column}) & {(1 << bits) - 1} AS h").distinct()
    dealt = hashed.repartition(F.expr(f"shiftright(h, {piece + 3})"))
    out = np.zeros((1 << bits) >> 3, dtype=np.uint8)
    for r in dealt.mapInArrow(mark, "piece long, bits binary").collect():
        out[r.piece << piece : (r.piece + 1) << piece] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.tobytes()


def marked(table: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(table, np.uint8)
    h = hashes & (8 * len(bits) - 1)
    return ((bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1).astype(bool)


_SETS = "doc_id long, grams array<long>, left boolean, right boolean"


def sets_of(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(doc_id, grams, left, right): the whole sets of the documents that stand on either side of a pair.

    A few others, with the same hash as one of them, are there as well.
    """
    shared = docs.sparkSession.sparkContext.broadcast((id_filter(pairs, "a"), id_filter(pairs, "b")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _WordCodes()
        for b in batches:
            left, right = (marked(t, np.asarray(b.column(2))) for t in shared.value)
            hit = left | right
            if hit.any():
                b = b.filter(pa.array(hit))
                grams = [ngram_set(t.as_py(), width, codes).view(np.int64) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(grams, pa.list_(pa.int64())), pa.array(left[hit]), pa.array(right[hit])],
                    names=["doc_id", "grams", "left", "right"],
                )

    return docs.withColumn("_h", F.expr("xxhash64(doc_id)")).mapInArrow(scan, _SETS)


_POSTING = "g long, cls long, n int, pos int, s0 long, s1 long, s2 long, s3 long"


def shared_postings(firsts: DataFrame, percent: int) -> DataFrame:
    """One row per class and prefix n-gram by which it may be found to be similar to another class.

    In the smaller set of a pair that passes the positional filter the n-gram stands so far in front
    that enough of the set is behind it; where no class has it there, it pairs nothing. The n-grams
    in question are marked in a table of bits, so that the others, nearly all, are dropped without a
    join. What stays by chance pairs with nothing.
    """
    front = f"pos <= n - ({2 * percent} * n + {99 + percent}) DIV {100 + percent}"
    placed = firsts.selectExpr("n", "posexplode(prefix) AS (pos, g)").selectExpr("g", f"{front} AS front")
    common = placed.groupBy("g").agg(F.count("*").alias("m"), F.max("front").alias("front")).filter("m > 1 AND front").select("g")
    rows = firsts.selectExpr("sum(size(prefix))").first()[0] or 0
    shared = firsts.sparkSession.sparkContext.broadcast(id_filter(cut_lineage(common, rows // 2), "g"))
    names = [f.split()[0] for f in _POSTING.split(", ")]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(6)
            g, h = np.asarray(lists.flatten()), np.asarray(b.column(7).flatten())
            size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            row = np.repeat(np.arange(len(b)), size)
            pos = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
            hit = np.flatnonzero(marked(shared.value, h))
            at = pa.array(row[hit])  # of the narrow columns only
            doc, size, *parity = (b.column(i).take(at) for i in range(6))
            yield pa.RecordBatch.from_arrays([pa.array(g[hit]), doc, size, pa.array(pos[hit].astype(np.int32)), *parity], names=names)

    hashed = firsts.drop("wide").withColumn("h", F.expr("transform(prefix, x -> xxhash64(x))"))
    return cut_lineage(hashed.mapInArrow(pick, _POSTING))


def plausible(firsts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose wide parities differ in no more places than similar sets can."""
    sides = [firsts.selectExpr(f"doc_id AS {c}", f"n AS n{c}", f"wide AS w{c}") for c in "ab"]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.asarray(b.column(2)).astype(np.int64) + np.asarray(b.column(4))
            allowed = n - 2 * ((n * percent + 99 + percent) // (100 + percent))
            differ = [parities_differ(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(np.asarray(differ, np.int64) <= allowed))

    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "wa", "nb", "wb")
    return both.mapInArrow(test, "a long, b long").distinct()


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left, right = (sets.filter(side).selectExpr(f"doc_id AS {c}", f"grams AS g{c}") for side, c in (("left", "a"), ("right", "b")))
    both = pairs.join(left, "a").join(right, "b").selectExpr("a", "b", "size(ga) AS na", "size(gb) AS nb", "size(array_intersect(ga, gb)) AS common")
    return both.filter(f"100 * common >= {percent} * (na + nb - common)").select("a", "b").distinct()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder, without the plan properties that a checkpoint carries on."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connecting(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified pairs among ``pairs`` that connect all that these connect: one of each ``a`` is tried first."""
    sets = stored(sets_of(docs, pairs, width), "ngram-sets")
    hooks = pairs.groupBy("a").agg(F.min("b").alias("b"))
    first = stored(verified(sets, hooks, percent), "ngram-links")
    group = components(first)
    named = pairs
    for c in "ab":
        named = named.join(group.withColumnsRenamed({"id": c, "component": f"grp_{c}"}), c, "left")
    apart = named.filter("coalesce(grp_a, a) <> coalesce(grp_b, b)").select("a", "b").join(hooks, ["a", "b"], "left_anti")
    return first.unionByName(stored(verified(sets, stored(apart, "ngram-pairs"), percent), "ngram-links"))


def links(docs: DataFrame, firsts: DataFrame, postings: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified pairs (a, b) that connect everything that is connected."""
    keep, n_postings = _passes(percent), postings.count()
    # what is joined back to its own input is stored first: Spark can then split large partitions of the join
    pivots = postings.groupBy("g").agg(F.min(F.struct("pos", "n", "cls", "s0", "s1", "s2", "s3")).alias("p"), F.count("*").alias("m"))
    pivots = cut_lineage(pivots.filter("m > 1").selectExpr("g", "p.*"), n_postings // 2)
    starred = postings.alias("l").join(pivots.alias("r"), F.expr(f"l.g = r.g AND l.cls <> r.cls AND {keep}"))
    # few pivots on the right; two classes that are each other's pivot are one pair
    tried = starred.selectExpr("struct(l.cls AS a, r.cls AS b) AS p").groupBy(F.expr("least(p.a, p.b) AS lo"), F.expr("greatest(p.a, p.b) AS hi"))
    tried = cut_lineage(tried.agg(F.min("p").alias("p")).selectExpr("p.a AS a", "p.b AS b"), n_postings)
    first = connecting(docs, stored(plausible(firsts, tried, percent), "ngram-pairs"), width, percent)
    group = components(first).withColumnsRenamed({"id": "cls", "component": "grp"})

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(group, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))

    # an n-gram of two classes has had its only pair, and one whose classes are all connected has nothing left to find
    mixed = named(postings.select("g", "cls")).groupBy("g").agg(F.count("*").alias("m"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    mixed = cut_lineage(mixed.filter("m > 2 AND lo <> hi").select("g"), n_postings // 3)
    p = cut_lineage(named(postings.join(mixed, "g", "left_semi")), n_postings)
    rest = p.alias("l").join(p.alias("r"), F.expr(f"l.g = r.g AND l.cls < r.cls AND l.grp <> r.grp AND {keep}"))
    done = tried.selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
    rest = rest.selectExpr("l.cls AS a", "r.cls AS b").distinct().join(done, ["a", "b"], "left_anti")
    return first.unionByName(connecting(docs, stored(plausible(firsts, stored(rest, "ngram-pairs"), percent), "ngram-pairs"), width, percent))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: two documents link when 100 * intersection >= percent * union."""
    spark: SparkSession = docs.sparkSession
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    described = describe(docs, width)
    rows = described.filter("chunk IS NULL").select("doc_id", "n", "d1", "d2")
    classes = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("cls"))
    path = fresh_path(spark, "ngram-prefixes")
    firsts = prefixes(docs, width, percent, count_levels(described)).join(classes.selectExpr("cls AS doc_id"), "doc_id", "left_semi")
    firsts.write.parquet(path)
    firsts = spark.read.schema(_PREFIX).parquet(path)
    postings = shared_postings(firsts, percent)
    group = components(links(docs, firsts, postings, width, percent)).withColumnRenamed("id", "cls")
    named = classes.join(group, "cls", "left").selectExpr("d1", "d2", "coalesce(component, cls) AS component")
    joined = rows.join(named, ["d1", "d2"], "left")
    return joined.selectExpr(
        "doc_id", "CAST(n AS BIGINT) AS n_shingles",
        "CASE WHEN doc_id IS NOT NULL THEN CASE WHEN n > 0 THEN component ELSE doc_id END END AS component_id",
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; rows without a doc_id stay."""
    dropped = near_duplicates(docs, width, percent).filter("doc_id <> component_id").select(F.col("doc_id").cast("long").alias("_doc")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["_doc"], "left_anti")
