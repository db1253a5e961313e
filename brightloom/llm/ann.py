"""Nearest neighbours by cosine, with a hierarchical k-means tree searched best bin first.

The tree is fitted to at most ``FIT_ROWS`` vectors, chosen by hash; every vector is then stored with
its leaf. A query walks the tree with a priority queue of nodes, nearest centre first, and so meets
leaves in order of promise. How many leaves it visits is calibrated: for at most
``CALIBRATION_ROWS`` vectors the exact neighbours among all vectors are found, and the visits are
widened until ``TARGET`` of them lie in visited leaves. A query goes on beyond that number until the
leaves hold enough vectors. Queries meet the vectors of a leaf in blocks of bounded size.

Vectors that are missing, zero, or hold missing or non-finite components, or have another length than
most, take no part, nor do rows without an id; repeated rows count once. Of equal vectors only the
k + 1 smallest ids are stored, as no other can be among the k nearest. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.session import cut_lineage, fresh_path

FIT_ROWS, LEAF_ROWS, BRANCHES, STEPS = 32_768, 128, 8, 12
CALIBRATION_ROWS, TARGET, WIDEN = 512, 0.96, 1.1
BLOCK_ROWS, QUERY_ROWS = 4_096, 1_024
FIRST_SHARE = 16  # one visit in so many comes first and sets the score to beat


@dataclass(frozen=True)
class Tree:
    centers: np.ndarray  # one unit vector per node
    first_child: np.ndarray  # -1 in a leaf
    n_children: np.ndarray
    leaf_of: np.ndarray  # number of a leaf, -1 elsewhere

    @property
    def n_leaves(self) -> int:
        return int(self.leaf_of.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each unit vector falls into: the nearest child at every node."""
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            for node in np.unique(at[self.first_child[at] >= 0]):
                rows = np.flatnonzero(at == node)
                a = self.first_child[node]
                at[rows] = a + (x[rows] @ self.centers[a : a + self.n_children[node]].T).argmax(axis=1)
            if (self.first_child[at] < 0).all():
                return self.leaf_of[at]

    def leaves(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue = [(-1.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            a = self.first_child[node]
            if a < 0:
                yield int(self.leaf_of[node])
                continue
            near = self.centers[a : a + self.n_children[node]] @ q
            for i, s in enumerate(near.tolist()):
                heapq.heappush(queue, (-s, int(a) + i))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Cluster of each unit vector, by cosine; empty clusters vanish."""
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(STEPS):
        label = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, label, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, sums / np.where(size > 0, size, 1), centers)
    return np.unique((x @ centers.T).argmax(axis=1), return_inverse=True)[1]


def fit_tree(x: np.ndarray, seed: int = 7) -> Tree:
    """Split unit vectors again and again until nodes hold at most ``LEAF_ROWS`` of them."""
    rng = np.random.default_rng(seed)
    centers, first, count, members = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [-1], [0], [np.arange(len(x))]
    node = 0
    while node < len(centers):
        rows = members[node]
        parts = min(BRANCHES, -(-len(rows) // LEAF_ROWS))
        label = _kmeans(x[rows], parts, rng) if parts > 1 else np.zeros(len(rows), int)
        if len(rows) and label.max() > 0:
            first[node], count[node] = len(centers), int(label.max()) + 1
            for c in range(count[node]):
                part = rows[label == c]
                mean = x[part].sum(axis=0)
                centers.append(mean / max(np.linalg.norm(mean), 1e-12))
                first.append(-1)
                count.append(0)
                members.append(part)
        members[node] = None
        node += 1
    first, leaf = np.array(first), np.full(len(first), -1)
    leaf[first < 0] = np.arange((first < 0).sum())
    return Tree(np.array(centers), first, np.array(count), leaf)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vectors that take part, and their length."""
    bad = "exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    v = vectors.selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "embedding").filter(
        f"vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT {bad} AND exists(embedding, x -> x <> 0)"
    )
    most = v.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = most.dim if most else 1
    return v.filter(F.size("embedding") == dim), dim


def _top(q_ids, q, x_ids, x, k: int, extra: dict[str, np.ndarray] | None = None, least: np.ndarray | None = None) -> pa.Table:
    """The k nearest rows of ``x`` for each query, without the query itself and those below ``least``, as rows."""
    scores = unit(q) @ unit(x).T
    scores[q_ids[:, None] == x_ids[None, :]] = -np.inf
    m = min(k, len(x_ids))
    floor = -np.partition(-scores, m - 1, axis=1)[:, m - 1 : m] - 1e-9
    if least is not None:
        floor = np.maximum(floor, least[:, None] - 1e-9)
    at_q, at_x = np.nonzero((scores >= floor) & np.isfinite(scores))
    # the same sum for equal pairs, wherever they stand in a block
    a, b = q[at_q], x[at_x]
    exact = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    order = np.lexsort((x_ids[at_x], -exact, at_q))
    at_q, at_x, exact = at_q[order], at_x[order], exact[order]
    starts = np.searchsorted(at_q, at_q)
    keep = np.arange(len(at_q)) - starts < k
    if least is not None:
        keep &= exact >= least[at_q]
    columns = {"query_id": q_ids[at_q][keep], "vec_id": x_ids[at_x][keep], "score": exact[keep]}
    for name, v in (extra or {}).items():
        columns[name] = v[at_x][keep]
    return pa.table(columns)


class Index:
    """The tree, the stored vectors with their leaves, and how many rows each leaf holds."""

    def __init__(self, vectors: DataFrame, k: int):
        self.spark, self.k = vectors.sparkSession, k
        rows, self.dim = usable(vectors)
        # like many nearest rows are few ids of many copies: the smallest k + 1 of equal vectors suffice
        first = Window.partitionBy("embedding").orderBy("vec_id")
        distinct = rows.distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1).drop("_n")
        path = fresh_path(self.spark, "ann-rows")
        distinct.write.parquet(path)
        stored = self.spark.read.schema(distinct.schema).parquet(path)
        sample = stored.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").collect()
        x = np.array([r.embedding for r in sample], dtype=np.float64).reshape(-1, self.dim)
        self.tree = tree = fit_tree(unit(x) if len(x) else x)
        dim = self.dim

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    leaf = tree.assign(unit(matrix(b.column(1), dim)))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], names=["vec_id", "embedding", "leaf"])

        path = fresh_path(self.spark, "ann-index")
        schema = "vec_id long, embedding array<float>, leaf int"
        stored.selectExpr("vec_id", "CAST(embedding AS array<float>) AS embedding").mapInArrow(place, schema).write.parquet(path)
        self.rows = self.spark.read.schema(schema).parquet(path)
        self.sizes = np.zeros(max(1, tree.n_leaves), dtype=np.int64)
        for r in self.rows.groupBy("leaf").count().collect():
            self.sizes[r.leaf] = r["count"]

    def exact(self, queries: list[tuple[int, list[float]]]) -> DataFrame:
        """(query_id, vec_id, score, leaf): the true k nearest of a bounded set of queries, among all rows."""
        ids, q = np.array([i for i, _ in queries]), np.array([v for _, v in queries], dtype=np.float64)
        dim, k = self.dim, self.k

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    leaf = np.asarray(b.column(2))
                    t = _top(ids, q, np.asarray(b.column(0)), matrix(b.column(1), dim), k, {"leaf": leaf})
                    yield from t.to_batches()

        near = self.rows.mapInArrow(scan, "query_id long, vec_id long, score double, leaf int")
        return near.withColumn("_n", _rank()).filter(F.col("_n") <= k).drop("_n")

    def calibrate(self) -> int:
        """Leaves to visit: widened until the target share of true neighbours lies in them."""
        sample = self.rows.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(CALIBRATION_ROWS).collect()
        if not sample:
            return 1
        vectors = {r.vec_id: r.embedding for r in sample}
        truth: dict[int, list[int]] = {i: [] for i in vectors}
        for r in self.exact(list(vectors.items())).collect():
            truth[r.query_id].append(r.leaf)
        total = sum(map(len, truth.values()))
        order = {i: list(self.tree.leaves(unit(np.array([v], dtype=np.float64))[0])) for i, v in vectors.items()}
        visits = 1
        while True:
            found = sum(leaf in seen for i, leaves in truth.items() for seen in [set(order[i][:visits])] for leaf in leaves)
            if found >= TARGET * total or visits >= self.tree.n_leaves:
                return visits
            visits = int(visits * WIDEN) + 1

    def search(self, queries: DataFrame, visits: int | None = None) -> DataFrame:
        """query_id, rank, vec_id and score of the k nearest found for each (query_id, embedding)."""
        visits = visits or self.calibrate()
        tree, sizes, dim, k = self.tree, self.sizes, self.dim, self.k
        first = -(-visits // FIRST_SHARE)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = unit(matrix(b.column(1), dim)) if len(b) else []
                row, leaf, block, early = [], [], [], []
                for i, v in enumerate(q):
                    met = 0
                    for n, x in enumerate(tree.leaves(v)):
                        if n >= visits and met > k:
                            break
                        met += int(sizes[x])
                        for s in range(-(-int(sizes[x]) // BLOCK_ROWS)):
                            row.append(i)
                            leaf.append(x)
                            block.append(s)
                            early.append(n < first)
                take = b.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*take.columns, pa.array(leaf, pa.int32()), pa.array(block, pa.int32()), pa.array(early, pa.bool_())],
                    names=["query_id", "q", "leaf", "block", "early"],
                )

        spread = queries.selectExpr("query_id", "CAST(embedding AS array<float>) AS embedding")
        schema = "query_id long, q array<float>, leaf int, block int, early boolean"
        path = fresh_path(self.spark, "ann-visits")
        spread.mapInArrow(walk, schema).write.parquet(path)
        asked = self.spark.read.schema(schema).parquet(path)
        # the first leaves give a score that the k nearest reach at least; the others only add what reaches it
        early = cut_lineage(self._meet(asked.filter("early").withColumn("least", F.lit(-2.0))))
        early = early.withColumn("_n", _rank()).filter(F.col("_n") <= k)
        least = early.filter(F.col("_n") == k).selectExpr("query_id", "score AS least")
        late = asked.filter("NOT early").join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        ranked = early.drop("_n").unionByName(self._meet(late)).withColumn("rank", _rank()).filter(F.col("rank") <= k)
        return ranked.selectExpr("query_id", "CAST(rank AS INT) AS rank", "vec_id", "score")

    def _meet(self, asked: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): per query and block the k nearest that reach the query's ``least``."""
        sizes, dim, k = self.sizes, self.dim, self.k
        # chunks of queries per leaf: as many as keep each within its bound; one row per leaf at most
        n_asked = asked.filter("block = 0").groupBy("leaf").agg(F.expr(f"int(ceil(count(*) / {QUERY_ROWS}))").alias("chunks"))
        blocks = self.spark.createDataFrame([(i, int(-(-n // BLOCK_ROWS))) for i, n in enumerate(sizes.tolist()) if n], "leaf int, blocks int")
        left = asked.join(n_asked, "leaf").withColumn("chunk", F.expr("int(pmod(xxhash64(query_id), chunks))"))
        right = self.rows.join(blocks, "leaf").join(n_asked, "leaf").selectExpr(
            "vec_id", "embedding", "leaf", "int(pmod(xxhash64(vec_id, 2), blocks)) AS block", "explode(sequence(0, chunks - 1)) AS chunk"
        )
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return schema.empty_table()
            q, x = matrix(a["q"].combine_chunks(), dim), matrix(b["embedding"].combine_chunks(), dim)
            return _top(np.asarray(a["query_id"]), q, np.asarray(b["vec_id"]), x, k, least=np.asarray(a["least"]))

        key = ["leaf", "block", "chunk"]
        return left.drop("chunks").groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")


def _rank() -> F.Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by ``every``, among all others."""
    rows, _ = usable(vectors)
    queries = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "query_id")
    return Index(vectors, k).search(queries)
