"""Quality scores learned from trusted positives and unlabelled text.

The classifier minimises the non-negative unbiased risk of positive-unlabelled learning with the
logistic loss: ``pi * E_p[l(z)] + max(0, E_u[l(-z)] - pi * E_p[l(-z)])``. As l(z) - l(-z) = -z, the
part without the maximum is ``E_u[log(1 + exp(z))] - pi * E_p[z]``: convex, so Newton steps
over sums that Spark gathers from all documents find its minimum, and a step that would make
the second risk negative is shortened until it does not. The class prior is estimated from the
same two samples: for the scores above any threshold the share of unlabelled text over that of
positives is at least the prior, and the smallest such ratio is taken.

Features describe the shape of a text (lengths, marks, repetition, how far it can be squeezed), each
cut into bins at quantiles of all documents. Labels, language, source and ids are no features.
Missing and empty texts have zero features and a score like any other. Without trusted positives
nothing can be learned: every score is 0.5 and every document stays. A document whose label rows
disagree is not trusted. A missing doc_id belongs to no training fold that is left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.sums import sum_vectors
from brightloom.session import fresh_path

FEATURES = (
    "log_words", "log_chars", "word_length", "long_words", "letters", "upper", "digits", "space", "marks", "odd_marks",
    "bars", "shouts", "caps_words", "distinct_words", "top_word", "same_as_before", "distinct_triples", "distinct_lines",
    "line_words", "sentence_words", "ends_in_mark", "ends_in_odd", "squeezed", "non_ascii", "links", "mark_kinds",
)
_ODD = "%$&*#@~^=<>{}[]\\/_"
_STOPS = re.compile(r"[.!?]+(?=\s|$)")


def text_features(text: str | None) -> np.ndarray:
    """Shape of a text, as numbers. A missing text counts as empty; an empty one has zeros."""
    f = np.zeros(len(FEATURES))
    t = text or ""
    words = t.split()
    if not words:
        return f
    raw = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    n, m = len(raw), len(words)
    low = np.bincount(raw[raw < 128], minlength=128)
    upper, lower, digits = low[65:91].sum(), low[97:123].sum(), low[48:58].sum()
    space = low[32] + low[9:14].sum()
    high = n - low.sum()
    odd = sum(low[ord(c)] for c in _ODD)
    lengths = np.fromiter(map(len, words), np.int64, m)
    kinds, counts = np.unique(np.array([hash(w) for w in words]), return_counts=True)
    codes = np.array([hash(w) for w in words], dtype=np.int64).astype(np.uint64)
    triples = codes[:-2] * np.uint64(3) + codes[1:-1] * np.uint64(5) + codes[2:] * np.uint64(7) if m > 2 else codes[:1]
    lines = [x for x in t.split("\n") if x.strip()]
    ends = [w[-1] for w in words]
    f[:] = (
        np.log1p(m), np.log1p(n), lengths.mean(), (lengths > 14).mean(), (upper + lower + high) / n, upper / n, digits / n,
        space / n, (n - space - upper - lower - digits - high) / n, odd / n, low[124] / m, low[33] / m,
        sum(w.isupper() for w in words) / m, len(kinds) / m, counts.max() / m,
        (codes[1:] == codes[:-1]).sum() / m, len(np.unique(triples)) / max(1, m - 2), len(set(lines)) / max(1, len(lines)),
        np.log1p(m / max(1, len(lines))), np.log1p(m / (1 + len(_STOPS.findall(t)))),
        sum(not c.isalnum() for c in ends) / m, sum(c in _ODD for c in ends) / m,
        len(zlib.compress(t.encode("utf-8", "replace"), 1)) / n, high / n,
        sum("://" in w or "@" in w for w in words) / m, (low[33:48] > 0).sum() / 15,
    )
    return f


EDGES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)
PENALTY, TOLERANCE, MAX_STEPS = 0.6, 1e-5, 100  # the penalty shrinks with the root of the positives' number
SHORTER = 0.5 ** np.arange(12)
FIRST_PRIOR, PRIOR_ROUNDS, TAIL_BINS = 0.5, 2, 4096
LEAST_TAIL, CONFIDENCE = 0.05, 0.1


@dataclass(frozen=True)
class QualityModel:
    edges: tuple[np.ndarray, ...]
    weights: np.ndarray | None
    prior: float

    def z(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return one_hot(x, self.edges) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.z(x), -500, 500)))


def one_hot(x: np.ndarray, edges: tuple[np.ndarray, ...]) -> np.ndarray:
    """A constant and, per feature, one indicator for each bin but the first."""
    columns = [np.ones((len(x), 1))]
    for j, e in enumerate(edges):
        columns.append(np.searchsorted(e, x[:, j], side="right")[:, None] == np.arange(1, len(e) + 1))
    return np.concatenate(columns, axis=1).astype(np.float64)


def held_out_fold(modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of the doc_id as text leaves ``remainder``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def features_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``x``, the features as 32-bit numbers, stored once."""
    schema = docs.select(*keep).schema.add("x", "binary")
    at = len(keep)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [text_features(t).astype("<f4").tobytes() for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(x, pa.binary())], names=[*keep, "x"])

    path = fresh_path(docs.sparkSession, "quality-features")
    docs.select(*keep, "text").mapInArrow(describe, schema).write.parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, len(FEATURES)).astype(np.float64)


def quantile_edges(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """Distinct approximate quantiles of each feature over all rows."""
    n = len(FEATURES)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, j]) for j in range(n)], names=[f"f{j}" for j in range(n)])

    wide = rows.select("x").mapInArrow(spread, ", ".join(f"f{j} double" for j in range(n)))
    at = ", ".join(map(str, EDGES))
    found = wide.selectExpr(*[f"percentile_approx(f{j}, array({at}), 2000) AS f{j}" for j in range(n)]).first()
    return tuple(np.unique(np.asarray(v or [], dtype=np.float64)) for v in found)


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


class _Risk:
    """Sums over the stored features: column 0 tells trusted positives, column 1 holds the features."""

    def __init__(self, rows: DataFrame, edges: tuple[np.ndarray, ...]):
        self.rows, self.edges = rows.select("positive", "x"), edges
        self.size = 1 + sum(len(e) for e in edges)
        size = self.size

        def count(b: pa.RecordBatch) -> np.ndarray:
            p = np.asarray(b.column(0).to_numpy(zero_copy_only=False), dtype=bool)
            return np.concatenate([[p.sum(), len(b)], one_hot(_matrix(b.column(1))[p], edges).sum(axis=0)])

        total = sum_vectors(self.rows, count, 2 + size)
        self.n_positive, self.n_all = total[0], total[1]
        self.mean_positive = total[2:] / max(1.0, total[0])
        self.penalty = PENALTY / max(1.0, self.n_positive) ** 0.5

    def slope(self, w: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
        edges, k = self.edges, self.size

        def gather(b: pa.RecordBatch) -> np.ndarray:
            d = one_hot(_matrix(b.column(1)), edges)
            p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
            return np.concatenate([d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

        total = sum_vectors(self.rows, gather, k + k * k) / self.n_all
        return total[:k] - prior * self.mean_positive + self.penalty * w, total[k:].reshape(k, k) + self.penalty * np.eye(k)

    def along(self, w: np.ndarray, step: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
        """Risk and the part that must not be negative, at w and at w plus each share of the step."""
        edges, shares = self.edges, np.concatenate([[0.0], SHORTER])

        def gather(b: pa.RecordBatch) -> np.ndarray:
            p = np.asarray(b.column(0).to_numpy(zero_copy_only=False), dtype=bool)
            d = one_hot(_matrix(b.column(1)), edges)
            z = (d @ w)[:, None] + (d @ step)[:, None] * shares
            return np.concatenate([_loss(z[p]).sum(axis=0), _loss(-z[p]).sum(axis=0), _loss(-z).sum(axis=0)])

        sums = sum_vectors(self.rows, gather, 3 * len(shares)).reshape(3, -1)
        right, wrong = prior * sums[0] / self.n_positive, sums[2] / self.n_all - prior * sums[1] / self.n_positive
        at = w[:, None] + step[:, None] * shares
        return right + np.maximum(0, wrong) + self.penalty / 2 * (at * at).sum(axis=0), wrong

    def minimise(self, prior: float, w: np.ndarray) -> np.ndarray:
        for _ in range(MAX_STEPS):
            gradient, curvature = self.slope(w, prior)
            step = -np.linalg.solve(curvature, gradient)
            risk, wrong = self.along(w, step, prior)
            good = np.flatnonzero((wrong[1:] >= 0) & (risk[1:] < risk[0]))
            if not len(good):
                return w
            w = w + SHORTER[good[0]] * step
            if risk[0] - risk[1 + good[0]] < TOLERANCE:
                return w
        return w

    def prior(self, w: np.ndarray) -> float:
        """Smallest share of unlabelled over positive text above a threshold, with a margin for chance."""
        edges = self.edges

        def gather(b: pa.RecordBatch) -> np.ndarray:
            p = np.asarray(b.column(0).to_numpy(zero_copy_only=False), dtype=bool)
            z = one_hot(_matrix(b.column(1)), edges) @ w
            at = np.minimum((TAIL_BINS / (1 + np.exp(-np.clip(z, -500, 500)))).astype(np.int64), TAIL_BINS - 1)
            return np.concatenate([np.bincount(at[p], minlength=TAIL_BINS), np.bincount(at, minlength=TAIL_BINS)]).astype(float)

        tails = sum_vectors(self.rows, gather, 2 * TAIL_BINS).reshape(2, -1)[:, ::-1].cumsum(axis=1)
        of_positive, of_all = tails[0] / self.n_positive, tails[1] / self.n_all
        chance = np.sqrt(np.log(4 / CONFIDENCE) / 2) * (self.n_positive**-0.5 + self.n_all**-0.5)
        enough = of_positive >= LEAST_TAIL
        ratio = (of_all[enough] + chance) / of_positive[enough]
        return float(min(1.0, ratio.min())) if len(ratio) else 1.0


def fit(rows: DataFrame) -> QualityModel:
    """Fit to stored features with ``positive``: which rows are trusted positives; all rows are unlabelled text.

    The first prior only serves to rank the texts; prior and weights are then found in turns.
    """
    edges = quantile_edges(rows)
    risk = _Risk(rows, edges)
    if not risk.n_positive:
        return QualityModel(edges, None, 1.0)
    prior, w = FIRST_PRIOR, np.zeros(risk.size)
    for _ in range(PRIOR_ROUNDS):
        w = risk.minimise(prior, w)
        prior = risk.prior(w)
        w = np.zeros(risk.size)
    return QualityModel(edges, risk.minimise(prior, w), prior)


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that all their label rows call good."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_q")).filter("_q = 1").select("doc_id")


def with_positives(rows: DataFrame, labels: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """Mark trusted positives outside the fold that is held out."""
    good = trusted(labels).withColumn("_good", F.lit(True))
    joined = rows.join(good, "doc_id", "left")
    return joined.withColumn("held_out", held_out_fold(modulus, remainder)).selectExpr(
        "doc_id", "held_out", "coalesce(_good, false) AND NOT held_out AS positive", "x"
    )


def _prepared(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int) -> DataFrame:
    spark = docs.sparkSession
    path = fresh_path(spark, "quality-rows")
    rows = features_of(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), ["doc_id"])
    marked = with_positives(rows, labels, modulus, remainder)
    marked.write.parquet(path)
    return spark.read.schema(marked.schema).parquet(path)


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = _prepared(docs, labels, modulus, remainder)
    model = fit(rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.select("doc_id", "held_out", "x").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier takes for good."""
    model = fit(_prepared(docs, labels, modulus, remainder))
    at = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = np.stack([text_features(t).astype("<f4") for t in b.column(at).to_pylist()]).astype(np.float64)
                yield b.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(good, docs.schema)
