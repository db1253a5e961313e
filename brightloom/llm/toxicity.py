"""Toxic passages by maximum-scoring segments.

A token is a word; its score is the log-odds of standing in toxic against other training documents,
the word's own or that of one of its stems, whichever is higher, shrunk by a
Dirichlet prior that follows the token's share of all documents; every token also costs ``DRIFT``, so
that a text of ordinary words scores ever lower. One linear scan finds all maximal segments, that
is, disjoint passages that no extension or cut makes better. A passage's score S becomes
``lambda * S - ln(K * n)`` in a text of n tokens, whose tail in random text is an extreme-value law;
lambda comes from the token scores' own distribution and K from non-toxic training documents. The
best and the summed significant passages of a document are then calibrated to a probability, on a
third of the training labels that the token scores were not learned from.

Counts of training documents take equal texts once. Missing and empty texts have no passage and the
lowest score. Without toxic training labels every score is 0. Label rows that disagree are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.quality import held_out_fold
from brightloom.llm.sums import sum_vectors
from brightloom.session import fresh_path

WORD = re.compile(r"\w+")
MAX_LABELLED = 100_000
MIN_DOCS = 3
MAX_TOKENS = 1 << 17
PRIOR_DOCS = 10.0
MIN_Z = 4.0
CALIBRATE = "pmod(xxhash64(doc_id, 1), 3) = 0"  # training labels that only calibrate
DRIFT = 0.05
STEMS = (5, 6, 7)
KEPT_WORDS = 500_000
SIGNIFICANT = math.log(20)
SEGMENT = "struct<first:int,last:int,start:int,end:int,score:double>"


def units(text: str | None) -> set[str]:
    """The distinct words of a text, and the stems of those that are longer."""
    found = set(words(text))
    return found.union(*({w[:k] + "*" for w in found if len(w) > k} for k in STEMS))


class Gains(dict):
    """Score per word: the best of the word's own and of its stems; 0 for words that say nothing."""

    def __init__(self, learnt: dict[str, float]):
        super().__init__()
        self.learnt = learnt

    def __missing__(self, w: str) -> float:
        if len(self) > KEPT_WORDS:
            self.clear()
        get = self.learnt.get
        self[w] = g = max(get(w, 0.0), *(get(w[:k] + "*", 0.0) for k in STEMS if len(w) > k), 0.0)
        return g


class Places(dict):
    """Numbers of the learnt tokens that a word stands for: its own and those of its stems."""

    def __init__(self, place: dict[str, int]):
        super().__init__()
        self.place = place

    def __missing__(self, w: str) -> tuple[int, ...]:
        if len(self) > KEPT_WORDS:
            self.clear()
        get = self.place.get
        found = (get(w), *(get(w[:k] + "*") for k in STEMS if len(w) > k))
        self[w] = found = tuple(i for i in found if i is not None)
        return found


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def maximal_segments(at: list[int], gain: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, score), in order of place.

    ``at`` and ``gain`` name the positions with a score above ``drift``; all others score minus
    ``drift``. Each step joins or opens a segment, so the scan is linear in the number of positions.
    """
    stack: list[list] = []  # first, last, total before it, total with it, next candidate on the left
    total, last = 0.0, -1
    for i, g in zip(at, gain, strict=True):
        total -= drift * (i - last - 1)
        last = i
        before, total = total, total + g - drift
        first, j = i, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
            j -= 1
        stack.append([first, i, before, total, j])
    return [(s[0], s[1], s[3] - s[2]) for s in stack]


@dataclass(frozen=True)
class ToxicityModel:
    gains: dict[str, float]
    rate: float  # lambda
    log_k: float
    weights: tuple[float, ...]  # constant, best passage, sum of passages


def find_segments(text: str | None, gains: Gains) -> tuple[int, list[tuple]]:
    """Number of tokens and the maximal segments (first and last token, start and end in the text, score)."""
    if not text:
        return 0, []
    low = text.lower()  # where this changes the length, places refer to the lower-cased text
    tokens = WORD.findall(low)
    gain = list(map(gains.__getitem__, tokens))
    at = [i for i, g in enumerate(gain) if g]
    if not at:
        return len(tokens), []
    found = maximal_segments(at, [gain[i] for i in at])
    spans = [m.span() for m in WORD.finditer(low)]
    return len(tokens), [(a, z, spans[a][0], spans[z][1], s) for a, z, s in found]


def labelled_sample(labels: DataFrame, modulus: int, remainder: int, limit: int) -> DataFrame:
    """doc_id and toxic of at most ``limit`` training labels, chosen by hash."""
    agreed = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
        .filter("toxic = _most")
    )
    train = agreed.filter(~held_out_fold(modulus, remainder)).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    return train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _token_counts(docs: DataFrame) -> DataFrame:
    """(token, toxic, n): training documents of either class that hold a token; equal texts count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[toxic].update(units(text))
                counts[toxic][""] += 1
            for k in (0, 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts[k]), pa.string()), pa.array([k] * len(counts[k]), pa.int32()), pa.array(list(counts[k].values()), pa.int64())],
                    names=["token", "toxic", "n"],
                )

    return docs.select("text", "toxic").mapInArrow(count, "token string, toxic int, n long").groupBy("token", "toxic").agg(F.sum("n").alias("n"))


def learn_gains(docs: DataFrame, labelled: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Positive log-odds per token, and each such token's share of all tokens of all documents."""
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("_digest")).join(F.broadcast(labelled), "doc_id")
    first = known.groupBy("_digest", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    path = fresh_path(spark, "toxicity-counts")
    _token_counts(known.join(first, "doc_id").select("text", "toxic")).write.parquet(path)
    counts = spark.read.parquet(path)
    both = counts.groupBy("token").agg(F.expr("sum(if(toxic = 1, n, 0)) AS bad"), F.expr("sum(if(toxic = 0, n, 0)) AS good"))
    n = both.filter("token = ''").first()
    if n is None or not n.bad:
        return {}, {}
    ratio = F.log((F.col("bad") + 1) / n.bad) - F.log((F.col("good") + 1) / max(1, n.good))
    rows = (
        both.filter(F.col("token") != "").filter((F.col("bad") >= MIN_DOCS) & (ratio > 0))
        .orderBy((ratio * F.col("bad")).desc(), "token").limit(MAX_TOKENS).collect()
    )
    place = {r.token: i for i, r in enumerate(rows)}

    numbers: list[Places] = []  # one per task, kept from batch to batch

    def gather(b: pa.RecordBatch) -> np.ndarray:
        if not numbers:
            numbers.append(Places(place))
        look_up, n_words, hits = numbers[0].__getitem__, 0, []
        for t in b.column(0).to_pylist():
            w = words(t)
            n_words += len(w)
            hits += set().union(*filter(None, map(look_up, set(w))))
        v = np.bincount(np.array(hits, np.int64), minlength=len(place) + 2).astype(float)
        v[-2:] = len(b), n_words
        return v

    seen = sum_vectors(docs.select("text"), gather, len(place) + 2)
    share = n.bad / (n.bad + n.good)
    gains, shares = {}, {}
    for r in rows:
        # pseudo-documents, more for a token of many documents, split as the classes are
        prior = PRIOR_DOCS * (1 + seen[place[r.token]] / max(1.0, seen[-2]))
        bad = (r.bad + prior * share) / (n.bad + prior)
        good = (r.good + prior * (1 - share)) / (n.good + prior)
        odds = math.log(bad / (1 - bad)) - math.log(good / (1 - good))
        spread = math.sqrt(1 / (r.bad + prior * share) + 1 / (r.good + prior * (1 - share)))
        if odds > max(2 * DRIFT, MIN_Z * spread):
            gains[r.token], shares[r.token] = odds, seen[place[r.token]] / max(1.0, seen[-1])
    return gains, shares


def segment_rate(gains: dict[str, float], shares: dict[str, float], drift: float = DRIFT) -> float:
    """The positive solution of sum p * exp(lambda * s) = 1 over token scores s with shares p."""
    if not gains:
        return 1.0
    s = np.array([gains[w] - drift for w in gains])
    p = np.array([shares[w] for w in gains])
    # the law needs a mean below zero; very common learnt tokens weigh less until it is
    p = p * min(1.0, 0.5 * drift / max(1e-12, float(p @ s)))
    low, high = 0.0, 1.0
    value = lambda x: float(p @ np.exp(np.minimum(x * s, 600))) + (1 - p.sum()) * math.exp(-x * drift) - 1
    while value(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def evidence(n: int, scores: list[float], rate: float, log_k: float) -> tuple[float, float]:
    """Best normalised passage and sum of the significant ones, both at least 0."""
    level = log_k + math.log(max(1, n))
    normal = [rate * s - level for s in scores]
    best = max([0.0, *normal])
    return best, sum(x for x in normal if x >= SIGNIFICANT)


def scan(docs: DataFrame, gains: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens and all maximal segments of every document, stored once."""
    schema = f"doc_id long, n_tokens long, segments array<{SEGMENT}>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    names = [f.name for f in kind.value_type]
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked_up = Gains(shared.value)
        for b in batches:
            found = [find_segments(t, looked_up) for t in b.column(1).to_pylist()]
            segments = [[dict(zip(names, s, strict=True)) for s in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array(segments, kind)], names=["doc_id", "n_tokens", "segments"]
            )

    path = fresh_path(docs.sparkSession, "toxicity-segments")
    docs.select("doc_id", "text").mapInArrow(find, schema).write.parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def calibrate(segments: DataFrame, labelled: DataFrame, gains: dict, shares: dict) -> ToxicityModel:
    """Fit K to the best passages of non-toxic training documents and the last weights to all of them."""
    rate = segment_rate(gains, shares)
    rows = segments.join(F.broadcast(labelled.filter(CALIBRATE)), "doc_id").selectExpr("n_tokens", "transform(segments, s -> s.score) AS s", "toxic").collect()
    rows = [r for r in rows if r.n_tokens]
    if not rows or not gains:
        return ToxicityModel(gains, rate, 0.0, (-40.0, 0.0, 0.0))
    best = [rate * max([0.0, *r.s]) - math.log(r.n_tokens) for r in rows if not r.toxic and r.s]
    # in random text the best normalised passage has mean 0.5772 + ln K
    log_k = float(np.mean(best)) - 0.5772 if best else 0.0
    x = np.array([evidence(r.n_tokens, r.s, rate, log_k) for r in rows])
    w = _logistic(x, np.array([float(r.toxic) for r in rows]))
    return ToxicityModel(gains, rate, log_k, tuple(w.tolist()))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """doc_id, held_out, score, predicted, best (normalised best passage) and passages: the significant ones.

    The classifier is fitted to at most ``max_labelled`` training labels; the prior counts, the
    scan and the scores cover every document.
    """
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    labelled = labelled_sample(labels, modulus, remainder, max_labelled)
    path = fresh_path(docs.sparkSession, "toxicity-labels")
    labelled.write.parquet(path)
    labelled = docs.sparkSession.read.schema(labelled.schema).parquet(path)
    gains, shares = learn_gains(docs, labelled.filter(f"NOT {CALIBRATE}"))
    segments = scan(docs, gains)
    model = calibrate(segments, labelled, gains, shares)
    level = f"({model.log_k!r} + ln(greatest(n_tokens, 1)))"
    normal = segments.selectExpr("*", f"transform(segments, s -> {model.rate!r} * s.score - {level}) AS v")
    a, b, c = model.weights
    normal = normal.selectExpr(
        "doc_id", "segments", "v", "greatest(0D, coalesce(array_max(v), 0D)) AS best",
        f"aggregate(filter(v, x -> x >= {SIGNIFICANT!r}), 0D, (t, x) -> t + x) AS total",
    ).withColumn("held_out", held_out_fold(modulus, remainder))
    scored = normal.selectExpr("*", f"1 / (1 + exp(-({a!r} + {b!r} * best + {c!r} * total))) AS score")
    return scored.selectExpr(
        "doc_id", "held_out", "score", "CAST(score >= 0.5 AS INT) AS predicted", "best",
        f"filter(segments, (s, i) -> v[i] >= {SIGNIFICANT!r}) AS passages",
    )
