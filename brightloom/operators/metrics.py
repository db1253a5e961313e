"""Errors, losses, ranking metrics and least squares as aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# The terms of the non-linear transform, in order; order k uses the first k + 1.
NONLINEAR = ("1D", "x1", "x2", "x1 * x1", "x2 * x2", "x1 * x2", "abs(x1 - x2)", "abs(x1 + x2)")


def nonlinear(k: int = 7) -> str:
    return f"array({', '.join(NONLINEAR[: k + 1])})"


def dot(w: list[float], terms: tuple[str, ...]) -> str:
    return " + ".join(f"{float(a)!r}D * ({t})" for a, t in zip(w, terms))


def line_through(ax: str, ay: str, bx: str, by: str) -> tuple[str, str, str]:
    """Weights (w0, w1, w2) of the line through two points."""
    return f"{bx} * {ay} - {by} * {ax}", f"{by} - {ay}", f"{ax} - {bx}"


def class_error(signal: str, label: str = "y") -> str:
    """Share of rows with y·s < 0; a zero signal is not an error."""
    return f"avg(CASE WHEN {label} * ({signal}) < 0 THEN 1D ELSE 0D END)"


def log_loss(signal: str, label: str = "y") -> str:
    """Mean of ln(1 + exp(-y·s)), safe for large signals."""
    m = f"(-{label} * ({signal}))"
    return f"avg(greatest({m}, 0D) + log1p(exp(-abs({m}))))"


def normal_sums(rows: DataFrame, terms: tuple[str, ...] = NONLINEAR, label: str = "y") -> DataFrame:
    """(i, j, value): XᵀX for i <= j, and Xᵀy as j = -1, from one aggregate."""
    pairs = [(i, j, f"sum(({terms[i]}) * ({terms[j]}))") for i in range(len(terms)) for j in range(i, len(terms))]
    pairs += [(i, -1, f"sum(({t}) * {label})") for i, t in enumerate(terms)]
    sums = rows.agg(*[F.expr(f"{e} AS s{n}") for n, (_, _, e) in enumerate(pairs)])
    items = ", ".join(f"named_struct('i', {i}, 'j', {j}, 'value', CAST(s{n} AS DOUBLE))" for n, (i, j, _) in enumerate(pairs))
    return sums.selectExpr(f"inline(array({items}))")


def solve_normal(sums: list[Row], k: int) -> list[float]:
    """Least-squares weights of the first k + 1 terms; the sums are at most 9 x 9 numbers."""
    n = k + 1
    a, b = np.zeros((n, n)), np.zeros(n)
    for r in sums:
        if r.i < n and r.j == -1:
            b[r.i] = r.value
        elif r.i < n and r.j < n:
            a[r.i, r.j] = a[r.j, r.i] = r.value
    return [float(x) for x in np.linalg.lstsq(a, b, rcond=None)[0]]


def ranking_metrics(scored: DataFrame, score: str, label: str, buckets: int = 10_000) -> DataFrame:
    """ROC-AUC, average precision and accuracy at 0.5; ``score`` lies in [0, 1], ``label`` is 0 or 1.

    Rows shrink to one per distinct score. Running totals are taken inside score buckets, plus
    the totals of all higher buckets, so no task sorts all scores.
    """
    g = scored.groupBy(F.expr(f"{score} AS s")).agg(
        F.expr(f"sum({label}) AS pos"), F.expr(f"count(*) - sum({label}) AS neg"),
        F.expr(f"sum(CASE WHEN (CASE WHEN {score} >= 0.5D THEN 1 ELSE 0 END) = {label} THEN 1 ELSE 0 END) AS hits"),
    ).selectExpr("*", f"CAST(least({buckets - 1}, floor(s * {buckets})) AS INT) AS b")
    above = g.groupBy("b").agg(F.expr("sum(pos) AS bp"), F.expr("sum(neg) AS bn")).selectExpr(
        "b", "sum(bp) OVER (ORDER BY b DESC) - bp AS pos_above", "sum(bn) OVER (ORDER BY b DESC) - bn AS neg_above"
    )
    run = g.join(F.broadcast(above), "b").selectExpr(
        "pos", "neg", "hits",
        "pos_above + sum(pos) OVER (PARTITION BY b ORDER BY s DESC) AS tp",
        "neg_above + sum(neg) OVER (PARTITION BY b ORDER BY s DESC) AS fp",
    )
    return run.agg(
        F.expr("try_divide(sum(neg * (tp - pos / 2)), CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc"),
        F.expr("try_divide(sum(pos * tp / (tp + fp)), sum(pos)) AS pr_auc"),
        F.expr("sum(hits) / sum(pos + neg) AS accuracy"),
        F.expr("sum(pos + neg) AS n"),
    )


def early_stop(losses: DataFrame, ids: list[str], epoch: str, loss: str, patience: int = 5) -> DataFrame:
    """Per series: the epoch training stops at, and the best epoch and loss kept.

    Training stops once ``patience`` epochs in a row bring no new minimum.
    """
    part = f"PARTITION BY {', '.join(ids)} ORDER BY {epoch}"
    seen = losses.selectExpr(
        *ids, epoch, loss, f"min({loss}) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before"
    ).selectExpr("*", f"CASE WHEN before IS NULL OR {loss} < before THEN {epoch} END AS gain")
    waited = seen.selectExpr(
        "*", f"{epoch} - last_value(gain) IGNORE NULLS OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wait"
    )
    stops = waited.groupBy(*ids).agg(
        F.expr(f"coalesce(min(CASE WHEN wait >= {patience} THEN {epoch} END), max({epoch})) AS stopped_at")
    )
    kept = waited.join(stops, ids).filter(f"{epoch} <= stopped_at AND gain IS NOT NULL")
    return kept.groupBy(*ids).agg(
        F.expr("any_value(stopped_at) AS stopped_at"), F.expr(f"max({epoch}) AS best_epoch"), F.expr(f"min({loss}) AS best_loss")
    )
