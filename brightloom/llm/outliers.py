"""Quality rules: counts per text, and robust multivariate outliers among them per language and source.

Everything is DataFrame and SQL functions.

*Counts* stay inside the row of their text: words, symbols, repeated lines, and the words in 5-word
windows that the text has twice or more. Windows meet by hash after a sort inside the row; those that
have a partner are compared again word for word.

*Estimates.* Shrunk ratios and logarithms of the counts, as integers in steps of 1/256, are a
vector of five per document. For each language and source the minimum-covariance-determinant
estimate is the mean and covariance of those ``SHARE`` of the vectors whose covariance has the
smallest determinant. Two starts (medians with absolute deviations; mean and covariance of all) are
improved by concentration steps until nothing changes: distances to the present centre, the
nearest ``SHARE`` (whole distance classes of about 1 %), their moments. The better determinant wins,
and one reweighting by all vectors within the 97.5 % ellipsoid gives the final estimate.

A step is one grouping by unit and distance class, combined on the map side, so a source with a
third of all rows is spread like any other. Moments are sums of integers: exact and the same in any
order, so that a fixed point is one, and repeated runs agree.

The languages and sources stay in tables; nothing but a count of changed units reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.session import broadcast_if_small, cut_lineage, fresh_path

STEPS = 256
SHARE = (3, 4)
MIN_GROUP = 100
MAX_ROUNDS = 20
TAIL = 1e-5
N = 5
AXES = range(1, N + 1)
LOWER = [(i, j) for i in AXES for j in range(1, i + 1)]
#: smallest spread per axis, so that an axis on which nearly all agree still has one
FLOORS = (0.1, 0.05, 0.2, 0.05, 0.05)
VECTOR = (
    "ln(1 + n_words)",
    "ln((word_chars + 250e0) / (n_words + 50))",
    "ln(1 + 100e0 * n_symbols / (word_chars + 200))",
    "n_dup_lines / (n_lines + 5e0)",
    "n_repeat_words / (n_words + 50e0)",
)
_SPACE = r"[\\x20\\x09-\\x0D]"
_WORD = r"[^\\x20\\x09-\\x0D]"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def num(x: float) -> str:
    """A double literal that both dialects read as such."""
    return f"{x:.17e}"


def chi2_below(x: float, k: int) -> float:
    """Probability that a chi-square of odd ``k`` degrees of freedom is at most ``x``."""
    term, total = 1.0, 0.0
    for i in range(1, (k - 1) // 2 + 1):
        total += term
        term *= x / (2 * i + 1)
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * total


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_below(mid, k) < p else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """By how much the covariance of the central ``share`` of a Gaussian falls short."""
    return share / chi2_below(chi2_quantile(share, N), N + 2)


WITHIN = chi2_quantile(0.975, N)
CUT = chi2_quantile(1 - TAIL, N)


def vector_columns() -> list[str]:
    return [f"CAST(floor({STEPS} * ({v}) + 5e-1) AS BIGINT) AS x{i}" for i, v in zip(AXES, VECTOR, strict=True)]


def moment_sums() -> list[str]:
    products = [f"CAST(sum(x{i} * x{j}) AS BIGINT) AS q{i}{j}" for i, j in LOWER]
    return ["count(*) AS n", *[f"CAST(sum(x{i}) AS BIGINT) AS s{i}" for i in AXES], *products]


MOMENTS = ["n", *[f"s{i}" for i in AXES], *[f"q{i}{j}" for i, j in LOWER]]


def ellipsoid_layers(share: float) -> list[list[str]]:
    """From moments to centre ``m``, Cholesky factor ``l`` of the covariance, and ``logdet``; each layer uses the ones before."""
    c = num(consistency(share) if share < 1 else 1.0)
    layers = [[f"CAST(s{i} AS DOUBLE) / n AS m{i}" for i in AXES]]
    spread = lambda i, j: f" + {num((STEPS * FLOORS[i - 1]) ** 2)}" if i == j else ""
    layers.append([f"(CAST(q{i}{j} AS DOUBLE) / n - m{i} * m{j}) * {c}{spread(i, j)} AS a{i}{j}" for i, j in LOWER])
    for j in AXES:
        done = lambda i, j=j: "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
        layers.append([f"sqrt(a{j}{j}{done(j)}) AS l{j}{j}"])
        if j < N:
            layers.append([f"(a{i}{j}{done(i)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, N + 1)])
    layers.append(["2 * (" + " + ".join(f"ln(l{j}{j})" for j in AXES) + ") AS logdet"])
    return layers


def distance_layers() -> list[list[str]]:
    """Squared Mahalanobis distance ``d2`` of x to the ellipsoid in the same row."""
    layers = [[f"(x{j} - m{j}" + "".join(f" - l{j}{k} * y{k}" for k in range(1, j)) + f") / l{j}{j} AS y{j}"] for j in AXES]
    return [*layers, [" + ".join(f"y{j} * y{j}" for j in AXES) + " AS d2"]]


DISTANCE_CLASS = f"CAST(floor({num(64 / math.log(2))} * ln(1 + d2)) AS INT)"
ELLIPSOID = [*[f"m{i}" for i in AXES], *[f"l{i}{j}" for i, j in LOWER], "logdet"]


def _layered(df: DataFrame, layers: list[list[str]]) -> DataFrame:
    for layer in layers:
        df = df.selectExpr("*", *layer)
    return df


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) with the counts of every text; a NULL text counts as empty.

    Store it before filtering: a filter on a count would be moved below the steps that compute it,
    and each step written out once per use.
    """
    keys = ["doc_id", "lang", "source"]
    a = docs.selectExpr(*keys, "coalesce(CAST(text AS STRING), '') AS text").selectExpr(
        *keys, "length(regexp_replace(text, '[^#*$%&|<>]+', '')) AS n_symbols", f"array_remove(split(text, '{_SPACE}+'), '') AS words",
        f"filter(split(text, '\\n'), l -> l RLIKE '{_WORD}') AS lines",
    )
    counts = ["n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    b = a.selectExpr(
        *keys, "n_symbols", "size(words) AS n_words", "length(array_join(words, '')) AS word_chars", "size(lines) AS n_lines",
        "size(lines) - size(array_distinct(lines)) AS n_dup_lines", "words", "transform(words, w -> xxhash64(w)) AS h",
    )
    c = b.selectExpr(
        *keys, *counts, "words", """CASE WHEN n_words > 5 THEN transform(slice(h, 1, n_words - 4),
            (x, i) -> xxhash64(x, h[i + 1], h[i + 2], h[i + 3], h[i + 4])) ELSE array() END AS g""",
    )
    d = c.selectExpr(*keys, *counts, "words", "CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (x, i) -> struct(x, i))) END AS p")
    twin = "(i > 0 AND {0}[i - 1].x = e.x) OR (i < size({0}) - 1 AND {0}[i + 1].x = e.x)"
    e = d.selectExpr(*keys, *counts, "CASE WHEN p IS NOT NULL THEN words END AS words", f"filter(p, (e, i) -> {twin.format('p')}) AS p")
    # by place, as slice() copies the whole array
    f = e.selectExpr(*keys, *counts, "sort_array(transform(p, e -> struct(concat_ws(' ', words[e.i], words[e.i + 1], words[e.i + 2], words[e.i + 3], words[e.i + 4]) AS x, e.i AS i))) AS p")
    g = f.selectExpr(*keys, *counts, f"sort_array(transform(filter(p, (e, i) -> {twin.format('p')}), e -> e.i)) AS p")
    covered = "aggregate(transform(p, (x, i) -> CASE WHEN i = 0 THEN 5 ELSE least(5, x - p[i - 1]) END), 0, (s, x) -> s + x)"
    h = g.selectExpr(*keys, *counts, f"coalesce({covered}, 0) AS n_repeat_words")
    return h.selectExpr(*keys, *[f"CAST({n} AS BIGINT) AS {n}" for n in (*_COUNTS, "n_lines")])


def _key(*columns: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(concat('=', replace(CAST({c} AS STRING), '|', '||')), '-')" for c in columns) + ")"


def _with_units(stats: DataFrame, min_group: int) -> DataFrame:
    """Each row with ``judge``, the unit whose estimate decides, and ``units``, those that its vector counts for.

    A unit is a language and source with at least ``min_group`` rows; else the whole language; else
    all rows; below that there is none.
    """
    keyed = stats.selectExpr(
        "*", "n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed", f"{_key('lang', 'source')} AS k_source", f"{_key('lang')} AS k_lang"
    )
    sizes = keyed.filter("NOT base_failed").groupBy("k_lang", "k_source").agg(F.expr("count(*) AS n_source"))
    sizes = cut_lineage(sizes)
    langs = sizes.groupBy("k_lang").agg(F.expr("sum(n_source) AS n_lang"), F.expr(f"bool_or(n_source < {min_group}) AS any_source"))
    total = langs.agg(F.expr("coalesce(sum(n_lang), 0L) AS n_all"), F.expr(f"coalesce(bool_or(n_lang < {min_group}), false) AS any_lang")).first()
    lang_ok, all_ok = f"n_lang >= {min_group}", "true" if total.n_all >= min_group else "false"
    units = sizes.join(broadcast_if_small(langs, 50_000), "k_lang").selectExpr(
        "k_source AS u_source",
        f"""CASE WHEN n_source >= {min_group} THEN concat('s', k_source) WHEN {lang_ok} THEN concat('l', k_lang) WHEN {all_ok} THEN 'a' END AS judge""",
        f"""array_compact(array(CASE WHEN n_source >= {min_group} THEN concat('s', k_source) END,
            CASE WHEN {lang_ok} AND any_source THEN concat('l', k_lang) END,
            CASE WHEN {all_ok} AND {str(total.any_lang).lower()} THEN 'a' END)) AS units""",
    )
    small = broadcast_if_small(cut_lineage(units), 50_000)
    return keyed.join(small, F.expr("k_source = u_source AND NOT base_failed"), "left").drop("u_source", "k_source", "k_lang")


def _medians(counts: DataFrame) -> DataFrame:
    """(unit, axis, median) from (unit, axis, v, n); the values are a bounded set per unit and axis."""
    order = "OVER (PARTITION BY unit, axis ORDER BY v)"
    return counts.selectExpr("*", f"sum(n) {order} AS upto", "sum(n) OVER (PARTITION BY unit, axis) AS total").filter("2 * upto >= total").groupBy(
        "unit", "axis"
    ).agg(F.min("v").alias("median"))


def _first_ellipsoids(points: DataFrame) -> DataFrame:
    """Two starts per unit: medians with absolute deviations, and mean with covariance of all."""
    axes = points.selectExpr("unit", f"stack({N}, {', '.join(f'{i}, x{i}' for i in AXES)}) AS (axis, v)")
    counts = cut_lineage(axes.groupBy("unit", "axis", "v").agg(F.expr("count(*) AS n")))
    medians = cut_lineage(_medians(counts))
    off = counts.join(medians, ["unit", "axis"]).selectExpr("unit", "axis", "abs(v - median) AS v", "n").groupBy("unit", "axis", "v").agg(F.sum("n").alias("n"))
    spread = medians.join(_medians(off).withColumnRenamed("median", "mad"), ["unit", "axis"])
    floor = "element_at(array(" + ", ".join(num(STEPS * f) for f in FLOORS) + "), axis)"
    wide = spread.selectExpr("unit", "axis", "CAST(median AS DOUBLE) AS m", f"greatest({num(1.4826)} * mad, {floor}) AS l").groupBy("unit").agg(
        *[F.expr(f"max(CASE WHEN axis = {i} THEN {c} END) AS {c}{i}") for i in AXES for c in ("m", "l")]
    )
    diagonal = {(i, i): f"l{i}" for i in AXES}
    by_median = wide.selectExpr(
        "unit", "0 AS start", "0L AS state", *[f"m{i}" for i in AXES], *[f"{diagonal.get(at, '0e0')} AS l{at[0]}{at[1]}" for at in LOWER], "0e0 AS logdet"
    )
    by_mean = _layered(points.groupBy("unit").agg(*map(F.expr, moment_sums())), ellipsoid_layers(1.0)).selectExpr("unit", "1 AS start", "0L AS state", *ELLIPSOID)
    return cut_lineage(by_median.unionByName(by_mean))


def _measured(points: DataFrame, ellipsoids: DataFrame) -> DataFrame:
    return _layered(points.join(broadcast_if_small(ellipsoids, 50_000), "unit"), distance_layers())


def _concentrate(points: DataFrame, ellipsoids: DataFrame) -> DataFrame:
    """One concentration step for all units and starts; ``old`` is the state before it."""
    at = _measured(points, ellipsoids).selectExpr("unit", "start", "state AS old", f"{DISTANCE_CLASS} AS d", *[f"x{i}" for i in AXES])
    by_class = at.groupBy("unit", "start", "old", "d").agg(*map(F.expr, moment_sums()))
    part, whole = SHARE
    nearest = by_class.selectExpr(
        "*", "sum(n) OVER (PARTITION BY unit, start ORDER BY d) - n AS before", "sum(n) OVER (PARTITION BY unit, start) AS total"
    ).filter(f"before * {whole} < total * {part}")
    moments = nearest.groupBy("unit", "start", "old").agg(*[F.expr(f"CAST(sum({c}) AS BIGINT) AS {c}") for c in MOMENTS])
    return _layered(moments, ellipsoid_layers(part / whole)).selectExpr("unit", "start", "old", f"xxhash64({', '.join(MOMENTS)}) AS state", *ELLIPSOID)


def estimates(points: DataFrame) -> DataFrame:
    """(unit, converged, centre, factor): the reweighted estimate of every unit of ``points`` (unit, x1 to x5).

    ``converged`` tells whether the last concentration step left the unit's subset as it was.
    """
    now = _first_ellipsoids(points)
    for _ in range(MAX_ROUNDS):
        now = cut_lineage(_concentrate(points, now))
        if now.filter("old <> state").limit(1).count() == 0:
            break
    best = now.selectExpr("*", "row_number() OVER (PARTITION BY unit ORDER BY logdet, start) AS rn").filter("rn = 1").drop("rn")
    best = cut_lineage(best)
    central = _measured(points, best).filter(f"d2 <= {num(WITHIN)}").withColumn("converged", F.expr("old = state"))
    moments = central.groupBy("unit", "converged").agg(*map(F.expr, moment_sums()))
    return cut_lineage(_layered(moments, ellipsoid_layers(0.975)).selectExpr("unit", "converged", *ELLIPSOID))


def judged(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) per row of ``docs``.

    A document fails the base rules with under 10 words or with more than a fifth of its words in
    repeated windows; such rows take no part in the estimates. Of the others those go whose squared
    distance is above the chi-square quantile of 1 - ``TAIL``. A language and source with under
    ``min_group`` rows is judged by its language, a language with under ``min_group`` by all rows, and
    where all are fewer, the base rules alone decide. NULL and empty texts have zero words and fail. NULL
    languages and sources are groups of their own; repeated rows each count and each come back; a NULL
    doc_id stays NULL; an empty table gives no rows; a long text is counted whole, in its row.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "statistics")
    counted = text_statistics(docs)
    counted.write.parquet(path)
    stats = spark.read.schema(counted.schema).parquet(path)
    path = fresh_path(spark, "vectors")
    vectors = _with_units(stats, min_group).selectExpr("doc_id", *_COUNTS, "base_failed", "judge", "units", *vector_columns())
    vectors.write.parquet(path)
    rows = spark.read.schema(vectors.schema).parquet(path)
    points = rows.selectExpr("explode(units) AS unit", *[f"x{i}" for i in AXES])
    # every unit that judges has at least min_group rows, so it has an estimate
    found = estimates(points).withColumnRenamed("unit", "judge").drop("converged")
    far = _layered(rows.join(broadcast_if_small(found, 50_000), "judge", "left"), distance_layers())
    return far.selectExpr("doc_id", *_COUNTS, "base_failed", f"NOT base_failed AND coalesce(d2 <= {num(CUT)}, true) AS kept")
