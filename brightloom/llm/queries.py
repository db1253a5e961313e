"""Registered queries of the training-data operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightloom.llm import ann, centroids, decontam, ngram_join, outliers, packing, passages, pii, quality, repair, spelling, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_hilbert_packing")
def op6(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), vocabulary())


@query("op7_repair_shards")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return repair.token_shards(table(spark, d, "documents"), vocabulary())


@query(
    "op9_warc",
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
    ), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first_id FROM p)
    SELECT page_id, payload_bytes, sha256(h) AS payload_digest,
      CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first_id <> page_id THEN first_id END AS refers_to
    FROM f
    """,
)
def op9(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"))


@query("op3_pu_quality")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return quality.score_quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op4_segment_toxicity")
def op4(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op5_pattern_pii")
def op5(spark: SparkSession, d: str) -> DataFrame:
    return pii.report(table(spark, d, "documents"))


@query("op8_repeated_passages")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return passages.repeated_units(table(spark, d, "documents"))


@query("op10_template_leaks")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return decontam.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op2_ngram_join")
def op2(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, d, "documents"), width=3, percent=90)


@query("op1_kmeans_tree")
def op1(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest(table(spark, d, "embeddings"))


def _centroid_rounds(k: int = 8, rounds: int = 10) -> str:
    """The rounds of ``op13`` one after the other, as plain distances over all components."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM (
      SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v ORDER BY h LIMIT {k}) z)"""
    ]
    for r in range(rounds + 1):
        # distance and number in one integer, so that its minimum also settles ties
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(v.e) AS e, min({k} * CAST(list_sum(list_transform(list_zip(v.e, c.e),
      lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) + c.c) AS m FROM v, c{r} c GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM (
      SELECT m % {k} AS c, i, sum(x) AS s, count(*) AS n FROM (
        SELECT m, unnest(e) AS x, unnest(range(64)) AS i FROM a{r}) u GROUP BY 1, 2) g GROUP BY c),
    c{r + 1} AS MATERIALIZED (SELECT c.c, CAST(coalesce(m.e, c.e) AS BIGINT[]) AS e FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)""")
    body = ",\n    ".join(steps)
    return f"""WITH {body}
    SELECT vec_id, CAST(m % {k} AS INT) AS cluster, m // {k} AS distance, CAST(sum(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia,
      CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} c ON c.c = m % {k}"""


@query("op13_walsh_centroids", _centroid_rounds())
def op13(spark: SparkSession, d: str) -> DataFrame:
    return centroids.cluster(table(spark, d, "embeddings"))


@query(
    "op12_spelling_tiles",
    r"""
    WITH RECURSIVE bits AS MATERIALIZED (
      SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], CAST(range(8) AS BIGINT[])),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
    ), runs AS MATERIALIZED (
      SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) x GROUP BY 1, 2
    ), hexed AS MATERIALIZED (
      SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6
    ), hashed AS MATERIALIZED (
      SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2),
        lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
        lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) + 1 AS INT)]))) AS h
      FROM hexed, bits
    ), words AS MATERIALIZED (
      SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) g
      WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
    ), holes AS MATERIALIZED (
      SELECT word, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, unnest(range(length(word))) AS i FROM words) u
    ), near AS MATERIALIZED (
      SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
      UNION SELECT h.word, w.word FROM holes h JOIN words w ON w.word = h.head || h.tail
      UNION SELECT w.word, h.word FROM holes h JOIN words w ON w.word = h.head || h.tail
    ), ranked AS (
      SELECT near.word, other, o.n AS other_n, w.n, count(*) OVER (PARTITION BY near.word) AS n_near,
        row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS rn
      FROM near JOIN words w ON w.word = near.word JOIN words o ON o.word = other
    ), forms AS MATERIALIZED (
      SELECT word, n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
      FROM ranked WHERE rn = 1
    ), chain AS (
      SELECT word, form AS goal, 1 AS d FROM forms WHERE form IS NOT NULL
      UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN forms f ON f.word = c.goal WHERE f.form IS NOT NULL
    ), roots AS (SELECT word, arg_max(goal, d) AS root FROM chain GROUP BY word)
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, form, form_n, coalesce(root, w.word) AS root
    FROM words w LEFT JOIN forms f ON f.word = w.word LEFT JOIN roots r ON r.word = w.word
    """,
)
def op12(spark: SparkSession, d: str) -> DataFrame:
    return spelling.group_spellings(table(spark, d, "documents"))


def _layers_sql(source: str, layers: list[list[str]]) -> str:
    for layer in layers:
        source = f"(SELECT *, {', '.join(layer)} FROM {source} t)"
    return source


def _outlier_sql() -> str:
    o = outliers
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    x, y = ", ".join(f"x{i}" for i in o.AXES), ", ".join(o.ELLIPSOID)
    floors = "[" + ", ".join(o.num(o.STEPS * f) for f in o.FLOORS) + "]"
    part, whole = o.SHARE
    ctes = [
        f"""texts AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{word}')) AS lines FROM documents)""",
        """grams AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (
      SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts) u)""",
        """repeats AS MATERIALIZED (SELECT doc_id, count(DISTINCT k) AS n FROM (
      SELECT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) c WHERE c > 1) z GROUP BY 1)""",
        f"""stats AS MATERIALIZED (SELECT t.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
      coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines FROM texts t LEFT JOIN repeats r ON r.doc_id = t.doc_id)""",
        f"""vectors AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {', '.join(o.vector_columns())} FROM stats)""",
        "fit AS (SELECT * FROM vectors WHERE NOT base_failed)",
        "by_source AS (SELECT lang, source, count(*) AS n FROM fit GROUP BY 1, 2)",
        f"by_lang AS (SELECT lang, sum(n) AS n, bool_or(n < {o.MIN_GROUP}) AS any_source FROM by_source GROUP BY 1)",
        f"by_all AS (SELECT sum(n) AS n, bool_or(n < {o.MIN_GROUP}) AS any_lang FROM by_lang)",
        f"""judges AS MATERIALIZED (SELECT s.lang, s.source, s.n >= {o.MIN_GROUP} AS own, l.n >= {o.MIN_GROUP} AND any_source AS of_lang, a.n >= {o.MIN_GROUP} AND any_lang AS of_all,
      CASE WHEN s.n >= {o.MIN_GROUP} THEN 's' || s.lang || '/' || s.source WHEN l.n >= {o.MIN_GROUP} THEN 'l' || s.lang WHEN a.n >= {o.MIN_GROUP} THEN 'a' END AS judge
      FROM by_source s JOIN by_lang l ON l.lang = s.lang, by_all a)""",
        f"""points AS MATERIALIZED (SELECT 's' || f.lang || '/' || f.source AS unit, {x} FROM fit f JOIN judges j ON j.lang = f.lang AND j.source = f.source WHERE own
      UNION ALL SELECT 'l' || f.lang, {x} FROM fit f JOIN judges j ON j.lang = f.lang AND j.source = f.source WHERE of_lang
      UNION ALL SELECT 'a', {x} FROM fit f JOIN judges j ON j.lang = f.lang AND j.source = f.source WHERE of_all)""",
        "axes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT unit, {i} AS axis, x{i} AS v FROM points" for i in o.AXES) + ")",
        "mid AS MATERIALIZED (SELECT unit, axis, quantile_disc(v, 0.5) AS m FROM axes GROUP BY 1, 2)",
        f"""dev AS MATERIALIZED (SELECT a.unit, a.axis, any_value(CAST(m AS DOUBLE)) AS m, greatest({o.num(1.4826)} * quantile_disc(abs(v - m), 0.5), any_value({floors}[a.axis])) AS l
      FROM axes a JOIN mid ON mid.unit = a.unit AND mid.axis = a.axis GROUP BY 1, 2)""",
    ]
    medians = ", ".join(f"max(CASE WHEN axis = {i} THEN m END) AS m{i}" for i in o.AXES)
    factor = ", ".join(f"max(CASE WHEN axis = {i} THEN l END) AS l{i}{j}" if i == j else f"CAST(0 AS DOUBLE) AS l{i}{j}" for i, j in o.LOWER)
    moments = ", ".join(o.moment_sums())
    everything = _layers_sql(f"(SELECT unit, {moments} FROM points GROUP BY unit)", o.ellipsoid_layers(1.0))
    ctes.append(f"""e0 AS MATERIALIZED (SELECT unit, 0 AS start, {medians}, {factor}, CAST(0 AS DOUBLE) AS logdet FROM dev GROUP BY unit
      UNION ALL SELECT unit, 1, {y} FROM {everything} z)""")
    for r in range(o.MAX_ROUNDS):
        at = _layers_sql(f"(SELECT e.*, {x} FROM points p JOIN e{r} e ON e.unit = p.unit)", o.distance_layers())
        ctes.append(f"d{r} AS MATERIALIZED (SELECT unit, start, {o.DISTANCE_CLASS} AS d, {x} FROM {at} z)")
        picked = f"""(SELECT unit, start, d FROM (SELECT *, sum(c) OVER (PARTITION BY unit, start ORDER BY d) - c AS before, sum(c) OVER (PARTITION BY unit, start) AS total
          FROM (SELECT unit, start, d, count(*) AS c FROM d{r} GROUP BY 1, 2, 3) g) h WHERE before * {whole} < total * {part})"""
        near = f"(SELECT z.unit, z.start, {moments} FROM d{r} z JOIN {picked} k ON k.unit = z.unit AND k.start = z.start AND k.d = z.d GROUP BY 1, 2)"
        ctes.append(f"e{r + 1} AS MATERIALIZED (SELECT unit, start, {y} FROM {_layers_sql(near, o.ellipsoid_layers(part / whole))} z)")
    ctes.append(f"best AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY logdet, start) AS rn FROM e{o.MAX_ROUNDS}) z WHERE rn = 1)")
    central = _layers_sql(f"(SELECT e.*, {x} FROM points p JOIN best e ON e.unit = p.unit)", o.distance_layers())
    kept = f"(SELECT unit, {moments} FROM (SELECT unit, {x} FROM {central} z WHERE d2 <= {o.num(o.WITHIN)}) w GROUP BY unit)"
    ctes.append(f"final AS MATERIALIZED (SELECT unit, {y} FROM {_layers_sql(kept, o.ellipsoid_layers(0.975))} z)")
    body = ",\n    ".join(ctes)
    verdict = _layers_sql(
        """(SELECT v.*, f.* EXCLUDE (unit) FROM vectors v LEFT JOIN judges j ON j.lang = v.lang AND j.source = v.source LEFT JOIN final f ON f.unit = j.judge)""",
        o.distance_layers(),
    )
    return f"""WITH {body}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {o.num(o.CUT)}, TRUE) AS kept FROM {verdict} z"""


@query("op11_mcd_outliers", _outlier_sql())
def op11(spark: SparkSession, d: str) -> DataFrame:
    return outliers.judged(table(spark, d, "documents"))
