import random
import re

import numpy as np

from brightloom.llm import graph, ngram_join
from tests.llm.helpers import EDGE, documents, prose


def brute(texts, width, percent):
    sets, parent = {}, {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(n, seed=3):
    r, out = random.Random(seed), []
    for i in range(n):
        words = prose(i % 4, 60 + 20 * (i % 4)).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            words[r.randrange(len(words))] = f"new{r.randrange(1000)}"
        out.append((i, " ".join(words).upper() if r.random() < 0.2 else "  ".join(words)))
    return out


def test_same_as_brute_force(spark):
    texts = near_copies(70) + [e for e in EDGE if e[0] is not None] + [(200, "one"), (201, "a b"), (202, "A  b"), (203, "b a")]
    for width, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents(spark, texts), width, percent).collect()}
        assert got == brute(texts, width, percent)


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "z")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents(spark, rows)).collect())
    assert got == [(0, 1, None), (0, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert sorted(r.doc_id or 0 for r in ngram_join.keep_one(documents(spark, rows)).collect()) == [0, 0, 1, 1]


def test_large_group_of_copies_and_a_very_long_text(spark):
    texts = [(i, prose(1, 80)) for i in range(1, 400)] + [(1000, prose(2, 30_000)), (1001, prose(2, 30_000) + " tail")]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(documents(spark, texts), 3, 90).collect()}
    assert {got[i] for i in range(1, 400)} == {1} and got[1001] == 1000


def test_empty_table(spark):
    assert ngram_join.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30, 60)] + [(5, k) for k in range(100, 120)] + [(8, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(30, 61)} == {30} and {got[i] for i in (5, *range(100, 120))} == {5} and got[8] == 7


def test_an_ngram_that_no_class_has_in_front_is_no_posting(spark):
    """Sets of 100 with at least 95 in common share one of their first 6; a larger set may have it later."""
    at = {1: {5: 70, 6: 80}, 2: {10: 70, 6: 80}}  # 70 in front in one set, 80 in none
    rows = [(i, 100, 0, 0, 0, 0, [g.get(k, 1000 * i + k) for k in range(11)], None) for i, g in at.items()]
    postings = ngram_join.shared_postings(spark.createDataFrame(rows, ngram_join._PREFIX), 90)
    assert sorted((r.g, r.cls, r.pos) for r in postings.collect() if r.g < 1000) == [(70, 1, 5), (70, 2, 10)]


def test_wide_parities_never_differ_more_than_the_sets():
    r = np.random.default_rng(5)
    for n in (1, 3, 40, 900):
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        for changed in (0, 1, n // 3, n):
            b = np.unique(np.concatenate([a[changed:], r.integers(0, 1 << 62, changed + n // 5).astype(np.uint64)]))
            x, y = ngram_join.wide_parities(a), ngram_join.wide_parities(b)
            assert ngram_join.parities_differ(x, y) == ngram_join.parities_differ(y, x) <= len(np.setxor1d(a, b))
    far = [ngram_join.wide_parities(np.unique(r.integers(0, 1 << 62, 900).astype(np.uint64))) for _ in range(2)]
    assert ngram_join.parities_differ(*far) > 900
