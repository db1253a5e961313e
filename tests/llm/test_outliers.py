import random
import re
from collections import Counter

import numpy as np
import pytest

from brightloom.llm import outliers
from brightloom.session import cut_lineage
from tests.llm.helpers import EDGE, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    held = {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held)


def base_failed(c):
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


def test_chi_square():
    assert abs(outliers.chi2_quantile(0.975, 5) - 12.8325) < 1e-4 and abs(outliers.chi2_quantile(0.95, 7) - 14.0671) < 1e-4
    assert outliers.consistency(0.75) > 1.3


def test_counts_of_texts(spark):
    r = random.Random(4)
    texts = list(EDGE)
    for i in range(60):
        words = r.choices("a bb c d é # $$ 漢\x1cx | zz".split(" "), k=r.randint(0, 60))
        texts.append((i, "".join(w + r.choice([" ", "\n", "\t", "\r\n", "\x0b", "  "]) for w in words)))
    texts += [(200, "a a a a a a"), (201, "p q r s t\np q r s t\nu"), (202, "x " * 30_000), (203, prose(1, 20_000)), (204, "\n\n \nq\nq\n q\n")]
    got = outliers.judged(documents(spark, texts))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = [tuple(r) for r in got.collect()]
    want = [(i, *counts(t), base_failed(counts(t))) for i, t in texts]
    assert sorted(map(str, (r[:7] for r in rows))) == sorted(map(str, want))


def plain_estimate(x):
    """Sorted concentration steps from the medians, on vectors in steps of 1/256."""
    floor = (np.array(outliers.FLOORS) * outliers.STEPS) ** 2
    h = -(-len(x) * 3 // 4)
    mid = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(abs(x - mid), axis=0), np.sqrt(floor))
    d = (((x - mid) / spread) ** 2).sum(axis=1)

    def fit(rows, share):
        m = rows.mean(axis=0)
        return m, np.cov(rows.T, bias=True) * outliers.consistency(share) + np.diag(floor)

    def far(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    for _ in range(50):
        d = far(*fit(x[np.argsort(d, kind="stable")[:h]], 0.75))
    m, c = fit(x[d <= outliers.WITHIN], 0.975)
    return m, far(m, c)


def test_estimate_resists_a_fifth_of_outliers(spark):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((5, 5))
    x = rng.standard_normal((800, 5)) @ a * 200 + 1000
    x[:160] = x[:160] * 0.1 + 5000  # a tight crowd elsewhere
    x = np.round(x).astype(int)
    points = spark.createDataFrame([("u", *map(int, v)) for v in x], "unit string, x1 long, x2 long, x3 long, x4 long, x5 long")
    e = outliers.estimates(points).collect()
    assert len(e) == 1 and e[0].converged
    m, d = plain_estimate(x.astype(float))
    got = np.array([e[0][f"m{i}"] for i in range(1, 6)])
    low = np.zeros((5, 5))
    for i, j in outliers.LOWER:
        low[i - 1, j - 1] = e[0][f"l{i}{j}"]
    mine = (np.linalg.solve(low, (x - got).T) ** 2).sum(axis=0)
    # the subset is taken in whole distance classes, so both agree up to about a class
    assert abs(got - m).max() < 15 and np.corrcoef(np.log(mine), np.log(d))[0, 1] > 0.999
    assert (mine[:160] > outliers.CUT).all() and (mine[160:] <= outliers.CUT).mean() > 0.995


def corpus(n, bad_every, seed=0, words=150):
    r = random.Random(seed)
    texts = []
    for i in range(n):
        t = prose(seed * 10_000 + i, r.randint(40, words))
        if i % bad_every == 0:
            t = " ".join(w + r.choice(["###", "$$$", "|"]) for w in t.split())
        texts.append((i, t))
    return texts


def test_symbol_texts_go_and_clean_ones_stay(spark):
    texts = corpus(400, 8)
    out = {r.doc_id: r for r in outliers.judged(documents(spark, texts)).collect()}
    assert not any(out[i].kept for i in range(0, 400, 8))
    assert all(out[i].kept for i in range(400) if i % 8)


def test_units_fall_back_and_nulls_are_groups(spark):
    texts = corpus(330, 10, seed=2)
    place = lambda i: (None if i < 150 else "de", f"s{i}" if i < 150 else None)
    rows = [(i, t, *place(i)) for i, t in texts] + [(1000, texts[1][1], "fr", "one"), (1000, texts[1][1], "fr", "one"), (None, "# " * 100, "fr", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = outliers._with_units(cut_lineage(outliers.text_statistics(df)), 100).collect()
    judge = {r.doc_id: r.judge for r in stats if not r.base_failed}
    assert judge[1] == "l-" and judge[151].startswith("s=de|-") and judge[1000] == "a"
    out = outliers.judged(df).collect()
    assert len(out) == len(rows) and not any(r.kept for r in out if r.doc_id is not None and r.doc_id % 10 == 0 and r.doc_id < 1000)
    assert [r.kept for r in out if r.doc_id == 1000] == [True, True]


@pytest.mark.parametrize("n", [0, 3])
def test_too_few_rows_for_an_estimate(spark, n):
    texts = [(i, prose(i, 30) + " ###" * 20) for i in range(n)]
    assert [r.kept for r in outliers.judged(documents(spark, texts)).collect()] == [not base_failed(counts(t)) for _, t in texts]


def test_no_python_in_the_plan(spark):
    df = outliers.judged(documents(spark, corpus(120, 7)))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
