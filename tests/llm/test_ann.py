import numpy as np

from brightloom.llm import ann


def plain(rows, every, k):
    v = {i: np.array(x, dtype=np.float32).astype(np.float64) for i, x in rows}
    out = {}
    for q in v:
        if q % every == 0:
            near = sorted((-float((v[q] * x).sum() / (np.sqrt((v[q] * v[q]).sum()) * np.sqrt((x * x).sum()))), i) for i, x in v.items() if i != q)
            out[q] = [i for _, i in near[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "l", 1) for i, x in rows], "vec_id long, embedding array<float>, label string, leaf int")


def test_recall_scores_and_order(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((30, 16))
    rows = [(i, (centers[i % 30] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(3000)]
    got = {}
    for r in ann.nearest(frame(spark, rows), every=50, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = plain(rows, 50, 5)
    assert set(got) == set(want)
    hits = sum(len({i for _, i, _ in got[q]} & set(want[q])) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for near in got.values():
        near.sort()
        assert [n for n, *_ in near] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)


def test_copies_ties_and_unusable_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 300)] + [(300, [3.0, 2.0, 1.0])]
    bad = [(400, None), (450, [0.0, 0.0, 0.0]), (500, [1.0, None, 2.0]), (550, [float("nan"), 1.0, 1.0]), (600, [float("inf"), 1.0, 1.0]), (650, [1.0, 2.0]), (None, same), (0, same)]
    got = {}
    for r in ann.nearest(frame(spark, rows + bad), every=50, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == {0, 50, 100, 150, 200, 250, 300}
    assert sorted(got[0]) == list(enumerate([1, 2, 3, 4, 5], 1)) and sorted(got[100]) == list(enumerate([0, 1, 2, 3, 4], 1))


def test_few_or_no_rows(spark):
    assert ann.nearest(frame(spark, [])).count() == 0
    assert ann.nearest(frame(spark, [(0, [1.0, 0.0])])).count() == 0
    few = ann.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])])).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(0, 1, 1), (0, 2, 2)]


def test_blocks_and_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ann, "QUERY_ROWS", 2)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(120)]
    index = ann.Index(frame(spark, rows), 5)
    queries = frame(spark, [r for r in rows if r[0] % 3 == 0]).withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in index.search(queries, visits=10_000).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == plain(rows, 3, 5)
