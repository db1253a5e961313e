import hashlib
import math

import numpy as np
import pytest

from brightloom.llm import centroids


def plain(rows, size, k, rounds, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    by_hash = sorted(kept, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())
    cents = [list(v) for _, v in by_hash[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        owner = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), o in zip(kept, owner, strict=True) if o == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    total = {j: sum(d for _, o, d in out if o == j) for j in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((i, o, d, total[o], sum(total.values()), digest[o]) for i, o, d in out)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(
        [(i, v, "x", 5, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, _c int, distance int"
    )


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_transform_keeps_distances_and_comes_back():
    rng = np.random.default_rng(0)
    x = rng.integers(-5000, 5000, (40, 64))
    t = centroids.coefficients(x)
    assert (centroids.components(t) == x).all()
    d, e = x[0] - x[1], t[0] - t[1]
    assert (e * e).sum() == 64 * (d * d).sum()
    # the coarsest coefficient is the sum, the finest alternates in sign
    assert (t[:, 0] == x.sum(axis=1)).all() and (t[:, 63] == (x * np.tile([1, -1], 32)).sum(axis=1)).all()


@pytest.mark.parametrize("far", [0, 1 << 40])
def test_search_is_exact_and_skips_work(far):
    rng = np.random.default_rng(1)
    c = rng.integers(-300, 300, (8, 64)) + far
    x = c[rng.integers(0, 8, 9000)] + rng.integers(-40, 40, (9000, 64))
    x[:50], c[5] = c[2], c[2]  # two equal centroids: the smaller number wins
    owner, best, taken = centroids.nearest_centroids(centroids.coefficients(x), centroids.coefficients(c))
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (owner == d.argmin(axis=1)).all() and (best.astype(np.int64) == d.min(axis=1)).all()
    assert taken < 0.5 * 9000 * 8 * 64


def test_ties_of_centroids_at_the_same_distance():
    c = np.array([[4, 0, 0, 0], [0, 4, 0, 0], [-4, 0, 0, 0]])
    owner, best, _ = centroids.nearest_centroids(centroids.coefficients(np.array([[0, 0, 0, 0], [0, 0, 9, 9], [0, 1, 0, 0]])), centroids.coefficients(c))
    assert owner.tolist() == [0, 0, 1] and best.tolist() == [16, 178, 9]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_same_as_plain_rounds(spark, kind):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) + 3 * (i % 5)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300, rows[7][1]), (301, [-0.0005] * 8)]
    assert got(centroids.cluster(frame(spark, rows, kind), size=8)) == plain(rows, 8, 8, 10)


def test_unusable_vectors_repeated_rows_and_few_rows(spark):
    v = [float(i) for i in range(8)]
    bad = [(90, None), (91, []), (92, v[:7]), (93, [*v, 1.0]), (94, [*v[:7], None]), (95, [*v[:7], float("nan")]), (96, [*v[:7], float("-inf")])]
    rows = [(1, v), (2, v[::-1]), (1, v)]
    out = got(centroids.cluster(frame(spark, rows + bad), size=8, rounds=3))
    assert [(r[0], r[2], r[4]) for r in out] == [(1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert centroids.cluster(frame(spark, bad), size=8).count() == 0
    empty = centroids.cluster(frame(spark, []), size=8)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    # a row without a key takes part
    assert centroids.cluster(frame(spark, [(None, v), (3, v)]), size=8).count() == 2


def test_a_copied_vector_holds_a_third_of_the_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0] * 16 if i % 3 == 0 else rng.standard_normal(16).astype(np.float32).tolist()) for i in range(600)]
    assert got(centroids.cluster(frame(spark, rows), size=16, k=4, rounds=4)) == plain(rows, 16, 4, 4)


def test_components_too_large_for_exact_distances(spark):
    with pytest.raises(Exception, match="too large for exact distances"):
        centroids.cluster(frame(spark, [(1, [1e30] * 8)], "double"), size=8)
