from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import knn

SCHEMA = "id long, embedding array<float>, key string, rep long"


def vectors(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, 64)).astype("f4")
    for i in range(0, n, 10):  # near copies of a few, of any length
        for j in range(1, rng.integers(1, 5)):
            v[i + j] = (v[i] + rng.choice([0.1, 0.2, 0.35]) * rng.standard_normal(64)) * rng.uniform(0.1, 9)
    v[5::500] = v[5]
    return v


def frame(spark, v, extra=()):
    rows = [(2 * i + 1, x.tolist(), "x", 0) for i, x in enumerate(v)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA)


BAD = [(9001, None, "x", 0), (9003, [], "x", 0), (9005, [1.0] * 63, "x", 0), (9007, [0.0] * 64, "x", 0), (9009, [math.nan] + [1.0] * 63, "x", 0), (9011, [math.inf] + [1.0] * 63, "x", 0), (9013, [None] + [1.0] * 63, "x", 0)]


def brute(v, k=5, least=0.9):
    u = v.astype("f8") / np.linalg.norm(v.astype("f8"), axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    np.fill_diagonal(c, -2)
    top = {i: np.lexsort((np.arange(len(v)), -c[i]))[:k] for i in range(len(v))}
    pairs = {(min(i, j), max(i, j)) for i in top for j in top[i] if c[i, j] >= least}
    return {(2 * a + 1, 2 * b + 1) for a, b in pairs}, {2 * i + 1: {2 * j + 1 for j in t} for i, t in top.items()}


def test_similar_pairs_recall_and_precision(spark):
    v = vectors()
    want, _ = brute(v)
    got = {(r.id_a, r.id_b) for r in knn.similar_pairs(frame(spark, v, BAD).repartition(5)).collect()}
    assert len(got & want) >= 0.97 * len(want) > 500 and len(got - want) <= 0.01 * len(want)


def test_copies_are_one_class(spark):
    rng = np.random.default_rng(1)
    one = rng.standard_normal(64).astype("f4")
    v = np.concatenate((rng.standard_normal((40, 64)).astype("f4"), np.repeat(one[None], 20, axis=0)))
    got = {(r.id_a, r.id_b) for r in knn.similar_pairs(frame(spark, v)).collect()}
    want, _ = brute(v)
    assert got == want and len(got) == 15 + 5 * 14 + 0  # every copy with the first five others


def test_cells_split_further_in_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 48)
    monkeypatch.setattr(knn, "SAMPLE", 160)  # upper trees of 4 levels; two more are fitted in the tasks
    fitted = []
    lower = knn.lower_trees
    monkeypatch.setattr(knn, "lower_trees", lambda *a: fitted.append(a[2:4]) or lower(*a))
    v = vectors()
    want, _ = brute(v)
    got = {(r.id_a, r.id_b) for r in knn.similar_pairs(frame(spark, v, BAD).repartition(5)).collect()}
    assert fitted == [(4, 2)] and len(got & want) >= 0.95 * len(want) > 500 and len(got - want) <= 0.01 * len(want)


def test_a_third_in_one_dense_cluster(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 32)  # as many leaves in the cluster as LEAF gives one of 24,000
    rng = np.random.default_rng(4)
    v = rng.standard_normal((6000, 64)).astype("f4")
    v[::3] = v[0] + 0.03 * rng.standard_normal((2000, 64))
    want, _ = brute(v)
    got = {(r.id_a, r.id_b) for r in knn.similar_pairs(frame(spark, v).repartition(4)).collect()}
    assert len(want) > 5000 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_copies_of_any_length_rank_by_id(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((3000, 64)).astype("f4")
    v[::3] = v[0] * rng.uniform(0.1, 9, (1000, 1)).astype("f4")
    want, _ = brute(v)
    got = {(r.id_a, r.id_b) for r in knn.similar_pairs(frame(spark, v).repartition(4)).collect()}
    assert got == want and len(want) == 15 + 5 * 994


def test_nearest_of_stated_queries(spark):
    v = vectors(2000, 3)
    _, top = brute(v)
    got = knn.nearest(frame(spark, v, BAD).repartition(4), F.col("id") % 50 == 1).collect()
    by: dict[int, set] = {}
    for r in got:
        by.setdefault(r.id, set()).add(r.neighbour_id)
    assert set(by) == {i for i in top if i % 50 == 1} and sum(len(by[i] & top[i]) for i in by) >= 0.95 * 5 * len(by)


def test_empty_and_single(spark):
    none = frame(spark, vectors(10)[:1]).where("false")
    assert knn.similar_pairs(none).count() == 0 and knn.nearest(none, F.col("id") > 0).count() == 0
    assert knn.similar_pairs(frame(spark, vectors(10)[:1])).count() == 0
    assert knn.similar_pairs(frame(spark, vectors(10)[:1], BAD)).count() == 0


def test_chi_square_quantiles():
    for p, dims, want in [(0.95, 16, 26.296), (0.98, 16, 29.633), (0.5, 8, 7.344), (0.9, 4, 7.779)]:
        assert abs(knn.chi_square(p, dims) - want) < 0.05
