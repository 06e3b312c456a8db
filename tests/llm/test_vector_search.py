import math
import random

import numpy as np

from tablewarden.llm import vector_search


def brute(rows, every, k=5):
    used = []
    for at, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((i, at, [math.floor(256 * x) for x in v]))
    out = []
    for i, at, q in used:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x)), j, other) for j, other, x in used if other != at)[:k]
            out += [(i, r, j, -s) for r, (s, j, _) in enumerate(found, start=1)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vector_search, "QUERY_ROWS", 7)
    r = random.Random(1)
    common = [r.uniform(-1, 1) for _ in range(20)]
    rows = [(i, common if i % 3 == 0 else [r.gauss(0, 0.4) for _ in range(20)]) for i in range(300)]
    rows += [(400, None), (401, [None] * 20), (402, [math.nan] + [0.0] * 19), (405, [math.inf] * 20), (None, common), (10, common), (10, common)]
    rows += [(410, [1.0, 2.0]), (411, []), (415, [0.0] * 20), (-5, common[::-1])]
    frame = spark.createDataFrame([(i, v, "l", 1.0) for i, v in rows], "vec_id long, embedding array<double>, block string, score double").repartition(3)
    assert sorted(map(tuple, vector_search.top_k(frame, every=5).collect())) == brute(rows, 5)


def test_large_values_and_few_rows(spark):
    rows = [(0, [1e6, 3.0]), (1, [1e6, -2.0]), (2, [-1e6, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vector_search.top_k(frame).collect())) == brute(rows, 50)
    assert vector_search.top_k(frame.limit(0)).count() == 0 and vector_search.top_k(frame.where("vec_id = 1")).count() == 0


def test_bounds_hold_and_rule_out():
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 64)) * 200
    x = np.floor(centres[r.integers(0, 6, 4000)] + r.normal(size=(4000, 64)) * 30)
    q = x[:20]
    exact = q @ x.T
    for n in vector_search.RESOLUTIONS:
        bound = vector_search.statistics(q, n) @ vector_search.statistics(x, n).T
        assert (bound >= exact - 1e-3).all()
    best = vector_search.Best(20, 5)
    taken = [vector_search.search_block(best, q, np.arange(20), x[i : i + 500], np.arange(i, i + 500), np.arange(i, i + 500)) for i in range(0, 4000, 500)]
    assert sum(taken[1:]) < 0.4 * 20 * 3500
