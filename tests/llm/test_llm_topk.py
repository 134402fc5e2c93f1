"""Top-k search against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from areametrics.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string, block int, rank int"


def brute(rows, queries, k=10, scale=1024):
    vectors = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors[i] = min(v, vectors.get(i, v))
    whole = {i: [math.floor(scale * x) for x in v] for i, v in vectors.items()}
    out = set()
    for q in whole:
        if not queries(q):
            continue
        scored = sorted(
            (-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v)))), i)
            for i, v in whole.items() if i != q and len(v) == len(whole[q])
        )
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 7, "x", 2, 3) for i, v in rows], SCHEMA)
    found = topk.search(df, df.where("vec_id % 100 = 0"), **options)
    return {tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()}


def awkward():
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 900)]  # a large group of copies, a query among them
    rows += [(1000, None), (1001, []), (1100, [1.0, None]), (1200, [math.nan] * 16), (1300, [math.inf] * 16)]
    rows += [(None, rows[1][1]), (1400, [0.0] * 16), (1500, [1.0]), (1501, [-2.0]), (1600, [3.0] * 5)]
    return rows + [(300, rng.standard_normal(16).tolist()), (-100, rows[7][1])]


def test_search(spark):
    rows = awkward()
    assert run(spark, rows) == brute(rows, lambda q: q % 100 == 0)


def test_many_units(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_BLOCKS", 1)
    monkeypatch.setattr(topk, "GROUP", 3)
    rows = awkward()
    assert run(spark, rows, k=3) == brute(rows, lambda q: q % 100 == 0, 3)


def test_sums_beyond_doubles(spark):
    rng = np.random.default_rng(6)
    rows = [(i * 50, (rng.standard_normal(8) * 10.0 ** (i % 12)).tolist()) for i in range(60)]
    assert run(spark, rows) == brute(rows, lambda q: q % 100 == 0)


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [(100, [1.0])]) == set()


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_blocks_are_skipped(spread):
    """Clustered vectors: few blocks are scored, and the result is that of all."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 16)) * 1000
    forward = [np.floor(c + spread * 100 * rng.standard_normal((50, 16))) for c in centres]
    ids = [np.arange(50) + 50 * b for b in range(40)]
    low, high = (np.array([f(m, axis=0) for m in forward]) for f in (np.min, np.max))
    queries, own, scored = forward[3][:5], ids[3][:5], []
    real = topk.products

    def counted(a, b):
        scored.append(len(a))
        return real(a, b)

    topk.products = counted
    try:
        scores, found = topk.best(queries, own, np.full(5, -np.inf), low, high, ids, forward, 10)
    finally:
        topk.products = real
    every = np.concatenate(forward) @ queries.T
    for q in range(5):
        want = sorted((-s, i) for i, s in enumerate(every[:, q]) if i != own[q])[:10]
        assert list(zip(scores[q], found[q])) == [(-s, i) for s, i in want]
    assert sum(scored) < 5 * 40 * (0.2 if spread < 1 else 1)
