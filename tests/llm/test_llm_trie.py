"""The trie of conversations against plain Python."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq

from areametrics.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, p1 string, seg int, h1 int, n int"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, ends, children = {}, {}, {}
    for c, ts in sorted(convs.items()):
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
            if d:
                children.setdefault(tuple(ts[: d - 1]), set()).add(tuple(ts[:d]))
        ends.setdefault(tuple(ts), []).append(c)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, ())
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in below)
        leaves[p] = sum(leaves[q] for q in below) if below else 1
    return sorted(
        (
            min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(children.get(p, ())), leaves[p],
            saved[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest(),
        )
        for p, ms in members.items()
    )


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA).repartition(parts)
    found = trie.rebuilt_trie(df).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
    return sorted(tuple(r) for r in found.collect())


def awkward():
    rng = np.random.default_rng(11)
    rows = [(c, t, "user", f"w{rng.integers(2)}") for c in range(60) for t in range(rng.integers(1, 9))]
    rows += [(c, t, "u", f"same {t}") for c in range(100, 260) for t in range(7)]  # copies
    # Long ones that part late, at the ends of segments among others.
    for c, stop in ((300, 200), (301, 64), (302, 128), (303, 63), (304, 65), (305, 200), (306, 150), (307, 64)):
        rows += [(c, t, "u", f"t{t}" if t < 140 else f"t{t}{c}") for t in range(stop)]
    rows += [(401, 0, "u", "no base"), (502, None, None, None), (502, None, "u", None), (502, 1, None, "é🙂")]
    rows += [(-7, 0, "u", "x"), (-7, 0, "u", "x"), (-7, 0, "a", "x"), (-250, 3, "u", ""), (None, 0, "u", "lost")]
    return rows + [(600, 0, "user", "long " * 30_000), (601, 0, "user", "long " * 30_000)]


def test_trie(spark):
    rows = awkward()
    assert run(spark, rows) == brute(rows)


def test_small_blocks(spark):
    """Blocks of a few rows each, so that nearly every node is merged across boundaries."""
    rows = awkward()[:700]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set(name, before)


def test_given_table(spark):
    rows = pq.read_table("/root/testdata/sf0.01/conversations.parquet").select(
        ["conv_id", "turn", "role", "text"]
    ).to_pylist()
    rows = [tuple(r.values()) for r in rows]
    assert run(spark, rows) == brute(rows)


def test_few(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 0, "u", "only")]) == brute([(1, 0, "u", "only")])


def test_union_find_contracts():
    """Rows ab, abc, abd, x: nodes at ab (two below it), the ends, and the root."""
    length, lcp = np.array([2, 3, 3, 1]), np.array([2, 2, 0])
    depth, lo, hi, least, over = trie.joined(length, lcp, np.array([9, 4, 5, 1]))
    found = sorted(zip(depth.tolist(), lo.tolist(), hi.tolist(), least.tolist(), over.tolist()))
    assert found == [(0, 0, 3, 1, -1), (1, 3, 3, 1, 0), (2, 0, 2, 4, 0), (3, 1, 1, 4, 2), (3, 2, 2, 5, 2)]
