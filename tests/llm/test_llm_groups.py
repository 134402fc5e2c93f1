"""Near-duplicates of texts and vectors, and components, against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from areametrics.llm import blocks, lattice, minhash
from areametrics.llm.graph import components
from areametrics.operators import joins
from llm_cases import SCHEMA, awkward, documents, sample, texts_by_id


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def linked(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    parts = Sets(sets)
    keys = [k for k in sets if sets[k] and k is not None]
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parts.join(a, b)
    return {k: (len(sets[k]), k if k is None else parts.find(k)) for k in sets}


def variants():
    """Chains of copies that drift apart, so that groups hold unlike texts."""
    rng = np.random.default_rng(8)
    rows, doc_id = [], 0
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(120)]
        for _ in range(25):
            rows.append((doc_id, " ".join(words), "en", "s", 1))
            doc_id += 1
            words = list(words)
            for p in rng.integers(0, len(words), 1 + family % 3):
                words[p] = f"new{doc_id}_{p}"
    return rows


@pytest.mark.parametrize("rows", [sample(150) + awkward(), variants()], ids=["documents", "drift"])
def test_minhash(spark, rows):
    texts = texts_by_id(rows)
    df = documents(spark, rows).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.judge(df).collect()}
    assert got == linked(texts)
    for r in minhash.judge(df).collect():
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_minhash_where_open_bands_are_many(spark, monkeypatch):
    """Too many to be sent to all tasks: the same rows by shuffling, and no text is moved to count them."""
    df = documents(spark, variants()).repartition(3)
    want = sorted(map(str, minhash.judge(df).collect()))
    moved, sized = [], joins.sized_join
    monkeypatch.setattr(blocks, "sized_join", lambda left, *a, **b: moved.append(left.columns) or sized(left, *a, **b))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    assert sorted(map(str, minhash.judge(df).collect())) == want
    assert moved == [["band", "rep", "component"]]


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.8):
        both = int(2000 * share)
        a, b = pool[:2000], np.concatenate([pool[:both], pool[5000 : 7000 - both]])
        regs = minhash.registers(np.concatenate([a, b]), np.repeat([0, 1], [2000, 2000]), 2)
        real = both / (4000 - both)
        assert minhash.estimate((regs[0] == regs[1]).sum()) == pytest.approx(real, abs=0.15)
    small = minhash.registers(pool[:1], np.zeros(1, np.int64), 2)
    assert (small[0] == small[0][0]).all() and (small[1] == 0xFFFF).all()


def test_minhash_empty(spark):
    assert minhash.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 450)]
    pairs += [(500, i) for i in range(501, 540)] + [(7, 7)]
    parts = Sets({x for p in pairs for x in p})
    for a, b in pairs:
        parts.join(a, b)
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["id"]: r["component"] for r in components(df).collect()}
    ends = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: parts.find(x) for x in ends}


def test_blocks_meet_once(spark):
    rows = [(k, i) for k, n in ((1, 23), (2, 1), (3, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, ident long")
    dealt = blocks.dealt(df, "key", "ident", block=5).collect()
    assert not [r for r in dealt if r["key"] == 2]
    met = {}
    for r in dealt:
        met.setdefault((r["key"], r["_i"], r["_j"]), []).append((r["ident"], r["_own"]))
    pairs = set()
    for (key, i, j), members in met.items():
        left = [x for x, own in members if own == i]
        right = [x for x, own in members if own == j]
        pairs |= {(key, min(a, b), max(a, b)) for a in left for b in right if a != b}
    assert pairs == {(1, a, b) for b in range(23) for a in range(b)} | {(3, 0, 1)}


def vectors():
    rng = np.random.default_rng(6)
    rows = []
    for label in range(3):
        for _ in range(12):
            base = rng.standard_normal(16)
            for step in (0.0, 0.05, 0.1, 0.2, 0.3):
                rows.append((base + step * rng.standard_normal(16), label))
    rows += [rows[0], rows[0], (rows[0][0] * 5, 0), (rows[0][0], 1), (rows[0][0], None)]
    out = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    out += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1),
            (904, [float("inf")] + [1.0] * 15, 1), (905, [], 1), (906, [1.0, 2.0], 1), (None, out[0][1], 0),
            (907, out[1][1], 0), (907, out[1][1], 0), (908, [1e30] * 16, 2), (909, [1e-30] * 16, 2)]
    return out


def test_lattice(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS h1")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.judge(df.repartition(3)).collect()}
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, dtype=np.float64)
            u = u / np.abs(u).max()
            good[i] = (u / np.linalg.norm(u), label)
    parts, links = Sets({r[0] for r in rows} - {None}), dict.fromkeys((r[0] for r in rows), 0)
    keys = sorted(good)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if good[a][1] == good[b][1] and good[a][0] @ good[b][0] >= 0.93:
                links[a] += 1
                links[b] += 1
                parts.join(a, b)
    want = {i: (links[i], i if i is None else parts.find(i)) for i in links}
    assert {k: v[:2] for k, v in got.items()} == want
    assert all(v[2] == (v[1] == k) for k, v in got.items())


def test_lattice_where_shared_entries_are_many(spark, monkeypatch):
    """Too many to be sent to all tasks: the same rows by shuffling."""
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")
    want = sorted(map(str, lattice.judge(df).collect()))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    assert sorted(map(str, lattice.judge(df).collect())) == want


@pytest.mark.parametrize("small, block", [(24, 1500), (1, 1500), (24, 9), (3, 40)])
def test_lattice_pairs_and_products_agree(spark, small, block):
    """Groups compared pair by pair, as products, and in many blocks give every link once."""
    rng = np.random.default_rng(9)
    middles = rng.standard_normal((12, 16))
    vectors = np.concatenate([
        middles[rng.integers(0, 12, 150)] + rng.standard_normal((150, 16)) * rng.choice([0.05, 0.2], (150, 1)),
        rng.standard_normal((60, 16)),
    ]).astype(np.float32)
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    rows = [(i, 1, v.tolist(), 7) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "rep long, size long, v array<float>, l long")
    found = lattice.links(df, block=block, small=small).collect()
    counts = Counter()
    for r in found:
        if r["b"] is None:
            counts[r["a"]] += r["n"]
    assert [counts[i] for i in range(len(rows))] == (near.sum(axis=1) - 1).tolist()
    assert sum(counts.values()) > 1000
    least = blocks.labels(near)
    joined = np.eye(len(rows), dtype=bool)
    for r in found:
        if r["b"] is not None:
            assert least[r["a"]] == least[r["b"]]
            joined[r["a"], r["b"]] = joined[r["b"], r["a"]] = True
    assert blocks.labels(joined).tolist() == least.tolist()


def test_lattice_compares_each_length(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for width, pairs in ((24, 12), (12, 8), (3, 1), (1, 1)):
        for _ in range(pairs):
            v, i = rng.standard_normal(width), len(rows)
            near = v * rng.uniform(2, 3) if width < 8 else v + rng.standard_normal(width) * 0.005
            rows += [(i, v.tolist(), width), (i + 1, near.tolist(), width)]
            want[i], want[i + 1] = (1, i), (1, i)
    n = len(rows)
    # Of one label, but not of one length.
    rows += [(n, [1.0] + [0.0] * 8, 99), (n + 1, [1.0] + [0.0] * 7, 99), (n + 2, [1.0], 99)]
    want |= {n + i: (0, n + i) for i in range(3)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.judge(df.repartition(2)).collect()}
    assert got == want


@pytest.mark.parametrize("kind, values", [("double", (1.2, 1.7)), ("string", ("a", "b")), ("boolean", (True, False))])
def test_lattice_labels_of_any_type(spark, kind, values):
    one, other = values
    v = [0.5] * 64
    near = [0.51] + [0.5] * 63
    rows = [(1, v, one), (2, near, one), (3, v, other), (4, v, None), (5, near, other)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.judge(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (0, 4), 5: (1, 3)}


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(7)
    y = rng.uniform(-3, 3, (300, 8))
    found = lattice.nearest(y)
    twice = np.rint(found * 2)
    assert (np.abs(twice - found * 2) < 1e-9).all()
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1)).all()  # all integers or all halves
    assert (np.rint(found.sum(axis=1)) % 2 == 0).all()
    own = ((y - found) ** 2).sum(axis=1)
    for root in lattice._ROOTS:
        assert (((y - found - root) ** 2).sum(axis=1) >= own - 1e-9).all()


def test_lattice_recall():
    """Pairs at the threshold itself share an entry, but for one in a thousand at most."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = rng.standard_normal((4000, 64))
    u -= (u * a).sum(axis=1, keepdims=True) * a
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * u
    none = np.zeros(4000, dtype=int)
    ka, kb = lattice.entries(a, none), lattice.entries(b, none)
    hit = np.zeros(4000, dtype=bool)
    for i in range(0, ka.shape[1]):
        hit |= (ka[:, i : i + 1] == kb).any(axis=1)
    assert hit.mean() > 0.999


def test_lattice_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert lattice.judge(df).collect() == []


def jobs(spark, run):
    """What ``run`` returns, and the ids of the jobs that it started."""
    context = spark.sparkContext
    name = f"jobs-{id(run)}"
    context.setJobGroup(name, "counted")
    try:
        return run(), context.statusTracker().getJobIdsForGroup(name)
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description"):
            context.setLocalProperty(key, None)


def test_few_jobs(spark):
    """The driver sets memory aside for every stage, scan and broadcast."""
    forest = spark.createDataFrame([(1, i) for i in range(2, 6)] + [(7, 9), (8, 7)], "a long, b long")
    got, started = jobs(spark, lambda: {tuple(r) for r in components(forest).collect()})
    assert got == {(i, 1) for i in range(1, 6)} | {(i, 7) for i in range(7, 10)}
    assert len(started) <= 10
    df = documents(spark, variants())
    got, started = jobs(
        spark, lambda: {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.judge(df).collect()}
    )
    assert got == linked(texts_by_id(variants()))
    assert len(started) <= 140
