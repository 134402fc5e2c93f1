"""Near-duplicate embeddings by lattice hashing.

Each of ``TABLES`` random projections takes a unit vector to eight dimensions, scaled, where the
nearest point of the E8 lattice is found; E8 has the densest packing there, so its cells are rounder
than a grid's and near vectors share one more often. A vector is entered under its own cell and
under the ``PROBES`` neighbouring cells that lie nearest to it. Vectors of one label and length that share an
entry are compared by cosine in double precision, in blocks of bounded size. A pair that shares
several entries counts at the least of them only.

Equal vectors of a label are one class; their links to each other are counted, not compared.

Vectors of different lengths do not link. Vectors that are null or zero, or that hold nulls or non-finite
numbers, and vectors whose label is null, link with nothing and keep their row. Repeated ids are
one vector (its least embedding and label); a null id keeps its row, without links. An empty table
gives no rows. Labels may be of any type that can be ordered, ids are whole numbers. Only id, vector and
label are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areametrics.llm import blocks
from areametrics.llm.common import lists, mixed
from areametrics.llm.graph import components
from areametrics.operators.joins import sized_join
from areametrics.sources.shared import stored

#: A pair of cosine 0.93 shares an entry of a table with probability 0.9, so all four miss one in 10**4.
TABLES, PROBES, SCALE, SEED = 4, 5, 6.0, 20
COSINE = 0.93
#: Groups of so many rows are compared pair by pair, together; larger ones as products of matrices.
SMALL = 24
#: Pairs of 64 components held at once, and lesser keys looked at at once; both bound a task's memory only.
PAIRS, COLUMNS = 1 << 14, 2048

_ROOTS = np.array(
    [
        [s if k == i else t if k == j else 0.0 for k in range(8)]
        for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)
    ]
    + [x for x in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
)


def _d8(y: np.ndarray) -> np.ndarray:
    """The nearest integer point with an even sum: if the sum is odd, the coordinate that was
    rounded farthest goes the other way."""
    near = np.rint(y)
    rest = y - near
    worst = np.abs(rest).argmax(axis=1)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    near[odd, worst[odd]] += np.where(rest[odd, worst[odd]] >= 0, 1.0, -1.0)
    return near


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point: of D8 or of D8 moved by a half."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def entries(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Keys of unit vectors, ``TABLES * (1 + PROBES)`` a row: hashes of table, label, length and
    cell. Fewer than eight components are padded with zeros."""
    width = vectors.shape[1]
    vectors = np.pad(vectors, ((0, 0), (0, max(0, 8 - width))))
    out = []
    for t in range(TABLES):
        rng = np.random.default_rng(SEED + t)
        plane, _ = np.linalg.qr(rng.standard_normal((vectors.shape[1], 8)))
        y = vectors @ plane * (SCALE * np.sqrt(vectors.shape[1] / 64))
        y = y + rng.uniform(0, 1, plane.shape[1])
        cell = nearest(y)
        order = ((y - cell) @ _ROOTS.T).argsort(axis=1, kind="stable")[:, ::-1][:, :PROBES]
        around = np.concatenate([cell[:, None], cell[:, None] + _ROOTS[order]], axis=1)
        doubled = np.rint(around * 2).astype(np.int64).astype(np.uint64)
        key = mixed(labels.astype(np.int64).astype(np.uint64) + np.uint64(t << 40))[:, None]
        key = mixed(key + np.uint64(width))
        for k in range(8):
            key = mixed(key + doubled[:, :, k] + np.uint64(k + 1))
        out.append(key)
    return np.concatenate(out, axis=1)


def _classes(df: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows with the class of each (null without), and the classes: ``rep``, ``size``, unit
    vector, label."""
    rows = df.groupBy(key).agg(F.min(vector).alias("v"), F.min(label).alias("l"))
    # Labels of any type are told by their hash.
    rows = rows.withColumn("l", F.when(F.col("l").isNotNull(), F.xxhash64("l")))
    fine = (
        f"`{key}` IS NOT NULL AND l IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL"
        " AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    )
    rows = rows.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False)))
    hashed = [F.when(F.col("fine"), F.xxhash64(F.col("l"), F.lit(s), F.col("v"))).alias(f"h{s}") for s in (1, 2)]
    rows = stored(rows.select(key, "v", "l", "fine", *hashed), "vectors")
    classes = rows.where("fine").groupBy("h1", "h2").agg(
        F.min(key).alias("rep"), F.count("*").alias("size"), F.min("v").alias("v"), F.min("l").alias("l")
    )
    return rows, stored(classes, "classes")


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded with zeros to the longest, and their lengths."""
    lengths = np.diff(column.offsets.to_numpy())
    inside = np.arange(lengths.max(initial=0)) < lengths[:, None]
    vectors = np.zeros(inside.shape)
    vectors[inside] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True), lengths


class _Rows:
    """Rows of whole groups (an entry and a pair of its blocks), and the links found in them."""

    def __init__(self, table: pa.Table, cosine: float):
        self.entry, self.i, self.j, self.own, self.ids, self.sizes = (
            table.column(c).to_numpy() for c in ("entry", "_i", "_j", "_own", "rep", "size")
        )
        self.vectors, self.lengths = _unit(table.column("v").combine_chunks())
        listed = table.column("lesser").combine_chunks()
        counts = np.diff(listed.offsets.to_numpy())
        # Lesser keys, filled up with the entry itself, which is none of them.
        self.lesser = np.repeat(self.entry[:, None], counts.max(initial=0), axis=1)
        self.lesser[np.arange(self.lesser.shape[1]) < counts[:, None]] = listed.flatten().to_numpy()
        self.cosine = cosine
        self.counts = np.zeros(len(self.ids), dtype=np.int64)
        self.joined: list[tuple[np.ndarray, np.ndarray]] = []

    def _first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether near rows ``a`` and ``b`` share no lesser key; with one they count there."""
        left = self.lesser[a]
        same = left[:, :, None] == self.lesser[b][:, None, :]
        return ~(same & (left < self.entry[a][:, None])[:, :, None]).any(axis=(1, 2))

    def small(self, starts: np.ndarray, size: int) -> None:
        """All groups of ``size`` rows at once, pair by pair in portions of bounded size."""
        x, y = np.triu_indices(size, 1)
        step = max(1, PAIRS * 64 // max(64, self.vectors.shape[1]) // len(x))
        for at in range(0, len(starts), step):
            base = starts[at : at + step, None]
            a, b = (base + x).ravel(), (base + y).ravel()
            good = (self.i[a] == self.j[a]) | (self.own[a] != self.own[b])
            good &= (self.lengths[a] == self.lengths[b]) & (self.ids[a] != self.ids[b])
            a, b = a[good], b[good]
            near = np.einsum("ij,ij->i", self.vectors[a], self.vectors[b]) >= self.cosine
            a, b = a[near], b[near]
            self.joined.append((a, b))
            first = self._first(a, b)
            np.add.at(self.counts, a[first], self.sizes[b[first]])
            np.add.at(self.counts, b[first], self.sizes[a[first]])

    def large(self, start: int, end: int) -> None:
        """One group, as a product of its blocks."""
        rows = np.arange(start, end)
        itself = self.i[start] == self.j[start]
        left = rows if itself else rows[self.own[start:end] == self.i[start]]
        right = rows if itself else rows[self.own[start:end] == self.j[start]]
        near = self.vectors[left] @ self.vectors[right].T >= self.cosine
        near &= self.ids[left][:, None] != self.ids[right][None, :]
        near &= self.lengths[left][:, None] == self.lengths[right][None, :]
        if not near.any():
            return
        joint = np.zeros((len(rows), len(rows)), dtype=bool)
        joint[np.ix_(left - start, right - start)] = near
        joint |= joint.T
        least = blocks.labels(joint)
        moved = np.flatnonzero(least != np.arange(len(rows)))
        self.joined.append((rows[moved], rows[least[moved]]))
        # Only rows with a near partner can have pairs to leave to lesser keys.
        p, q = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        left, right, near = left[p], right[q], near[np.ix_(p, q)]
        known = self.lesser[left] < self.entry[start]
        both = np.intersect1d(self.lesser[left][known], self.lesser[right])
        for at in range(0, len(both), COLUMNS):
            keys = both[at : at + COLUMNS]
            near &= self._holds(left, keys) @ self._holds(right, keys).T == 0
        np.add.at(self.counts, left, near @ self.sizes[right])
        if not itself:
            np.add.at(self.counts, right, self.sizes[left] @ near)

    def _holds(self, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """A row of ones and zeros for each row: which of the sorted ``keys`` it has."""
        place = np.searchsorted(keys, self.lesser[rows]).clip(max=len(keys) - 1)
        r, c = np.nonzero(keys[place] == self.lesser[rows])
        out = np.zeros((len(rows), len(keys)), dtype=np.float32)
        out[r, place[r, c]] = 1
        return out

    def result(self) -> pa.RecordBatch:
        ids, row = np.unique(self.ids, return_inverse=True)
        counts = np.zeros(len(ids), dtype=np.int64)
        np.add.at(counts, row, self.counts)
        least = np.arange(len(ids))
        if self.joined:
            a, b = (row[np.concatenate(side)] for side in zip(*self.joined))
            before = None
            while before is None or (least != before).any():
                before = least.copy()
                low = np.minimum(least[a], least[b])
                for side in (a, b, before[a], before[b]):
                    np.minimum.at(least, side, low)
                least = least[least]
        some, own = counts > 0, np.flatnonzero(least != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[some], ids[own]])),
                pa.array(np.concatenate([np.zeros(some.sum(), np.int64), ids[least[own]]]),
                         mask=np.arange(some.sum() + len(own)) < some.sum()),
                pa.array(np.concatenate([counts[some], np.zeros(len(own), np.int64)])),
            ],
            ["a", "b", "n"],
        )


def _found(table: pa.Table, cosine: float, small: int) -> pa.RecordBatch:
    """Links within the groups of ``table``, whose rows are sorted by group."""
    rows = _Rows(table, cosine)
    change = (np.diff(rows.entry) != 0) | (np.diff(rows.i) != 0) | (np.diff(rows.j) != 0)
    starts = np.concatenate([[0], np.flatnonzero(change) + 1])
    sizes = np.diff(np.append(starts, len(rows.entry)))
    for size in range(2, small + 1):
        some = starts[sizes == size]
        if len(some):
            rows.small(some, size)
    for k in np.flatnonzero(sizes > small):
        rows.large(starts[k], starts[k] + sizes[k])
    return rows.result()


def links(
    classes: DataFrame, cosine: float = COSINE, block: int = blocks.BLOCK, small: int = SMALL
) -> DataFrame:
    """``a``, ``b``, ``n``: with null ``b``, ``n`` vectors in other classes are linked with those of
    class ``a`` (to be summed); else a link of classes, enough of them for the components.

    Entries travel with ids only until it is known which are shared, and by which blocks.
    """

    def enter(batches):
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            for width in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == width)))
                vectors, _ = _unit(part.column(2))
                found = entries(vectors, part.column(3).to_numpy(zero_copy_only=False)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(2),
                        lists(found.ravel(), np.full(len(part), found.shape[1]), pa.int64()),
                    ],
                    ["rep", "size", "v", "keys"],
                )

    kind = classes.schema["v"].dataType.simpleString()
    keyed = classes.select("rep", "size", "v", "l").mapInArrow(
        enter, f"rep long, size long, v {kind}, keys array<long>"
    )
    keyed = stored(keyed, "entries")
    rows = blocks.dealt(keyed.select("rep", F.explode("keys").alias("entry")), "entry", "rep", block)
    ready = rows.join(keyed, "rep").select(
        "entry", "_i", "_j", "_own", "rep", "size", "v",
        F.expr("filter(keys, k -> k < entry)").alias("lesser"),
    )
    group = ["entry", "_i", "_j"]
    ready = ready.repartition(*group).sortWithinPartitions(*group, "rep")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            # The last group may go on in the next batch.
            last = [table.column(c)[len(table) - 1].as_py() for c in group] if len(table) else None
            if last is None:
                continue
            same = np.ones(len(table), dtype=bool)
            for name, value in zip(group, last):
                same &= table.column(name).to_numpy() == value
            whole = len(table) - int(same.sum())
            if whole:
                yield _found(table.slice(0, whole).combine_chunks(), cosine, small)
            held = table.slice(whole)
        if held is not None:
            yield _found(held.combine_chunks(), cosine, small)

    return ready.mapInArrow(run, "a long, b long, n long")


def judge(
    df: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` for every vector."""
    rows, classes = _classes(df, key, vector, label)
    found = stored(links(classes, cosine), "links")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    parts = components(found.where("b IS NOT NULL").select("a", "b"))
    whole = (
        classes.select("h1", "h2", "rep", "size")
        .join(counts, F.col("rep") == F.col("a"), "left")
        .join(parts, F.col("rep") == F.col("id"), "left")
        .select("h1", "h2", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    joined = sized_join(rows.select(key, "h1", "h2"), whole, ["h1", "h2"]).select(
        f"l.{key}", "n_links", "component_id"
    )
    own = F.coalesce(F.col("component_id"), F.col(key))
    return joined.select(
        key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(own == F.col(key), F.lit(True)).alias("kept"),
    )
