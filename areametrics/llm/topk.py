"""Exact top-k search by inner product, block at a time.

Components become whole numbers, ``floor(scale * x)``. Vectors, ordered by the signs of a few random
projections and then by id, are cut into *blocks*: ranges of at most ``BLOCK`` vectors with a forward
index (the numbers of each vector) and the least and greatest number of every component. A query's
bound for a block is the sum over its components of the most that the block can give. Blocks are taken
in descending order of bounds and scored through their forward index, until the bound falls below the
kth score; a block whose bound equals it is skipped only if all its ids are larger than the kth's.

Work is dealt in units of a query group and a shard of blocks, both of bounded size, so it spreads
over the cluster whatever the data; the first shard gives every query the score to beat in the others.
All scores are exact: sums that doubles may not hold are done in whole numbers of any size.

Vectors that are null or empty, or that hold null or non-finite components (also after scaling), and
rows with a null id take no part. Vectors of different lengths do not meet. Repeated ids are one
vector, the least. Ties go to the smaller id. A score beyond 64 bits is given as the nearest such
number. Other columns are left out, whatever their names. An empty table gives no rows, and a query
without candidates none. Ids are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areametrics.sources.shared import stored

#: Vectors of a block, blocks of a shard, queries of a group, projections of the order.
BLOCK, SHARD_BLOCKS, GROUP, BITS, SEED = 256, 64, 1024, 12, 13
#: Sums of doubles below this are exact.
_EXACT = 2.0**53
_LIMITS = np.iinfo(np.int64)
_NONE = _LIMITS.max


def numbered(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``id``, ``v`` (whole numbers as doubles) and ``code`` of the vectors that take part."""
    fine = (
        f"`{key}` IS NOT NULL AND size(`{vector}`) > 0 AND forall(`{vector}`, x -> x IS NOT NULL AND NOT"
        f" isnan(x) AND abs({scale!r}D * double(x)) < double('Infinity'))"
    )
    rows = df.where(F.expr(fine)).select(
        F.col(key).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("v"),
    )
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            code = np.zeros(len(lengths), np.int32)
            for width in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == width)
                plane = np.random.default_rng(SEED).standard_normal((width, BITS))
                signs = values[starts[rows][:, None] + np.arange(width)] @ plane > 0
                code[rows] = signs @ (1 << np.arange(BITS))
            v = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(code)], ["id", "v", "code"])

    return rows.mapInArrow(run, "id long, v array<double>, code int")


def blocks(rows: DataFrame) -> DataFrame:
    """A row per block: ``block``, ``width``, ``ids``, ``low``, ``high`` and ``forward``, the numbers
    of all its vectors as 32-bit integers if they fit, else as doubles."""
    ordered = rows.withColumn("width", F.size("v"))
    ordered = ordered.repartitionByRange("width", "code", "id").sortWithinPartitions("width", "code", "id")
    doubles = pa.list_(pa.float64())
    names = ["block", "width", "ids", "low", "high", "forward"]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), doubles, doubles, pa.binary()]

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        held, out = [], []  # (ids, matrix) of one width, fewer than a block in all

        def cut(ids, matrix):
            nonlocal number
            small = np.abs(matrix).max() < 2**31
            out.append((
                number, matrix.shape[1], ids, matrix.min(axis=0), matrix.max(axis=0),
                matrix.astype(np.int32 if small else np.float64).tobytes(),
            ))
            number += 1

        def push(ids, matrix, last=False):
            if held and (last or held[0][1].shape[1] != matrix.shape[1]):
                cut(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                held.clear()
            if last:
                return
            ids = np.concatenate([*(h[0] for h in held), ids])
            matrix = np.concatenate([*(h[1] for h in held), matrix])
            held.clear()
            whole = len(ids) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                cut(ids[i : i + BLOCK], matrix[i : i + BLOCK])
            if whole < len(ids):
                held.append((ids[whole:], matrix[whole:]))

        def flush():
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            ids, widths = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            values = batch.column(1).flatten().to_numpy()
            at, done = 0, 0
            for width in np.unique(widths).tolist():
                n = int((widths == width).sum())
                push(ids[done : done + n], values[at : at + n * width].reshape(n, width))
                at, done = at + n * width, done + n
            if out:
                yield flush()
        push(None, None, last=True)
        if out:
            yield flush()

    return ordered.select("id", "v", "width").mapInArrow(
        run, "block long, width int, ids array<long>, low array<double>, high array<double>, forward binary"
    )


def _matrix(column, rows: np.ndarray, width: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of whole numbers, exact; doubles, or Python numbers (kept within 64 bits) where doubles
    do not hold them."""
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], dtype=object) for m in (a, b)]
    return np.minimum(np.maximum(whole[0] @ whole[1].T, _LIMITS.min), _LIMITS.max)


def best(queries, own, seed, low, high, ids, forward, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids, best first, of the best ``k`` vectors for each query (id ``own``, score to beat
    ``seed``); places that nothing fills have the id ``_NONE``."""
    n = len(queries)
    reach = np.abs(queries).max() * max(np.abs(low).max(), np.abs(high).max()) * queries.shape[1]
    if reach < _EXACT:
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    else:
        bounds = np.full((n, len(ids)), np.inf)
    order = np.argsort(-bounds, axis=1, kind="stable")
    least = np.array([i.min() for i in ids])
    exact = reach < _EXACT
    scores = np.full((n, k), -np.inf, dtype=np.float64 if exact else object)
    found = np.full((n, k), _NONE)
    active = np.ones(n, dtype=bool)
    every = np.arange(n)
    for turn in range(len(ids)):
        block = order[:, turn]
        bound = bounds[every, block]
        kth = scores[:, -1]
        active &= (bound >= kth).astype(bool) & (bound >= seed)
        if not active.any():
            break
        beaten = (bound == kth).astype(bool) & (least[block] > found[:, -1])
        rows = np.flatnonzero(active & ~beaten)
        rows = rows[np.argsort(block[rows], kind="stable")]
        for part in np.split(rows, np.flatnonzero(np.diff(block[rows])) + 1):
            if not len(part):
                continue
            b = block[part[0]]
            got = products(queries[part], forward[b])
            named = np.broadcast_to(ids[b], got.shape)
            self = named == own[part][:, None]
            got = np.where(self, -np.inf, got)
            named = np.where(self, _NONE, named)
            both = np.concatenate([scores[part], got.astype(scores.dtype)], axis=1)
            names = np.concatenate([found[part], named], axis=1)
            if exact:
                top = np.lexsort((names, -both), axis=1)[:, :k]
            else:
                top = np.array([sorted(range(len(r)), key=lambda i: (-r[i], m[i]))[:k] for r, m in zip(both, names)])
            scores[part] = np.take_along_axis(both, top, axis=1)
            found[part] = np.take_along_axis(names, top, axis=1)
    return scores, found


def _scored(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each unit: ``query_id``, ``vec_id``, ``score``. Both sides carry ``_g``, ``_s``."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        widths = left.column("width").to_numpy()
        own = right.column("id").to_numpy()
        seeds = right.column("seed").to_numpy()
        sizes = right.column("v").combine_chunks().value_lengths().to_numpy()
        parts = []
        for width in np.intersect1d(widths, sizes).tolist():
            rows, asked = np.flatnonzero(widths == width), np.flatnonzero(sizes == width)
            ids = [np.array(left.column("ids")[i].as_py()) for i in rows.tolist()]
            raw = [left.column("forward")[i].as_buffer() for i in rows.tolist()]
            forward = [
                np.frombuffer(r, np.int32 if len(r) == 4 * width * len(i) else np.float64)
                .reshape(len(i), width).astype(np.float64)
                for r, i in zip(raw, ids)
            ]
            scores, found = best(
                _matrix(right.column("v").combine_chunks(), asked, width), own[asked], seeds[asked],
                _matrix(left.column("low").combine_chunks(), rows, width),
                _matrix(left.column("high").combine_chunks(), rows, width), ids, forward, k,
            )
            real = found != _NONE
            if scores.dtype == object:
                scores = np.array([int(s) for s in scores[real]], np.int64)
            else:
                scores = scores[real].astype(np.int64)
            parts.append((np.repeat(own[asked], real.sum(axis=1)), found[real], scores))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return index.groupBy("_g", "_s").cogroup(queries.groupBy("_g", "_s")).applyInArrow(
        run, "query_id long, vec_id long, score long"
    )


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    scale: float = 1024.0,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for each query the ``k`` vectors of
    greatest inner product, the one with its own id aside."""
    index = stored(blocks(numbered(vectors, key, vector, scale)), "blocks")
    asked = stored(numbered(queries, key, vector, scale).select("id", "v"), "queries")
    shards = max(1, -(-index.count() // SHARD_BLOCKS))
    groups = max(1, -(-asked.count() // GROUP))
    index = index.withColumn("_s", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
    index = index.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.withColumn("_g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    first = _scored(
        index.where("_s = 0"), asked.withColumns({"_s": F.lit(0), "seed": F.lit(float("-inf"))}), k
    )
    found = first
    if shards > 1:
        found = first = stored(first, "first")
        # The kth score so far is one that the rest must reach; with fewer than k there is none.
        kth = first.groupBy("query_id").agg(
            F.when(F.count("*") >= k, F.min("score").cast("double")).alias("seed")
        )
        rest = asked.join(kth, F.col("id") == F.col("query_id"), "left").select(
            "id", "v", "_g",
            # A double below the score, should it not hold all its digits.
            F.coalesce(F.expr("seed - abs(seed) * 1e-15"), F.lit(float("-inf"))).alias("seed"),
            F.explode(F.sequence(F.lit(1), F.lit(shards - 1))).alias("_s"),
        )
        found = first.unionByName(_scored(index.where("_s > 0"), rest, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
