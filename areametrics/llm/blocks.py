"""All comparisons within the groups of a key, in blocks of bounded size.

A group of more than ``BLOCK`` rows is dealt into blocks by a hash of its ids, and each pair of its
blocks is a task's unit of work with a key of its own; only rows of such groups are repeated. So a
key with very many rows is spread over the cluster and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areametrics.operators.joins import sized_join

BLOCK = 1500


def dealt(rows: DataFrame, key: str, ident: str, block: int = BLOCK) -> DataFrame:
    """``rows`` of keys with two rows or more, plus ``_i``, ``_j`` (a pair of blocks, ``_i <= _j``)
    and ``_own``, the row's block, which is one of them. Rows are counted by key and may be shuffled for
    it, so they should be narrow."""
    sizes = rows.groupBy(key).count().where("count > 1").select(
        key, F.ceil(F.col("count") / F.lit(block)).cast("int").alias("_n")
    )
    rows = sized_join(rows, sizes, [key], how="inner").selectExpr("l.*", "_n")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(ident), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select(
        "*", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")
    ).drop("_n", "_other")


def compared(
    rows: DataFrame, key: str, ident: str, columns: list[str],
    work: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch], schema: str,
    block: int = BLOCK, wide: DataFrame | None = None,
) -> DataFrame:
    """``work(table, left, right)`` for each pair of blocks: ``left`` and ``right`` are the rows of
    the two blocks in ``table``; they are the same rows if a block meets itself. ``wide`` has one row
    for each ``ident``, with columns that the rows get once they are dealt."""
    ready = dealt(rows, key, ident, block)
    ready = (ready if wide is None else ready.join(wide, ident)).select(key, "_i", "_j", "_own", *columns)
    ready = ready.repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j", "_own", ident)

    def run(batches: Iterator[pa.RecordBatch]):
        def finish(table):
            own, i, j = (table.column(c).to_numpy() for c in ("_own", "_i", "_j"))
            if i[0] == j[0]:
                every = np.arange(len(own))
                return work(table, every, every)
            return work(table, np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0]))

        open_, open_key = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if open_ and open_key != keys[at]:
                    yield finish(pa.Table.from_batches(open_).combine_chunks())
                    open_ = []
                open_key = keys[at]
                open_.append(batch.slice(at, end - at))
                at = end
        if open_:
            yield finish(pa.Table.from_batches(open_).combine_chunks())

    return ready.mapInArrow(run, schema)


def labels(linked: np.ndarray) -> np.ndarray:
    """The least row reachable from each row in a symmetric matrix of links."""
    n = len(linked)
    found = np.arange(n)
    near = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, found[None, :], n).min(axis=1)
        new = new[new]
        if (new == found).all():
            return found
        found = new
