"""Helpers that several operators share: rows per document, texts of an Arrow batch as bytes, word
and span hashes in numpy."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Texts are worked on in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 21


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, for sessions that were
    started elsewhere. On a cluster the package is installed or shipped with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def one_per_id(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``key`` and ``text``, one row per key; null text is empty.

    Rows that repeat a key (null is a key like any other) are one document: its least text.
    """
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    repeated = df.groupBy(key).count().where("count > 1").limit(1).count()
    return rows.groupBy(key).agg(F.min(text).alias(text)) if repeated else rows


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the ``n + 1`` offsets of its rows. Null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of ``x`` spread over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** n``; those of a group's usual length are held."""
    held = _POWERS.get(int(base))
    if held is None or len(held) <= n:
        held = np.full(max(n + 1, GROUP_BYTES + (GROUP_BYTES >> 3)), base, dtype=np.uint64)
        held[0] = 1
        np.cumprod(held, out=held)
        if len(held) <= 4 * GROUP_BYTES:
            _POWERS[int(base)] = held
    return held[: n + 1]


class SpanHash:
    """Hashes of any byte spans of ``data``: equal spans have equal hashes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.multiply(data, _powers(_BASE, n)[:n], out=self._sums[1:], casting="unsafe")
        np.cumsum(self._sums, out=self._sums)
        self._inverse = _powers(_BASE_INVERSE, n)

    def raw(self, starts, ends) -> np.ndarray:
        return (self._sums[ends] - self._sums[starts]) * self._inverse[starts]

    def __call__(self, starts, ends) -> np.ndarray:
        return mixed(self.raw(starts, ends) ^ mixed((ends - starts).astype(np.uint64)))

    def windows(self, length: int) -> np.ndarray:
        """The hash of every window of ``length`` bytes."""
        n = len(self._sums) - length
        return mixed((self._sums[length:] - self._sums[:n]) * self._inverse[:n])


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` values."""
    n = len(values) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(size if n > 0 else 0):
        out = mixed(out + values[i : i + n] + np.uint64(i + 1))
    return out


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row's range."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row ``i`` holds the next ``counts[i]`` values."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def by_group(function):
    """A ``mapInArrow`` function: ``function(keys, data, offsets)`` gives the output batch of a
    group of texts. Input columns are key and text."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in groups(offsets):
                part = data[offsets[i] : offsets[j]]
                yield function(batch.column(0).slice(i, j - i), part, offsets[i : j + 1] - offsets[i])

    return run
