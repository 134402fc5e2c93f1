"""Sum-of-squares packing of token ids into sequences of fixed length.

Each input partition packs by itself, so nothing is shuffled and a lost task is run again with the
same result. A document's full sequences are cut off; what is left, shorter than a sequence, goes
online to the *fill level* that makes the sum of squared level counts least: ``open_[h]`` windows
are filled up to ``h``, and moving one from ``h`` to ``h + r`` (or opening one at ``r``) changes the
sum by a term that the level array gives for all ``h`` at once. A full window is closed. At the end
of a partition the windows still open are poured together, so that one at most is not full.

Sequence ids are the partition's number times 2**40, plus a count.

Null text is empty: its end id is its only token. Repeated keys are one document. An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from areametrics.llm.common import groups, one_per_id, text_bytes
from areametrics.llm.units import units_of

#: A piece of a document: key, start in its ids, the ids, all ids of the document.
Piece = tuple[object, int, np.ndarray, int]


class Packer:
    """Windows of ``size`` ids filled by the sum-of-squares rule."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size, dtype=np.int64)
        self.open: list[deque[list[Piece]]] = [deque() for _ in range(size)]

    def level(self, length: int) -> int:
        """The level to fill up by ``length``; 0 is a new window. Of equal ones the fullest.

        With counts ``n``: leaving ``h`` adds ``1 - 2 n[h]``, reaching ``t`` adds ``2 n[t] + 1``,
        and a new window leaves no level, a full one reaches none.
        """
        n, top = self.count, self.size - length
        change = np.empty(top + 1, dtype=np.int64)
        change[0] = 2 * n[length] + 1
        if top:
            change[1:] = 2 - 2 * n[1 : top + 1]
            change[1:top] += 2 * n[length + 1 : self.size]
            change[top] = 1 - 2 * n[top]
            change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(change[::-1].argmin())

    def place(self, piece: Piece) -> list[Piece] | None:
        """Place a piece shorter than a window; the window, if that fills it."""
        length = len(piece[2])
        at = self.level(length)
        window = []
        if at:
            window = self.open[at].popleft()
            self.count[at] -= 1
        window.append(piece)
        if at + length == self.size:
            return window
        self.open[at + length].append(window)
        self.count[at + length] += 1
        return None

    def rest(self) -> Iterator[list[Piece]]:
        """The open windows, fullest first, poured into full ones; only the last may be short."""
        window, room = [], self.size
        for level in range(self.size - 1, 0, -1):
            while self.open[level]:
                for key, start, ids, total in self.open[level].popleft():
                    while len(ids):
                        part = ids[:room]
                        window.append((key, start, part, total))
                        start, ids, room = start + len(part), ids[room:], room - len(part)
                        if not room:
                            yield window
                            window, room = [], self.size
        self.count[:] = 0
        if window:
            yield window


def pack(
    df: DataFrame, tokenizer: str, end_id: int, size: int = 2048, key: str = "doc_id",
    text: str = "text", with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, unless ``with_ids`` is false, the ``ids`` themselves."""
    rows = one_per_id(df, key, text)
    kind = rows.schema[key].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names[1:])

    def run(batches):
        units, packer = units_of(tokenizer), Packer(size)
        sequence = TaskContext.get().partitionId() << 40
        found, kind_ = [], None

        def close(window):
            nonlocal sequence
            offset = 0
            for k, start, ids, total in window:
                found.append((k, start, ids, total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush():
            columns = list(zip(*found)) or [()] * 6
            ids = [x.astype("<u4") for x in columns[2]]
            arrays = [
                pa.array(columns[0], kind_), pa.array(columns[1], pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                *(pa.array(c, pa.int64()) for c in columns[3:6]),
            ]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            found.clear()
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        for batch in batches:
            kind_ = batch.schema.field(0).type
            data, offsets = text_bytes(batch.column(1))
            keys = batch.column(0).to_pylist()
            for i, j in groups(offsets):
                ids, counts = units.group(
                    data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                )
                at = 0
                for k, n in zip(keys[i:j], counts.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id))
                    at += n
                    whole = len(own) - len(own) % size
                    for start in range(0, whole, size):
                        close([(k, start, own[start : start + size], n + 1)])
                    if whole < len(own):
                        if window := packer.place((k, whole, own[whole:], n + 1)):
                            close(window)
                if found:
                    yield flush()
        if kind_ is not None:
            for window in packer.rest():
                close(window)
            yield flush()

    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
