"""MinHash near-duplicates on HyperMinHash registers.

The shingles of a text are dealt over ``REGISTERS`` buckets by hash. Of each bucket's least hash
value a register keeps the number of leading zeros and the ``MANTISSA`` bits after them, 16 bits in
all. An empty bucket borrows from the first filled one in a fixed random order of its own, which
keeps the chance of two registers to agree at the Jaccard similarity. Bands of ``ROWS`` registers
are the candidate keys: at similarity 0.8 a pair shares none of the 32 bands with probability
6e-5, at 0.9 with 1e-11.

Texts of equal shingle sets are one class (128-bit set hash), compared once. Candidates:

1. each class with the least class of each of its bands;
2. in bands that still hold several components, pairs of different components whose registers
   agree well enough: the Jaccard estimate, corrected for chance collisions of registers, is at
   most ``MARGIN`` (over four standard errors) under the threshold.

Every candidate is confirmed on the full shingle sets of the whole texts. Links among members of
one component are not looked for again, so copies are never expanded into all pairs, and no band
or group is capped. Bands with many rows are compared in blocks of bounded size, and pairs that
fail never leave their block.

Null and empty texts have no shingles and link with nothing; a text with fewer words than a shingle
is one shingle. Repeated keys are one document; a null key keeps its row and links with nothing.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areametrics.llm import blocks
from areametrics.llm.common import (
    SpanHash, by_group, groups, lists, mixed, one_per_id, text_bytes, window_hashes, words,
)
from areametrics.llm.graph import components
from areametrics.operators.joins import sized_join
from areametrics.sources.shared import stored

REGISTERS, MANTISSA, ROWS, SEED = 192, 10, 6, 11
BANDS = REGISTERS // ROWS
MARGIN = 0.125
#: Rows of a band that are compared at a time, with their texts.
TEXT_BLOCK = 600

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE_BITS = 44
_EMPTY = np.uint16(0xFFFF)
_ORDER = np.argsort(np.random.default_rng(SEED).random((REGISTERS, REGISTERS)), axis=1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every distinct shingle, by row."""
    data = _LOWER[data]
    start, end, row = words(data, offsets)
    if not len(row):
        return np.zeros(0, np.uint64), row
    word = SpanHash(data)(start, end)
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    count = np.bincount(row, minlength=len(offsets) - 1)
    found, owner = [], []
    if len(word) >= size:
        inside = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
        found.append(window_hashes(word, size)[inside])
        owner.append(row[inside])
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            every = np.zeros(len(short), dtype=np.uint64)
            for i in range(n):
                every = mixed(every + word[first[short] + i] + np.uint64(i + 101))
            found.append(every)
            owner.append(short)
    found, owner = np.concatenate(found), np.concatenate(owner)
    _, kept = np.unique(mixed(found + mixed(owner.astype(np.uint64))), return_index=True)
    kept = kept[np.argsort(owner[kept], kind="stable")]
    return found[kept], owner[kept]


def registers(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The registers of ``n`` sets, a row each; all empty for an empty set."""
    out = np.full((n, REGISTERS), _EMPTY, dtype=np.uint16)
    if not len(values):
        return out
    spread = mixed(values + np.uint64(SEED))
    bucket = owner * REGISTERS + (spread % np.uint64(REGISTERS)).astype(np.int64)
    value = mixed(spread) >> np.uint64(64 - _VALUE_BITS)
    order = np.lexsort((value, bucket))
    at = order[np.flatnonzero(np.diff(bucket[order], prepend=-1))]
    least = value[at]
    length = np.zeros(len(least), dtype=np.int64)
    rest = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= (np.uint64(1) << np.uint64(step))
        length[big] += step
        rest[big] >>= np.uint64(step)
    zeros = _VALUE_BITS - 1 - length
    # The bits after the leading one, filled up with zeros if fewer are left.
    shift = length - MANTISSA
    low = least - np.where(least > 0, np.uint64(1) << length.astype(np.uint64), np.uint64(0))
    bits = np.where(
        shift >= 0, low >> np.maximum(shift, 0).astype(np.uint64),
        low << np.maximum(-shift, 0).astype(np.uint64),
    )
    out.ravel()[bucket[at]] = ((zeros << MANTISSA) | bits.astype(np.int64)).astype(np.uint16)
    filled = out != _EMPTY
    need = np.argwhere(~filled & filled.any(axis=1)[:, None])
    own = out.copy()
    for attempt in range(REGISTERS):
        if not len(need):
            break
        other = own[need[:, 0], _ORDER[need[:, 1], attempt]]
        got = other != _EMPTY
        out[need[got, 0], need[got, 1]] = other[got]
        need = need[~got]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    wide = regs.astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    key = mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(SEED))[None, :].repeat(len(regs), 0)
    for i in range(ROWS):
        key = mixed(key + wide[:, :, i] + np.uint64(i + 1))
    return key


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less those equal by chance."""
    chance = 0.1699 * REGISTERS * 2.0 ** (1 - MANTISSA)
    return (equal - chance) / (REGISTERS - chance)


def sketches(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """``id``, ``n_shingles``, ``s1``, ``s2`` (hash of the set), ``regs`` and ``bands``."""

    def run(keys, data, offsets):
        n = len(offsets) - 1
        values, owner = shingles(data, offsets, size)
        edges = np.searchsorted(owner, np.arange(n + 1))
        sums = []
        for seed in (1, 2):
            total = np.append(np.uint64(0), np.cumsum(mixed(values + np.uint64(seed)), dtype=np.uint64))
            sums.append((total[edges[1:]] - total[edges[:-1]]).view(np.int64))
        regs = registers(values, owner, n)
        return pa.RecordBatch.from_arrays(
            [
                keys, pa.array(np.diff(edges), pa.int64()), *map(pa.array, sums),
                pa.array([r.tobytes() for r in regs], pa.binary()),
                lists(band_keys(regs).view(np.int64).ravel(), np.full(n, BANDS), pa.int64()),
            ],
            ["id", "n_shingles", "s1", "s2", "regs", "bands"],
        )

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(
        by_group(run), "id long, n_shingles long, s1 long, s2 long, regs binary, bands array<long>"
    )


def likely(pairs: DataFrame, regs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose registers do not rule the threshold out."""
    left, right = (regs.select(F.col("rep").alias(c), F.col("regs").alias(f"r{c}")) for c in "ab")

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            ra, rb = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                for i in (2, 3)
            )
            good = estimate((ra == rb).sum(axis=1)) >= threshold - MARGIN
            yield batch.select(["a", "b"]).filter(pa.array(good))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb")
    return joined.mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """``100 * intersection >= percent * union`` of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs with ``100 * intersection >= percent * union`` on the sets of whole texts."""
    left, right = (texts.select(F.col("rep").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")

    def sets(column):
        data, offsets = text_bytes(column)
        out = []
        for i, j in groups(offsets):
            values, owner = shingles(
                data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size
            )
            out += np.split(values, np.searchsorted(owner, np.arange(1, j - i)))
        return [np.sort(x) for x in out]

    def run(batches):
        for batch in batches:
            good = [
                similar(x, y, percent) for x, y in zip(sets(batch.column(2)), sets(batch.column(3)))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long")


def near_links(
    shared: DataFrame, reps: DataFrame, parts: DataFrame, texts: DataFrame, percent: int, size: int
) -> DataFrame:
    """Links between different components that share a band. ``shared`` has ``band`` and ``rep``.

    A pair is looked at in the first band it shares, if its registers do not rule it out, and
    confirmed on its full sets there and then; once two components are linked within a block, no
    other pair of theirs is looked at. So what comes out grows with the rows, not with the pairs.
    """
    threshold = percent / 100
    named = shared.join(parts, F.col("rep") == F.col("id"), "left").select(
        "band", "rep", F.coalesce("component", "rep").alias("component")
    )
    open_ = named.groupBy("band").agg(
        F.min("component").alias("x"), F.max("component").alias("y")
    ).where("x <> y").select("band")
    opened = stored(named.join(open_, "band"), "open")
    wide = reps.select("rep", "n_shingles", "regs").join(texts, "rep")

    def work(table, left, right):
        ids = table.column("rep").to_numpy()
        part = table.column("component").to_numpy()
        sizes = table.column("n_shingles").to_numpy()
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(regs)
        band = np.int64(table.column("band")[0].as_py()).view(np.uint64)
        place = int(np.argmax((keys == band).any(axis=0)))
        texts_ = table.column("text")
        sets: dict[int, np.ndarray] = {}
        up: dict[int, int] = {}

        def find(x):
            while x in up:
                x = up[x]
            return x

        def shingled(i):
            if i not in sets:
                raw = np.frombuffer(texts_[i].as_py().encode(), np.uint8)
                sets[i] = np.sort(shingles(raw, np.array([0, len(raw)]), size)[0])
            return sets[i]

        found = []
        for i in left.tolist():
            other = right[part[right] != part[i]]
            if left is right:
                other = other[other > i]
            fits = np.minimum(sizes[other], sizes[i]) >= threshold * np.maximum(sizes[other], sizes[i]) - 1e-9
            other = other[fits]
            if not len(other):
                continue
            other = other[estimate((regs[other] == regs[i]).sum(axis=1)) >= threshold - MARGIN]
            other = other[(keys[other] == keys[i]).argmax(axis=1) == place]
            for j in other.tolist():
                x, y = find(int(part[i])), find(int(part[j]))
                if x != y and similar(shingled(i), shingled(j), percent):
                    up[max(x, y)] = min(x, y)
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return blocks.compared(
        opened, "band", "rep", ["rep", "component", "n_shingles", "regs", "text"], work,
        "a long, b long", TEXT_BLOCK, wide,
    )


def judge(
    df: DataFrame, percent: int = 80, size: int = 4, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (the least key reachable by links) and ``kept``."""
    docs = one_per_id(df, key, text)
    drawn = stored(sketches(docs, size, key, text), "sketches")
    reps = drawn.where("n_shingles > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n_shingles").agg(
        F.min_by("regs", "id").alias("regs"), F.min_by("bands", "id").alias("bands"), F.min("id").alias("rep")
    )
    reps = stored(reps, "classes")
    rows = reps.select(F.explode("bands").alias("band"), "rep")
    # Bands of one class only are most; they go first.
    pivots = rows.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("most"))
    pivots = pivots.where("pivot <> most").select("band", "pivot")
    shared = stored(rows.join(pivots, "band").select("band", "rep", "pivot"), "bands")
    stars = shared.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    texts = docs.join(
        shared.select("rep").distinct(), F.col(key) == F.col("rep"), "left_semi"
    ).select(F.col(key).alias("rep"), text)
    texts = stored(texts.toDF("rep", "text"), "texts")
    threshold = percent / 100
    near = stored(likely(stars, reps, threshold), "likely")
    first = stored(confirmed(near, texts, percent, size), "confirmed")
    parts = components(first)
    second = stored(
        near_links(shared.select("band", "rep"), reps, parts, texts, percent, size), "confirmed"
    )
    parts = components(parts.toDF("a", "b").unionByName(second))
    whole = reps.select("s1", "s2", F.col("n_shingles").alias("n"), "rep").join(
        parts, F.col("rep") == F.col("id"), "left"
    ).select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id"))
    whole = stored(whole, "components")
    members = drawn.select("id", "n_shingles", F.col("n_shingles").alias("n"), "s1", "s2")
    joined = sized_join(members, whole, ["s1", "s2", "n"]).select(
        "l.id", "l.n_shingles", F.when(F.col("l.id").isNotNull(), F.col("component_id")).alias("c")
    )
    own = F.coalesce("c", "id")
    return joined.select(
        F.col("id").alias(key), "n_shingles", own.alias("component_id"),
        F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"),
    )
