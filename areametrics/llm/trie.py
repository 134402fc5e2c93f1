"""The prefix trie of all conversations, by union-find over neighbours in sorted order.

A conversation is a sequence of turns; a node is a distinct beginning of some of them. Conversations
are cut into *segments* of ``SEGMENT`` turns; a segment belongs to the trie that hangs below what came
before it, told by a hash of all earlier turns. So every trie is at most ``SEGMENT`` deep, and no row
grows with the length of a conversation.

Segments are sorted by range over the cluster, each block of sorted rows is worked on by itself: the
common prefixes of neighbours are edges, which join components in descending depth; each merge opens
a branching node or adds to the one of its depth. The stretches between branching nodes are then
unrolled into the nodes of the trie. Nodes that reach neither end of the block are whole; the
contracted rest, the paths of its first and last row, is merged with that of other blocks by the
hashes of the nodes. Sums over subtrees follow from the least members: a node belongs to its least
member, whose later nodes are all its own, so that running sums along one conversation, added up over
a node's members, give the sum over its subtree.

Turns are told by 128-bit hashes of role and text, beginnings by exclusive or of hashes of turn and
place. Null role or text is empty; a null turn number comes first; ties go by role and text, repeated
rows are turns of their own. Rows with a null conversation id name no conversation and are left out.
Ids are whole numbers. Other columns are left out, whatever their names. Texts of any length are
hashed whole. An empty table gives no rows, not even a root. The digest of a node's ends takes their
ids in order through one task, as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areametrics.llm.units import ragged
from areametrics.operators.joins import sized_join
from areametrics.sources.shared import stored

#: Turns of a segment.
SEGMENT = 64
_KEY = ["depth", "p1", "p2"]


def numbered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id``, ``at`` (a number that rises along each conversation), ``h1``, ``h2`` and ``chars``
    of every turn, sorted by range so that a conversation of any length is spread."""
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.select(
        "conv_id", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(1), "role", "text").alias("h2"), F.length("text").cast("long").alias("chars"),
    ), "turns")


def _runs(rows: DataFrame) -> DataFrame:
    """What lies of each conversation in each partition: first number, rows, and rows before it."""
    runs = rows.groupBy("conv_id", F.shiftright("at", 33).alias("part")).agg(
        F.min("at").alias("first"), F.count("*").alias("n")
    )
    order = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))


def placed(rows: DataFrame, runs: DataFrame, *more: str) -> DataFrame:
    """``rows`` with ``pos``, the place in the conversation from 0, and columns of ``runs``."""
    rows = rows.withColumn("part", F.shiftright("at", 33))
    return rows.join(runs, ["conv_id", "part"]).select(
        "conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "h1", "h2", "chars", *more
    )


def conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns by place and the list of all conversations, as they are."""
    runs = _runs(rows)
    turns = placed(rows, runs).withColumnRenamed("pos", "depth")
    return turns, runs.groupBy("conv_id").agg(F.sum("n").alias("turns"))


def rebuilt(rows: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """As :func:`conversations`, after the first ``h`` turns of every conversation ``c`` gave way to
    the first ``h`` of conversation ``c - c % family``; ``h`` is the checksum of ``c`` modulo ``most``."""
    runs = stored(_runs(rows), "runs")
    sizes = runs.groupBy("conv_id").agg(F.sum("n").alias("own"))
    lead = F.expr(f"crc32(CAST(conv_id AS STRING)) % {most}")
    convs = sizes.withColumns({"h": lead, "base": F.expr(f"conv_id - conv_id % {family}")}).join(
        sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("given")), "base", "left"
    ).select(
        "conv_id", "base", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("taken"),
        F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("left"),
    )
    convs = stored(convs, "convs")
    turns = placed(rows, runs.join(convs, "conv_id"), "h", "taken")
    kept = turns.where("pos >= h").selectExpr("conv_id", "taken + pos - h AS depth", "h1", "h2", "chars")
    heads = placed(rows, runs.where(f"conv_id % {family} = 0")).where(F.col("pos") < most - 1)
    heads = heads.withColumnRenamed("conv_id", "base")
    given = convs.where("taken > 0").join(heads, "base").where("pos < taken").select(
        "conv_id", F.col("pos").alias("depth"), "h1", "h2", "chars"
    )
    return kept.unionByName(given), convs.selectExpr("conv_id", "taken + left AS turns")


def segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id``, ``seg``, ``p1``, ``p2`` (hash of all earlier turns), ``turns`` (two hashes and the
    length of each), ``e1``, ``e2`` (hash up to the end), ``last`` (no segment follows)."""
    kind = "array<struct<f1:bigint,f2:bigint,chars:bigint>>"
    held = turns.select(
        "conv_id", F.expr(f"int(depth DIV {SEGMENT})").alias("seg"),
        F.struct(
            "depth", F.xxhash64("depth", "h1", "h2").alias("f1"),
            F.xxhash64(F.lit(1), "depth", "h1", "h2").alias("f2"), "chars",
        ).alias("t"),
    ).groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list("t")).alias("ts")).select(
        "conv_id", "seg",
        F.expr("transform(ts, t -> named_struct('f1', t.f1, 'f2', t.f2, 'chars', t.chars))").cast(kind).alias("turns"),
    )
    none = convs.where("turns = 0").select("conv_id", F.lit(0).alias("seg"), F.expr(f"CAST(array() AS {kind})").alias("turns"))
    every = held.unionByName(none)
    for i in (1, 2):
        every = every.withColumn(f"x{i}", F.expr(f"aggregate(turns, 0L, (s, t) -> s ^ t.f{i})"))
    along = Window.partitionBy("conv_id").orderBy("seg")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    for i in (1, 2):
        every = every.withColumn(f"p{i}", F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)))
    every = every.withColumn("last", F.lead("seg").over(along).isNull())
    return stored(every.selectExpr(
        "conv_id", "seg", "p1", "p2", "turns", "p1 ^ x1 AS e1", "p2 ^ x2 AS e2", "last"
    ), "segments")


class _Rows:
    """Sorted segments of a block as arrays: turn ``t`` of row ``i`` lies at ``start[i] + t``."""

    def __init__(self, turns: pa.ListArray):
        self.length = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        flat = turns.flatten()
        self.f1, self.f2, self.chars = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))

    def matrix(self, values: np.ndarray) -> np.ndarray:
        """A row per segment, zeros after its end."""
        out = np.zeros((len(self.length), max(1, int(self.length.max()))), dtype=values.dtype)
        out[np.arange(out.shape[1]) < self.length[:, None]] = values
        return out


def joined(length: np.ndarray, lcp: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union-find over the edges between neighbours, deepest first; an edge below 0 joins nothing.

    The contracted forest: of every end or branching node its depth, first and last row, least name,
    and the depth of the node above it, or -1.
    """
    n = len(length)
    depth, lo, hi, least = length.tolist(), list(range(n)), list(range(n)), names.tolist()
    above, alias, up, top = [-1] * n, list(range(n)), list(range(n)), list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    order = np.argsort(-lcp, kind="stable")
    for edge in order[: int((lcp >= 0).sum())].tolist():
        d = int(lcp[edge])
        a, b = find(edge), find(edge + 1)
        x, y = top[a], top[b]
        if depth[x] != d and depth[y] != d:  # a new branching node
            depth.append(d), lo.append(lo[x]), hi.append(hi[y])
            least.append(min(least[x], least[y])), above.append(-1), alias.append(len(alias))
            above[x] = above[y] = new = len(alias) - 1
        else:
            new, other = (x, y) if depth[x] == d else (y, x)
            if depth[other] == d:
                alias[other] = new
            else:
                above[other] = new
            lo[new], hi[new], least[new] = lo[x], hi[y], min(least[x], least[y])
        up[b] = a
        top[a] = new
    depth, lo, hi, least = (np.array(v, dtype=np.int64) for v in (depth, lo, hi, least))
    above, alias = np.array(above, dtype=np.int64), np.array(alias, dtype=np.int64)
    while (alias[alias] != alias).any():
        alias = alias[alias]
    real = np.flatnonzero(alias == np.arange(len(alias)))
    over = np.where(above[real] < 0, -1, depth[alias[above[real]]])
    return depth[real], lo[real], hi[real], least[real], over


def _forest(batches):
    """Nodes of each block of sorted segments; ``open`` ones may go on in another block."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, seg, p1, p2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        rows = _Rows(batch.column(4))
        first, second, chars = rows.matrix(rows.f1), rows.matrix(rows.f2), rows.matrix(rows.chars)
        inside = np.arange(first.shape[1]) < rows.length[:, None]
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1]) & inside[1:] & inside[:-1]
        lcp = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        lcp[(seg[1:] != seg[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])] = -1
        depth, lo, hi, least, over = joined(rows.length, lcp, conv)
        # The root of all stands at depth 0; the tops of deeper tries are nodes of earlier segments.
        over = np.where(over < 0, np.where(seg[lo] == 0, -1, 0), over)
        count = np.maximum(depth - over, 0)
        node = np.repeat(np.arange(len(depth)), count)
        level = ragged(np.arange(SEGMENT + 1), over + 1, count)
        row = lo[node]
        after = [
            np.concatenate([p[:, None], np.bitwise_xor.accumulate(f, axis=1) ^ p[:, None]], axis=1)
            for p, f in ((p1, first), (p2, second))
        ]
        at = [a[row, level] for a in after]
        up = [pa.array(a[row, np.maximum(level - 1, 0)], pa.int64(), mask=level == 0) for a in after]
        size = np.where(level > 0, chars[row, np.maximum(level - 1, 0)], 0)
        open_ = (lo == 0) | (hi == n - 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(level + SEGMENT * seg[row].astype(np.int64)), *map(pa.array, at), *up,
                pa.array(least[node]), pa.array((hi - lo + 1)[node]), pa.array(size, pa.int64()), pa.array(open_[node]),
            ],
            [*_KEY, "q1", "q2", "conv_id", "n_convs", "chars", "open"],
        )


def nodes(parts: DataFrame) -> DataFrame:
    """The nodes of the trie: key (depth and hash), hash of the parent, least member, members, and
    code points of the last text."""
    order = ["seg", "p1", "p2", "turns", "conv_id"]
    found = parts.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "seg", "p1", "p2", "turns"
    ).mapInArrow(
        _forest, "depth long, p1 long, p2 long, q1 long, q2 long, conv_id long, n_convs long, chars long, open boolean"
    )
    found = stored(found, "forest")
    merged = found.where("open").groupBy(*_KEY).agg(
        F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.min("chars").alias("chars"),
    )
    return found.where("NOT open").drop("open").unionByName(merged)


def _subtree_shares(batches):
    """What each member adds to the sums of the nodes it passes."""
    for batch in batches:
        seg, p1, p2, more_saved, more_leaves = (
            batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 5, 6)
        )
        rows = _Rows(batch.column(3))
        after = [
            np.concatenate([p[:, None], np.bitwise_xor.accumulate(rows.matrix(f), axis=1) ^ p[:, None]], axis=1)
            for p, f in ((p1, rows.f1), (p2, rows.f2))
        ]
        n, width = after[0].shape
        own = batch.column(4)
        lengths = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, place = own.flatten(), np.repeat(np.arange(n), lengths)
        saved, leaves = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
        level = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
        saved[place, level] = flat.field(1).to_numpy(zero_copy_only=False)
        leaves[place, level] = flat.field(2).to_numpy(zero_copy_only=False)
        saved = saved[:, ::-1].cumsum(axis=1)[:, ::-1] + more_saved[:, None]
        leaves = leaves[:, ::-1].cumsum(axis=1)[:, ::-1] + more_leaves[:, None]
        levels = np.arange(width)
        take = (levels <= rows.length[:, None]) & ((levels > 0) | (seg[:, None] == 0)) & ((saved > 0) | (leaves > 0))
        row, level = np.nonzero(take)
        yield pa.RecordBatch.from_arrays(
            [pa.array(level + SEGMENT * seg[row].astype(np.int64)), *(pa.array(a[row, level]) for a in after),
             pa.array(saved[row, level]), pa.array(leaves[row, level])],
            [*_KEY, "saved_tokens", "n_leaves"],
        )


def _subtrees(found: DataFrame, parts: DataFrame) -> DataFrame:
    """``saved_tokens`` and ``n_leaves`` of every node's subtree, by key."""
    seg = F.expr(f"int(greatest(depth - 1, 0) DIV {SEGMENT})")
    leaf = F.expr("IF(n_children = 0, 1L, 0L)")
    own = found.select(
        "conv_id", seg.alias("seg"),
        F.struct(
            (F.col("depth") - SEGMENT * seg).cast("long").alias("level"),
            F.expr("(n_convs - 1) * chars").alias("saved"), leaf.alias("leaf"),
        ).alias("o"),
    ).groupBy("conv_id", "seg").agg(
        F.collect_list("o").alias("own"), F.sum("o.saved").alias("saved"), F.sum("o.leaf").alias("leaves")
    )
    later = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.select("conv_id", "seg", "p1", "p2", "turns").join(own, ["conv_id", "seg"], "left").select(
        "seg", "p1", "p2", "turns", "own",
        F.coalesce(F.sum("saved").over(later), F.lit(0)).alias("more_saved"),
        F.coalesce(F.sum("leaves").over(later), F.lit(0)).alias("more_leaves"),
    )
    shares = rows.mapInArrow(_subtree_shares, "depth long, p1 long, p2 long, saved_tokens long, n_leaves long")
    return shares.groupBy(*_KEY).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))


def _ends(parts: DataFrame) -> DataFrame:
    """``ends_sha256`` by key, for nodes where conversations end."""
    ends = parts.where("last").select(
        F.expr(f"bigint(seg) * {SEGMENT} + size(turns)").alias("depth"), F.col("e1").alias("p1"),
        F.col("e2").alias("p2"), "conv_id",
    ).repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id")

    def run(batches):
        key, digest, out = None, None, []

        def flush():
            columns = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()])], [*_KEY, "ends_sha256"]
            )

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in columns[:3]:
                change[1:] |= c[1:] != c[:-1]
            starts = np.append(0, np.flatnonzero(change))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                if a == b:
                    continue
                here = tuple(int(c[a]) for c in columns[:3])
                text = ",".join(map(str, columns[3][a:b].tolist()))
                if here == key:
                    digest.update(("," + text).encode())
                    continue
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = here, hashlib.sha256(text.encode())
            if out:
                yield flush()
        if key:
            out.append((*key, digest.hexdigest()))
            yield flush()

    return ends.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node. ``turns``: ``conv_id``, ``depth`` from 0, ``h1``, ``h2``, ``chars``; ``convs``:
    every ``conv_id`` with its number of ``turns``, which may be none."""
    parts = segments(turns, convs)
    found = nodes(parts)
    children = found.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")
    ).agg(F.count("*").alias("n_children"))
    found = stored(
        found.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes"
    )
    parents = found.select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    named = sized_join(found, parents, ["depth", "q1", "q2"]).selectExpr("l.*", "parent_conv_id")
    none = hashlib.sha256().hexdigest()
    return named.join(_subtrees(found, parts), _KEY, "left").join(_ends(parts), _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def rebuilt_trie(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    family: int = 100, most: int = 6,
) -> DataFrame:
    """:func:`trie` of the conversations after :func:`rebuilt`."""
    return trie(*rebuilt(numbered(df, conv, turn, role, text), family, most))
