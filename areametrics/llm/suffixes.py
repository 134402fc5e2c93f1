"""Repeated passages by an enhanced suffix array.

A byte is removed if a string of ``length`` bytes over it also starts earlier, in a document of
smaller id or further up in its own. Three steps find all such strings:

1. *Anchors.* Among the ``length`` bytes from every position the least-hashed run of ``GRAM`` bytes
   is the anchor. Equal strings have equal anchors at equal offsets, and neighbouring positions
   mostly share one, so a text needs an anchor every ``(length - GRAM) / 2`` bytes or so. The bytes
   all strings of an anchor cover are its *stretch*.
2. *Classes.* Anchors of equal run and equal stretch (128 hash bits) are one class, combined within
   each batch of documents before the shuffle; all but its first member are repeated throughout.
3. *Suffix array.* Runs that stand in different stretches have their stretches compared, if those agree
   on one side of the run: a string holds half of its other bytes before the run or half of them behind
   it, so 16 hash bits of either side tell most chance meetings of short runs apart before any text
   moves. The first stretch of every such class goes into a suffix array with the lengths of common prefixes. A stack
   scan over it enumerates the interval tree of prefixes of ``length`` bytes or more. An interval
   whose suffixes have different bytes (or none) to their left cannot be extended to the left: it
   is a maximal repeat, and the group of all its occurrences is put out, not neighbours only. All
   but the first occurrence of a group are repeated. (An interval with one left byte is covered by
   the longer repeat that starts with that byte.)

Runs that stand in more than ``WIDE`` different stretches, such as a short common header, are taken
apart: each string is sent by its own hash, one per batch of documents, and compared in a stream.

Null text is empty; null and empty texts have nothing to remove. A null id sorts before all others.
Repeated ids are one document. An empty table gives no rows. Whole texts are used. Only key and text
are read, so other columns may have any name; the key must cast to long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areametrics.llm.common import SpanHash, groups, mixed, one_per_id, text_bytes
from areametrics.operators.joins import sized_join
from areametrics.sources.shared import stored

GRAM = 32
#: More different stretches of one run than this are taken apart.
WIDE = 5_000
#: A suffix array is built over about so many bytes at a time; all stretches of a run that is not
#: wide have less.
ARRAY_BYTES = 1 << 20
NULL_ID = -(1 << 63)

#: Distances to an anchor, less than ``length - GRAM + 1``, are held in eight bits.
LONGEST = GRAM + 255
_PLACE_BITS = np.uint64(28)
_PLACE = np.uint64((1 << 28) - 1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Row, anchor, first and last string start of all anchors (starts count from the group's
    first byte), the hashes of run and stretch, and of both sides of the run: 16 bits for the half before
    it and 16 for that behind it, 0 for a half that is not all in the stretch."""
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(np.int32))
    if len(data) < length:
        return nothing
    hashed = SpanHash(data)
    runs = hashed.windows(GRAM)
    keyed = (runs & ~_PLACE) | np.arange(len(runs), dtype=np.uint64)
    least = (sliding_least(keyed, length - GRAM + 1) & _PLACE).astype(np.int64)
    # Starts whose string ends within their text.
    fits = np.zeros(len(least) + 1, dtype=np.int8)
    sizes = np.diff(offsets)
    long = sizes >= length
    np.add.at(fits, offsets[:-1][long], 1)
    np.add.at(fits, (offsets[1:] - length + 1)[long], -1)
    starts = np.flatnonzero(np.cumsum(fits[:-1]))
    if not len(starts):
        return nothing
    at = least[starts]
    opens = np.append(True, (np.diff(at) != 0) | (np.diff(starts) != 1))
    first = starts[opens]
    last = starts[np.append(opens[1:], True)]
    at = at[opens]
    row = np.searchsorted(offsets, first, "right") - 1
    stretch = mixed(hashed(first, last + length) + mixed((at - first).astype(np.uint64)))
    half, sides = (length - GRAM + 1) // 2, np.zeros(len(at), dtype=np.uint32)
    for shift, a, b in ((16, at - half, at), (0, at + GRAM, at + GRAM + half)):
        whole = np.flatnonzero((a >= first) & (b <= last + length))
        hash_ = hashed.raw(a[whole], b[whole]) if half else np.zeros(len(whole), np.uint64)
        sides[whole] |= ((mixed(hash_) % np.uint64(0xFFFF)).astype(np.uint32) + np.uint32(1)) << np.uint32(shift)
    return row, at, first, last, runs[at], stretch, sides.view(np.int32)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as ranges that do not touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    opens = np.append(True, starts[1:] > ends[:-1])
    return starts[opens], ends[np.append(opens[1:], True)]


def _anchor_rows(docs: DataFrame, length: int, fold: bool = True) -> DataFrame:
    """``run``, ``stretch``, ``id``, ``place``, ``sides``: the first anchor of each class in a batch, and
    what the batch by itself shows to be repeated, as ranges (``place`` is -1 - start, ``stretch`` the
    length, ``run`` arbitrary, ``sides`` 0). An anchor's place is start << 16 | anchor - start << 8 | more
    starts. Without ``fold`` every anchor has a row."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            found = []
            for i, j in groups(offsets):
                base = offsets[i]
                row, at, first, last, gram, stretch, sides = anchors(
                    data[base : offsets[j]], offsets[i : j + 1] - base, length
                )
                start = first + base - offsets[row + i]
                found.append((row + i, start, at - first, last - first, gram, stretch, sides))
            if not found:
                continue
            row, start, lead, more, gram, stretch, sides = map(np.concatenate, zip(*found))
            rank = np.argsort(np.argsort(ids, kind="stable"))
            place = (rank[row] << 32) | start
            order = np.lexsort((place, mixed(gram + mixed(stretch))))
            gram, stretch = gram[order], stretch[order]
            new = np.append(True, (np.diff(gram) != 0) | (np.diff(stretch) != 0))[: len(order)] | (not fold)
            rest = np.sort(order[~new])  # by row and start
            # Ranges over one number line, a gap between rows.
            line = row[rest] << 33
            a, b = merged(line + start[rest], line + start[rest] + more[rest] + length)
            keep = order[new]
            packed = (start[keep] << 16) | (lead[keep] << 8) | more[keep]
            owner = ids[a >> 33]
            a, size = a & ((1 << 33) - 1), b - a
            spread = mixed(owner.view(np.uint64) + mixed(a.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([gram[new], spread]).view(np.int64)),
                    pa.array(np.concatenate([stretch[new].view(np.int64), size])),
                    pa.array(np.concatenate([ids[row[keep]], owner])),
                    pa.array(np.concatenate([packed, -1 - a])),
                    pa.array(np.concatenate([sides[keep], np.zeros(len(a), np.int32)])),
                ],
                ["run", "stretch", "id", "place", "sides"],
            )

    return docs.select("id", "text").mapInArrow(run, "run long, stretch long, id long, place long, sides int")


def _sorted_out(rows: DataFrame) -> DataFrame:
    """What is repeated for sure (``stretches`` null) and the first anchors of classes that agree with
    another class of their run on a side of it, with the number of these."""
    own = Window.partitionBy("run", "stretch").orderBy("id", "place")
    run = Window.partitionBy("run")
    # Dealt by run, rows lie right for both windows.
    marked = rows.repartition("run").withColumn("nth", F.row_number().over(own)).withColumn(
        "stretches", F.sum(F.when((F.col("nth") == 1) & (F.col("place") >= 0), 1).otherwise(0)).over(run)
    )
    marked = marked.where("place < 0 OR nth > 1 OR stretches > 1")
    first, alike = (F.col("place") >= 0) & (F.col("nth") == 1), F.lit(False)
    for side in (F.shiftrightunsigned("sides", 16), F.col("sides").bitwiseAND(0xFFFF)):
        count = F.sum(F.when(first, 1).otherwise(0)).over(Window.partitionBy("run", side))
        alike = alike | ((side != 0) & (count > 1))
    marked = marked.withColumn("alike", first & alike).withColumn(
        "stretches", F.sum(F.col("alike").cast("int")).over(run)
    )
    return marked.where("place < 0 OR nth > 1 OR alike").select(
        "run", "id", "place", "stretch", F.when(F.col("alike"), F.col("stretches")).alias("stretches")
    )


def _stretches(docs: DataFrame, asked: DataFrame, length: int, wide: int, fold: bool = True) -> DataFrame:
    """``key``, ``id``, ``start``, ``more``, ``bytes`` of the stretches asked for. Those of wide
    runs come string by string; with ``fold``, strings that repeat within a batch come back as ranges
    with a null key (``more`` is then the length)."""
    per_doc = asked.groupBy("id").agg(
        F.collect_list(F.struct("run", "place", (F.col("stretches") > wide).alias("wide"))).alias("asked")
    )
    joined = docs.join(per_doc, "id").select("id", "text", "asked")

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            data, offsets = text_bytes(batch.column(1))
            raw = data.tobytes()
            ids = batch.column(0).to_numpy()
            listed = batch.column(2)
            flat = listed.flatten()
            row = np.repeat(np.arange(len(batch)), listed.value_lengths().to_numpy())
            key = flat.field("run").to_numpy()
            place = flat.field("place").to_numpy()
            wide_ = flat.field("wide").to_numpy(zero_copy_only=False)
            start, more = place >> 16, place & 255
            a = offsets[row] + start
            narrow = ~wide_
            out = [[key[narrow], ids[row[narrow]], start[narrow], more[narrow],
                    list(zip(a[narrow].tolist(), (a + more + length)[narrow].tolist()))]]
            gone = [np.zeros(0, np.int64)] * 3
            if wide_.any():
                # One string each, by its own hash; only the first of a batch is sent on.
                n = more[wide_] + 1
                w_row = np.repeat(row[wide_], n)
                w_start = np.repeat(start[wide_], n) + np.concatenate([np.arange(k) for k in n])
                w_a = offsets[w_row] + w_start
                spread = np.concatenate([
                    SpanHash(data[offsets[r] : offsets[r + 1]])(
                        w_start[w_row == r], w_start[w_row == r] + length
                    ) for r in np.unique(w_row)
                ])
                order = np.lexsort((w_start, ids[w_row], spread))
                new = np.append(True, np.diff(spread[order]) != 0) | (not fold)
                keep, rest = order[new], order[~new]
                out.append([spread[keep].view(np.int64), ids[w_row[keep]], w_start[keep],
                            np.zeros(len(keep), np.int64),
                            list(zip(w_a[keep].tolist(), (w_a[keep] + length).tolist()))])
                gone = [ids[w_row[rest]], w_start[rest], np.full(len(rest), length)]
            for keys, who, first, extra, spans in out:
                for i in range(0, len(keys), 20_000):
                    s = slice(i, i + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[s]), pa.array(who[s]), pa.array(first[s]), pa.array(extra[s]),
                         pa.array([raw[x:y] for x, y in spans[s]], pa.binary())],
                        ["key", "id", "start", "more", "bytes"],
                    )
            if len(gone[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(gone[0]), pa.int64()), *map(pa.array, gone),
                     pa.nulls(len(gone[0]), pa.binary())],
                    ["key", "id", "start", "more", "bytes"],
                )

    return joined.mapInArrow(run, "key long, id long, start long, more long, bytes binary")


def shared_parts(more: np.ndarray, texts: list[bytes], length: int):
    """What of the texts a suffix array has to order: ``piece``, ``a``, ``b``, the texts that share a
    string with others and their bytes from the first such string to the end of the last; and ``own``,
    ``ahead``, the part of each such string and its start in there. All maximal repeats lie inside: a
    shared byte before or behind a shared string makes another."""
    offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    piece = np.repeat(np.arange(len(texts)), more + 1)
    ahead = np.arange(len(piece)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    at = offsets[piece] + ahead
    hashed = SpanHash(np.frombuffer(b"".join(texts), np.uint8)).raw(at, at + length)
    order = np.argsort(hashed)
    same = hashed[order[1:]] == hashed[order[:-1]]
    found = np.sort(order[np.append(same, False) | np.append(False, same)])
    piece, ahead = piece[found], ahead[found]
    opens = np.append(True, np.diff(piece) != 0)[: len(piece)]
    first, last = np.flatnonzero(opens), np.flatnonzero(np.append(opens[1:], True)[: len(piece)])
    own = np.cumsum(opens) - 1
    return piece[first], ahead[first], ahead[last] + length, own, ahead - ahead[first][own]


class SuffixArray:
    """Suffixes of several pieces in order, with the lengths of the prefixes that neighbours share.

    A piece ends with a mark of its own, so all suffixes differ and no prefix runs over an end.
    Ranks of prefixes of 8, 16, .. bytes come from one another by doubling; the length that two
    suffixes share is read off them, from the longest down. Only the suffixes ``wanted`` are listed.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
        n = len(data)
        sizes = np.diff(offsets)
        self.data = data
        self.left = np.repeat(offsets[1:], sizes) - np.arange(n)
        head = np.zeros(n, dtype=np.uint64)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        for i in range(8):
            byte = np.where(self.left > i, padded[i : i + n], 0).astype(np.uint64)
            head = (head << np.uint64(8)) | byte
        # Of equal heads the shorter suffix comes first, then each end mark by itself.
        mark = np.where(self.left < 8, self.left * (n + 1) + np.arange(1, n + 1), 8 * (n + 1))
        ranks = self._pair_ranks(self._ranks(head), mark)
        self.levels, size = [(8, ranks)], 8
        while size <= sizes.max():
            ahead = np.zeros(n, dtype=np.int32)
            ahead[: n - size] = ranks[size:] + 1
            # Of a suffix that ends before ``size`` bytes the rank is its own already.
            ranks = self._pair_ranks(ranks, np.where(self.left > size, ahead, 0))
            size *= 2
            self.levels.append((size, ranks))
        self.suffixes = wanted[np.argsort(ranks[wanted])]
        self.shared = self._common(self.suffixes[:-1], self.suffixes[1:])

    @staticmethod
    def _ranks(values: np.ndarray) -> np.ndarray:
        order = np.argsort(values)
        a = values[order]
        out = np.empty(len(order), dtype=np.int32)
        out[order] = np.append(0, np.cumsum(a[1:] != a[:-1]))
        return out

    @classmethod
    def _pair_ranks(cls, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Both are under 2 ** 32: sorting whole numbers is much faster than sorting pairs."""
        return cls._ranks((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64))

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = np.zeros(len(a), dtype=np.int64)
        most = np.minimum(self.left[a], self.left[b]) if len(a) else size
        for step, ranks in reversed(self.levels):
            fits = np.flatnonzero(size + step <= most)
            size[fits] += step * (ranks[a[fits] + size[fits]] == ranks[b[fits] + size[fits]])
        for _ in range(7):
            fits = np.flatnonzero(size < most)
            same = self.data[a[fits] + size[fits]] == self.data[b[fits] + size[fits]]
            if not same.any():
                break
            size[fits[same]] += 1
            most[fits[~same]] = size[fits[~same]]
        return size

    def repeats(self, least: int, before: np.ndarray):
        """``(shared, first, last)`` of every interval of ``least`` shared bytes or more whose
        suffixes differ in what stands ``before`` them: the maximal repeats, by one scan with a
        stack. ``first`` and ``last`` are places in :attr:`suffixes`."""
        shared = self.shared.tolist()
        before = before[self.suffixes].tolist()
        long = np.flatnonzero(self.shared >= least)
        for run in np.split(long, np.flatnonzero(np.diff(long) > 1) + 1) if len(long) else []:
            stack = []  # shared, first, what stands before all its suffixes or None if they differ
            end = int(run[-1]) + 1
            for i in range(int(run[0]), end + 1):
                size = shared[i] if i < end else 0
                first, common = i, before[i]
                while stack and stack[-1][0] > size:
                    length, first, value = stack.pop()
                    common = value if value == common else None
                    if common is None:
                        yield length, first, i
                if size and stack and stack[-1][0] == size:
                    _, start, value = stack.pop()
                    stack.append((size, start, value if value == common else None))
                elif size:
                    stack.append((size, first, common))


def _grouped(stretches: DataFrame, length: int, occurrences: bool) -> DataFrame:
    """The maximal repeats among the stretches: with ``occurrences`` a row for each (``repeat``,
    ``length``, ``id``, ``start``), else the ranges (``id``, ``start``, ``size``) that repeat an
    earlier one."""
    ready = stretches.where("key IS NOT NULL").repartition("key").sortWithinPartitions("key", "id", "start")
    schema = "repeat long, length long, id long, start long" if occurrences else "id long, start long, size long"

    def work(ids, start, more, texts):
        kept = shared_parts(more, texts, length)
        if not len(kept[0]):
            return None
        piece, a, b, own, ahead = kept
        ids, start = ids[piece], start[piece] + a
        texts = [texts[i][x:y] for i, x, y in zip(piece.tolist(), a.tolist(), b.tolist())]
        offsets = np.append(0, np.cumsum(b - a))
        data = np.frombuffer(b"".join(texts), np.uint8)
        array = SuffixArray(data, offsets, offsets[own] + ahead)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        # The byte before, or the piece itself at its start, which differs from all.
        before = np.append(np.int64(0), data[:-1].astype(np.int64))
        before[offsets[:-1]] = 256 + np.arange(len(texts))
        change = np.zeros(len(data) + 1, dtype=np.int64)
        listed = []
        for shared, first, last in array.repeats(length, before):
            at = array.suffixes[first : last + 1]
            own = owner[at]
            ahead = at - offsets[own]
            if occurrences:
                listed.append((shared, ids[own], start[own] + ahead))
                continue
            # All but the earliest repeat it. Pieces of one document may overlap.
            order = np.lexsort((start[own] + ahead, ids[own]))
            rest = at[order[1:]]
            same = (ids[own[order[0]]] == ids[own[order[1:]]]) & (
                start[own[order[0]]] + ahead[order[0]] == (start[own] + ahead)[order[1:]]
            )
            np.add.at(change, rest[~same], 1)
            np.add.at(change, rest[~same] + shared, -1)
        if occurrences:
            if not listed:
                return None
            # Numbered by their first occurrence and length.
            names = np.zeros(len(listed), np.uint64)
            for part in zip(*((w[0], p[0], n) for n, w, p in listed)):
                names = mixed(names + np.array(part, np.int64).view(np.uint64))
            sizes = [len(w) for _, w, _ in listed]
            return [
                np.repeat(names.view(np.int64), sizes),
                np.repeat(np.array([n for n, _, _ in listed]), sizes),
                np.concatenate([w for _, w, _ in listed]), np.concatenate([p for _, _, p in listed]),
            ]
        covered = np.cumsum(change[:-1]) > 0
        edge = covered.copy()
        edge[1:] &= ~covered[:-1] | (owner[1:] != owner[:-1])
        a = np.flatnonzero(edge)
        stop = covered.copy()
        stop[:-1] &= ~covered[1:] | (owner[1:] != owner[:-1])
        b = np.flatnonzero(stop) + 1
        own = owner[a]
        return [ids[own], start[own] + a - offsets[own], b - a]

    def run(batches):
        held, size = [], 0

        def finish(columns):
            found = work(*columns) if len(columns[0]) else None
            if found and len(found[0]):
                names = [f.split()[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

        def columns(batch_list):
            table = pa.Table.from_batches(batch_list).combine_chunks()
            return table.column("key").to_numpy(), (
                table.column("id").to_numpy(), table.column("start").to_numpy(),
                table.column("more").to_numpy(), table.column("bytes").to_pylist(),
            )

        for batch in batches:
            held.append(batch)
            size += batch.column("bytes").nbytes
            if size < ARRAY_BYTES:
                continue
            keys, found = columns(held)
            # Whole keys only; the last one may go on.
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from finish([c[:cut] for c in found])
                table = pa.Table.from_batches(held).combine_chunks().slice(cut)
            elif found[2].max() == 0:
                # One string by its own hash: its earliest stays to meet the rest.
                yield from finish(found)
                table = pa.Table.from_batches(held).combine_chunks().slice(0, 1)
            else:
                table = pa.Table.from_batches(held)
            held = table.combine_chunks().to_batches()
            size = sum(b.column("bytes").nbytes for b in held) if cut or found[2].max() == 0 else 0
        if held:
            yield from finish(columns(held)[1])

    return ready.mapInArrow(run, schema)


def _prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id`` (null as the least number) and ``text``, one row per id."""
    rows = one_per_id(df, key, text)
    return rows.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text).alias("text"))


def _check(length: int) -> None:
    if not GRAM <= length <= LONGEST:
        raise ValueError(f"strings of {length} bytes: from {GRAM} to {LONGEST} are compared")


def _found(docs: DataFrame, length: int, wide: int) -> tuple[DataFrame, DataFrame]:
    """Anchors sorted out, written once, and the stretches to compare."""
    _check(length)
    rows = stored(_sorted_out(_anchor_rows(docs, length)), "anchors")
    asked = rows.where("stretches IS NOT NULL").select("run", "id", "place", "stretches")
    return rows, stored(_stretches(docs, asked, length, wide), "stretches")


def repeat_groups(
    df: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", wide: int = WIDE
) -> DataFrame:
    """The maximal repeats with all their occurrences, those in exact copies too: ``repeat``,
    ``length``, ``id``, ``start``.

    A class of equal stretches goes into the suffix array by its first and its last member, so that the
    stretch itself is a repeat; what is found is then listed for all members. Repeats longer than a
    stretch appear as overlapping ones, those of wide runs as strings of ``length`` bytes."""
    _check(length)
    docs = _prepared(df, key, text)
    anchors = stored(_anchor_rows(docs, length, fold=False), "anchors")
    classes = anchors.groupBy("run", "stretch").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("first"), F.max(F.struct("id", "place")).alias("last")
    )
    classes = stored(classes, "classes")
    per_run = classes.groupBy("run").agg(F.count("*").alias("stretches"))
    ends = stored(
        classes.join(per_run, "run").where("n > 1 OR stretches > 1").select(
            "run", "stretch", "stretches", F.explode(F.array_distinct(F.array("first", "last"))).alias("end")
        ).select("run", "stretch", "stretches", "end.*"), "ends",
    )
    stretches = stored(_stretches(docs, ends.drop("stretch"), length, wide, fold=False), "stretches")
    found = _grouped(stretches, length, True)
    # Of a document's anchors just one has a given string; its strings lie in at most two buckets of 256.
    first, more = F.shiftright("place", 16), F.col("place").bitwiseAND(255)
    buckets = F.explode(F.array_distinct(F.array(F.shiftright(first, 8), F.shiftright(first + more, 8))))
    owners = ends.select("run", "stretch", "id", first.alias("first"), more.alias("more"), buckets.alias("bucket"))
    owned = found.withColumn("bucket", F.shiftright("start", 8)).join(owners, ["id", "bucket"]).where(
        "start BETWEEN first AND first + more"
    ).selectExpr("repeat", "length", "run", "stretch", "start - first AS ahead").distinct()
    members = sized_join(
        anchors.select("run", "stretch", "id", first.alias("first")), stored(owned, "repeats"), ["run", "stretch"], how="inner"
    )
    own = F.when(F.col("id") != NULL_ID, F.col("id")).alias("id")
    return members.select("repeat", "length", own, (F.col("first") + F.col("ahead")).alias("start"))


def repeated_ranges(docs: DataFrame, length: int, wide: int = WIDE) -> DataFrame:
    """``id``, ``start``, ``size``: ranges whose union is all that repeats an earlier string."""
    rows, stretches = _found(docs, length, wide)
    sure = rows.where("stretches IS NULL").select(
        "id",
        F.expr("CASE WHEN place < 0 THEN -1 - place ELSE shiftright(place, 16) END").alias("start"),
        F.expr(f"CASE WHEN place < 0 THEN stretch ELSE {length} + (place & 255) END").alias("size"),
    )
    streamed = stretches.where("key IS NULL").select("id", "start", F.col("more").alias("size"))
    return sure.unionByName(streamed).unionByName(_grouped(stretches, length, False))


def _spans(column: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray]:
    if not column[i].is_valid:
        none = np.zeros(0, np.int64)
        return none, none
    values = column[i].values
    start = values.field("start").to_numpy()
    return merged(start, start + values.field("size").to_numpy())


def dedup(
    df: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", wide: int = WIDE,
    with_text: bool = False,
) -> DataFrame:
    """A row per document: ``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and,
    if asked for, ``kept_text``, whose cut characters are left out whole."""
    docs = _prepared(df, key, text)
    ranges = repeated_ranges(docs, length, wide).groupBy("id").agg(
        F.collect_list(F.struct("start", "size")).alias("ranges")
    )
    joined = docs.join(ranges, "id", "left").select("id", "text", "ranges")
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw, listed = memoryview(data.tobytes()), batch.column(2)
            out = []
            for i in range(len(batch)):
                a, b = _spans(listed, i)
                base, size = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), size]
                kept = b"".join(
                    raw[base + x : base + y] for x, y in zip(edges[::2], edges[1::2])
                )
                out.append((size, size - len(kept), len(a), hashlib.sha256(kept).hexdigest(),
                            kept.decode(errors="ignore") if with_text else None))
            columns = list(zip(*out)) or [()] * 5
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]),
                      pa.array(columns[3], pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(columns[4], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = joined.mapInArrow(run, schema + (", kept_text string" if with_text else ""))
    own = F.when(F.col("id") != NULL_ID, F.col("id")).cast(kind).alias(key)
    return found.select(own, *found.columns[1:])
