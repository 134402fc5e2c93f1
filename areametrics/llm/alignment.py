"""Two tokenizers' tokens of the same texts, aligned by their bytes.

A, a byte-level tokenizer, takes a space and the text; B, a piece tokenizer, takes the text and adds
the space itself; strings of special tokens inside texts are plain text. The tokens of both are sorted
together by where they start; the running maximum of their ends says where a start reaches all that
came before, and there a new *group* opens: both have a token that ends there. Inside the groups each
pair of tokens whose bytes overlap is a *link*.

How many documents hold a pair of ids linked is a number over the whole corpus. Texts are encoded
once: a document's distinct pairs are written with their number of links, in blocks of about
``BLOCK_BYTES`` of text. Each block's distinct pairs are counted before they are exchanged, summed by
pair, and the sums a block needs come back to it, so what travels is the distinct pairs of blocks.

Texts that are null or empty, or whose tokens of A or B do not give back the bytes, have no tokens:
zeros and an empty digest. Rows that repeat an id (null is an id like any other) are one document, its
least text. A text of any length is encoded whole, as a block of its own if it is long. Ties for the
highest count all count as best. Other columns are left out, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areametrics.llm.common import groups, lists, one_per_id, text_bytes
from areametrics.llm.units import Units, ragged
from areametrics.operators.joins import sized_join
from areametrics.sources.shared import stored

BLOCK_BYTES = 8 << 20
_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes for
    themselves, the others for characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class _Vocabulary:
    """Bytes and decimal digits of every id, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.size = len(entries)
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        digits = [str(i).encode() for i in range(len(entries))]
        self.digit_counts = np.array([len(d) for d in digits], np.int64)
        self.digit_starts = np.cumsum(self.digit_counts) - self.digit_counts
        self.digits = np.frombuffer(b"".join(digits), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.bytes, self.starts[ids], self.lengths[ids])


class Tokenizers:
    """Both tokenizers, loaded once per worker process."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Units(a_path)
        self.a.tokenizer.encode_special_tokens = True
        self.a.units.clear()
        self.a.chunks.clear()
        for token in self.a.tokenizer.get_added_tokens_decoder().values():
            text = f"x{token.content} y,{token.content}.z"
            if self.a.encode([text.encode()])[0].tolist() != self.a.plain(text):
                raise ValueError(f"{a_path}: {text!r} is not the sum of its units")
        alphabet = byte_alphabet()
        size = self.a.tokenizer.get_vocab_size(with_added_tokens=True)
        entries = [self.a.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.a_entries = _Vocabulary([
            bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries
        ])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            pieces.append(
                bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            )
        self.b_entries = _Vocabulary(pieces)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """Space and text of all texts that are not empty, with offsets, and the ids and number of
        ids of each by A and by B."""
        length = np.diff(offsets)
        spaced = np.append(0, np.cumsum(length + (length > 0)))
        whole = np.full(int(spaced[-1]), 0x20, np.uint8)
        keep = np.ones(len(whole), dtype=bool)
        keep[spaced[:-1][length > 0]] = False
        whole[keep] = data
        ids_a, n_a = self.a.group(whole, spaced)
        raw = data.tobytes()
        texts = [raw[i:j].decode() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        found = self.b.encode(texts, num_threads=1)
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        ids_b = np.fromiter((i for ids in found for i in ids), np.int64, int(n_b.sum()))
        return whole, spaced, ids_a.astype(np.int64), n_a, ids_b, n_b


def _per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def faithful(whole: np.ndarray, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray, entries) -> np.ndarray:
    """Which texts the tokens spell out exactly."""
    length = np.diff(offsets)
    good = (_per_text(entries.lengths[ids], counts) == length) & (length > 0)
    spelled = entries.spelled(ids[np.repeat(good, counts)])
    wrong = spelled != whole[np.repeat(good, length)]
    if wrong.any():
        owner = np.repeat(np.flatnonzero(good), length[good])
        good[owner[wrong]] = False
    return good


def coalesced(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple:
    """Group number (from 0) of every token of A and of B: sorted by start, a group opens where a
    start reaches the greatest end before it."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    side = np.repeat([0, 1], [len(start_a), len(start_b)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = start[order][1:] >= reach[:-1]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(opens) - 1
    return number[: len(start_a)], number[len(start_a) :]


def overlapping(start_a, end_a, start_b, end_b) -> tuple[np.ndarray, np.ndarray]:
    """Indices of A and B tokens for every pair whose bytes overlap. Tokens of each side follow one
    another, so those of B that a token of A meets are a run."""
    first = np.searchsorted(end_b, start_a, "right")
    count = np.searchsorted(start_b, end_a, "left") - first
    return np.repeat(np.arange(len(start_a)), count), ragged(np.arange(len(start_b)), first, count)


def written(ids_a, group_a, ids_b, group_b, both: Tokenizers) -> tuple[np.ndarray, np.ndarray]:
    """All groups as bytes, ``a1,a2|b1;`` each, and the group of every byte."""
    group = np.concatenate([group_a, group_b])
    side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
    order = np.lexsort((side, group))
    group, side = group[order], side[order]
    count = np.concatenate([both.a_entries.digit_counts[ids_a], both.b_entries.digit_counts[ids_b]])[order]
    base = len(both.a_entries.digits)
    start = np.concatenate([both.a_entries.digit_starts[ids_a], base + both.b_entries.digit_starts[ids_b]])[order]
    digits = np.concatenate([both.a_entries.digits, both.b_entries.digits])
    last = np.cumsum(count + 1) - 1
    out = np.empty(int(last[-1]) + 1 if len(last) else 0, np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[last] = False
    out[inside] = ragged(digits, start, count)
    mark = np.full(len(group), ord(","), np.uint8)
    if len(group):
        mark[:-1][side[1:] != side[:-1]] = ord("|")
        mark[:-1][group[1:] != group[:-1]] = ord(";")
        mark[-1] = ord(";")
    out[last] = mark
    return out, np.repeat(group, count + 1)


def aligned(both: Tokenizers, data: np.ndarray, offsets: np.ndarray) -> dict:
    """Figures and digest of every text, and its distinct linked pairs with their number of links."""
    n = len(offsets) - 1
    whole, spaced, ids_a, n_a, ids_b, n_b = both.encode(data, offsets)
    good = faithful(whole, spaced, ids_a, n_a, both.a_entries) & faithful(whole, spaced, ids_b, n_b, both.b_entries)
    ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
    n_a, n_b = n_a * good, n_b * good
    end_a, end_b = np.cumsum(both.a_entries.lengths[ids_a]), np.cumsum(both.b_entries.lengths[ids_b])
    start_a, start_b = end_a - both.a_entries.lengths[ids_a], end_b - both.b_entries.lengths[ids_b]
    group_a, group_b = coalesced(start_a, end_a, start_b, end_b)
    text_a = np.repeat(np.arange(n), n_a)
    first = np.ones(len(group_a), dtype=bool)
    first[1:] = group_a[1:] != group_a[:-1]
    n_groups = np.bincount(text_a[first], minlength=n)

    spelled, group = written(ids_a, group_a, ids_b, group_b, both)
    owner = text_a[first]  # the text of each group
    size = np.bincount(owner[group], minlength=n) if len(group) else np.zeros(n, np.int64)
    ends = np.cumsum(size)
    raw = spelled.tobytes()
    digests = [
        hashlib.sha256(raw[e - s : e - 1]).hexdigest() if s else "" for s, e in zip(size.tolist(), ends.tolist())
    ]

    link_a, link_b = overlapping(start_a, end_a, start_b, end_b)
    text = text_a[link_a]
    pairs = both.a_entries.size * both.b_entries.size
    code, times = np.unique(text * pairs + ids_a[link_a] * both.b_entries.size + ids_b[link_b], return_counts=True)
    distinct = np.bincount(code // pairs, minlength=n)
    code %= pairs
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(text, minlength=n), "digest": digests,
        "a": code // both.b_entries.size, "b": code % both.b_entries.size, "times": times, "distinct": distinct,
    }


_HELD: dict[tuple[str, str], Tokenizers] = {}


def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _HELD:
        _HELD[a_path, b_path] = Tokenizers(a_path, b_path)
    return _HELD[a_path, b_path]


def encoded(rows: DataFrame, key: str, a_path: str, b_path: str) -> DataFrame:
    """Figures per document, ``groups_sha256``, ``block``, and the distinct pairs ``a``, ``b``,
    ``times`` as arrays."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        both = tokenizers_of(a_path, b_path)
        block, filled = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in groups(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if filled and filled + len(part) > BLOCK_BYTES:
                    block, filled = block + 1, 0
                filled += len(part)
                found = aligned(both, part, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(np.full(j - i, block), pa.int64()),
                        *(pa.array(found[c], pa.int64()) for c in _FIGURES), pa.array(found["digest"], pa.string()),
                        *(lists(found[c], found["distinct"], pa.int32()) for c in ("a", "b", "times")),
                    ],
                    [key, "block", *_FIGURES, "groups_sha256", "a", "b", "times"],
                )

    return rows.mapInArrow(
        run, f"`{key}` {kind}, block long, " + ", ".join(f"{c} long" for c in _FIGURES)
        + ", groups_sha256 string, a array<int>, b array<int>, times array<int>",
    )


def _codes(a, b) -> np.ndarray:
    a, b = (np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.int64) for c in (a, b))
    return (a << 32) | b


def block_pairs(docs: DataFrame) -> DataFrame:
    """``block``, ``code`` (both ids of a pair) and ``n``, how many of the block's documents hold it.
    A block that two tasks read gives two rows for a pair."""

    def run(batches):
        held, block = [], None

        def closed():
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(code), block), pa.int64()), pa.array(code), pa.array(n, pa.int64())],
                ["block", "code", "n"],
            )

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if held and blocks[i] != block:
                    yield closed()
                    held = []
                block = int(blocks[i])
                held.append(_codes(batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i)))
        if held:
            yield closed()

    return docs.select("block", "a", "b").mapInArrow(run, "block long, code long, n long")


def counted(docs: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Documents with ``n_best`` and ``count_sum``; ``pairs`` gives each block what it needs."""
    names = [key, *_FIGURES, "groups_sha256", "n_best", "count_sum"]
    kind = docs.schema[key].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        code, where = np.unique(right.column("code").to_numpy(), return_index=True)
        count = right.column("count").to_numpy()[where]
        best = right.column("best").to_numpy()[where]
        columns = {c: left.column(c).combine_chunks() for c in ("a", "b", "times")}
        lengths = columns["a"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(code, _codes(columns["a"], columns["b"]))
        times = columns["times"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        more = [times * best[at], times * count[at]] if len(at) else [times, times]
        sums = [pa.array(_per_text(v, lengths), pa.int64()) for v in more]
        return pa.Table.from_arrays(
            [*(left.column(c) for c in names[:-2]), *sums], names=names
        )

    return docs.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(
        run, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in _FIGURES)
        + ", groups_sha256 string, n_best long, count_sum long",
    )


def align(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: tokens of A and B, groups and their digest, links, links whose pair is its
    A id's commonest (``n_best``), and the pairs' counts summed over the links (``count_sum``)."""
    docs = stored(encoded(one_per_id(df, key, text), key, a_path, b_path), "aligned")
    pairs = stored(block_pairs(docs), "pairs")
    counts = pairs.groupBy("code").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("a", F.shiftright("code", 32))
    counts = stored(counts, "counts")
    # As many rows as A has ids at most.
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    counts = counts.join(F.broadcast(highest), "a").selectExpr("code", "count", "int(count = highest) AS best")
    needed = sized_join(pairs.select("block", "code"), counts, ["code"], how="inner").selectExpr(
        "l.block", "l.code", "count", "best"
    )
    return counted(docs, needed, key).select(
        key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
