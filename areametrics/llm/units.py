"""Token ids of whole texts by way of spans that are encoded once per worker.

A *unit* is the text between two safe cuts: places where the tokenizer always ends one piece and
starts the next, whatever stands around them. A text's ids are those of its units in order. Cuts:

* before ASCII white space that follows a character which is not Unicode white space;
* before ASCII punctuation (not ``|``) that follows an ASCII letter or digit or a Latin-1 letter.

:class:`Units` tries the rule on probes and on the tokenizer's special tokens and refuses a
tokenizer that breaks it. *Chunks* are runs of units between the places a rolling hash picks; a
unit with such a place in it is the join of two chunks and encoded by itself.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from areametrics.llm.common import SPACE, SpanHash

# Spark runs a worker per core already.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A place is picked where the hash of the last so many bytes has its low ``CHUNK_BITS`` bits 0.
ROLLING_BYTES, CHUNK_BITS = 16, 8
#: A worker holds about so many bytes of ids; then it starts anew.
HELD_BYTES = 48 << 20
#: A longer unit is encoded whenever it is met.
LONGEST_HELD = 256

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "|"]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[b for b in range(0x21, 0x7F) if chr(b).isalnum()]] = True
_PROBES = [
    "a b", "a  b", "a\n\nb", "it's  's 't", "é è", "1 2\t3", "!  ?", "a　b", " lead", "trail ",
    "  ", "###  ***", "l'eau  d'", "́ ́a", "a\xa0 b", "a\xa0  b", "€ , x", "x€,y é,é 1,2", "ab,'s'll",
]


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all units: the safe cuts and the starts of texts, in order."""
    n = len(data)
    cut = np.zeros(n, dtype=bool)
    if n > 1:
        before, here = data[:-1], data[1:]
        two = np.concatenate([np.zeros(1, np.uint8), data[:-2]])
        three = np.concatenate([np.zeros(min(2, n - 1), np.uint8), data[:-3]])
        white = SPACE[before]
        for b, c in ((0x85, 0xC2), (0xA0, 0xC2), (0x9F, 0x81), (0x80, 0x9A), (0x80, 0x80)):
            white |= (before == b) & (two == c)  # the last bytes of U+0085, A0, 205F, 1680, 3000
        white |= (two == 0x80) & (three == 0xE2)  # U+2000 to 203F; those that are no space get no cut
        latin = (two == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        cut[1:] = SPACE[here] & ~white
        cut[1:] |= _PUNCTUATION[here] & (_ALNUM[before] | latin)
    starts = offsets[:-1]
    cut[starts[starts < n]] = True
    return np.flatnonzero(cut)


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``values[starts[i] : starts[i] + counts[i]]`` for all ``i``, one after the other."""
    before = np.cumsum(counts) - counts
    return values[np.repeat(starts - before, counts) + np.arange(counts.sum())]


class Table:
    """Hash of a span -> its ids. Ids lie in one array, hashes are sorted."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of every key, -1 where it is not held."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1)

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        base = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])
        keys = np.concatenate([self.keys, keys])
        place = np.concatenate([self.place, np.arange(base, len(self.starts))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.place = keys[order], place[order]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[rows]
        return ragged(self.ids, self.starts[rows], counts), counts


class Units:
    """A tokenizer file with what this worker has encoded by it."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.units, self.chunks = Table(), Table()
        self.decoder = self.tokenizer.decoder
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        for text in _PROBES + [f"x{s} y,{s}.z" for s in special] + special:
            if self.encode([text.encode()])[0].tolist() != self.plain(text):
                raise ValueError(f"{path}: {text!r} is not the sum of its units")
        self._pieces = None

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _library(self, data: np.ndarray, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Ids and id counts of the spans, by the library itself."""
        raw = data.tobytes()
        texts = [raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())]
        found = []
        for i in range(0, len(texts), 10_000):
            part = self.tokenizer.encode_batch_fast(texts[i : i + 10_000], add_special_tokens=False)
            found += [x.ids for x in part]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, counts.sum()), counts

    def _spans(self, table: Table, data, hashes, starts, ends, make) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans: those of a hash are made once and held."""
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        rows = table.rows(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            pick = first[new]
            table.add(keys[new], *make(pick, starts[pick], ends[pick]))
            rows = table.rows(keys)
        return table.gather(rows[inverse])

    def group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a group one after the other, and the number of ids of each."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        for table in (self.units, self.chunks):
            if table.ids.nbytes + 32 * len(table.keys) > HELD_BYTES:
                table.clear()
        starts = safe_cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashed = SpanHash(data)
        unit_hash = hashed(starts, ends)

        def unit_ids(pick):
            return self._spans(
                self.units, data, unit_hash[pick], starts[pick], ends[pick],
                lambda _, s, e: self._library(data, s, e),
            )

        join = np.zeros(len(starts), dtype=bool)
        if len(data) >= ROLLING_BYTES:
            rolled = hashed.windows(ROLLING_BYTES) & np.uint64((1 << CHUNK_BITS) - 1)
            picked = np.flatnonzero(rolled == 0) + ROLLING_BYTES - 1
            join[np.searchsorted(starts, picked, "right") - 1] = True
        join |= (ends - starts) > LONGEST_HELD
        text_start = np.zeros(len(starts), dtype=bool)
        text_start[np.searchsorted(starts, offsets[:-1][np.diff(offsets) > 0])] = True
        # A piece is a join unit or a run of other units of one text.
        opens = join | text_start
        opens[1:] |= join[:-1]
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(starts))
        piece_start, piece_end = starts[first], ends[last - 1]
        alone = join[first]

        def chunk_ids(_, s, e):
            a, b = np.searchsorted(starts, s), np.searchsorted(starts, e)
            ids, counts = unit_ids(ragged(np.arange(len(starts)), a, b - a))
            edges = np.append(0, np.cumsum(b - a))
            sums = np.append(0, np.cumsum(counts))
            return ids, sums[edges[1:]] - sums[edges[:-1]]

        whole = np.flatnonzero(~alone)
        ids_a, n_a = self._spans(
            self.chunks, data, hashed(piece_start[whole], piece_end[whole]),
            piece_start[whole], piece_end[whole], chunk_ids,
        ) if len(whole) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        short = np.flatnonzero(alone & (piece_end - piece_start <= LONGEST_HELD))
        ids_b, n_b = unit_ids(first[short]) if len(short) else (ids_a[:0], n_a[:0])
        long = np.flatnonzero(alone & (piece_end - piece_start > LONGEST_HELD))
        ids_c, n_c = self._library(data, piece_start[long], piece_end[long])

        counts = np.zeros(len(first), np.int64)
        where = np.zeros(len(first), np.int64)
        ids = np.concatenate([ids_a, ids_b, ids_c])
        base = 0
        for pick, n in ((whole, n_a), (short, n_b), (long, n_c)):
            counts[pick] = n
            where[pick] = base + np.cumsum(n) - n
            base += n.sum()
        ids = ragged(ids, where, counts)
        edges = np.searchsorted(piece_start, offsets)
        sums = np.append(0, np.cumsum(counts))
        return ids, sums[edges[1:]] - sums[edges[:-1]]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        ids, counts = self.group(np.frombuffer(b"".join(texts), np.uint8), offsets)
        return np.split(ids, np.cumsum(counts)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """``decode(ids, skip_special_tokens=False)`` in UTF-8. Without a decoder in the file the
        library joins the tokens by a space, which is done here from the vocabulary."""
        if self.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        if self._pieces is None:
            size = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self._pieces = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        return b" ".join(map(self._pieces.__getitem__, ids.tolist()))


_HELD: dict[str, Units] = {}


def units_of(path: str) -> Units:
    """The tokenizer at ``path``, loaded once per worker process."""
    if path not in _HELD:
        _HELD[path] = Units(path)
    return _HELD[path]
