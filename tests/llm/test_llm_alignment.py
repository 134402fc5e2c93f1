"""Token alignment against plain Python and the libraries themselves."""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from areametrics.llm import alignment
from llm_cases import SCHEMA, awkward, documents, sample, texts_by_id

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        # The byte-level alphabet, learned from the library: a byte's own character.
        alphabet = alignment.byte_alphabet()
        assert len(set(alphabet.values())) == len(alphabet) == 256
        self.alphabet = alphabet

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        a_bytes = [bytes(self.alphabet[c] for c in self.a.id_to_token(i)) for i in a]
        b_bytes = []
        for i in b:
            p = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
        return list(zip(a, a_bytes)), list(zip(b, b_bytes))

    def document(self, text):
        if not text:
            return None
        a, b = self.tokens(text)
        want = (" " + text).encode()
        if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
            return None
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        held = [[[], []] for _ in cuts]
        for n, side in enumerate(spans):
            for i, s, _ in side:
                held[bisect.bisect_right(cuts, s)][n].append(str(i))
        pieces = [f"{','.join(x)}|{','.join(y)}" for x, y in held]
        links, j = [], 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        return len(a), len(b), len(cuts), links, hashlib.sha256(";".join(pieces).encode()).hexdigest()


def brute(texts):
    one = Brute()
    found = {k: one.document(t) for k, t in texts.items()}
    counts = Counter(p for f in found.values() if f for p in set(f[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = {}
    for k, f in found.items():
        out[k] = (0, 0, 0, 0, 0, 0, "") if f is None else (
            *f[:3], len(f[3]), sum(counts[p] == best[p[0]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]
        )
    return out


def run(df):
    return {
        r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
        for r in alignment.align(df, A, B).collect()
    }


def more():
    texts = [
        "a ▁ b", "<s> x </s> <unk>", "<|endoftext|>", "x<|endoftext|>y", "  two", " ", "\t", "ﬁ Å é", "é",
        "<0x41>", "日本　語", "a b", "👩‍👩‍👧 ok", "l'été's 1,234.50!!", "end \n",
    ]
    return [(3000 + i, t, "en", "s", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [1000, 8 << 20])
def test_alignment(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    rows = sample(60) + awkward() + more()
    assert run(documents(spark, rows).repartition(3)) == brute(texts_by_id(rows))


def test_empty(spark):
    assert run(documents(spark, [])) == {}
    assert run(spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], SCHEMA)) == {
        1: (0, 0, 0, 0, 0, 0, ""), 2: (0, 0, 0, 0, 0, 0, "")
    }


def test_coalescing():
    """Bytes 0-2-5 against 0-1-5-7 and then 5-7: cuts at 5 and 7 alone."""
    a, b = alignment.coalesced(*map(np.array, ([0, 2, 5], [2, 5, 7], [0, 1, 5], [1, 5, 7])))
    assert a.tolist() == [0, 0, 1] and b.tolist() == [0, 0, 1]
    left, right = alignment.overlapping(*map(np.array, ([0, 2, 5], [2, 5, 7], [0, 1, 5], [1, 5, 7])))
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)]
