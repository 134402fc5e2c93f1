"""Suffix array, BPE, packing and quality rules against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from areametrics.llm import bpe, packing, rules, suffixes
from areametrics.llm.units import Units
from llm_cases import SCHEMA, awkward, documents, sample, texts_by_id

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def removed(texts, length=100):
    """By a set of all strings seen so far."""
    seen, out = set(), {}
    for key in sorted(texts, key=lambda k: (k is not None, k)):
        data = texts[key].encode()
        flag = np.zeros(len(data) + 1, dtype=int)
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                flag[p] += 1
                flag[p + length] -= 1
            seen.add(s)
        gone = np.cumsum(flag[:-1]) > 0
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())
        out[key] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("wide", [suffixes.WIDE, 1])
def test_repeats_are_removed(spark, wide):
    rows = sample() + awkward()
    df = documents(spark, rows).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in suffixes.dedup(df, wide=wide).collect()}
    assert got == removed(texts_by_id(rows))


def test_groups_hold_all_occurrences(spark):
    passage = " ".join(f"word{i}" for i in range(25))
    texts = {i: f"{chr(97 + i) * 20}{passage}{chr(107 + i) * 20}" for i in range(5)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    groups = {}
    for r in suffixes.repeat_groups(df).collect():
        groups.setdefault((r["repeat"], r["length"]), []).append((r["id"], r["start"]))
    assert groups
    for (_, length), places in groups.items():
        strings = {texts[i][p : p + length] for i, p in places}
        assert len(strings) == 1 and len(places) > 1
    assert max(len(p) for p in groups.values()) == 5


@pytest.mark.parametrize("wide", [suffixes.WIDE, 1])
def test_groups_against_brute_force(spark, wide):
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, other = letters(260), letters(150)
    texts = {i: passage + other for i in range(4)}  # exact copies
    texts |= {i: letters(40) + passage[i : 200 + i] + letters(30) for i in range(4, 9)}
    texts |= {9: other * 3, 10: "ab" * 150, 11: "", 12: letters(500)}
    texts[13] = texts[12][:130]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    groups = {}
    for r in suffixes.repeat_groups(df, wide=wide).collect():
        groups.setdefault((r["repeat"], r["length"]), []).append((r["id"], r["start"]))
    covered = set()
    for (_, n), places in groups.items():
        assert len(places) == len(set(places)) > 1
        i, p = places[0]
        string = texts[i][p : p + n]
        assert set(places) == {(j, q) for j, t in texts.items() for q in range(len(t) - n + 1) if t.startswith(string, q)}
        covered |= {(j, q + k) for j, q in places for k in range(n - 99)}
    where = {}
    for j, t in texts.items():
        for q in range(len(t) - 99):
            where.setdefault(t[q : q + 100], []).append((j, q))
    assert covered == {x for places in where.values() if len(places) > 1 for x in places}


def test_chance_meetings_are_not_compared(spark):
    """Texts that share a run, but no string, move no bytes; those that share strings on one side do."""
    rng = np.random.default_rng(12)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    common = letters(50)
    texts = {i: letters(150) + common + letters(150) for i in range(60)}
    frame = lambda t: spark.createDataFrame(list(t.items()), "id long, text string").repartition(3)
    asked = lambda t: suffixes._sorted_out(suffixes._anchor_rows(frame(t), 100)).where("stretches IS NOT NULL")
    assert asked(texts).count() == 0
    # Strings of 120 that begin or end with what all share.
    more, tails = letters(70), {}
    for i, at in ((60, 0), (61, 150), (62, 30)):
        tails[i] = letters(at) + common + more + letters(60)
        tails[i + 10] = letters(at + 20) + more + common + letters(90)
    assert asked(texts | tails).select("id").distinct().count() == 6
    got = {r[0]: tuple(r)[1:] for r in suffixes.dedup(frame(texts | tails), key="id").collect()}
    assert got == removed(texts | tails) and sum(v[1] > 0 for v in got.values()) == 4


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(4)
    pieces = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in (30, 1, 9, 64, 17, 40, 8)] + [b"\0" * 12, b"\0" * 20]
    offsets = np.append(0, np.cumsum([len(p) for p in pieces]))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    array = suffixes.SuffixArray(data, offsets, np.arange(len(data)))
    tails = {int(o + i): p[i:] for o, p in zip(offsets, pieces) for i in range(len(p))}
    for a, b, n in zip(array.suffixes[:-1], array.suffixes[1:], array.shared):
        x, y = tails[int(a)], tails[int(b)]
        common = next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        assert n == common
    before = np.append(0, data[:-1].astype(int))
    before[offsets[:-1]] = 256 + np.arange(len(pieces))
    found = {}
    for n, first, last in array.repeats(5, before):
        found[tails[int(array.suffixes[first])][:n]] = sorted(map(int, array.suffixes[first : last + 1]))
    want = {}
    for n in range(5, 65):
        places = {}
        for p, t in tails.items():
            if len(t) >= n:
                places.setdefault(t[:n], []).append(p)
        for s, at in places.items():
            right = {tails[p][n] if len(tails[p]) > n else -p - 1 for p in at}
            if len(at) > 1 and len(right) > 1 and len({int(before[p]) for p in at}) > 1:
                want[s] = sorted(at)
    assert found == want


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_agree_with_the_library(path):
    texts = [t or "" for _, t, *_ in sample(30) + awkward()]
    rng = np.random.default_rng(2)
    signs = list("abZ ,.!é×?#'\t\n\x85\xa0 　́​1٣|<>sİǅ漢🙂€") + ["<|endoftext|>", "'ll", " 's"]
    texts += ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(2000)]
    tokenizer, units = library(path), Units(path)
    for _ in range(2):  # the second time from the tables
        for text, ids in zip(texts, units.encode([t.encode() for t in texts])):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
            assert units.decode(ids).decode() == tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def test_unfit_tokenizer_is_refused(tmp_path):
    from tokenizers import models

    path = str(tmp_path / "t.json")
    vocab = {c: i for i, c in enumerate("ab ")} | {"a ": 3, "<unk>": 4}
    Tokenizer(models.BPE(vocab, [("a", " ")], unk_token="<unk>")).save(path)
    with pytest.raises(ValueError, match="sum of its units"):
        Units(path)


def test_bpe_round_trip(spark):
    rows = sample() + awkward()
    tokenizer, texts = library(WORD), texts_by_id(rows)
    df = documents(spark, rows).repartition(3)
    got = {r["doc_id"]: r for r in bpe.round_trip(df, WORD).collect()}
    assert set(got) == set(texts)
    for key, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        packed = np.array(ids, dtype="<u4").tobytes()
        assert tuple(got[key])[1:] == (
            len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
        )
    encoded = bpe.encode(df, WORD)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, WORD).collect()}
    assert hashlib.sha256(back[1004].encode()).hexdigest() == got[1004]["decoded_sha256"]


def test_packing(spark):
    rows = sample(200) + awkward()
    tokenizer, texts = library(BYTE), texts_by_id(rows)
    df = documents(spark, rows).repartition(2)
    out = packing.pack(df, BYTE, end_id=1).collect()
    ids = {k: tokenizer.encode(t, add_special_tokens=False).ids + [1] for k, t in texts.items()}
    pieces, windows = {}, {}
    for r in out:
        assert r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key, all_ids in ids.items():
        at = 0
        for start, length in sorted(pieces[key]):
            assert start == at
            at += length
        assert at == len(all_ids)
    fills = []
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        fills.append(at)
    assert sum(f < 2048 for f in fills) <= 2


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    packer = packing.Packer(16)
    for n in rng.integers(1, 16, 400).tolist():
        before = packer.count.copy()
        best = []
        for h in range(0, 16 - n + 1):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= h > 0
            if h + n < 16:
                after[h + n] += 1
            best.append((int((after**2).sum()), -h))
        assert packer.level(n) == -min(best)[1]
        packer.place((0, 0, np.zeros(n, np.uint32), n))
        assert [len(x) for x in packer.open] == packer.count.tolist()


def test_rules(spark):
    rows = sample(150) + awkward()
    texts = texts_by_id(rows)
    df = documents(spark, rows).repartition(3)
    got = {r["doc_id"]: r for r in rules.judge(df).collect()}
    assert set(got) == set(texts)
    for key, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = {w for w in windows if windows.count(w) > 1} if len(words) < 3000 else set()
        if len(words) >= 3000:
            from collections import Counter

            often = {w for w, n in Counter(windows).items() if n > 1}
        covered = {i + j for i, w in enumerate(windows) if w in often for j in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want = (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), failed,
        )
        r = got[key]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (failed and r["kept"])
        assert 0 <= r["class_distance"] <= 1 and 0 <= r["word_distance"] <= 1


def test_lists_of_uncommon_words_are_rejected(spark):
    prose = "the house {0} view {1} of town {2} small {3} garden {4} and"
    text = lambda i: " ".join(prose.format(*(f"q{131 * i + 5 * j + k}z" for k in range(5))) for j in range(12))
    rows = [(i, text(i), "en", "s", None) for i in range(40)]
    plain = " ".join(w for w in text(99).split() if w not in rules.COMMON_WORDS["en"])
    listed = " ".join([plain] + [f"q{i}z view house" for i in range(90)])
    rows += [(100, listed, "en", "s", None), (101, "q1z q2z q3z house view town " * 2, "en", "s", None)]
    df = documents(spark, rows)
    got = {r["doc_id"]: r for r in rules.judge(df).collect()}
    r = got[100]
    limit = rules.CLASS_DISTANCE * rules.CLASS_SHARE
    assert not r["base_failed"] and r["n_words"] >= 100 and r["class_distance"] < limit
    assert not r["kept"]
    assert not any(got[i]["base_failed"] for i in range(40))
    assert all(got[i]["kept"] for i in range(40))
    passed = corpus_pipeline.quality_rules(spark, df, "").select("doc_id").collect()
    assert {r[0] for r in passed} == {k for k, r in got.items() if r["kept"]}


def test_distance(spark):
    a, b = [3, 0, 1, 0], [1, 1, 0, 0]
    df = spark.createDataFrame([(a, b), (a, a), ([1, 0], [0, 5]), ([0, 0], [1, 2])], "x array<long>, y array<long>")
    got = [r[0] for r in df.select(rules.distance("x", "y")).collect()]
    p, q = np.array(a) / 4, np.array(b) / 2
    m = (p + q) / 2
    kl = lambda u: sum(x * np.log2(x / y) for x, y in zip(u, m) if x)
    assert got[0] == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))
    assert got[1:] == pytest.approx([0, 1, 0])


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert suffixes.dedup(df).collect() == []
    assert bpe.round_trip(df, WORD).collect() == []
    assert packing.pack(df, BYTE, end_id=1).collect() == []
    assert rules.judge(df).collect() == []


def test_lengths_out_of_reach_raise(spark):
    df = documents(spark, [(1, "text", "en", "s", 1)])
    for length in (31, 288, 400):
        with pytest.raises(ValueError):
            suffixes.dedup(df, length=length)
