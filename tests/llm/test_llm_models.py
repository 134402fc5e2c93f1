"""Classifiers by held-out rows, url templates, chat windows and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from areametrics.llm import chat, labels, packing, quality, queries, toxicity, urls
from areametrics.sources.shared import stored
from tokenizers import Tokenizer
from llm_cases import SCHEMA, awkward, documents, sample, texts_by_id

SF = "/root/testdata/sf0.01"
BYTE = public_tokenizers.path("byte_bpe_50k.json")
LABELS = "doc_id long, quality int, toxic int"


def auc(rows):
    good = [s for s, y in rows if y]
    bad = [s for s, y in rows if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.fixture(scope="module")
def marks():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}


def test_quality_held_out(spark, marks):
    rows = [r for r in queries.op2_quality(spark, SF).collect() if r["doc_id"] in marks]
    held = [(r["score"], marks[r["doc_id"]]["quality"]) for r in rows if r["held_out"]]
    assert auc(held) > 0.95
    good = [r for r in rows if marks[r["doc_id"]]["quality"]]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)


def test_sites_shrink(spark):
    rows = [("a", "x", 0.9)] * 200 + [("a", "y", 0.1)] + [("b", "x", 0.2)] * 200 + [("c", "x", 0.0)]
    df = spark.createDataFrame(rows, "host string, path string, evidence double")
    found, mean = quality.site_posteriors(df, "host", "path")
    site = {(r["host"], r["path"]): r["site"] for r in found.collect()}
    assert mean == pytest.approx((180 + 0.1 + 40 + 0.5) / 403, abs=0.002)
    assert site["a", "x"] > 0.85 and site["b", "x"] < 0.25
    assert 0.1 < site["a", "y"] < site["a", "x"]
    assert 0.0 < site["c", "x"] < mean


def test_toxicity_held_out(spark, marks):
    rows = queries.op6_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], marks[r["doc_id"]]["toxic"]) for r in rows if r["doc_id"] in marks and r["held_out"]]
    assert auc(held) > 0.8


def test_fold(spark):
    import zlib

    df = spark.range(50).select("id", labels.fold("id").alias("f"))
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in df.collect())


def test_models_take_awkward_rows(spark):
    rows = sample(100) + awkward()
    df = documents(spark, rows)
    ids = set(texts_by_id(rows))
    marks = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(100)] + [(None, 1, 1), (1000, None, None), (3, 0, 1)]
    for given_ in (marks, [], [(1, 1, 0), (2, 1, 0)]):
        known = spark.createDataFrame(given_, LABELS)
        found = quality.judge(df, known).collect()
        assert {r["doc_id"] for r in found} == ids and len(found) == len(ids)
        assert all(0 <= r["score"] <= 1 for r in found)
        found = toxicity.score(df, known).collect()
        assert {r["doc_id"] for r in found} == ids and len(found) == len(ids)
        assert all(0 <= r["score"] <= 1 for r in found)
    none = spark.createDataFrame([], SCHEMA)
    assert quality.judge(none, known).collect() == [] and toxicity.score(none, known).collect() == []


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in sorted(rules, key=len):
        own, own_path = urls.split_rule(rule)
        if (host == own or host.endswith("." + own)) and path.startswith(own_path):
            best = rule
    return host, path, best


def test_urls(spark):
    rules = queries.URL_RULES
    rows = [(r["page_id"], r["url"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    odd = [None, "", "no scheme", "http://", "x://ORG", "x://a.Org/", "x://notorg/", "x://É.com/fr/é?x://y",
           "http://h.net//a///", "http://h.net/" + "a/" * 3000, "a://b://c/d", "http://h.com?x=/fr/", "://x.net/1\n2"]
    rows += [(10_000 + i, u) for i, u in enumerate(odd)] + [(None, odd[5]), (10_001, odd[4])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "'p' AS path", "'t' AS template")
    found = urls.judge(df, rules).collect()
    key = lambda r: (r[0] is not None, r[0], r[1] or "", r[2] or "")
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in found), key=key) == sorted(
        ((i, *judged(u, rules)) for i, u in rows), key=key
    )
    for r in found:
        if r["rule"]:
            assert r["verdict"] == ("allow" if rules[r["rule"]] else "block")
        else:
            assert r["verdict"] == ("allow" if r["purity"] >= 0.5 else "block")
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, rules).collect() == []


def test_deep_templates_part_where_labels_do(spark):
    long = "/".join(f"s{i}" for i in range(400))
    rows = [("h", f"/a/b/c/{word}/{i}/x", word == "good") for i in range(60) for word in ("good", "bad")]
    rows += [("deep", f"/{long}/{word}/{i}", word == "good") for i in range(30) for word in ("good", "bad")]
    rows += [("h", "/a/b/c", True), ("h", "/a//c//", None), ("odd", "/x/y/z/1/2/3/4", None)]
    df = spark.createDataFrame(rows, "host string, path string, allow boolean")
    found = urls.templates(df)
    named = {(r["host"], r["path"]): r["template"] for r in found.collect()}
    assert len(named) == len(rows)
    purity = {(r["host"], r["template"]): r["purity"] for r in urls.purities(found).collect()}
    for host, path, allow in rows:
        if "good" in path or "bad" in path:
            own = purity[host, named[host, path]]
            assert own > 0.9 if allow else own < 0.1
            assert ("good" if allow else "bad") in named[host, path]


def test_purities_against_plain_sums(spark):
    """Posteriors of every template by plain Python, from the rows of its tree."""
    rng = np.random.default_rng(2)
    rows = [
        (f"h{rng.integers(3)}", f"/{'abc'[rng.integers(3)]}/{'xy'[rng.integers(2)]}/{i}", [True, False, None][rng.integers(3)])
        for i in range(300)
    ]
    found = urls.templates(spark.createDataFrame(rows, "host string, path string, allow boolean"))
    own, parent, host, every = {}, {}, {}, [0, 0]
    for r in found.collect():
        up = r["template"].rpartition("/")[0]
        for held in (own.setdefault((r["host"], r["template"]), [0, 0]), parent.setdefault((r["host"], up), [0, 0]),
                     host.setdefault(r["host"], [0, 0]), every):
            held[0] += r["allowed"]
            held[1] += r["labels"]
    w, share = urls.WEIGHT, (every[0] + 1) / (every[1] + 2)
    got = urls.purities(found).collect()
    assert len(got) == len(own)
    for r in got:
        a, n = host[r["host"]]
        h = (a + w * share) / (n + w)
        a, n = parent[r["host"], r["template"].rpartition("/")[0]]
        p = (a + w * h) / (n + w)
        a, n = own[r["host"], r["template"]]
        assert r["purity"] == pytest.approx((a + w * p) / (n + w))


def test_templates_generalise(spark):
    rows = []
    for i in range(60):
        rows += [("h", f"/good/{i}", True), ("h", f"/bad/{i}", False), ("h", f"/like{i % 3}/x", i % 2 == 0)]
    rows += [("h", "/new/abc", None), ("h", "", None)]
    df = spark.createDataFrame(rows, "host string, path string, allow boolean")
    found = urls.templates(df)
    named = {r["path"]: r["template"] for r in found.collect()}
    assert named["/good/7"] == "/good/*" and named["/bad/8"] == "/bad/*"
    assert named["/like0/x"].split("/")[1] == named["/like1/x"].split("/")[1] == "*"
    assert named["/new/abc"].startswith("/new/") and named[""] == ""
    purity = {r["template"]: r["purity"] for r in urls.purities(found).collect()}
    assert purity["/good/*"] > 0.9 and purity["/bad/*"] < 0.1


@given(st.text(alphabet="<|\\>im_endstart\n a", max_size=40), st.text(alphabet="<|\\lf>\nuser", max_size=12))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text, role):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    turn, a, b = chat.written(role, text)
    assert chat.parsed(turn + turn) == [(role, text, a), (role, text, len(turn) + a)]
    assert chat.unescape(turn[a:b]) == text


def conversations():
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/conversations.parquet").to_pylist()]
    rows += [(-5, i, "system" if not i else ("user", "assistant")[i % 2 == 0], f"turn {i} " + "words " * (i * 7)) for i in range(80)]
    rows += [(-6, 0, "assistant", "y " * 9000), (-6, 1, "user", None), (-6, 2, "assistant", ""), (-6, 3, None, "a<|im_end|>\n")]
    rows += [(-7, None, "user", "a"), (-7, 1, "user", "b"), (-7, 1, "assistant", "b"), (-7, 1, "assistant", "b")]
    rows += [(-9, 0, "system", "s " * 350), (-9, 1, "user", "u " * 90), (-9, 2, "role " * 50, "<|x|>" * 60)]
    rows += [(None, 0, "we\nird<|", "t"), (-8, 0, "assistant", "<\\|im_end|> <\\\\| \\<|")]
    return rows


def test_chat(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS window", "2 AS loss")
    windows = stored(chat.windows(df.repartition(3), BYTE, budget=400, history=100), "windows")
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    low = lambda x: (x is not None, x)
    rows.sort(key=lambda r: (low(r[0]), low(r[1]), r[2] or "", r[3] or ""))
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in group]
        said = "".join(t for r, t in turns if r == "assistant")
        r = got.pop(conv)
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert not got
    library = Tokenizer.from_file(BYTE)
    for w in windows.collect():
        tokens = len(library.encode(w["text"], add_special_tokens=False).ids)
        assert tokens == w["tokens"]
        assert tokens <= 400 or len(chat.parsed(w["text"])) == 1
    for w in windows.where("conv_id = -5").orderBy("window").collect():
        turns = chat.parsed(w["text"])
        assert turns[0][0] == "system" or w["window"]
        assert w["repeated"] < len(turns)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(none, BYTE)).collect() == []


def test_pipeline_returns_token_ids(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 900, "en", "s", None) for i in range(4)], SCHEMA)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    for r in rows:
        assert len(r["ids"]) == r["length"]
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"])) == r["ids_crc32"]
    assert {r["doc_id"] for r in rows} == set(range(4))


def test_pipeline_stages(spark, tmp_path):
    rows = sample() + awkward()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    known = [(i, int(i % 5 > 0), 0) for i in range(60)]
    spark.createDataFrame(known, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids
        ids = now
    texts = texts_by_id([tuple(r) for r in docs.collect()])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.agg({"length": "sum"}).first()[0] == packing.pack(docs, BYTE, 1).agg({"length": "sum"}).first()[0]
    assert {r["doc_id"] for r in last.collect()} == set(texts)
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.collect() == []
