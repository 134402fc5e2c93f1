"""Documents that operators must take: nulls, empty, long, repeated, tied, unusual characters."""

from __future__ import annotations

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "A passage that stands in several of these documents word for word, " * 3


def sample(n=60):
    rows = pq.read_table(f"{SF}/documents.parquet").slice(0, n).to_pylist()
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows]


def awkward():
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    texts = [
        None, "", " \t\n", "one", "two words", "a b c d", "a b c d", "A B C D",
        PASSAGE, "before " + PASSAGE + " after", "Éà " + PASSAGE, long, long + " end", "x" * 5000,
        "ab" * 3000, "<|endoftext|> é <|im_end|>", "日本語の文章 です", "\x00\x01 zero", "id1ot idiot you",
        "l\nl\nl\n\nl\r\n", "!!! ### ***", "a" * 99, "a" * 100, "a" * 101, "🙂" * 60,
    ]
    rows = [(1000 + i, t, "en", "src", None) for i, t in enumerate(texts)]
    rows += [(None, PASSAGE, None, None, None), (5, "same id", "xx", None, 7), (5, "same id", "xx", None, 7)]
    rows += [(6, "other text", "en", "a", 1), (6, "another text", "en", "b", 2)]
    return rows


def documents(spark, rows):
    """With columns whose names operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 AS id", "'x' AS rep", "'y' AS run", "2 AS label", "3 AS component", "4 AS n_words")


def texts_by_id(rows):
    """The documents as operators take them: the least text of each id, null as empty."""
    found = {}
    for doc_id, text, *_ in rows:
        found.setdefault(doc_id, []).append(text or "")
    return {k: min(v) for k, v in found.items()}
