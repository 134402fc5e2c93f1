"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text, all rates: words in a lexicon, words that begin like lexicon words, lexicon
words near a second-person word, lexicon words that appear only after look-alike characters are
mapped to letters, words that mix letters with digits or signs, capitals, punctuation, exclamation
marks, and the length. The lexicon is learned too: words, and beginnings of words, whose odds of
standing in a toxic text are significantly raised.

Labelled rows outside fold 0 teach. Each fold is measured by the lexicon of the others; folds 1 to 3
fit the trees, 4 the calibration; other texts are measured by the lexicon of all four. At most
``limit`` labelled rows are used; that bounds the fit and nothing else. Every whole text is scored.

Null and empty texts have zero rates and get the score of those. Without both labels in a fold
every text gets the share of label 1. Repeated keys are one document. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areametrics.llm.common import SPACE, SpanHash, by_group, lists, one_per_id, per_text, words
from areametrics.llm.labels import both, fold, sample
from areametrics.sources.shared import stored

#: Beginnings of words in the lexicon have so many bytes.
PREFIX_BYTES = 5
#: A lexicon entry stands in so many texts of label 1 at least, in more than in those of label 0,
#: and its likelihood-ratio statistic is over this (chance gives one in 10**6 words).
LEAST_TEXTS, GAIN = 4, 24.0
#: Runs of characters other than ASCII punctuation and white space.
_TOKEN = r"[^\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E\\x20\\x09-\\x0D]+"
#: A second-person word is near within so many words.
NEAR = 5
#: Second-person words.
SECOND_PERSON = (
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr "
    "euch euer tú ti tuyo usted ustedes vosotros"
).split()
#: Characters that stand for letters.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

NAMES = [
    "lexicon", "prefix", "second_person", "masked", "mixed", "capitals", "punctuation",
    "exclamations", "length",
]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PLAIN = _LOWER.copy()
for _a, _b in LOOK_ALIKES.items():
    _PLAIN[ord(_a)] = ord(_b)
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in "0123456789@$*"]] = True
_SOFT = _PUNCTUATION.copy()
_SOFT[[ord(c) for c in "@$"]] = False


def _hash_words(listed: list[bytes]) -> np.ndarray:
    lengths = np.array([len(w) for w in listed], dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.sort(SpanHash(np.frombuffer(b"".join(listed), np.uint8))(ends - lengths, ends))


def _within(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _tokens(data, offsets, apart):
    """Words after the characters in ``apart`` became spaces."""
    return words(np.where(apart[data], np.uint8(32), data), offsets)


def rates(data: np.ndarray, offsets: np.ndarray, terms: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """The features of a group of texts, a row each."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    if not len(data):
        return out
    lower = _LOWER[data]
    hashed = SpanHash(lower)
    start, end, row = _tokens(lower, offsets, _PUNCTUATION)
    total = np.maximum(1, np.bincount(row, minlength=n))
    whole = hashed(start, end)
    hit = _within(whole, terms)
    stem = _within(hashed(start, np.minimum(end, start + PREFIX_BYTES)), stems) & (
        end - start >= PREFIX_BYTES
    )
    you = np.append(0, np.cumsum(_within(whole, _hash_words([w.encode() for w in SECOND_PERSON]))))
    at = np.flatnonzero(hit | stem)
    edges = np.searchsorted(row, np.arange(n + 1))
    low = np.maximum(at - NEAR, edges[row[at]])
    high = np.minimum(at + NEAR + 1, edges[row[at] + 1])
    near = you[high] > you[low]
    # Masked words: look-alikes mapped to letters, signs inside words kept in them.
    plain = _PLAIN[data]
    p_start, p_end, p_row = _tokens(data, offsets, _SOFT)
    signs = np.append(0, np.cumsum(_SIGN[data]))
    odd = np.flatnonzero(signs[p_end] > signs[p_start])
    masked = _within(SpanHash(plain)(p_start[odd], p_end[odd]), terms)
    letters = np.append(0, np.cumsum((lower >= 97) & (lower <= 122)))
    blend = letters[p_end[odd]] > letters[p_start[odd]]

    def share(rows):
        return np.bincount(rows, minlength=n) / total

    solid = np.maximum(1, per_text(~SPACE[data], offsets))
    out[:, 0] = share(row[hit])
    out[:, 1] = share(row[stem])
    out[:, 2] = share(row[at[near]])
    out[:, 3] = share(p_row[odd[masked]])
    out[:, 4] = share(p_row[odd[blend]])
    out[:, 5] = per_text(_CAPITAL[data], offsets) / solid
    out[:, 6] = per_text(_PUNCTUATION[data], offsets) / solid
    out[:, 7] = per_text(data == ord("!"), offsets) / solid
    out[:, 8] = np.log1p(total)
    return out


def term_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """For every word and word beginning in ``texts`` (with ``label`` and ``fold``), which is
    bounded: how many texts of label 1 and 0 it stands in, by fold. The empty word counts all."""
    token = F.expr(f"regexp_extract_all(lower(`{text}`), '{_TOKEN}', 0)")
    word = F.expr("transform(array_distinct(w), x -> named_struct('stem', false, 't', encode(x, 'UTF-8')))")
    stem = F.expr(
        f"transform(array_distinct(transform(filter(w, x -> octet_length(x) >= {PREFIX_BYTES}), "
        f"x -> substr(encode(x, 'UTF-8'), 1, {PREFIX_BYTES}))), x -> named_struct('stem', true, 't', x))"
    )
    everything = F.expr("array(named_struct('stem', false, 't', encode('', 'UTF-8')))")
    rows = texts.select("fold", "label", token.alias("w")).select(
        "fold", "label", F.explode(F.concat(word, stem, everything)).alias("term")
    )
    return rows.groupBy("term.stem", "term.t", "fold").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")
    )


def lexicons(texts: DataFrame, text: str = "text") -> dict[int, tuple[list[bytes], list[bytes]]]:
    """Words and word beginnings whose share of label 1 is raised: for each fold those that the
    other folds show, so that no text is measured by what it has taught; for 0 those of all."""
    counts = stored(term_counts(texts, text), "terms")
    found = {}
    for left_out in (0, 1, 2, 3, 4):
        sums = counts.where(F.col("fold") != left_out).groupBy("stem", "t").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b")
        )
        total = sums.where("octet_length(t) = 0").first()
        if not total or not total["a"] or not total["b"]:
            found[left_out] = [], []
            continue
        share = total["a"] / (total["a"] + total["b"])
        gain = (
            f"2 * (a * ln(a / ((a + b) * {share!r}D)) +"
            f" CASE WHEN b > 0 THEN b * ln(b / ((a + b) * {1 - share!r}D)) ELSE 0 END)"
        )
        raised = sums.where(
            F.expr(f"octet_length(t) > 0 AND a >= {LEAST_TEXTS} AND a > b AND {gain} > {GAIN}")
        ).select("stem", "t").collect()
        found[left_out] = tuple([bytes(r["t"]) for r in raised if r["stem"] == k] for k in (False, True))
    return found


def features(
    rows: DataFrame, key: str, text: str, listed: dict[int, tuple[list[bytes], list[bytes]]]
) -> DataFrame:
    """``key`` and ``rates``; rows with a ``fold`` are measured by their fold's lexicon."""
    hashed = {
        f: [_hash_words(x) if x else np.zeros(0, np.uint64) for x in pair]
        for f, pair in listed.items()
    }

    def measure(lexicon):
        def run(keys, data, offsets):
            found = rates(data, offsets, *hashed[lexicon])
            return pa.RecordBatch.from_arrays(
                [keys, lists(found.ravel(), np.full(len(found), len(NAMES)), pa.float64())],
                [key, "rates"],
            )

        return by_group(run)

    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, rates array<double>"
    if "fold" not in rows.columns:
        return rows.select(key, text).mapInArrow(measure(0), schema)
    parts = [rows.where(F.col("fold") == f).select(key, text).mapInArrow(measure(f), schema) for f in (1, 2, 3, 4)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def score(
    df: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = 20_000, trees: int = 20,
    depth: int = 3, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for every document."""
    rows = one_per_id(df, key, text)
    chosen = sample(labels, label, key, limit)
    # At most ``limit`` rows: a bounded broadcast. Labelled texts are spread over all cores.
    train = stored(rows.join(F.broadcast(chosen), key), "toxicity")
    out = (F.col(key), (fold(key) == 0).alias("held_out"))
    parts = [train.where("fold <> 4"), train.where("fold = 4")]
    if not all(both(p) for p in parts):
        share = train.agg((F.sum("label") + 1) / (F.count("*") + 2)).first()[0]
        fixed = rows.select(*out, F.lit(0.5 if share is None else float(share)).alias("score"))
        return fixed.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    listed = lexicons(train, text)
    known = features(train, key, text, listed).join(F.broadcast(chosen), key)
    known = known.select("fold", "label", array_to_vector("rates").alias("features")).cache()
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1).fit(
        known.where("fold <> 4")
    )

    def margin(scored):
        scored = scored.withColumn("margin", vector_to_array("rawPrediction")[1])
        return scored.drop("rawPrediction", "probability", "prediction")

    curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(
        margin(fitted.transform(known.where("fold = 4"))).select("margin", "label")
    )
    known.unpersist()
    every = features(rows, key, text, listed).withColumn("features", array_to_vector("rates"))
    found = curve.transform(margin(fitted.transform(every)))
    # The curve is flat in places; the margin orders the texts there.
    even = 1 / (1 + F.exp(-F.col("margin")))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.99 * F.col("prediction") + 0.01 * even))
    return found.select(*out, clipped.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
