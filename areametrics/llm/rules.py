"""Quality rules: plain counts, and the divergence of a document from its language.

Base rules: too few words, or too many words in repeated 5-word windows. Beyond them a document's
histograms of character classes and of common words are compared with its language's, pooled over
all documents that pass the base rules, by the Jensen-Shannon distance (base 2, so 0 to 1). A
minimum length guards each comparison, since the histogram of a few words says nothing. The limits
lie on scales that texts reach: for words, a share of the distance that a text without any common word
has to the reference, if the text has a smaller share of common words than that; for classes, a limit
that falls with the length.

Null text has no words. A language that is null, or without a word list, is a language of its own,
whose common-word histogram has one bin, so that its distance is 0. Repeated keys are one document:
its least text, and its least language. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areametrics.llm.common import (
    SPACE, SpanHash, groups, lists, mixed, per_text, text_bytes, window_hashes, words,
)
from areametrics.operators.joins import sized_join
from areametrics.sources.shared import stored

#: Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on with as be by this are or an at from".split(),
    "fr": "le de la et les des un une du en que est pour dans qui au sur par il ce ne se".split(),
    "de": "der die und den das von zu mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo es".split(),
}
WORD_BINS = 1 + max(map(len, COMMON_WORDS.values()))

#: Character classes by first byte. Other characters are the last two classes.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ",
           "\t\n\v\f\r", ".,;:!?", "'\"-()", "#*$%&|<>"]
CLASS_BINS = len(CLASSES) + 2
_CLASS = np.full(256, CLASS_BINS - 2, dtype=np.int64)
_CLASS[0xC0:] = CLASS_BINS - 1
for _i, _chars in enumerate(CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Lengths from which on distances count.
CLASS_MIN_CHARS, WORD_MIN_WORDS = 200, 100
#: The class limit goes from the first figure at the least length towards this share of it, by the
#: square root of the length.
CLASS_DISTANCE, CLASS_SHARE = 0.33, 0.5
#: The word limit is this share of the distance of a text without common words.
WORD_SHARE = 0.8


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base columns of a group of texts, and the word spans found on the way."""
    n = len(offsets) - 1
    head = (data & 0xC0) != 0x80
    solid = ~SPACE[data]
    hashed = SpanHash(data)
    # Lines
    newline = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - ((ends > starts) & (data[ends - 1] == 10)) if len(ends) else ends
    filled = np.append(0, np.cumsum(solid))
    keep = filled[ends] > filled[starts]
    starts, ends = starts[keep], ends[keep]
    row = np.searchsorted(offsets, starts, "right") - 1
    _, first = np.unique(mixed(hashed(starts, ends) + row.astype(np.uint64)), return_index=True)
    lines = np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)
    # Words
    start, end, row = words(data, offsets)
    word = hashed(start, end)
    covered = np.zeros(len(row), dtype=bool)
    if len(row) >= WINDOW:
        last = len(row) - WINDOW + 1
        inside = np.flatnonzero(row[:last] == row[WINDOW - 1 :])
        keys = mixed(window_hashes(word, WINDOW)[inside] + row[inside].astype(np.uint64))
        _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = inside[times[inverse] > 1]
        for i in range(WINDOW):
            covered[twice + i] = True
    return {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": per_text(head & solid, offsets),
        "n_symbols": per_text(_SYMBOL[data], offsets),
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(row[covered], minlength=n),
        "spans": (start, end, row),
    }


def _word_keys() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language the sorted hashes of its common words, and the bin of each."""
    out = {}
    for lang, listed in COMMON_WORDS.items():
        texts = [w.encode() for w in listed]
        ends = np.cumsum([len(t) for t in texts])
        keys = SpanHash(np.frombuffer(b"".join(texts), np.uint8))(
            ends - np.array([len(t) for t in texts]), ends
        )
        order = np.argsort(keys)
        out[lang] = keys[order], order
    return out


def measure(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key``, ``lang``, the base columns, ``classes`` and ``common``: histograms as arrays."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).alias("lang"))
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        rows = rows.groupBy(key).agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        known = _word_keys()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            langs = np.array(batch.column(2).to_pylist(), dtype=object)
            for i, j in groups(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                n = j - i
                found = counts(part, at)
                start, end, row = found["spans"]
                owner = np.repeat(np.arange(n), np.diff(at))
                head = (part & 0xC0) != 0x80
                classes = np.bincount(
                    owner[head] * CLASS_BINS + _CLASS[part[head]], minlength=n * CLASS_BINS
                )
                lower = SpanHash(_LOWER[part])(start, end)
                place = np.full(len(row), WORD_BINS - 1)
                for name, (keys, order) in known.items():
                    own = np.flatnonzero((langs[i:j] == name)[row])
                    near = np.minimum(np.searchsorted(keys, lower[own]), len(keys) - 1)
                    hit = keys[near] == lower[own]
                    place[own[hit]] = order[near[hit]]
                common = np.bincount(row * WORD_BINS + place, minlength=n * WORD_BINS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n), batch.column(2).slice(i, n),
                        *(pa.array(found[c], pa.int64()) for c in names),
                        lists(classes, np.full(n, CLASS_BINS), pa.int64()),
                        lists(common, np.full(n, WORD_BINS), pa.int64()),
                    ],
                    [key, "lang", *names, "classes", "common"],
                )

    return rows.mapInArrow(
        run, f"`{key}` {kind}, lang string, " + ", ".join(f"{c} long" for c in names)
        + ", classes array<long>, common array<long>",
    )


def distance(a: str, b: str) -> Column:
    """Jensen-Shannon distance of two arrays of counts, each taken as shares; 0 if one is empty."""
    shares = "transform({0}, v -> v / aggregate({0}, 0D, (s, v) -> s + v))"
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (z.p + z.q)) ELSE 0D END"
    return F.expr(
        f"CASE WHEN aggregate({a}, 0L, (s, v) -> s + v) = 0 OR aggregate({b}, 0L, (s, v) -> s + v) = 0"
        f" THEN 0D ELSE sqrt(greatest(0D, aggregate(zip_with({shares.format(a)}, {shares.format(b)},"
        f" (p, q) -> named_struct('p', p, 'q', q)), 0D, (s, z) -> s + 0.5 * ("
        f"{part.format('z.p')} + {part.format('z.q')})))) END"
    )


def references(measured: DataFrame) -> DataFrame:
    """A row per language: pooled histograms of the documents that pass the base rules."""
    return measured.where("NOT base_failed").groupBy("lang").agg(
        F.array(*[F.sum(F.col("classes")[i]) for i in range(CLASS_BINS)]).alias("ref_classes"),
        F.array(*[F.sum(F.col("common")[i]) for i in range(WORD_BINS)]).alias("ref_common"),
    )


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base columns, ``base_failed``, ``class_distance``, ``word_distance``, ``kept``.

    Measures are written to the shared folder once, since the references need all of them first.
    """
    measured = stored(
        measure(df, key, text, lang).withColumn(
            "base_failed",
            F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"),
        ),
        "rules",
    ).withColumn("lang_key", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")))
    pooled = stored(references(measured), "references").withColumn(
        "lang_key", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    )
    joined = sized_join(measured, pooled.drop("lang"), ["lang_key"]).selectExpr("l.*", "ref_classes", "ref_common")
    empty = F.expr("array_repeat(0L, 1)")
    joined = joined.withColumns({
        "ref_classes": F.coalesce("ref_classes", empty), "ref_common": F.coalesce("ref_common", empty),
    }).withColumns({
        "class_distance": distance("classes", "ref_classes"),
        "word_distance": distance("common", "ref_common"),
        "bare_distance": distance(f"array_append(array_repeat(0L, {WORD_BINS - 1}), 1L)", "ref_common"),
    })
    last = WORD_BINS - 1
    fewer = (
        f"double(get(common, {last})) * aggregate(ref_common, 0L, (s, v) -> s + v)"
        f" > double(get(ref_common, {last})) * n_words"
    )
    limit = (
        f"{CLASS_DISTANCE} * ({CLASS_SHARE} + {1 - CLASS_SHARE} * sqrt({CLASS_MIN_CHARS}D / greatest(word_chars, 1)))"
    )
    kept = F.expr(
        f"NOT base_failed AND NOT (word_chars >= {CLASS_MIN_CHARS} AND class_distance > {limit})"
        f" AND NOT (n_words >= {WORD_MIN_WORDS} AND word_distance > {WORD_SHARE} * bare_distance"
        f" AND coalesce({fewer}, false))"
    )
    return joined.withColumn("kept", kept).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "class_distance", "word_distance", "kept",
    )
