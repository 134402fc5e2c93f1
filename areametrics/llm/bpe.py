"""BPE encoding and decoding with reuse of content-defined chunks.

Places where a rolling hash of the last 16 bytes has its low bits 0 divide every text into chunks.
Documents that share a passage share its inner chunks, whatever stands before it. A worker encodes
a chunk once and then copies its ids. The text around each such place, from the last safe cut
before it to the first after it, is the join of two chunks; it is encoded by itself, so the ids
agree exactly with those of the whole text (:mod:`areametrics.llm.units` says why, and refuses a
tokenizer for which it does not hold). Inside a new chunk, units met before are reused too.

Reuse reaches as far as one worker's table of bounded size. An exchange of chunks between workers
would move every text and all its ids, more than the disk allowed.

Null text is empty and has no ids; a text is never cut; repeated keys are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from areametrics.llm.common import by_group, lists, one_per_id
from areametrics.llm.units import units_of


def encode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids``: the ids of each whole text, without added special tokens."""

    def run(keys, data, offsets):
        ids, counts = units_of(tokenizer).group(data, offsets)
        return pa.RecordBatch.from_arrays(
            [keys, lists(ids.astype(np.int32), counts, pa.int32())], [key, "ids"]
        )

    rows = one_per_id(df, key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(by_group(run), f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text``: what the tokenizer's ``decode`` gives, special tokens included. Null
    ids are decoded as none."""

    def run(batches):
        units = units_of(tokenizer)
        for batch in batches:
            texts = [
                units.decode(np.asarray(x, dtype=np.int64)).decode()
                for x in (v.values if v.is_valid else () for v in batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts)], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass, and keep the digests only: ``n_tokens``, ``ids_sha256`` of
    the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` of the text in UTF-8."""

    def run(keys, data, offsets):
        units = units_of(tokenizer)
        ids, counts = units.group(data, offsets)
        parts = np.split(ids.astype("<u4"), np.cumsum(counts)[:-1]) if len(counts) else []
        return pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array(counts, pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in parts], pa.string()),
                pa.array([hashlib.sha256(units.decode(x)).hexdigest() for x in parts], pa.string()),
            ],
            [key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = one_per_id(df, key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(
        by_group(run),
        f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
