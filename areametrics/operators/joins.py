"""Equi-join of a huge left side with a layer-sized right side.

Two ways, both exact:

* the right side is *measured*; under the limit it is broadcast and the left side never moves;
* otherwise both sides shuffle on the join keys, and keys with very many left rows are spread
  over sub-keys (only their right rows are repeated).

Rows with a null key match nothing; they are spread by a hash of the row. The list of heavy keys
only decides how rows are spread, never which rows match, and its length is bounded by what counts
as heavy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areametrics.schemas import POLYGON
from areametrics.sources.shared import stored

#: Broadcast only a right side measured to be below this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
#: A key with this many left rows, or with more than one part in ``FEWEST_SHARES`` of all, is split
#: into shares below that. At most ``FEWEST_SHARES`` keys can have so many.
HEAVY_ROWS = 2_000_000
FEWEST_SHARES = 50_000
#: Rows with a null key are dealt to so many sub-keys.
NULL_SHARES = 1 << 20

_SALT, _SHARES = "_salt", "_shares"


def row_bytes(df: DataFrame) -> Column:
    """Generous size of a row: values as JSON text, 32 bytes a vertex, a fixed part per column."""
    shapes = [f.name for f in df.schema.fields if f.dataType == POLYGON]
    plain = [f.name for f in df.schema.fields if f.name not in shapes]
    size = F.lit(32 + 8 * len(df.columns))
    if plain:
        size = size + F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in plain])))
    for c in shapes:
        size = size + F.expr(f"coalesce(32 * size(flatten(flatten(`{c}`))), 0)")
    return size


def measured_bytes(df: DataFrame) -> int:
    """One aggregate over ``df``; nothing but the sum reaches the driver."""
    return int(df.agg(F.sum(row_bytes(df)).cast("long").alias("b")).first()["b"] or 0)


def heavy_keys(left: DataFrame, keys: list[str], heavy_rows: int) -> DataFrame:
    """Keys with ``heavy_rows`` rows or one part in ``FEWEST_SHARES`` of all, whichever is more, and
    the number of sub-keys (``_n``) that brings each share under it.

    So there are ``FEWEST_SHARES`` such keys at most, however large the table, and every key past
    them is smaller than the mean partition of a shuffle that wide. Counting reads the key columns
    only, once, and combines before it shuffles; no key reaches the driver.
    """
    counts = stored(left.groupBy(*keys).count(), "key_counts").where(
        " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    )
    total = counts.agg(F.sum("count")).first()[0] or 0
    heavy = max(heavy_rows, -(-total // FEWEST_SHARES))
    return counts.where(F.col("count") >= heavy).select(
        *keys, F.ceil(F.col("count") / F.lit(heavy)).cast("int").alias("_n")
    )


def salted(
    left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Add a salt key to both sides: 0 for light keys, ``0 .. _n - 1`` for heavy ones, anything for
    left rows with a null key.

    The left salt is a hash of the row, so a recomputed task sends each row to the same place.
    Only the right rows of heavy keys are repeated.
    """
    hashed = F.xxhash64(*[
        F.col(f"`{f.name}`") for f in left.schema.fields if not isinstance(f.dataType, T.MapType)
    ])
    # Either side may have a column named as that of ``heavy`` is.
    heavy = F.broadcast(heavy.withColumnRenamed("_n", _SHARES))
    absent = F.expr(" OR ".join(f"`{k}` IS NULL" for k in keys))
    shares = F.when(absent, F.lit(NULL_SHARES)).otherwise(F.coalesce(F.col(_SHARES), F.lit(1)))
    left = left.join(heavy, keys, "left").withColumn(_SALT, F.coalesce(F.pmod(hashed, shares).cast("int"), F.lit(0)))
    right = right.join(heavy, keys, "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SHARES), F.lit(1)) - 1))
    )
    return left.drop(_SHARES), right.drop(_SHARES)


def sized_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    condition: Column | None = None,
    how: str = "left",
    right_bytes: int | None = None,
    limit: int | None = None,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Join ``left`` aliased ``l`` with ``right`` aliased ``r`` on ``keys`` and ``condition``.

    Result columns are those of both sides, still qualified by ``l`` and ``r``. Null keys match
    nothing and, under ``how="left"``, stay.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    size = measured_bytes(right) if right_bytes is None else right_bytes
    if size <= limit:
        right = F.broadcast(right)
    else:
        left, right = salted(left, right, keys, heavy_keys(left, keys, heavy_rows))
        right = right.hint("merge")
        keys = [*keys, _SALT]
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    if condition is not None:
        on = on & condition
    return left.alias("l").join(right.alias("r"), on, how)
