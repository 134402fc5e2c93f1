"""Height map of observations: rows and species by square cell, at every level of a quad tree.

A cell's *quad key* has a digit per level, the quarter (0 to 3: column, plus 2 for the upper row) of
the cell above; the key of any cell above is a prefix of it. Rows are read once, for the finest
level: counts and distinct sketches (HyperLogLog) are combined before the shuffle, so a cell with a
third of all rows is one sketch a task. There are ``4 ** levels`` finest cells at most, whatever the
number of rows, and coarser levels are merged from cells, not rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areametrics.sources.shared import stored

#: So many levels are merged from one stored level at a time: fewer jobs, and no sketch is sent
#: more often than that.
STRIDE = 4
#: Registers of a sketch are 2 to this power: a standard error of 1.6 % past some hundred species.
SKETCH_BITS = 12


def quad_key(x: Column, y: Column, levels: int, box: tuple[float, float, float, float]) -> Column:
    """Quad key of a location; null if it is null, no number or outside ``box`` (minx, miny, maxx, maxy).

    Borders belong to the cell on their upper right, those of the box to the cells inside it."""
    return _quad(*_numbers(x, y, levels, box), levels)


def _numbers(x: Column, y: Column, levels: int, box: tuple[float, float, float, float]) -> list[Column]:
    """Column and row of a location's finest cell."""
    minx, miny, maxx, maxy = map(float, box)
    side = 1 << levels

    def index(v: Column, low: float, high: float) -> Column:
        at = F.floor((v - F.lit(low)) / F.lit(high - low) * F.lit(float(side))).cast("long")
        return F.when(v.between(low, high), F.least(at, F.lit(side - 1)))

    return [index(x, minx, maxx), index(y, miny, maxy)]


def _quad(cx: Column, cy: Column, levels: int) -> Column:
    return F.concat(*[
        (F.shiftright(cx, i).bitwiseAND(1) + F.shiftright(cy, i).bitwiseAND(1) * 2).cast("string")
        for i in reversed(range(levels))
    ])


def _located(
    points: DataFrame, x: str, y: str, levels: int, box: tuple[float, float, float, float], species: str
) -> DataFrame:
    """Rows in ``box``: ``cx``, ``cy``, ``taxon``. Keys stay numbers until cells are few."""
    minx, miny, maxx, maxy = map(float, box)
    x, y = F.col(f"`{x}`"), F.col(f"`{y}`")
    cx, cy = _numbers(x, y, levels, box)
    return points.where(x.between(minx, maxx) & y.between(miny, maxy)).select(
        cx.alias("cx"), cy.alias("cy"), F.col(f"`{species}`").alias("taxon")
    )


def _merged(cells: DataFrame, levels: list[int]) -> DataFrame:
    """Cells of coarser levels from the cells of one level."""
    taken = cells.select(
        F.explode(F.array(*map(F.lit, levels))).alias("level"), "quad", "observations", "sketch"
    )
    return taken.groupBy("level", F.expr("substring(quad, 1, level)").alias("quad")).agg(
        F.sum("observations").alias("observations"), F.hll_union_agg("sketch").alias("sketch")
    )


def height_map(
    points: DataFrame, box: tuple[float, float, float, float], levels: int = 10, species: str = "species",
    x: str = "minx", y: str = "miny", sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """``level`` (1 to ``levels``), ``quad``, ``observations``, ``species_richness`` and ``height`` of
    every cell with rows.

    ``observations`` is exact, ``species_richness`` a sketch's estimate that leaves nulls out.
    ``height`` goes from 0 to 1, by the logarithm of the rows, 1 for the level's fullest cell. Rows
    without a location in ``box`` are on no level."""
    if levels < 1:
        raise ValueError(f"{levels} levels: at least one")
    cells = _located(points, x, y, levels, box, species).groupBy("cx", "cy").agg(
        F.count("*").alias("observations"), F.hll_sketch_agg(F.col("taxon").cast("string"), sketch_bits).alias("sketch")
    ).select(F.lit(levels).alias("level"), _quad(F.col("cx"), F.col("cy"), levels).alias("quad"), "observations", "sketch")
    parts, finest = [stored(cells, "cells")], levels
    while finest > 1:
        above = list(range(max(1, finest - STRIDE), finest))
        base = parts[-1].where(F.col("level") == finest)
        parts.append(stored(_merged(base, above), "cells"))
        finest = above[0]
    every = reduce(DataFrame.unionByName, parts)
    # A row per level.
    most = every.groupBy("level").agg(F.max("observations").alias("most"))
    return every.join(F.broadcast(most), "level").select(
        "level", "quad", "observations", F.hll_sketch_estimate("sketch").alias("species_richness"),
        (F.log1p("observations") / F.log1p("most")).alias("height"),
    )


def exact_richness(
    points: DataFrame, box: tuple[float, float, float, float], levels: int = 10, species: str = "species",
    x: str = "minx", y: str = "miny",
) -> DataFrame:
    """``level``, ``quad`` and the exact ``species_richness``, by distinct pairs: the measure of the
    estimate, at the cost of shuffling a row per finest cell and species twice. The second time by
    species, so that the pairs of all coarser levels meet in the task that has them."""
    pairs = _located(points, x, y, levels, box, species).where("taxon IS NOT NULL").distinct()
    leveled = pairs.repartition("taxon").select(
        F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"), "cx", "cy", "taxon"
    ).selectExpr(
        "level", *[f"shiftright({c}, {levels} - level) AS {c}" for c in ("cx", "cy")], "taxon"
    )
    cells = leveled.groupBy("taxon", "level", "cx", "cy").agg(F.lit(1).alias("_one"))
    counted = cells.groupBy("level", "cx", "cy").agg(F.count("*").alias("species_richness"))
    wide = counted.withColumns({c: F.expr(f"shiftleft({c}, {levels} - level)") for c in ("cx", "cy")})
    quad = _quad(F.col("cx"), F.col("cy"), levels)
    return wide.select("level", F.substring(quad, F.lit(1), F.col("level")).alias("quad"), "species_richness")
