"""Height map against counting in Python."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from areametrics.operators import heightmap as H

BOX = (-10.0, 40.0, 30.0, 60.0)


def _key(x, y, levels):
    side = 2**levels
    cx = min(int((x + 10) / 40 * side), side - 1)
    cy = min(int((y - 40) / 20 * side), side - 1)
    return "".join(str((cx >> i & 1) + 2 * (cy >> i & 1)) for i in reversed(range(levels)))


def test_levels_against_counting(spark):
    rng = random.Random(5)
    # A third of all rows in one place, corners, outside and missing locations.
    rows = [(rng.uniform(-10, 30), rng.uniform(40, 60), f"s{rng.randrange(400)}") for _ in range(2000)]
    rows += [(5.0, 50.0, f"s{i % 900}") for i in range(1000)]
    rows += [(-10.0, 40.0, "s1"), (30.0, 60.0, None), (30.0, 40.0, "s2")]
    outside = [(-10.1, 50.0, "s1"), (0.0, 61.0, "s1"), (None, 50.0, "s1"), (float("nan"), 50.0, "s1")]
    df = spark.createDataFrame(rows + outside, "minx double, miny double, species string")
    counts, taxa = Counter(), defaultdict(set)
    for x, y, s in rows:
        for level in range(1, 8):
            cell = (level, _key(x, y, 7)[:level])
            counts[cell] += 1
            taxa[cell] |= {s} - {None}
    got = {(r.level, r.quad): r for r in H.height_map(df, BOX, 7).collect()}
    assert {c: r.observations for c, r in got.items()} == counts
    exact = {(r.level, r.quad): r.species_richness for r in H.exact_richness(df, BOX, 7).collect()}
    assert exact == {c: len(v) for c, v in taxa.items() if v}
    errors = [abs(r.species_richness - len(taxa[c])) / max(1, len(taxa[c])) for c, r in got.items()]
    assert max(errors) < 0.06
    for level in range(1, 8):
        most = max(n for (at, _), n in counts.items() if at == level)
        for (at, quad), r in got.items():
            if at == level:
                assert math.isclose(r.height, math.log1p(r.observations) / math.log1p(most))


def test_large_sets_stay_within_the_sketch_error(spark):
    df = spark.range(200_000).selectExpr("(id % 2) * 0.75D AS minx", "0.1D AS miny", "CAST(id AS STRING) AS species")
    got = {(r.level, r.quad): r.species_richness for r in H.height_map(df, (0, 0, 1, 1), 2).collect()}
    assert set(got) == {(1, "0"), (1, "1"), (2, "00"), (2, "11")}
    assert all(abs(n - 100_000) < 0.06 * 100_000 for n in got.values())


def test_empty_and_single_level(spark):
    empty = spark.createDataFrame([], "minx double, miny double, species string")
    assert H.height_map(empty, BOX).collect() == []
    one = spark.createDataFrame([(0.0, 50.0, None)], "minx double, miny double, species string")
    assert [tuple(r) for r in H.height_map(one, BOX, 1).collect()] == [(1, "2", 1, 0, 1.0)]
    with pytest.raises(ValueError):
        H.height_map(one, BOX, 0)


def test_coarser_levels_stay_where_the_pairs_are(spark):
    """Pairs of all levels meet in the tasks of their species: only counts by cell move after that."""
    rows = spark.range(50).selectExpr("id / 50D AS minx", "0.5D AS miny", "concat('s', id % 3) AS species")
    plan = H.exact_richness(rows, (0, 0, 1, 1))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and not [line for line in moved if "level" in line and "taxon" in line]
