from __future__ import annotations

import math

import pytest
from helpers import plan_text

from areametrics.operators import metrics as M

COLUMNS = "gbifID long, kingdom string, class string, family string, genus string, " \
          "species string, park_id int, park_name string, year int, month int, recordedBy string"


@pytest.fixture(scope="module")
def data(spark):
    rows = [
        # one species, a repeated id
        (1, "P", "c", "f", "g", "s1", 7, "one", 2020, 1, "ann"),
        (1, "P", "c", "f", "g", "s1", 7, "one", 2020, 1, "ann"),
        # four equal species
        *[(10 + i, "P", "c", "f", f"g{i}", f"e{i}", 8, "equal", 2021, 4, "bob") for i in range(4)],
        # a null species counts as one in the index, not in richness
        (20, "P", "c", "f", "g", "s1", 9, "withnull", 2021, 7, "bob"),
        (21, "P", "c", "f", "g", None, 9, "withnull", 2021, 7, "bob"),
        # nothing but nulls
        (30, None, None, None, None, None, None, "bare", 2022, 10, None),
        # no area
        (40, "A", "d", "f2", "g2", "s2", 1, None, None, None, "ann"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_richness(data):
    got = by(M.taxa_richness(data, "park_name", "park_id"), "park_name")
    assert set(got) == {"one", "equal", "withnull", "bare"}
    assert got["one"]["observation"] == 1
    assert got["equal"]["species_richness"] == 4 and got["equal"]["family_richness"] == 1
    assert got["withnull"]["species_richness"] == 1
    bare = got["bare"]
    assert (bare["observation"], bare["kingdom_richness"], bare["park_id"]) == (1, 0, None)


def test_richness_by_a_rank(data):
    got = by(M.area_metrics(data, "kingdom"), "kingdom")
    assert set(got) == {"P", "A"}
    assert got["P"]["species_richness"] == 5 and got["P"]["kingdom_richness"] == 1


def test_text_id(data):
    rows = data.selectExpr("* EXCEPT (park_id)", "CAST(park_id AS STRING) AS park_id")
    got = by(M.taxa_richness(rows, "park_name", "park_id"), "park_name")
    assert got["one"]["park_id"] == "7" and got["bare"]["park_id"] is None
    assert M.park_taxa(rows).where("park_name = 'one'").first().park_id == "7"


def test_richness_with_geometry(data):
    rows = data.selectExpr("*", "array(array(array(named_struct('x', 1D, 'y', 2D)))) AS park_geom")
    got = by(M.park_richness(rows, geom=True), "park_name")
    assert got["one"]["park_geom"][0][0][0].x == 1.0


def test_shannon(data):
    got = {k: v["shannon_index"] for k, v in by(M.shannon_index(data), "park_name").items()}
    assert got["one"] == 0.0 and math.copysign(1, got["one"]) == 1
    assert got["equal"] == pytest.approx(math.log(4))
    assert got["withnull"] == pytest.approx(math.log(2))
    assert got["bare"] == 0.0
    assert set(got) == {"one", "equal", "withnull", "bare"}


def test_shannon_equals_sum_over_proportions(data):
    direct = M.species_proportions(data).groupBy("park_name").agg({"p": "sum"})
    assert all(r[1] == pytest.approx(1.0) for r in direct.collect())
    h = {}
    for r in M.species_proportions(data).collect():
        h[r.park_name] = h.get(r.park_name, 0.0) - r.p * math.log(r.p)
    got = by(M.shannon_index(data), "park_name")
    assert all(got[k]["shannon_index"] == pytest.approx(v) for k, v in h.items())


def test_area_metrics_keeps_areas_without_index(data):
    richness = M.park_richness(data)
    only = M.shannon_index(data.where("park_name = 'one'"))
    got = by(M.with_shannon(richness, only), "park_name")
    assert got["one"]["shannon_index"] == 0.0 and got["equal"]["shannon_index"] is None


def test_park_taxa_keeps_null_groups(data):
    got = {(r.park_name, r.species): r.species_count for r in M.park_taxa(data).collect()}
    assert got[("one", "s1")] == 2
    assert got[("withnull", None)] == 0 and got[("bare", None)] == 0
    assert got[(None, "s2")] == 1
    assert M.by_taxa(M.park_taxa(data)).collect()[-1].park_name is None


def test_counts(data):
    assert {r.year: r.annual_observations for r in M.annual_observations(data).collect()} == {
        2020: 1, 2021: 6, 2022: 1, None: 1
    }
    assert [r.year for r in M.newest_first(M.annual_observations(data)).collect()] == [
        2022, 2021, 2020, None
    ]
    top = M.most_observed_first(M.most_observed_species(data), 1).first()
    assert (top.species, top.observations) == ("s1", 3)
    assert M.total_species(data).first().total_species == 6
    assert {(r.park_name, r.kingdom): r["count"] for r in M.rank_counts(data, "kingdom").collect()}[
        ("withnull", "P")
    ] == 2


def test_pairs_and_summary(data):
    pairs = M.kingdom_class_pairs(data).where("park_name = 'equal'").collect()
    assert [(r.kingdom_count, r.class_count) for r in pairs] == [(4, 4)]
    summary = by(M.taxa_summary(data), "park_name")
    assert summary["one"]["kingdom_count"] == 2 and summary["one"]["observation"] == 1


def test_reports(data):
    assert M.top_observers(data, 1).first().recordedBy == "bob"
    seasons = by(M.seasonal_trend(data), "season")
    assert seasons["spring"]["species_richness"] == 4 and seasons[None]["observations"] == 1
    assert by(M.compare_areas(data, "park_name", "one", "withnull"), "shared") == {
        1: {"shared": 1, "first_only": 0, "second_only": 0}
    }
    assert M.search(data, "species", "E1").count() == 1
    top = M.top_species_by_kingdom(data, 2).where("kingdom = 'P'").orderBy("rank").collect()
    assert [r.species for r in top] == ["s1", "e0"]


def test_wide_aggregations_hash_instead_of_sorting(data):
    plan = plan_text(M.taxa_richness(data, "park_name", "park_id"))
    assert plan.count("Expand") == 1 and "SortAggregate" not in plan
    assert "SortAggregate" not in plan_text(M.shannon_index(data))
    assert "Window" not in plan_text(M.shannon_index(data))


def test_all_areas_are_compared(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "y"), ("b", "y"), ("b", "z"), ("c", "q"), ("d", None), (None, "y")]
    rows += [(f"p{i:02}", "everywhere") for i in range(40)]
    df = spark.createDataFrame(rows, "park_name string, species string")
    sets = {}
    for area, species in rows:
        if area and species:
            sets.setdefault(area, set()).add(species)
    want = {
        (a, b, len(sets[a] & sets[b]), len(sets[a] - sets[b]), len(sets[b] - sets[a]))
        for a in sets for b in sets if a < b and sets[a] & sets[b]
    }
    for options in ({}, {"limit": -1, "heavy_rows": 5}):
        assert {tuple(r) for r in M.compare_all_areas(df, **options).collect()} == want
