"""The shuffle way of joins, distances across map edges, and the order of ordered queries."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalog import ORACLES, QUERIES, SF_DIR, _canon

from areametrics.operators import joins, layers
from areametrics.operators import metrics as M
from areametrics.operators import spatial as S


def test_null_and_heavy_keys_are_spread(spark):
    points = spark.range(60_000).select(
        F.expr("CASE WHEN id % 2 = 0 THEN NULL WHEN id % 3 = 0 THEN 7 ELSE id END").alias("k"),
        F.col("id").alias("v"),
    )
    right = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.sized_join(points, right, ["k"], limit=-1, heavy_rows=500)
        parts = joined.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
        sizes = [r["count"] for r in parts]
        assert sum(sizes) == 60_000 and max(sizes) < 2 * sum(sizes) / 8
        plain = points.alias("l").join(right.alias("r"), F.col("l.k") == F.col("r.k"), "left")
        assert joined.select("v", "w").exceptAll(plain.select("v", "w")).isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_heavy_keys_have_no_cap(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 1500).alias("k"))
    assert joins.heavy_keys(df, ["k"], 2).count() == 1500
    monkeypatch.setattr(joins, "FEWEST_SHARES", 100)
    assert joins.heavy_keys(df, ["k"], 2).count() == 0  # no key has a hundredth


def test_circles_cross_map_edges(spark):
    cells = [(1, 179.9, 0.0), (2, -179.98, 0.0), (3, 0.01, 89.8), (4, 90.0, 89.99), (5, -170.0, 89.99),
             (6, 0.0, 0.0), (7, 179.0, 0.0), (8, 10.0, -89.95)]
    df = spark.createDataFrame(
        [(i, x - 0.01, y - 0.005, x + 0.01, y + 0.005) for i, x, y in cells],
        "id int, minx double, miny double, maxx double, maxy double",
    )
    away = layers.haversine("(minx + maxx) / 2", "(miny + maxy) / 2", "x", "y")
    for x, y, metres in ((179.96, 0.01, 20_000.0), (-179.99, 0.0, 15_000.0), (0.01, 89.95, 20_000.0),
                         (100.0, 89.2, 200_000.0), (0.0, -89.99, 30_000.0), (0.0, 0.0, 10.0)):
        got = {r["id"] for r in layers.cells_within(df, x, y, metres).collect()}
        every = df.withColumns({"x": F.lit(x), "y": F.lit(y)}).where(away <= metres)
        assert got == {r["id"] for r in every.collect()}


def test_no_kingdom_vanishes(spark):
    rows = [("a", "K", "s1"), ("a", "new", "s2"), ("a", None, "s3"), ("b", "new", "s2"), ("b", "K", None)]
    df = spark.createDataFrame(rows, "park_name string, kingdom string, species string")
    got = {r["park_name"]: (r["k"], r["other"]) for r in M.park_species_matrix(df, ["K"]).collect()}
    assert got == {"a": (1, 2), "b": (0, 1)}


@pytest.mark.parametrize("make", [M.dataset_summary, M.seasonal_trend, M.taxa_summary, M.kingdom_class_pairs])
def test_one_pass(spark, tmp_path, make):
    columns = ["park_name", "gbifID", "kingdom", "family", "genus", "species", "class"]
    df = spark.createDataFrame([("p", *"abcdef")], ", ".join(f"`{c}` string" for c in columns)).withColumn("month", F.lit(1))
    df.write.parquet(str(tmp_path / "t"))
    plan = make(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


ORDERS = {
    "park_richness": "species_richness DESC, park_name",
    "park_taxa_ordered": "park_name NULLS LAST, kingdom NULLS LAST, class NULLS LAST, genus NULLS LAST, species NULLS LAST",
    "annual_observations": "year DESC NULLS LAST",
    "most_observed_species": "observations DESC, species NULLS LAST",
    "top_species": "observations DESC, species NULLS LAST",
    "top_observers": 'observations DESC, "recordedBy" NULLS LAST',
    "richness_hotspots": "species_richness DESC, id",
    "park_list": "park_name NULLS LAST",
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_order(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SF_DIR)
    cur = con.execute(f"SELECT * FROM ({ORACLES[name]}) q ORDER BY {ORDERS[name]}")
    names = [c[0] for c in cur.description]
    want = [tuple(map(_canon, r)) for r in cur.fetchall()]
    got = [tuple(_canon(r[n]) for n in names) for r in df.collect()]
    assert got == want


def test_key_test_is_not_pushed_below(spark):
    """Joins ask rows for keys that are not null. Cell keys never are, so the places they come from are
    not worked out a second time below the joins that made them."""
    made = spark.range(9).join(spark.range(9).withColumnRenamed("id", "k"), F.col("id") == F.col("k")).select(
        "id", F.expr("CASE WHEN k > 3 THEN named_struct('x', k / 9D, 'y', id / 9D) END AS geom")
    )
    keyed = S._point_keys(made, 0.25)
    assert not any(keyed.schema[c].nullable for c in ("_cx", "_cy", "_cell"))
    plan = keyed.where("_cell IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "0.25" in line]
    assert joins.heavy_keys(keyed, ["_cell"], 3).select("_n").collect() == [(2,)]
