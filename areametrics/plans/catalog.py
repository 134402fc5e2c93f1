"""Registered queries: each operator run over whole derived tables.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame. Spatial joins run a few jobs over
their layers while the query is being built, and those that store a step write it then. Nested
geometry is shown through its box or vertex sums, which other engines can compute too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areametrics.functions import crs
from areametrics.functions import geometry as G
from areametrics.functions import wkb
from areametrics.operators import heightmap as H
from areametrics.operators import layers as L
from areametrics.operators import metrics as M
from areametrics.operators import near as N
from areametrics.operators import overlay as O
from areametrics.operators import projection as P
from areametrics.operators import spatial as S
from areametrics.plans import build as B
from areametrics.plans import derived as D
from areametrics.schemas import BBOX, CSV_TYPES, GEOM
from areametrics.sources import readers, shapefile, sniff, writers
from areametrics.sources.shared import new_path, stored

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    _REGISTRY[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a source with fewer splits than cores, so heavy expressions use all of them.

    A source with enough splits, which any large one has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.raw_occurrences(spark, sf_dir)


def _spread_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.raw_occurrences(spark, sf_dir, spread)


def _grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.points_in_polygons(_points(spark, sf_dir), D.grid(spark), keep_geom=False)
    return stored(rows.select("id", "gbifID", *M.RANKS), "grid_sjoin")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.occurrence_points(spark, sf_dir, spread)


def _rounded(column: str, digits: int) -> Column:
    """Rounded, with -0.0 shown as 0.0."""
    return (F.round(column, digits) + F.lit(0.0)).alias(column)


def _vertex_sums(df: DataFrame) -> list[Column]:
    """Edge count and sums over edge starts: the last vertex of a ring repeats the first."""
    starts = f"transform(flatten({GEOM}), r -> slice(r, 1, size(r) - 1))"
    total = "aggregate(flatten({s}), 0D, (n, v) -> n + v.{a})"
    return [
        F.expr(f"CAST(size(flatten({starts})) AS BIGINT)").alias("vertices"),
        F.round(F.expr(total.format(s=starts, a="x")), 6).alias("sum_x"),
        F.round(F.expr(total.format(s=starts, a="y")), 6).alias("sum_y"),
    ]


# --- metrics per area ---------------------------------------------------------------------

@query
def park_richness(spark, d):
    return M.by_richness(M.park_richness(_spread_occurrences(spark, d)), "park_name")


@query
def taxa_richness_by_grid(spark, d):
    rows = _grid_rows(spark, d)
    boxes = D.grid(spark).select("id", "minx", "miny")
    return M.taxa_richness(rows, "id").join(boxes, "id")


@query
def shannon_index(spark, d):
    return M.shannon_index(_occurrences(spark, d)).select(
        "park_name", _rounded("shannon_index", 6)
    )


@query
def species_proportions(spark, d):
    return M.species_proportions(_occurrences(spark, d)).withColumn("p", F.round("p", 9))


@query
def park_metrics(spark, d):
    return M.area_metrics(_spread_occurrences(spark, d), "park_name", "park_id").withColumn(
        "shannon_index", _rounded("shannon_index", 6)
    )


@query
def richness_with_shannon(spark, d):
    rows = _occurrences(spark, d)
    joined = M.with_shannon(M.park_richness(rows), M.shannon_index(rows))
    return joined.withColumn("shannon_index", _rounded("shannon_index", 6))


@query
def grid_metrics(spark, d):
    rows = _grid_rows(spark, d)
    return M.area_metrics(rows, "id").withColumn("shannon_index", _rounded("shannon_index", 6))


@query
def park_taxa(spark, d):
    return M.park_taxa(_spread_occurrences(spark, d))


@query
def park_taxa_ordered(spark, d):
    return M.by_taxa(M.park_taxa(_spread_occurrences(spark, d)))


@query
def annual_observations(spark, d):
    return M.newest_first(M.annual_observations(_occurrences(spark, d)))


@query
def most_observed_species(spark, d):
    return M.most_observed_first(M.most_observed_species(_occurrences(spark, d)))


@query
def total_species(spark, d):
    return M.total_species(_occurrences(spark, d))


@query
def park_kingdom_counts(spark, d):
    return M.rank_counts(_occurrences(spark, d), "kingdom")


@query
def park_class_counts(spark, d):
    return M.rank_counts(_occurrences(spark, d), "class")


@query
def park_kingdom_class_pairs(spark, d):
    return M.kingdom_class_pairs(_occurrences(spark, d))


@query
def park_taxa_summary(spark, d):
    return M.taxa_summary(_spread_occurrences(spark, d))


# --- tables, columns, filters ---------------------------------------------------------------

@query
def occurrence_table(spark, d):
    return _points(spark, d).drop(GEOM)


@query
def prune_fields(spark, d):
    return P.prune(_occurrences(spark, d), ["gbifID", "species", "order", "year"])


@query
def layer_bbox(spark, d):
    return P.set_bbox(D.raw_plots(spark, d)).select("OBJECTID", *BBOX)


@query
def clean_layer(spark, d):
    mapping = {"OBJECTID": "park_id", "Nom": "park_name", "TYPO1": "park_type1", GEOM: GEOM}
    return L.clean_layer(D.raw_plots(spark, d), mapping, 4326, 4326).drop(GEOM)


@query
def type_filter(spark, d):
    kept = D.raw_plots(spark, d).where(P.any_equal(D.PARK_TYPE_TERMS))
    return kept.select("OBJECTID", "Nom", "Type", "TYPO1", "TYPO2")


@query
def drop_any_null(spark, d):
    return P.drop_any_null(D.raw_plots(spark, d)).drop(GEOM)


@query
def limit_rows(spark, d):
    """Which rows are kept is open; how many, and that they are rows of the source, is not."""
    def facts(name: str, rows: DataFrame) -> DataFrame:
        kept = P.limit_rows(rows, 1000)
        known = rows.distinct().withColumn("known", F.lit(1))
        return kept.join(known, rows.columns, "left").agg(
            F.count("*").alias("kept"), F.count("known").alias("known")
        ).select(F.lit(name).alias("source"), "kept", "known")

    nations = D.table(spark, d, "nation").select("n_nationkey")
    return facts("occurrences", _occurrences(spark, d).select("gbifID")).union(facts("nations", nations))


@query
def profile_nulls(spark, d):
    return P.profile(_spread_occurrences(spark, d))


@query
def park_types(spark, d):
    return P.distinct_values(D.raw_plots(spark, d), "TYPO2")


# --- spatial joins --------------------------------------------------------------------------

@query
def grid_sjoin(spark, d):
    return S.points_in_polygons(_points(spark, d), D.grid(spark)).drop(GEOM)


@query
def layer_sjoin_points(spark, d):
    joined = S.points_in_polygons(_points(spark, d), D.parks(spark, d))
    return joined.select("gbifID", "species", "park_id", "park_name", *BBOX)


@query
def colliding_names(spark, d):
    parks = D.parks(spark, d).withColumnRenamed("park_name", "species")
    joined = S.points_in_polygons(_points(spark, d), parks, keep_geom=False)
    return joined.select("gbifID", "species", "park_id", "species_1")


@query
def mixed_sjoin(spark, d):
    """Plots and, around them all, one large rectangle."""
    plots = D.plots(spark, d, spread).select(F.col("OBJECTID").alias("plot_id"), GEOM, *BBOX)
    world = spark.range(1).select(
        F.lit(-1).cast("long").alias("plot_id"), G.rectangle("-180D", "-90D", "0.7D", "90D").alias(GEOM)
    ).withColumns(G.polygon_bbox(GEOM))
    joined = S.points_in_polygons(_points(spark, d), plots.unionByName(world), keep_geom=False)
    return joined.select("gbifID", "species", "plot_id")


#: Settings under which joins shuffle and keys of the test tables are heavy.
_SHUFFLED = {"limit": -1, "heavy_rows": 500}


@query
def plot_sjoin_shuffled(spark, d):
    plots = D.plots(spark, d, spread).select(F.col("OBJECTID").alias("plot_id"), GEOM, *BBOX)
    joined = S.points_in_polygons(_points(spark, d), plots, keep_geom=False, **_SHUFFLED)
    return joined.select("gbifID", "species", "plot_id")


@query
def layer_sjoin_cells_shuffled(spark, d):
    grid = D.grid(spark)
    rows = S.points_in_polygons(_points(spark, d), grid, keep_geom=False, **_SHUFFLED)
    joined = S.cells_in_polygons(rows, D.parks(spark, d), grid, "id", **_SHUFFLED)
    return joined.select("gbifID", "species", "id", "park_id", "park_name", *BBOX)


@query
def clip_points_shuffled(spark, d):
    kept = S.clip_to_region(_points(spark, d), D.parks(spark, d), 4326, 4326, **_SHUFFLED)
    return kept.select("gbifID", "species", F.col("geom.x").alias("x"), F.col("geom.y").alias("y"))


@query
def layer_sjoin_cells(spark, d):
    grid = D.grid(spark)
    rows = S.points_in_polygons(_points(spark, d), grid, keep_geom=False)
    joined = S.cells_in_polygons(rows, D.parks(spark, d), grid, "id")
    return joined.select("gbifID", "species", "id", "park_id", "park_name", *BBOX)


@query
def layer_sjoin_nested(spark, d):
    grid = D.grid(spark)
    rows = S.points_in_polygons(_points(spark, d), grid, keep_geom=False)
    joined = S.cells_in_polygons(rows, D.neighbourhoods(spark, d), grid, "id")
    return joined.select("gbifID", "id", "qr_id", "qr_name", "minx", "maxx")


@query
def plot_sjoin(spark, d):
    plots = D.plots(spark, d, spread).select(F.col("OBJECTID").alias("plot_id"), GEOM, *BBOX)
    joined = S.points_in_polygons(_points(spark, d), plots, keep_geom=False)
    return joined.select("gbifID", "species", "plot_id")


@query
def plot_metrics(spark, d):
    plots = D.plots(spark, d, spread).select(F.col("OBJECTID").alias("plot_id"), GEOM, *BBOX)
    rows = S.points_in_polygons(_points(spark, d), plots, keep_geom=False, how="inner")
    rows = stored(rows.select("plot_id", "gbifID", *M.RANKS), "plot_sjoin")
    return M.area_metrics(rows, "plot_id").withColumn("shannon_index", _rounded("shannon_index", 6))


@query
def clip_points(spark, d):
    kept = S.clip_to_region(_points(spark, d), D.parks(spark, d), 4326, 4326)
    return kept.select("gbifID", "species", F.col("geom.x").alias("x"), F.col("geom.y").alias("y"))


@query
def clip_plots(spark, d):
    kept = S.clip_to_region(D.plots(spark, d), D.parks(spark, d), 4326, 4326)
    return kept.select("OBJECTID", *BBOX)


def _plots_and(spark, d, *wide):
    """Plots as ``plot_id`` and, numbered from -1 down, rectangles far wider than they."""
    rows = D.plots(spark, d).select(F.col("OBJECTID").cast("long").alias("plot_id"), GEOM, *BBOX)
    for i, sides in enumerate(wide):
        one = spark.range(1).select(
            F.lit(-1 - i).cast("long").alias("plot_id"), G.rectangle(*sides).alias(GEOM)
        )
        rows = rows.unionByName(one.withColumns(G.polygon_bbox(GEOM)))
    return rows


@query
def clip_mixed(spark, d):
    """Plots and a rectangle around half the world, clipped by size class."""
    rows = _plots_and(spark, d, ("-180D", "-90D", "0.7D", "90D"), ("2D", "-90D", "180D", "90D"))
    return S.clip_polygons(rows, D.parks(spark, d)).select("plot_id", *BBOX)


@query
def mixed_boxes(spark, d):
    """Boxes of plots and of two wide rectangles, one of them inside a neighbourhood."""
    rows = _plots_and(spark, d, ("-180D", "-90D", "0.7D", "90D"), ("0.25D", "0.125D", "0.375D", "0.875D"))
    joined = S.boxes_in_polygons(rows.drop(GEOM), D.neighbourhoods(spark, d), keep_geom=False)
    return joined.select("plot_id", "qr_id", "qr_name")


@query
def clip_stacked(spark, d):
    """Occurrences on a heap of lots, one for each part and nearly all in one place, or far west."""
    side = "(p_partkey % 4) / 1024D"
    lots = spread(D.table(spark, d, "part"), "p_partkey").select(
        G.rectangle(f"0.25D + {side}", "0.25D", f"0.2578125D + {side}", "0.2578125D").alias(GEOM)
    )
    west = spark.range(1).select(G.rectangle("-180D", "-90D", "0.125D", "90D").alias(GEOM))
    region = lots.unionByName(west).withColumns(G.polygon_bbox(GEOM))
    return S.clip_points(_points(spark, d), region).select("gbifID", "species")


@query
def plots_in_neighbourhoods(spark, d):
    plots = D.plots(spark, d).select("OBJECTID", *BBOX)
    joined = S.boxes_in_polygons(plots, D.neighbourhoods(spark, d), keep_geom=False)
    return joined.select("OBJECTID", "qr_id", "qr_name")


# --- layers and coordinates -----------------------------------------------------------------

@query
def dissolve_plots(spark, d):
    merged = L.dissolve(D.raw_plots(spark, d), "Nom", "OBJECTID")
    return merged.select("Nom", "Type", F.size(GEOM).cast("long").alias("parts"), *BBOX)


@query
def reproject_mtm8(spark, d):
    metres = _spread_occurrences(spark, d).where(f"{D.LON} IS NOT NULL").selectExpr(
        "gbifID", f"267000 + {D.LON} * 45000 AS lon", f"5029000 + {D.LAT} * 34000 AS lat"
    )
    moved = crs.reproject_xy(metres, "lon", "lat", 32188, 4326)
    return moved.select("gbifID", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query
def reproject_plots(spark, d):
    metres = D.raw_plots(spark, d).select("OBJECTID", F.expr(
        f"transform({GEOM}, p -> transform(p, r -> transform(r, v -> named_struct("
        "'x', 267000 + v.x * 45000, 'y', 5029000 + v.y * 34000))))"
    ).alias(GEOM))
    boxed = P.set_bbox(crs.reproject(metres, 32188, 4326))
    return boxed.select("OBJECTID", *[F.round(c, 8).alias(c) for c in BBOX])


@query
def grid_over_plots(spark, d):
    return L.grid_over(D.plots(spark, d), 0.25).select("id", *BBOX)


# --- files ----------------------------------------------------------------------------------

@query
def csv_to_parquet(spark, d):
    text, table = new_path(spark, "csv"), new_path(spark, "parquet")
    rows = _spread_occurrences(spark, d).select(*[f"`{c}`" for c in CSV_TYPES])
    rows.write.option("sep", "\t").option("header", True).option("quote", "").csv(text)
    writers.csv_to_parquet(spark, text, table)
    return readers.read_occurrences(spark, table)


@query
def csv_sniffed(spark, d):
    """Semicolons, a header and quotes, none of which the reader is told."""
    text = new_path(spark, "csv")
    rows = _spread_occurrences(spark, d).select(*[f"`{c}`" for c in CSV_TYPES])
    rows.write.option("sep", ";").option("header", True).option("quoteAll", True).option("escape", '"').option(
        "compression", "gzip"
    ).csv(text)
    return sniff.read_delimited(spark, text)


@query
def csv_sniffed_headerless(spark, d):
    """Commas without a header: types come from all rows."""
    text = new_path(spark, "csv")
    rows = _spread_occurrences(spark, d).selectExpr(
        "gbifID", "species", "day", "eventDate", "gbifID / 8 AS eighth", "year > 1995 AS recent"
    )
    rows.write.csv(text)
    return sniff.read_delimited(spark, text)


@query
def area_rows(spark, d):
    table = new_path(spark, "area")
    writers.write_table(_spread_occurrences(spark, d), table)
    return readers.read_area_occurrences(spark, table).select("gbifID", "park_id", "park_name")


@query
def geojson_roundtrip(spark, d):
    path = new_path(spark, "geojson")
    writers.write_features(D.raw_plots(spark, d).drop("area_value"), path)
    properties = "OBJECTID BIGINT, Nom STRING, Type STRING, TYPO1 STRING, TYPO2 STRING"
    back = readers.read_features(spark, path, properties)
    return back.select(
        "OBJECTID", "Nom", "Type", "TYPO1", "TYPO2", *_vertex_sums(back)
    )


@query
def shapefile_roundtrip(spark, d):
    """Plots written as shapefiles and read by ranges of records, nulls included."""
    path = new_path(spark, "shapefile")
    shapefile.write_shapefile(spread(D.raw_plots(spark, d).drop("area_value"), "OBJECTID"), path, 4326)
    back = shapefile.read_shapefile(spark, path, split_bytes=64 << 10)
    return back.select("OBJECTID", "Nom", "Type", "TYPO1", "TYPO2", *_vertex_sums(back))


@query
def wkb_roundtrip(spark, d):
    """Plots as well-known binary in both byte orders by turns, and back."""
    plots = D.raw_plots(spark, d).drop("area_value")
    little, big = (wkb.polygon_to_wkb(GEOM, b) for b in (False, True))
    coded = plots.withColumn("coded", F.when(F.col("OBJECTID") % 2 == 0, little).otherwise(big))
    back = coded.drop(GEOM).withColumn(GEOM, wkb.polygon_from_wkb("coded"))
    return back.select("OBJECTID", "Nom", "Type", "TYPO1", "TYPO2", *_vertex_sums(back))


@query
def staged_build(spark, d):
    """All stages from files; the first run is capped, and the second must not keep its tables."""
    root = new_path(spark, "build")
    rows = _spread_occurrences(spark, d).select(*[f"`{c}`" for c in CSV_TYPES])
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("compression", "gzip").csv(
        f"{root}/csv"
    )
    writers.write_features(D.grid(spark).select("id", GEOM), f"{root}/grid")
    grid = B.Layer(f"{root}/grid", "id BIGINT", {"id": "id"}, "id", per_line=True)
    B.run(spark, B.Build(f"{root}/out", f"{root}/csv", {"grid": grid}, limit=7))
    B.run(spark, B.Build(f"{root}/out", f"{root}/csv", {"grid": grid}))
    table = spark.read.parquet(f"{root}/out/processed/grid_metrics.parquet").drop(GEOM)
    return table.withColumn("shannon_index", _rounded("shannon_index", 6))


# --- map and report data --------------------------------------------------------------------

@query
def choropleth_features(spark, d):
    metrics = M.park_richness(_spread_occurrences(spark, d))
    features = L.choropleth(D.parks(spark, d), metrics, "park_name", ["species_richness"])
    return P.set_bbox(features).drop(GEOM)


@query
def park_list(spark, d):
    return L.pick_list(_occurrences(spark, d))


@query
def richness_bars(spark, d):
    return L.bar_series(M.park_richness(_spread_occurrences(spark, d)))


@query
def top_species_by_kingdom(spark, d):
    return M.top_species_by_kingdom(_occurrences(spark, d))


@query
def top_species(spark, d):
    return M.most_observed_first(M.most_observed_species(_occurrences(spark, d)), 10)


@query
def top_observers(spark, d):
    return M.top_observers(_occurrences(spark, d))


@query
def seasonal_trend(spark, d):
    return M.seasonal_trend(_occurrences(spark, d))


@query
def dataset_summary(spark, d):
    return M.dataset_summary(_occurrences(spark, d))


@query
def observations_by_kingdom(spark, d):
    return M.observations_by_kingdom(_occurrences(spark, d))


@query
def richness_hotspots(spark, d):
    rows = _grid_rows(spark, d)
    return M.by_richness(M.taxa_richness(rows, "id"), "id").select("id", "species_richness").limit(20)


def _places(spark: SparkSession, d: str) -> DataFrame:
    rows = _spread_occurrences(spark, d)
    return rows.select("species", F.col(D.LON).alias("minx"), F.col(D.LAT).alias("miny"))


@query
def height_map(spark, d):
    """Rows and relief of every cell on ten levels over the unit square."""
    found = H.height_map(_places(spark, d), (0, 0, 1, 1))
    return found.select("level", "quad", "observations", _rounded("height", 9))


@query
def height_map_species(spark, d):
    """Species of all cells by level, and whether each cell's estimate is within 5 %."""
    places = stored(_places(spark, d), "places")
    exact = H.exact_richness(places, (0, 0, 1, 1)).withColumnRenamed("species_richness", "exact")
    both = H.height_map(places, (0, 0, 1, 1)).join(exact, ["level", "quad"], "left")
    n = F.coalesce("exact", F.lit(0))
    return both.groupBy("level").agg(
        F.count("*").alias("cells"), F.sum(n).alias("species"),
        F.bool_and(F.abs(F.col("species_richness") - n) <= 0.05 * n).alias("within"),
    )


@query
def closest_plots(spark, d):
    near = L.closest(D.raw_plots(spark, d), 0.3, 0.05, 10, "OBJECTID")
    return near.select("OBJECTID", F.round("distance", 9).alias("distance"))


@query
def plots_within_radius(spark, d):
    near = L.cells_within(D.plots(spark, d), 0.5, 0.05, 5000.0)
    return near.select("OBJECTID", F.round("distance", 3).alias("distance"))


@query
def park_kingdom_matrix(spark, d):
    return M.park_species_matrix(_occurrences(spark, d), D.KINGDOMS)


@query
def park_comparison(spark, d):
    return M.compare_areas(_occurrences(spark, d), "park_name", "NATION_1", "NATION_2")


@query
def species_search(spark, d):
    return M.search(_occurrences(spark, d), "species", "Bolt").select(
        "gbifID", "species", "park_name"
    )


# --- overlay of outlines --------------------------------------------------------------------

def _outline_facts() -> list[Column]:
    """Area in lattice units, corners, and shells less holes: what a union looks like to others."""
    return [
        F.expr(f"CAST(round({O.area()} * 1048576) AS BIGINT)").alias("area_units"),
        F.expr(f"CAST(size(flatten(flatten({GEOM}))) - size(flatten({GEOM})) AS BIGINT)").alias("vertices"),
        F.expr(f"CAST(2 * size({GEOM}) - size(flatten({GEOM})) AS BIGINT)").alias("euler"),
    ]


@query
def dissolve_lots(spark, d):
    """Lots of a name as one outline, without the borders between them."""
    return O.dissolve(D.lots(spark, d), "Nom", "lot_id").select("Nom", *_outline_facts())


@query
def union_lots(spark, d):
    """All lots and zones as one layer without inner borders, summed over its parts."""
    both = D.lots(spark, d).select(GEOM, *BBOX).unionByName(D.zones(spark, d).select(GEOM, *BBOX))
    # As of a whole outline, but summed by ring: the lots are one part, whose outline grows with the layer.
    facts = O.union(both).select(
        F.expr("CAST(round(area * 1048576) AS BIGINT)").alias("area_units"), "vertices", (2 - F.col("rings")).alias("euler")
    )
    return facts.agg(*[F.sum(c).alias(c) for c in ("area_units", "vertices", "euler")])


@query
def clip_lots_cut(spark, d):
    """Lots cut to the zones."""
    return O.cut(D.lots(spark, d), D.zones(spark, d), "lot_id").select("lot_id", "Nom", *_outline_facts())


@query
def lots_in_zones(spark, d):
    """Each lot with the zones that hold all of its outline."""
    joined = O.polygons_in_polygons(D.lots(spark, d), D.zones(spark, d), "lot_id", "zone_id")
    return joined.select("lot_id", "zone_id", "zone_name")


# --- joins by distance ----------------------------------------------------------------------

@query
def nearest_plots(spark, d):
    """The three plots nearest to every station."""
    plots = D.plots(spark, d).select(F.col("OBJECTID").alias("plot_id"), GEOM, *BBOX)
    found = N.nearest(D.stations(spark, d), plots, "station_id", "plot_id", 3)
    return found.withColumn("distance", F.round("distance", 9))


@query
def ships_near_ports(spark, d):
    """Ships and ports at most 4 km apart."""
    found = N.within_metres(D.ships(spark, d), D.ports(spark, d), "ship_id", "port_id", 4000.0)
    return found.withColumn("distance", F.round("distance", 3))


@query
def ships_near_ports_shuffled(spark, d):
    """The same by shuffling both sides, with cubes of many ships split."""
    found = N.within_metres(D.ships(spark, d), D.ports(spark, d), "ship_id", "port_id", 4000.0, limit=-1, heavy_rows=3)
    return found.withColumn("distance", F.round("distance", 3))


# --- comparisons, projections ---------------------------------------------------------------

@query
def park_comparisons(spark, d):
    """Species that every two parks share, and those of one only."""
    return M.compare_all_areas(_occurrences(spark, d))


@query
def park_comparisons_shuffled(spark, d):
    return M.compare_all_areas(_occurrences(spark, d), **_SHUFFLED)


@query
def reproject_planes(spark, d):
    """Longitude and latitude in two planes, and how far off the way back from the first ends."""
    degrees = _spread_occurrences(spark, d).where(f"{D.LON} IS NOT NULL").selectExpr(
        "gbifID", f"{D.LON} * 20 - 80 AS lon", f"{D.LAT} * 15 + 45 AS lat"
    )
    both = degrees.withColumns({"x": F.col("lon"), "y": F.col("lat"), "mx": F.col("lon"), "my": F.col("lat")})
    moved = crs.reproject_xy(crs.reproject_xy(both, "x", "y", 4326, 32198), "mx", "my", 4326, 3857)
    back = crs.reproject_xy(moved.withColumns({"bx": F.col("x"), "by": F.col("y")}), "bx", "by", 32198, 4326)
    off = back.withColumns({"lon_off": F.col("bx") - F.col("lon"), "lat_off": F.col("by") - F.col("lat")})
    return off.select(
        "gbifID", *[_rounded(c, 3) for c in ("x", "y", "mx", "my")], *[_rounded(c, 8) for c in ("lon_off", "lat_off")]
    )
