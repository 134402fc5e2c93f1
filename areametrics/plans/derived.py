"""Occurrences and layers derived from the star-schema test tables.

The tables hold no places and no nulls, so coordinates are computed from keys with whole-number
arithmetic and nulls are put in by key. SQL engines then agree on every value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areametrics.functions import geometry as G
from areametrics.operators.projection import occurrence_table
from areametrics.schemas import GEOM, LAT, LON

# The kingdoms of the derived occurrences.
KINGDOMS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
#: Grid columns and rows over the unit square.
GRID = 20


# Columns of the test tables in use. Given up front, no file is opened to plan.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def raw_occurrences(
    spark: SparkSession, sf_dir: str, spread: Callable[..., DataFrame] | None = None
) -> DataFrame:
    """One row per line item, with the occurrence columns, coordinates and a park by supplier.

    ``spread``, if given, may repartition the scan by the two columns of the row key.
    """
    line = table(spark, sf_dir, "lineitem")
    if spread:
        line = spread(line, "l_orderkey", "l_linenumber")
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    joined = (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
    )
    in_park = "s_nationkey % 7 <> 0"
    return joined.selectExpr(
        "l_orderkey * 8 + l_linenumber AS gbifID",
        "concat('occ-', l_orderkey, '-', l_linenumber) AS occurrenceID",
        "p_type AS kingdom",
        "p_brand AS phylum",
        "CAST(p_size AS STRING) AS class",
        "p_type AS `order`",
        "p_brand AS family",
        "split_part(p_name, ' ', 2) AS genus",
        "CASE WHEN l_linenumber <> 7 THEN p_name END AS species",
        "CASE WHEN l_linenumber <> 7 THEN 'SPECIES' ELSE 'GENUS' END AS taxonRank",
        "p_name AS scientificName",
        "date_format(l_shipdate, 'yyyy-MM-dd') AS eventDate",
        "day(l_shipdate) AS day",
        "month(l_shipdate) AS month",
        "year(l_shipdate) AS year",
        "p_partkey AS taxonKey",
        "l_returnflag AS basisOfRecord",
        "l_linestatus AS license",
        "CAST(l_suppkey AS STRING) AS recordedBy",
        "CASE WHEN l_suppkey % 10 <> 9 THEN ((l_orderkey * 7919 + l_partkey * 104729 "
        f"+ l_linenumber * 31) % 100003) / CAST(100003 AS DOUBLE) END AS {LON}",
        "((l_orderkey * 15485863 + l_suppkey * 7907 + l_linenumber * 17) % 100019) "
        f"/ CAST(100019 AS DOUBLE) AS {LAT}",
        f"CASE WHEN {in_park} THEN s_nationkey END AS park_id",
        f"CASE WHEN {in_park} THEN n_name END AS park_name",
    )


def grid(spark: SparkSession) -> DataFrame:
    """``GRID`` x ``GRID`` unit-square cells, ``id = cx * GRID + cy``."""
    n = float(GRID)
    cells = spark.range(GRID * GRID).selectExpr(
        "CAST(id AS INT) AS id", f"CAST(id DIV {GRID} AS INT) AS cx", f"CAST(id % {GRID} AS INT) AS cy"
    )
    box = [f"cx / {n}D", f"cy / {n}D", f"(cx + 1) / {n}D", f"(cy + 1) / {n}D"]
    return cells.select("id", G.rectangle(*box).alias(GEOM)).withColumns(G.polygon_bbox(GEOM))


# Outlines as parts -> rings -> (x, y) offsets from a lattice corner. The park
# figures are the ones of the test layer, the plot figures are in units of 1/1024.
PARK_SHAPES = {
    "ell": [[[(0, 0), (0.18, 0), (0.18, 0.08), (0.08, 0.08), (0.08, 0.18), (0, 0.18)]]],
    "holed": [[[(0, 0), (0.18, 0), (0.18, 0.08), (0.08, 0.08), (0.08, 0.18), (0, 0.18)],
               [(0.02, 0.02), (0.02, 0.06), (0.06, 0.06), (0.06, 0.02)]]],
}
PLOT_SHAPES = {
    "ell": [[[(0, 0), (6, 0), (6, 3), (3, 3), (3, 6), (0, 6)]]],
    "holed": [[[(0, 0), (6, 0), (6, 6), (0, 6)], [(1, 1), (1, 3), (3, 3), (3, 1)]]],
    "diamond": [[[(3, 0), (6, 3), (3, 6), (0, 3)]]],
    "pair": [[[(0, 0), (2, 0), (2, 2), (0, 2)]], [[(4, 4), (6, 4), (6, 6), (4, 6)]]],
}
PLOT_UNIT = 1 / 1024
#: Plots per lattice row; the row above starts where this one ends.
PLOT_ROW = 128


def _outline(parts: list, x: str, y: str, unit: float) -> str:
    def vertex(v: tuple) -> str:
        return (
            f"named_struct('x', {x} + {float(v[0]) * unit!r}D, 'y', {y} + {float(v[1]) * unit!r}D)"
        )

    def ring(vs: list) -> str:
        return f"array({', '.join(vertex(v) for v in [*vs, vs[0]])})"

    return f"array({', '.join('array(' + ', '.join(ring(r) for r in p) + ')' for p in parts)})"


def _shaped(shape: str, shapes: dict, x: str, y: str, unit: float) -> str:
    cases = " ".join(
        f"WHEN {shape} = '{name}' THEN {_outline(parts, x, y, unit)}"
        for name, parts in shapes.items()
    )
    return f"CASE {cases} END"


PARK_SHAPE = "CASE WHEN n_nationkey % 3 = 0 THEN 'holed' ELSE 'ell' END"
PLOT_SHAPE = (
    "CASE WHEN c_custkey % 8 = 5 THEN 'pair' WHEN c_custkey % 4 = 1 THEN 'diamond' "
    "WHEN c_custkey % 3 = 0 THEN 'holed' ELSE 'ell' END"
)


def parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An L-shaped park per nation on a 5 x 5 lattice; every third has a square hole."""
    x, y = "(n_nationkey % 5) * 0.2D", "(n_nationkey DIV 5) * 0.2D"
    return (
        table(spark, sf_dir, "nation")
        .selectExpr(
            "n_nationkey AS park_id",
            "n_name AS park_name",
            f"{_shaped(PARK_SHAPE, PARK_SHAPES, x, y, 1.0)} AS {GEOM}",
        )
        .withColumns(G.polygon_bbox(GEOM))
    )


def neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full-height rectangle per region."""
    box = ["r_regionkey / 5D", "0", "(r_regionkey + 1) / 5D", "1"]
    return (
        table(spark, sf_dir, "region")
        .select(
            F.col("r_regionkey").alias("qr_id"),
            F.col("r_name").alias("qr_name"),
            G.rectangle(*box).alias(GEOM),
        )
        .withColumns(G.polygon_bbox(GEOM))
    )


def raw_plots(
    spark: SparkSession, sf_dir: str, spread: Callable[..., DataFrame] | None = None
) -> DataFrame:
    """A green-space outline per customer, as raw layers name their columns (no box yet).

    Outlines do not overlap, whatever the number of customers: the lattice grows upwards. Some
    names and types are null; four neighbours share a name. ``spread``, if given, may repartition
    the scan by the key.
    """
    x, y = f"(c_custkey % {PLOT_ROW}) / 128D", f"(c_custkey DIV {PLOT_ROW}) / 128D"
    customer = table(spark, sf_dir, "customer")
    if spread:
        customer = spread(customer, "c_custkey")
    return customer.selectExpr(
        "c_custkey AS OBJECTID",
        "CASE WHEN c_custkey % 50 <> 7 THEN concat('Green ', c_custkey DIV 4) END AS Nom",
        f"{case_of(PLOT_TYPES['Type'], 'c_custkey % 5')} AS Type",
        f"{case_of(PLOT_TYPES['TYPO1'], 'c_custkey % 7')} AS TYPO1",
        f"{case_of(PLOT_TYPES['TYPO2'], 'c_custkey % 11')} AS TYPO2",
        "c_acctbal AS area_value",
        f"{_shaped(PLOT_SHAPE, PLOT_SHAPES, x, y, PLOT_UNIT)} AS {GEOM}",
    )


def plots(
    spark: SparkSession, sf_dir: str, spread: Callable[..., DataFrame] | None = None
) -> DataFrame:
    """:func:`raw_plots` with box columns."""
    return raw_plots(spark, sf_dir, spread).withColumns(G.polygon_bbox(GEOM))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A location per supplier, among the plots and around them; every tenth has none."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS station_id",
        f"CASE WHEN s_suppkey % 10 <> 4 THEN named_struct('x', ((s_suppkey * 7919) % 10007) / 10007D * 1.4D - 0.2D, "
        f"'y', ((s_suppkey * 104729) % 10009) / 10009D * 0.3D - 0.1D) END AS {GEOM}",
    )


def _across(key: str, name: str, factor: int) -> list[str]:
    """Location within a degree of where the antimeridian meets 60 degrees north."""
    lon = f"(179D + (({key} * {factor}) % 10007) / 10007D * 2D)"
    return [
        f"{key} AS {name}",
        f"named_struct('x', IF({lon} > 180D, {lon} - 360D, {lon}), 'y', 59D + (({key} * 7907) % 10009) / 10009D * 2D) AS {GEOM}",
    ]


def ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A location per customer, on both sides of the antimeridian."""
    return table(spark, sf_dir, "customer").selectExpr(*_across("c_custkey", "ship_id", 7919))


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A location per supplier, on both sides of the antimeridian."""
    return table(spark, sf_dir, "supplier").selectExpr(*_across("s_suppkey", "port_id", 3571))


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline per customer in units of 1/1024, on the lattice of the plots: neighbours share borders in
    part, every fifth reaches into the next, and some have a hole. Four neighbours share a name."""
    x, y = f"((c_custkey % {PLOT_ROW}) * 8)", f"((c_custkey DIV {PLOT_ROW}) * 8)"
    u = f"{PLOT_UNIT!r}D"

    def ring(x0: str, y0: str, x1: str, y1: str) -> str:
        vs = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        return "array(" + ", ".join(f"named_struct('x', ({a}) * {u}, 'y', ({b}) * {u})" for a, b in vs) + ")"

    shell = ring(x, y, f"{x} + IF(c_custkey % 5 = 0, 11, 8)", f"{y} + IF(c_custkey % 7 = 3, 8, 5 + c_custkey % 3)")
    hole = ring(f"{x} + 2", f"{y} + 2", f"{x} + 5", f"{y} + 5")
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS lot_id", "CASE WHEN c_custkey % 50 <> 7 THEN concat('Green ', c_custkey DIV 4) END AS Nom",
        f"array(CASE WHEN c_custkey % 7 = 3 THEN array({shell}, {hole}) ELSE array({shell}) END) AS {GEOM}",
    ).withColumns(G.polygon_bbox(GEOM))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle per nation over the lots, in the same units; some overlap, some have a hole."""
    x, y = "((n_nationkey % 5) * 205 + 3)", "((n_nationkey DIV 5) * 19 + 2)"
    u = f"{PLOT_UNIT!r}D"

    def box(x0: str, y0: str, x1: str, y1: str) -> str:
        sides = [f"({v}) * {u}" for v in (x0, y0, x1, y1)]
        vs = [(0, 1), (2, 1), (2, 3), (0, 3), (0, 1)]
        return "array(" + ", ".join(f"named_struct('x', {sides[a]}, 'y', {sides[b]})" for a, b in vs) + ")"

    shell = box(x, y, f"{x} + 160 + (n_nationkey % 3) * 40", f"{y} + 12 + (n_nationkey % 4) * 5")
    hole = box(f"{x} + 20", f"{y} + 3", f"{x} + 100", f"{y} + 8")
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS zone_id", "n_name AS zone_name",
        f"array(CASE WHEN n_nationkey % 6 = 1 THEN array({shell}, {hole}) ELSE array({shell}) END) AS {GEOM}",
    ).withColumns(G.polygon_bbox(GEOM))


# Values the type filter looks for, by column, as terms of one disjunction.
PARK_TYPE_TERMS = [
    ("TYPO1", "Grand parc"),
    ("TYPO2", "Parc-nature"),
    ("TYPO2", "Îlot de verdure"),
    ("TYPO2", "Parc de quartier"),
    ("TYPO2", "Jardin Botanique"),
    ("TYPO2", "Bande riveraine"),
    ("Type", "Cimetière"),
    ("Nom", "Jarry"),
    ("Nom", "Lieu Historique National du Canada du-Canal-de-Lachine"),
]
PLOT_TYPES = {
    "Type": {0: "Cimetière", 1: "Parc", 2: "Parc", 3: "Place"},
    "TYPO1": {0: "Grand parc", 1: "Parc local", 2: "Parc local", 3: "Square"},
    "TYPO2": {0: "Parc-nature", 1: "Parc de quartier", 2: "Jardin Botanique", 3: "Halte",
              4: "Halte", 5: "Bande riveraine"},
}


def case_of(values: dict[int, str], on: str) -> str:
    """``CASE`` text that picks a value by number; other numbers give null."""
    return "CASE " + " ".join(f"WHEN {on} = {k} THEN '{v}'" for k, v in values.items()) + " END"


def occurrence_points(
    spark: SparkSession, sf_dir: str, spread: Callable[..., DataFrame] | None = None
) -> DataFrame:
    """The occurrence table: pruned columns, point and box."""
    return occurrence_table(raw_occurrences(spark, sf_dir, spread))
