"""Spatial joins as equi-joins on grid-of-plane cells.

The plane is cut into squares of side ``C`` and a layer is turned into *chips*, one row per
polygon and cell it reaches. A chip says how to judge a location in that cell:

* ``full``: the cell lies inside the polygon; nothing left to test,
* ``box``: the polygon is a rectangle; four comparisons,
* ``parts``: per polygon part, the few edges near the cell (``local``), the heights at which
  the inside/outside answer flips because of edges further right (``steps``), and the answer
  below all of them (``base``).

Cells the polygon's outline passes by and whose inside is empty give no chip. A location has
one cell key, so every (location, polygon) pair meets in exactly one cell: a left outer join
needs no dedupe.

A layer of very different sizes has no good ``C``: one city border would make cells that hold
thousands of parks. Its polygons are split into classes of like size, each with a cell side of its
own. A location looks up the few chips of its cell in each class and takes the hits of all.

Cell keys are ``floor(v / C)``, and rounding never reverses an order, so "edge key right of my
cell" proves "edge right of me". No tolerance is needed anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areametrics.functions import crs
from areametrics.functions import geometry as G
from areametrics.operators import joins
from areametrics.operators.projection import set_bbox
from areametrics.schemas import BBOX, GEOM
from areametrics.sources.shared import stored

#: The automatic cell side may make this many chips per polygon, one per this many vertices, or
#: ``MIN_CELLS`` in all, whichever is most: chips stay in proportion to the layer.
CELLS_PER_POLYGON = 4
VERTICES_PER_CELL = 2
MIN_CELLS = 4096
#: Chips built by one task.
CHIPS_PER_TASK = 4096

#: A layer of more polygons than this is split by size if its cells would be so many times as wide
#: as its median polygon. Sizes within a factor of 2 ** ``CLASS_OCTAVES`` are one class.
MIXED_FROM, MIXED_SIDE, CLASS_OCTAVES = 64, 8.0, 4
#: Chips of one size class that may be gathered into the row of their cell. Polygons stacked on one
#: place make more; locations there meet them one row each, with heavy cells split.
CROWDED = 256

_KEYS = ["_cell"]
#: A chip with at most this many nearby edges and flips holds them as plain columns.
_EDGES, _STEPS = 4, 2
_PARTS_TYPE = (
    "array<struct<local:array<struct<lx:double,ly:double,hx:double,hy:double>>,"
    "base:int,steps:array<double>>>"
)


@dataclass(frozen=True)
class CellPlan:
    """Cell side, number of cells the boxes of the layer cover, bytes its chips may take,
    whether every polygon is an axis-parallel rectangle, and whether sizes are so mixed that the
    side is far above the usual polygon's."""

    cell: float
    cells: int
    bytes: int
    only_boxes: bool = False
    mixed: bool = False


def _spans(side: str, reach: tuple[int, int] = (0, 0)) -> str:
    return (
        f"(floor(maxx / {side}) - floor(minx / {side}) + {1 + reach[0]}D) * "
        f"(floor(maxy / {side}) - floor(miny / {side}) + {1 + reach[1]}D)"
    )


def _extent_of() -> Column:
    return F.expr("greatest(maxx - minx, maxy - miny)")


def choose_cell(layer: DataFrame, at_least: float = 0.0) -> CellPlan:
    """The finest power-of-two cell side whose chip count fits the budget.

    One aggregate over the layer's boxes bounds the sides that come into question, a second counts
    their cells, and a third asks for the median extent where the least one does not settle what is
    mixed; each gives one row. The byte figure takes every edge to be near every cell of its
    polygon, so it can only be too high.
    """
    # Polygons without a box add nothing. Filtered out, they would be looked for before a layer is spread.
    held = F.col("minx").isNotNull()
    wide, high = "maxx - minx", "maxy - miny"
    facts = layer.select(
        *BBOX, F.when(held, F.expr(f"size(flatten(flatten({GEOM})))")).alias("v"),
        F.when(held, F.expr(G.is_box(GEOM))).alias("box"),
    ).agg(
        F.count("minx").alias("n"), F.sum("v").alias("v"), F.bool_and("box").alias("box"),
        F.min(_extent_of()).alias("least"), F.max(_extent_of()).alias("widest"),
        F.expr(f"sum({wide})").alias("wide"), F.expr(f"sum({high})").alias("high"),
        F.expr(f"sum(({wide}) * ({high}))").alias("area"),
    ).first()
    if not facts["n"]:
        return CellPlan(1.0, 0, 0)
    budget = max(MIN_CELLS, CELLS_PER_POLYGON * facts["n"], (facts["v"] or 0) // VERTICES_PER_CELL)
    sides = [2.0**k for k in range(-24, 25)]
    allowed = [c for c in sides if c >= at_least] or sides[-1:]

    def sure_to_exceed(side: float) -> bool:
        return max(facts["wide"] / side, facts["high"] / side, facts["area"] / side**2) > budget * (1 + 1e-6)

    likely = [c for c in allowed if not sure_to_exceed(c)] or allowed[-1:]
    # A box no wider than a cell reaches four at most, which fits; one side more for rounding.
    enough = next((i for i, c in enumerate(likely) if c >= facts["widest"]), len(likely) - 1) + 2
    likely = likely[:enough]
    spans = [_spans(f"{c!r}D") for c in likely]
    counts = layer.select(
        *BBOX, (joins.row_bytes(layer) + F.expr(f"256 + 72 * size(flatten(flatten({GEOM})))")).alias("w")
    ).agg(
        *[F.expr(f"sum({n})").alias(f"cells{i}") for i, n in enumerate(spans)],
        *[F.expr(f"sum({n} * w)").alias(f"bytes{i}") for i, n in enumerate(spans)],
    ).first()
    at = next((i for i in range(len(likely)) if counts[f"cells{i}"] <= budget), len(likely) - 1)
    side = likely[at]
    cells, size = (int(min(counts[f"{c}{at}"] or 0.0, 2.0**62)) for c in ("cells", "bytes"))
    mixed = facts["n"] > MIXED_FROM and side > MIXED_SIDE * facts["least"]
    if mixed:
        mixed = side > MIXED_SIDE * layer.agg(F.percentile_approx(_extent_of(), 0.5)).first()[0]
    return CellPlan(side, cells, size, facts["box"], mixed)


def plan_cells(
    layer: DataFrame,
    cell: float,
    window: tuple[int, int] = (0, 0),
    lead: bool = False,
    keep_geom: bool = True,
) -> CellPlan:
    """Upper bound for the bytes of the chips of a given cell side.

    The bound counts every cell a box covers, every cell an edge's box covers, and both ends of
    each edge in all columns of its strip. It is summed edge by edge, without making chips.
    """
    c = f"{float(cell)!r}D"
    rides = [n for n in layer.columns if keep_geom or n != GEOM]
    dx, dy = window
    near = (
        f"(floor(greatest(e.lx, e.hx) / {c}) - floor(least(e.lx, e.hx) / {c}) + {1 + dx}D) * "
        f"(floor(e.hy / {c}) - floor(e.ly / {c}) + {1 + dy}D)"
    )
    ends = f"{16 * (1 + dy)} * (floor(maxx / {c}) - floor(minx / {c}) + {1 + dx}D)"
    edges = (
        f"aggregate({GEOM}, 0D, (n, p) -> n + aggregate({G.edge_list('p')}, 0D, "
        f"(m, e) -> m + 40 * {near} + {ends}))"
    )
    spans = _spans(c, window if lead else (0, 0))
    total = layer.where(F.col("minx").isNotNull()).select(
        F.expr(spans).alias("cells"),
        ((joins.row_bytes(layer.select(*rides)) + 256) * F.expr(spans) + F.expr(edges)).alias("bytes"),
        F.expr(G.is_box(GEOM)).alias("box"),
    ).agg(F.sum("cells"), F.sum("bytes"), F.bool_and("box")).first()
    cells, size = (int(min(v or 0.0, 2.0**62)) for v in total[:2])
    return CellPlan(float(cell), cells, size, bool(total[2]))


def _point_plan(layer: DataFrame, cell: float | None, keep_geom: bool, limit: int) -> CellPlan:
    """Plan for point joins: the rough bound first, the closer one if that does not settle it."""
    if cell is None:
        rough = choose_cell(layer)
        if rough.bytes <= limit or rough.mixed:
            return rough
        cell = rough.cell
    return plan_cells(layer, cell, keep_geom=keep_geom)


def _near_points(layer: DataFrame, points: DataFrame) -> DataFrame:
    """Polygons whose box meets the box around all points; no other can hold one of them."""
    x, y = f"{GEOM}.x", f"{GEOM}.y"
    ends = points.where(f"NOT isnan({x}) AND NOT isnan({y})").agg(
        F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy")
    ).first()
    end = {n: F.lit(ends[n]).cast("double") for n in BBOX}
    return layer.where(
        (F.col("minx") <= end["maxx"]) & (F.col("maxx") >= end["minx"])
        & (F.col("miny") <= end["maxy"]) & (F.col("maxy") >= end["miny"])
    )


def _planned_layer(
    points: DataFrame, layer: DataFrame, cell: float | None, keep_geom: bool, limit: int,
    distinct: bool = False,
) -> tuple[DataFrame, CellPlan]:
    """Layer and plan for point joins. A layer too large to broadcast is cut down to the polygons near
    the points, without copies if only ``distinct`` ones matter, and stored: the jobs that plan it and
    make its chips would each build its outlines anew."""
    plan = _point_plan(layer, cell, keep_geom, limit)
    if plan.bytes <= limit:
        return layer, plan
    near = _near_points(layer, points)
    near = stored(near.distinct() if distinct else near, "near_polygons")
    return near, _point_plan(near, cell, keep_geom, limit)


def _spread(layer: DataFrame, plan: CellPlan) -> DataFrame:
    """Share chip making among tasks: layers often come from one file, read by one task."""
    tasks = plan.cells // CHIPS_PER_TASK
    return layer.repartition(tasks) if tasks > 1 else layer


def chips(
    layer: DataFrame,
    cell: float,
    window: tuple[int, int] = (0, 0),
    lead: bool = False,
    keep_geom: bool = True,
    flag_boxes: bool = True,
    flat: bool = False,
) -> DataFrame:
    """Layer -> chips keyed by ``_cx, _cy``; every other layer column rides along.

    ``window`` widens the area a chip describes by whole cells to the right and up, for left
    sides that have an extent. ``lead`` also makes chips left of and below the polygon, for
    predicates a left box may satisfy from outside the polygon's own cells. ``flag_boxes=False``
    gives rectangles edges like any other polygon. ``flat`` moves the edges of chips with few
    of them out of ``_parts`` into columns, where generated code tests them.
    """
    dx, dy = window
    lx, ly = window if lead else (0, 0)
    c = f"{float(cell)!r}D"
    attrs = [f"`{n}`" for n in layer.columns if n != GEOM or keep_geom]
    box = G.is_box(GEOM) if flag_boxes else "false"

    keyed_edge = (
        "named_struct('lx', e.lx, 'ly', e.ly, 'hx', e.hx, 'hy', e.hy, "
        f"'x0', floor(least(e.lx, e.hx) / {c}), 'x1', floor(greatest(e.lx, e.hx) / {c}), "
        f"'y0', floor(e.ly / {c}), 'y1', floor(e.hy / {c}))"
    )
    base = layer.where(F.col("minx").isNotNull()).selectExpr(
        *attrs,
        f"{box} AS _box",
        f"CASE WHEN {box} THEN array() ELSE "
        f"transform({GEOM}, part -> transform({G.edge_list('part')}, e -> {keyed_edge})) "
        "END AS _parts",
        f"floor(minx / {c}) AS _x0",
        f"floor(maxx / {c}) AS _x1",
        f"explode(sequence(floor(miny / {c}) - {ly}, floor(maxy / {c}))) AS _cy",
    )

    # One row per horizontal strip: the edges that cross it, part by part.
    strips = base.selectExpr(
        *attrs, "_box", "_x0", "_x1", "_cy",
        "transform(filter(transform(_parts, "
        f"p -> filter(p, e -> e.y0 <= _cy + {dy} AND e.y1 >= _cy)), p -> size(p) > 0), "
        "p -> named_struct('edges', p, "
        f"'x0', array_min(transform(p, e -> e.x0)) - {lx}, "
        "'x1', array_max(transform(p, e -> e.x1)))) AS _strips",
    )
    # Per cell of the strip: nearby edges, and both ends of every edge wholly to the right.
    near = strips.selectExpr(
        *attrs, "_box", "_cy",
        f"transform(CASE WHEN _box THEN sequence(_x0 - {lx}, _x1) ELSE array_distinct(flatten("
        "transform(_strips, s -> sequence(s.x0, s.x1)))) END, c -> named_struct('x', c, 'near', "
        "transform(filter(_strips, s -> s.x0 <= c AND c <= s.x1), s -> named_struct("
        f"'local', transform(filter(s.edges, e -> e.x0 <= c + {dx} AND e.x1 >= c), "
        "e -> named_struct('lx', e.lx, 'ly', e.ly, 'hx', e.hx, 'hy', e.hy)), "
        f"'ends', flatten(transform(filter(s.edges, e -> e.x0 > c + {dx}), "
        "e -> array(named_struct('y', e.ly, 'k', e.y0), named_struct('y', e.hy, 'k', e.y1)))))"
        "))) AS _cells",
    )
    counted = near.selectExpr(
        *attrs, "_box", "_cy",
        "transform(_cells, c -> named_struct('x', c.x, 'near', transform(c.near, "
        "p -> named_struct('local', p.local, "
        "'base', size(filter(p.ends, t -> t.k < _cy)) % 2, "
        f"'ys', transform(filter(p.ends, t -> t.k >= _cy AND t.k <= _cy + {dy}), t -> t.y)))"
        ")) AS _cells",
    )
    # A height met twice flips the answer and flips it back: drop both.
    judged = counted.selectExpr(
        *attrs, "_box", "_cy",
        "filter(transform(_cells, c -> named_struct('x', c.x, 'near', filter(transform(c.near, "
        "p -> named_struct('local', p.local, 'base', p.base, 'steps', filter(p.ys, "
        "(t, i) -> array_position(p.ys, t) = i + 1 "
        "AND size(filter(p.ys, u -> u = t)) % 2 = 1))), "
        "p -> size(p.local) > 0 OR p.base = 1))), "
        "c -> _box OR size(c.near) > 0) AS _cells",
    )
    made = judged.selectExpr(
        *attrs, "_box", "_cy",
        "inline(transform(_cells, c -> named_struct('_cx', c.x, "
        "'_full', exists(c.near, p -> size(p.local) = 0), "
        f"'_parts', CAST(CASE WHEN exists(c.near, p -> size(p.local) = 0) THEN array() "
        f"ELSE c.near END AS {_PARTS_TYPE}))))",
    ).withColumn("_cell", _cell_id("_cx", "_cy"))
    if not flat:
        return made
    one = "get(_parts, 0)"
    few = (
        f"(size(_parts) = 1 AND size({one}.local) <= {_EDGES} AND size({one}.steps) <= {_STEPS})"
    )

    def held(value: str, absent: str) -> str:
        return f"coalesce(CASE WHEN {few} THEN {value} END, {absent})"

    # Absent edges and flips are NaN, which sorts above every number and so never counts.
    nan = "double('NaN')"
    return made.selectExpr(
        *attrs, "_box", "_full", "_cx", "_cy", "_cell",
        f"{held(f'{one}.base', '-1')} AS _base",
        *[
            f"{held(f'get({one}.local, {i}).{end}', nan)} AS _{end}{i}"
            for i in range(_EDGES) for end in ("lx", "ly", "hx", "hy")
        ],
        *[f"{held(f'get({one}.steps, {i})', nan)} AS _s{i}" for i in range(_STEPS)],
        f"CASE WHEN {few} THEN CAST(array() AS {_PARTS_TYPE}) ELSE _parts END AS _parts",
    )


# --- predicates against a chip, left columns under l, chip columns under r ---------------

_SAME_CELL = "((l._cx ^ r._cx) = 0 AND (l._cy ^ r._cy) = 0)"


def _flat_crossings(x: str, y: str) -> str:
    """Crossings as :func:`geometry.parity` counts them, from edge columns; 10 more per edge the
    point lies on. Without such edges the sum stays below 10."""
    terms = ["r._base"] + [f"IF(r._s{i} <= {y}, 1, 0)" for i in range(_STEPS)]
    for i in range(_EDGES):
        lx, ly, hx, hy = (f"r._{end}{i}" for end in ("lx", "ly", "hx", "hy"))
        side = f"(({x} - {lx}) * ({hy} - {ly}) - ({hx} - {lx}) * ({y} - {ly}))"
        terms.append(
            f"IF({y} < {ly} OR {y} > {hy}, 0, CASE WHEN {side} < 0 THEN IF({y} < {hy}, 1, 0) "
            f"WHEN {side} = 0 AND {x} >= least({lx}, {hx}) AND {x} <= greatest({lx}, {hx}) THEN 10 "
            "ELSE 0 END)"
        )
    return " + ".join(terms)


def _all_flat(flat_chips: DataFrame) -> bool:
    """No chip keeps edges in arrays. Stops at the first that does.

    Only asked where the session makes Spark give up on generated methods the JVM would not
    compile; without that limit, keeping the join out of a large fused stage is the safer way.
    """
    limit = flat_chips.sparkSession.conf.get("spark.sql.codegen.hugeMethodLimit", "65535")
    return int(limit) <= 8000 and flat_chips.where("size(_parts) > 0").isEmpty()


def _point_in_chip(closed: bool, only_boxes: bool, all_flat: bool) -> Column:
    """Test of a point against a flat chip of its own cell.

    The array test is left out where no chip needs it: with it, Spark runs the join operator
    without generated code, at several times the cost per point.
    """
    x, y = "l._px", "l._py"
    lo, hi = ("<=", ">=") if closed else ("<", ">")
    in_box = f"{x} {hi} r.minx AND {x} {lo} r.maxx AND {y} {hi} r.miny AND {y} {lo} r.maxy"
    if only_boxes:
        return F.expr(f"{_SAME_CELL} AND {in_box}")
    rest = "false"
    if not all_flat:
        fold = G.parity("p.local", x, y, f"p.base + size(filter(p.steps, t -> t <= {y}))")
        rest = f"exists(r._parts, p -> ({fold}) % 2 {'<> 0' if closed else '= 1'})"
    flat_hit = "NOT IN (0, 2, 4, 6, 8)" if closed else "IN (1, 3, 5, 7, 9)"
    return F.expr(
        f"{_SAME_CELL} AND CASE WHEN r._full THEN true WHEN r._box THEN {in_box} "
        f"WHEN r._base >= 0 THEN ({_flat_crossings(x, y)}) {flat_hit} "
        f"ELSE {rest} END"
    )


def _join_points(
    points: DataFrame, layer: DataFrame, plan: CellPlan, closed: bool, keep_geom: bool, how: str,
    limit: int, heavy_rows: int,
) -> DataFrame:
    right = chips(_spread(layer, plan), plan.cell, keep_geom=keep_geom, flat=True)
    flat = plan.only_boxes or _all_flat(right)
    return joins.sized_join(
        _point_keys(points, plan.cell), right, _KEYS,
        _point_in_chip(closed, plan.only_boxes, flat), how,
        right_bytes=plan.bytes, limit=limit, heavy_rows=heavy_rows,
    )


def size_classes(layer: DataFrame) -> list[DataFrame]:
    """The layer's polygons by size, smallest first; each class spans a factor of
    2 ** ``CLASS_OCTAVES``, so there are a dozen at most over all sizes that cells can have."""
    octave = F.floor(F.log2(F.greatest(_extent_of(), F.lit(2.0**-24))) / CLASS_OCTAVES)
    named = layer.where(F.col("minx").isNotNull()).withColumn(
        "_class", F.least(octave, F.lit(24 // CLASS_OCTAVES)).cast("int")
    )
    found = sorted(r["_class"] for r in named.select("_class").distinct().collect())
    return [named.where(F.col("_class") == c).drop("_class") for c in found]


def _widest(df: DataFrame) -> tuple[float, bool]:
    """The longest side of all boxes, and whether it is far above the usual box's."""
    extent = _extent_of()
    row = df.agg(
        F.max(extent).alias("widest"), F.percentile_approx(extent, 0.5).alias("usual"),
        F.count("minx").alias("n"),
    ).first()
    widest = row["widest"] or 0.0
    return widest, row["n"] > MIXED_FROM and widest > MIXED_SIDE * row["usual"]


def _crowded_cells(layer: DataFrame, cell: float) -> DataFrame:
    """Cells (``_cell``) that the boxes of more than ``CROWDED`` polygons reach."""
    c = f"{float(cell)!r}D"
    reached = layer.where(F.col("minx").isNotNull()).selectExpr(
        f"floor(minx / {c}) AS _x0", f"floor(maxx / {c}) AS _x1",
        f"explode(sequence(floor(miny / {c}), floor(maxy / {c}))) AS _cy",
    ).selectExpr("explode(sequence(_x0, _x1)) AS _cx", "_cy")
    counts = reached.groupBy(_cell_id("_cx", "_cy").alias("_cell")).count()
    return counts.where(F.col("count") > CROWDED).select("_cell")


def _join_mixed(
    points: DataFrame, layer: DataFrame, closed: bool, keep_geom: bool, how: str, limit: int,
    heavy_rows: int,
) -> DataFrame:
    """Points to polygons of mixed sizes, class by class. Points in a cell that is crowded in some
    class are told apart first; their polygons stay a row each."""
    classes = []
    for part in size_classes(layer):
        plan = choose_cell(part)
        if plan.bytes > limit:
            plan = plan_cells(part, plan.cell, keep_geom=keep_geom)
        classes.append((part, plan))
    options = (closed, keep_geom, how, limit, heavy_rows)
    flagged, any_crowded = points.withColumn("_busy", F.lit(False)), False
    for part, plan in classes:
        cells = _crowded_cells(part, plan.cell)
        if cells.isEmpty():
            continue
        any_crowded = True
        joined = joins.sized_join(
            _point_keys(flagged, plan.cell), cells.withColumn("_here", F.lit(True)), _KEYS, None, "left",
            limit=limit, heavy_rows=heavy_rows,
        )
        flagged = joined.select(
            *[f"l.`{c}`" for c in points.columns], F.expr("l._busy OR r._here IS NOT NULL").alias("_busy")
        )
    if not any_crowded:
        return _join_gathered(points, layer, classes, *options)
    flagged = stored(flagged, "told_points")
    light = _join_gathered(flagged.where("NOT _busy").drop("_busy"), layer, classes, *options)
    return light.union(_join_stacked(flagged.where("_busy").drop("_busy"), layer, classes, *options))


def _join_stacked(
    points: DataFrame, layer: DataFrame, classes: list[tuple[DataFrame, CellPlan]], closed: bool,
    keep_geom: bool, how: str, limit: int, heavy_rows: int,
) -> DataFrame:
    """A join of its own for each class; points without a hit in any are found by anti joins."""
    names = [c for c in layer.columns if keep_geom or c != GEOM]
    own = [f"`{c}`" for c in points.columns]
    found, rest = [], points
    for part, plan in classes:
        def joined(left, way, part=part, plan=plan):
            return _join_points(left, part, plan, closed, keep_geom, way, limit, heavy_rows)

        if how == "left_semi":
            found.append(joined(rest, "left_semi").select(*own))
        else:
            found.append(joined(points, "inner").select(*_joined_columns(points.columns, names)))
        if how != "inner":
            rest = joined(rest, "left_anti").select(*own)
    if how == "left":
        nothing = F.lit(None).cast(layer.select(*[f"`{c}`" for c in names]).schema)
        found.append(
            rest.select(F.struct(*own).alias("l"), nothing.alias("r"))
            .select(*_joined_columns(points.columns, names))
        )
    return reduce(DataFrame.union, found)


def _join_gathered(
    points: DataFrame, layer: DataFrame, classes: list[tuple[DataFrame, CellPlan]], closed: bool,
    keep_geom: bool, how: str, limit: int, heavy_rows: int,
) -> DataFrame:
    """Points to polygons of mixed sizes. Each class's chips are gathered by cell (few, since its
    cells are about as wide as its polygons), so every join is to one row at most and the points
    never multiply; the hits of all classes are then unfolded once."""
    lo, hi = ("<=", ">=") if closed else ("<", ">")
    in_box = f"_px {hi} r.minx AND _px {lo} r.maxx AND _py {hi} r.miny AND _py {lo} r.maxy"
    fold = G.parity("p.local", "_px", "_py", "p.base + size(filter(p.steps, t -> t <= _py))")
    test = (
        f"r._cx = _cx AND r._cy = _cy AND CASE WHEN r._full THEN true WHEN r._box THEN {in_box} "
        f"ELSE exists(r._parts, p -> ({fold}) % 2 {'<> 0' if closed else '= 1'}) END"
    )
    names = [c for c in layer.columns if keep_geom or c != GEOM]
    hit = "named_struct(" + ", ".join(f"'{c}', r.`{c}`" for c in names) + ")"
    out, hits = points, []
    for i, (part, plan) in enumerate(classes):
        made = chips(_spread(part, plan), plan.cell, keep_geom=keep_geom)
        held = made.groupBy("_cell").agg(F.collect_list(F.struct("*")).alias("_chips"))
        keyed = _point_keys(out, plan.cell)
        joined = joins.sized_join(
            keyed, held, _KEYS, None, "left", right_bytes=plan.bytes, limit=limit, heavy_rows=heavy_rows
        ).select("l.*", "_chips")
        found = F.expr(f"transform(filter(coalesce(_chips, array()), r -> {test}), r -> {hit})")
        out = joined.withColumn(f"_hits{i}", found).select(*[f"`{c}`" for c in out.columns], f"_hits{i}")
        hits.append(f"_hits{i}")
    every = F.concat(*hits)
    if how == "left_semi":
        return out.where(F.size(every) > 0).select(*[f"`{c}`" for c in points.columns])
    unfold = F.explode_outer if how == "left" else F.explode
    flat = out.select(F.struct(*[f"`{c}`" for c in points.columns]).alias("l"), unfold(every).alias("r"))
    return flat.select(*_joined_columns(points.columns, names))


def _box_in_chip() -> Column:
    b = [f"l.{c}" for c in BBOX]
    x, y = f"(({b[0]} + {b[2]}) / 2)", f"(({b[1]} + {b[3]}) / 2)"
    start = f"p.base + size(filter(p.steps, t -> t <= {y}))"
    inside = (
        f"NOT exists(p.local, e -> {G.crosses_open_box('e', *b)}) "
        f"AND ({G.parity('p.local', x, y, start)}) % 2 = 1"
    )
    return F.expr(
        f"{_SAME_CELL} "
        "AND l.minx >= r.minx AND l.maxx <= r.maxx AND l.miny >= r.miny AND l.maxy <= r.maxy "
        f"AND (r._full OR r._box OR exists(r._parts, p -> {inside}))"
    )


def _polygon_meets_chip() -> Column:
    """Left polygon (edges per part in ``l._edges``) shares a point with the chip's polygon."""
    first = ("get(a, 0).lx", "get(a, 0).ly")
    start = f"p.base + size(filter(p.steps, t -> t <= {first[1]}))"
    return F.expr(
        f"{_SAME_CELL} "
        "AND l.maxx >= r.minx AND l.minx <= r.maxx AND l.maxy >= r.miny AND l.miny <= r.maxy "
        "AND (r._full OR exists(r._parts, p -> exists(l._edges, a -> size(a) > 0 AND ("
        f"exists(a, f -> exists(p.local, e -> {G.edges_touch('f', 'e')})) "
        f"OR ({G.parity('p.local', *first, start)}) % 2 <> 0 "
        f"OR ({G.parity('a', 'get(p.local, 0).lx', 'get(p.local, 0).ly')}) % 2 = 1))))"
    )


# --- keys ---------------------------------------------------------------------------------

#: Cell number of rows without a place. No double is that near the greatest long, so no place has it.
_NO_CELL = (1 << 63) - 8


def _cell_key(v: str, cell: float) -> Column:
    """Never null: else a join would ask rows for keys that are not null, and Spark would write out
    that test, with all that ``v`` is made of, below the joins that the rows come from."""
    return F.expr(f"coalesce(CASE WHEN NOT isnan({v}) THEN floor({v} / {float(cell)!r}D) END, {_NO_CELL}L)")


def _cell_id(cx: str, cy: str) -> Column:
    """Both cell numbers in one long, which hash joins look up fastest. Cells more than 2^31
    sides from the origin may share an id, so join conditions also compare the numbers."""
    return F.expr(f"shiftleft({cx}, 32) ^ ({cy} & 4294967295L)")


def _with_keys(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    numbered = df.withColumns({"_cx": _cell_key(x, cell), "_cy": _cell_key(y, cell)})
    return numbered.withColumn("_cell", _cell_id("_cx", "_cy"))


def _point_keys(points: DataFrame, cell: float) -> DataFrame:
    """Cell numbers and plain coordinates, none of them null (NaN points have the cell of no place)."""
    flat = points.withColumns({
        "_px": F.expr(f"coalesce({GEOM}.x, double('NaN'))"),
        "_py": F.expr(f"coalesce({GEOM}.y, double('NaN'))"),
    })
    return _with_keys(flat, "_px", "_py", cell)


def _extent(df: DataFrame, cell: float) -> tuple[int, int]:
    """Largest number of cell borders a box of ``df`` crosses, per axis."""
    c = f"{float(cell)!r}D"
    row = df.agg(
        F.expr(f"max(floor(maxx / {c}) - floor(minx / {c}))").alias("dx"),
        F.expr(f"max(floor(maxy / {c}) - floor(miny / {c}))").alias("dy"),
    ).first()
    return int(row["dx"] or 0), int(row["dy"] or 0)


def suffixed(names: list[str], taken: list[str]) -> dict[str, str]:
    """New names for right columns that collide with left ones: ``c_1``, ``c_2`` and so on."""
    used, out = set(taken), {}
    for n in names:
        new, i = n, 0
        while new in used:
            i += 1
            new = f"{n}_{i}"
        used.add(new)
        out[n] = new
    return out


def _joined_columns(left: list[str], right: list[str]) -> list[Column]:
    """Left columns without geometry and box, then right ones; the right box becomes the box."""
    shape = [GEOM, *BBOX]
    keep = [c for c in left if c not in shape]
    attrs = [c for c in right if c not in shape]
    renamed = suffixed(attrs, keep + shape)
    out = [F.col(f"l.`{c}`") for c in keep]
    out += [F.col(f"r.`{c}`").alias(renamed[c]) for c in attrs]
    return out + [F.col(f"r.{c}") for c in shape if c in right]


# --- joins --------------------------------------------------------------------------------

def points_in_polygons(
    points: DataFrame,
    layer: DataFrame,
    cell: float | None = None,
    keep_geom: bool = True,
    limit: int | None = None,
    heavy_rows: int = joins.HEAVY_ROWS,
    how: str = "left",
) -> DataFrame:
    """Left join of points (``geom`` a point) to the polygons they lie strictly inside.

    Points with no polygon, on a border or without geometry stay with nulls; a point in two
    polygons gives two rows. The result carries the polygon's ``geom`` and box, not the
    point's. ``keep_geom=False`` leaves the polygon outlines out of the join: cheaper when
    they are large and the key is enough.
    """
    limit = joins.BROADCAST_BYTES if limit is None else limit
    layer, plan = _planned_layer(points, layer, cell, keep_geom, limit)
    names = [c for c in layer.columns if keep_geom or c != GEOM]
    if plan.mixed:
        return _join_mixed(points, layer, False, keep_geom, how, limit, heavy_rows)
    joined = _join_points(points, layer, plan, False, keep_geom, how, limit, heavy_rows)
    return joined.select(*_joined_columns(points.columns, names))


def boxes_in_polygons(
    boxes: DataFrame,
    layer: DataFrame,
    cell: float | None = None,
    keep_geom: bool = True,
    limit: int | None = None,
    heavy_rows: int = joins.HEAVY_ROWS,
    how: str = "left",
) -> DataFrame:
    """Left join of axis-parallel boxes (grid cells, by their box columns) to the polygons that
    wholly contain them; touching the border from inside counts. Rows without a box stay.

    Chips are widened by as many cells as the widest box goes over, so boxes of very different
    sizes are joined by size class, each with cells in proportion.
    """
    limit = joins.BROADCAST_BYTES if limit is None else limit
    if cell is None and _widest(boxes)[1]:
        parts = size_classes(boxes)
        if how == "left":
            parts[0] = parts[0].unionByName(boxes.where("minx IS NULL"))
        return reduce(DataFrame.union, [
            _boxes_in_polygons(
                part, layer, choose_cell(layer, at_least=_widest(part)[0] / 4).cell, keep_geom, limit,
                heavy_rows, how,
            )
            for part in parts
        ])
    return _boxes_in_polygons(
        boxes, layer, cell or choose_cell(layer).cell, keep_geom, limit, heavy_rows, how
    )


def _boxes_in_polygons(
    boxes: DataFrame, layer: DataFrame, cell: float, keep_geom: bool, limit: int, heavy_rows: int,
    how: str,
) -> DataFrame:
    window = _extent(boxes, cell)
    plan = plan_cells(layer, cell, window, keep_geom=keep_geom)
    right = chips(_spread(layer, plan), cell, window, keep_geom=keep_geom)
    left = _with_keys(boxes, "minx", "miny", plan.cell)
    joined = joins.sized_join(
        left, right, _KEYS, _box_in_chip(), how,
        right_bytes=plan.bytes, limit=limit, heavy_rows=heavy_rows,
    )
    names = [c for c in layer.columns if keep_geom or c != GEOM]
    return joined.select(*_joined_columns(boxes.columns, names))


def cells_in_polygons(
    rows: DataFrame,
    layer: DataFrame,
    cells: DataFrame,
    cell_key: str,
    cell: float | None = None,
    keep_geom: bool = True,
    limit: int | None = None,
    heavy_rows: int = joins.HEAVY_ROWS,
) -> DataFrame:
    """Same answer as :func:`boxes_in_polygons` for rows that carry a grid cell.

    Containment depends on the cell alone, so it is decided once per cell of ``cells`` and the
    rows then join by ``cell_key``: geometry work grows with the grid, not with the rows. The
    pairs of cell and polygon are written to the shared folder, so that measuring and joining them
    does not find them twice.
    """
    pairs = stored(boxes_in_polygons(
        cells.select(F.col(cell_key).alias("_row"), *BBOX), layer, cell, keep_geom,
        limit, heavy_rows, how="inner",
    ), "cell_pairs")
    names = [c for c in layer.columns if keep_geom or c != GEOM]
    joined = joins.sized_join(
        rows.withColumn("_row", F.col(cell_key)), pairs, ["_row"], None, "left",
        limit=limit, heavy_rows=heavy_rows,
    )
    return joined.select(*_joined_columns(rows.columns, names))


def clip_points(
    points: DataFrame,
    region: DataFrame,
    cell: float | None = None,
    limit: int | None = None,
    heavy_rows: int = joins.HEAVY_ROWS,
) -> DataFrame:
    """Points inside or on the border of at least one region polygon; each kept once.

    Copies of a polygon say no more than one of them, so a large region is used without: points beside
    a heap of copies would be tested against them all.
    """
    limit = joins.BROADCAST_BYTES if limit is None else limit
    region, plan = _planned_layer(points, region.select(GEOM, *BBOX), cell, False, limit, distinct=True)
    if plan.mixed:
        return _join_mixed(points, region, True, False, "left_semi", limit, heavy_rows)
    kept = _join_points(points, region, plan, True, False, "left_semi", limit, heavy_rows)
    return kept.select(*[f"`{c}`" for c in points.columns])


def clip_polygons(
    layer: DataFrame,
    region: DataFrame,
    cell: float | None = None,
    limit: int | None = None,
    heavy_rows: int = joins.HEAVY_ROWS,
) -> DataFrame:
    """Polygons that share at least a point with the region, whole (they are not cut).

    Cells are no smaller than the widest polygon, whose box then crosses one border at most;
    polygons of very different sizes are clipped by size class, so one wide polygon does not bring
    all others into a few cells.
    """
    limit = joins.BROADCAST_BYTES if limit is None else limit
    region = region.select(GEOM, *BBOX)
    if cell is None:
        widest, mixed = _widest(layer)
        if mixed:
            return reduce(DataFrame.union, [
                _clip_polygons(
                    part, region, choose_cell(region, at_least=_widest(part)[0]).cell, limit, heavy_rows
                )
                for part in size_classes(layer)
            ])
        cell = choose_cell(region, at_least=widest).cell
    return _clip_polygons(layer, region, cell, limit, heavy_rows)


def _clip_polygons(
    layer: DataFrame, region: DataFrame, cell: float, limit: int, heavy_rows: int
) -> DataFrame:
    window = _extent(layer, cell)
    tasks = layer.count() // CHIPS_PER_TASK
    layer = layer.repartition(tasks) if tasks > 1 else layer
    plan = plan_cells(region, cell, window, lead=True, keep_geom=False)
    right = chips(
        _spread(region, plan), cell, window, lead=True, keep_geom=False, flag_boxes=False
    )
    left = _with_keys(layer, "minx", "miny", cell).withColumn(
        "_edges", F.expr(f"transform({GEOM}, part -> {G.edge_list('part')})")
    )
    return joins.sized_join(
        left, right, _KEYS, _polygon_meets_chip(), "left_semi",
        right_bytes=plan.bytes, limit=limit, heavy_rows=heavy_rows,
    ).select(*[f"`{c}`" for c in layer.columns])


def clip_to_region(
    df: DataFrame, region: DataFrame, srid: int, region_srid: int, **options: object
) -> DataFrame:
    """Clip points or polygons; a region in another coordinate system is moved first."""
    if not crs.same_crs(srid, region_srid):
        region = set_bbox(crs.reproject(region.select(GEOM), region_srid, srid))
    is_point = isinstance(df.schema[GEOM].dataType, T.StructType)
    return (clip_points if is_point else clip_polygons)(df, region, **options)
