"""Overlay of polygon layers by their edges: outlines of unions, and cutting to a region.

Every edge runs with the inside on its left. Edges of a group (the polygons to be merged) are split
where they cross, touch or overlap, found by an equi-join on the plane cells they pass. Pieces with
the same ends then fall together: with the inside on both sides they are an inner border and cancel;
the others are outline unless some other part of the group covers their midpoint, a point-in-polygon
join. Outline edges are linked at their ends into rings by pointer doubling: each round joins every
edge with the one its pointer has reached and doubles the reach, so a ring of a million edges takes
twenty rounds and no task holds a ring, a cell or a group before the row of a finished ring is made.

Cutting does the same for two layers: pieces of a polygon's edges inside the region, and pieces of
the region's outline inside the polygon, are linked by polygon.

Coordinates of a crossing that neither edge fixes (as axis-parallel edges do) are rounded to a grid
of 2 ** -44 of the largest coordinate; an end nearer than that to another edge lies on it. Vertices
inside a straight line are left out of the result. Where the inside meets itself in a point, rings
part there. Parts of no area vanish; an outline that does not close raises.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areametrics.operators import joins
from areametrics.operators import spatial as S
from areametrics.operators.projection import set_bbox
from areametrics.schemas import BBOX, GEOM
from areametrics.sources.shared import stored

#: Bits of the largest coordinate that crossings keep.
BITS = 44
#: Shells of more vertices than this are met edge by edge, so many edges in a strip of the plane.
RING_EDGES, STRIP_EDGES = 4096, 64
#: What is told of a part of a union beside its outline.
FACTS = ["area", "vertices", "rings"]
_G, _PART, _POS = "_g", "_part", "_pos"
_ENDS = ["ax", "ay", "bx", "by"]


def _area2(ring: str) -> str:
    """Twice the signed area of a closed ring, positive if counter-clockwise."""
    o = f"get({ring}, 0)"
    return (
        f"aggregate(zip_with(slice({ring}, 1, size({ring}) - 1), slice({ring}, 2, size({ring}) - 1), (a, b) -> "
        f"(a.x - {o}.x) * (b.y - {o}.y) - (b.x - {o}.x) * (a.y - {o}.y)), 0D, (s, v) -> s + v)"
    )


def area(geom: str = GEOM) -> str:
    """Area of a polygon: shells less holes."""
    return (
        f"aggregate({geom}, 0D, (n, p) -> n + aggregate(transform(p, (r, i) -> "
        f"abs({_area2('r')}) * IF(i = 0, 0.5D, -0.5D)), 0D, (m, v) -> m + v))"
    )


def _tolerance(*layers: DataFrame) -> float:
    most = 0.0
    for layer in layers:
        row = layer.agg(F.max(F.greatest(*[F.abs(c) for c in BBOX]))).first()
        most = max(most, row[0] or 0.0)
    return 2.0 ** (ceil(log2(most or 1.0)) - BITS)


def parts(layer: DataFrame, by: str) -> DataFrame:
    """Distinct parts of the layer: ``_g`` (the value of ``by``), ``_part``, ``geom`` and box. Copies
    of a part in its group are one."""
    rows = layer.where(F.col(GEOM).isNotNull()).select(F.col(by).alias(_G), F.explode(GEOM).alias("p"))
    rows = rows.where(F.col(_G).isNotNull() & (F.size("p") > 0)).distinct()
    rows = rows.select(_G, F.monotonically_increasing_id().alias(_PART), F.array("p").alias(GEOM))
    return stored(set_bbox(rows), "parts")


def directed(rows: DataFrame) -> DataFrame:
    """Edges of parts with the inside on the left: ``_g``, ``_part``, ``_pos``, ends ``a`` and ``b``."""
    ring = (
        f"transform(get({GEOM}, 0), (r, i) -> CASE WHEN size(r) < 4 THEN slice(r, 1, 0) "
        f"WHEN ({_area2('r')} > 0) = (i = 0) THEN r ELSE reverse(r) END)"
    )
    edges = (
        f"flatten(transform(filter({ring}, r -> size(r) > 3), r -> zip_with(slice(r, 1, size(r) - 1), "
        "slice(r, 2, size(r) - 1), (a, b) -> named_struct('ax', a.x, 'ay', a.y, 'bx', b.x, 'by', b.y))))"
    )
    return rows.selectExpr(_G, _PART, f"posexplode({edges}) AS ({_POS}, e)").selectExpr(
        _G, _PART, f"bigint({_POS}) AS {_POS}", *[f"e.{c}" for c in _ENDS]
    ).where("ax <> bx OR ay <> by")


def _by_cell(edges: DataFrame, cell: float, tol: float) -> DataFrame:
    """A row per edge and plane cell it passes, strip by strip."""
    c, t = f"{cell!r}D", f"{tol!r}D"
    strips = edges.withColumn("_cy", F.expr(
        f"explode(sequence(bigint(floor((least(ay, by) - {t}) / {c})), bigint(floor((greatest(ay, by) + {t}) / {c}))))"
    ))

    def at(y: str) -> str:
        return f"ax + (bx - ax) * greatest(0D, least(1D, (({y}) - ay) / (by - ay)))"

    flat = f"abs(by - ay) <= {t}"
    ends = [f"CASE WHEN {flat} THEN {v} ELSE {at(y)} END" for v, y in (("ax", f"_cy * {c}"), ("bx", f"(_cy + 1) * {c}"))]
    # Interpolation is off by less than this; a cell too many does no harm.
    slack = f"({t} + 1e-9D * {c})"
    return strips.withColumn("_cx", F.expr(
        f"explode(sequence(bigint(floor((least({', '.join(ends)}) - {slack}) / {c})), "
        f"bigint(floor((greatest({', '.join(ends)}) + {slack}) / {c}))))"
    ))


def _near(tol: float) -> str:
    """Boxes of edges ``l`` and ``r`` meet."""
    return " AND ".join(
        f"greatest(l.a{v}, l.b{v}) + {tol!r}D >= least(r.a{v}, r.b{v}) "
        f"AND greatest(r.a{v}, r.b{v}) + {tol!r}D >= least(l.a{v}, l.b{v})" for v in "xy"
    )


def _judged(met: DataFrame) -> DataFrame:
    """Joined edges with what :func:`_meetings` asks of them, each worked out once: the side of edge ``e``
    that end ``p`` of the other lies on (``_e_p``), and lengths. In one expression they would make a
    method too large for the JVM to compile."""
    sides = {
        f"_{e}_{p}": f"({e}.bx - {e}.ax) * ({f}.{p}y - {e}.ay) - ({e}.by - {e}.ay) * ({f}.{p}x - {e}.ax)"
        for e, f in (("l", "r"), ("r", "l")) for p in "ab"
    }
    lengths = {f"_{e}": f"sqrt(pow({e}.bx - {e}.ax, 2) + pow({e}.by - {e}.ay, 2))" for e in "lr"}
    return met.withColumns({c: F.expr(v) for c, v in {**sides, **lengths}.items()})


def _meetings(tol: float) -> str:
    """Where edges ``l`` and ``r`` of :func:`_judged` must be split: array of ``side`` (0 for ``l``), ``x``, ``y``."""
    t = f"{tol!r}D"

    def on(e: str, f: str, p: str, side: int) -> str:
        x, y = f"{f}.{p}x", f"{f}.{p}y"
        along = f"(({x} - {e}.ax) * ({e}.bx - {e}.ax) + ({y} - {e}.ay) * ({e}.by - {e}.ay))"
        return (
            f"CASE WHEN abs(_{e}_{p}) <= {t} * _{e} AND {along} > {t} * _{e} "
            f"AND {along} < (_{e} - {t}) * _{e} THEN named_struct('side', {side}, 'x', {x}, 'y', {y}) END"
        )

    apart = " AND ".join(f"abs(_{e}_{p}) > {t} * _{e}" for e in "lr" for p in "ab")
    crossing = f"{apart} AND signum(_l_a) <> signum(_l_b) AND signum(_r_a) <> signum(_r_b)"

    def coordinate(v: str) -> str:
        exact = f"l.a{v} + (l.b{v} - l.a{v}) * _r_a / nullif(_r_a - _r_b, 0D)"
        return f"CASE WHEN l.a{v} = l.b{v} THEN l.a{v} WHEN r.a{v} = r.b{v} THEN r.a{v} ELSE rint(({exact}) / {t}) * {t} END"

    both = [
        f"CASE WHEN {crossing} THEN named_struct('side', {side}, 'x', {coordinate('x')}, 'y', {coordinate('y')}) END"
        for side in (0, 1)
    ]
    ends = [on(e, f, p, s) for s, e, f in ((0, "l", "r"), (1, "r", "l")) for p in "ab"]
    return f"filter(array({', '.join(ends + both)}), m -> m IS NOT NULL)"


_ID = [_G, _PART, _POS]


def _pieces(edges: DataFrame, splits: DataFrame, ident: list[str] | None = None) -> DataFrame:
    """Edges cut at ``splits`` (their key, ``x``, ``y``). Only edges that are cut move."""
    ident = ident or _ID
    cut = edges.join(splits.select(*ident).distinct(), ident, "left_semi")
    whole = edges.join(splits.select(*ident).distinct(), ident, "left_anti")
    place = "(x - ax) * (bx - ax) + (y - ay) * (by - ay)"
    at = splits.join(cut, ident).unionByName(
        cut.withColumns({"x": F.col("ax"), "y": F.col("ay")})
    ).unionByName(cut.withColumns({"x": F.col("bx"), "y": F.col("by")})).withColumn("_t", F.expr(place))
    order = Window.partitionBy(*ident).orderBy("_t", "x", "y")
    made = at.withColumns({"_nx": F.lead("x").over(order), "_ny": F.lead("y").over(order)})
    made = made.where("_nx IS NOT NULL AND (x <> _nx OR y <> _ny)").selectExpr(
        *ident, "x AS ax", "y AS ay", "_nx AS bx", "_ny AS by"
    )
    return whole.select(*ident, *_ENDS).unionByName(made)


def _keyed(edges: DataFrame) -> DataFrame:
    """With ends in order (``lx``, ``ly`` first) and ``fwd``, whether the edge runs that way."""
    fwd = "(ax < bx OR ax = bx AND ay < by)"
    return edges.selectExpr(
        *[c for c in edges.columns if c not in _ENDS], f"{fwd} AS fwd",
        *[f"IF({fwd}, {p}, {q}) AS {n}" for n, p, q in (
            ("lx", "ax", "bx"), ("ly", "ay", "by"), ("hx", "bx", "ax"), ("hy", "by", "ay"))],
    )


_LINE = ["lx", "ly", "hx", "hy"]


def _midpoints(lines: DataFrame) -> DataFrame:
    return lines.withColumn(GEOM, F.expr("named_struct('x', (lx + hx) / 2, 'y', (ly + hy) / 2)"))


def _in_parts(points: DataFrame, rows: DataFrame, plan: S.CellPlan, keys: list[str], how: str, closed: bool) -> DataFrame:
    """Points joined with the parts that hold them, by cell and further keys."""
    right = S.chips(S._spread(rows, plan), plan.cell, keep_geom=False, flat=True)
    flat = plan.only_boxes or S._all_flat(right)
    return joins.sized_join(
        S._point_keys(points, plan.cell), right, [*keys, "_cell"],
        S._point_in_chip(closed, plan.only_boxes, flat), how, right_bytes=plan.bytes,
    )


def outline(rows: DataFrame, tol: float) -> DataFrame:
    """Edges ``_g``, ``ax`` .. ``by`` of the union of each group of :func:`parts`, inside on the left."""
    plan = S.choose_cell(rows)
    edges = stored(directed(rows), "edges")
    celled = _by_cell(edges, plan.cell, tol)
    met = celled.alias("l").join(celled.alias("r"), on=F.expr(
        f"l.{_G} = r.{_G} AND l._cx = r._cx AND l._cy = r._cy AND {_near(tol)} "
        f"AND (l.{_PART} < r.{_PART} OR l.{_PART} = r.{_PART} AND l.{_POS} < r.{_POS})"
    ))
    met = _judged(met).selectExpr(f"l.{_G}", f"l.{_PART} AS p0", f"l.{_POS} AS e0", f"r.{_PART} AS p1", f"r.{_POS} AS e1",
                         f"explode({_meetings(tol)}) AS m")
    splits = stored(met.selectExpr(
        _G, f"IF(m.side = 0, p0, p1) AS {_PART}", f"IF(m.side = 0, e0, e1) AS {_POS}", "m.x", "m.y"
    ).distinct(), "splits")
    lines = stored(_keyed(_pieces(edges, splits)), "pieces")
    border = lines.groupBy(_G, *_LINE).agg(F.bool_and("fwd").alias("left"), F.bool_or("fwd").alias("fwd"))
    # Inside on one side only; both sides would differ.
    border = border.where("left = fwd").select(_G, *_LINE, "fwd")
    held = _in_parts(_midpoints(border), rows, plan, [_G], "inner", False).select(
        *[F.col(f"l.{c}") for c in (_G, *_LINE)], F.col(f"r.{_PART}").alias(_PART)
    )
    covered = held.join(lines.select(_G, *_LINE, _PART), [_G, *_LINE, _PART], "left_anti")
    kept = border.join(covered.select(_G, *_LINE).distinct(), [_G, *_LINE], "left_anti")
    return stored(kept.selectExpr(
        _G, "IF(fwd, lx, hx) AS ax", "IF(fwd, ly, hy) AS ay", "IF(fwd, hx, lx) AS bx", "IF(fwd, hy, ly) AS by"
    ), "outline")


def _linked(edges: DataFrame) -> DataFrame:
    """Edges with the id of the one that follows: at a vertex, the first that leaves it clockwise from
    where the edge came, which bounds the same stretch of inside."""
    arriving = edges.selectExpr(_G, "bx AS vx", "by AS vy", "atan2(ay - by, ax - bx) AS turn", "_id", "0 AS leaves")
    leaving = edges.selectExpr(_G, "ax AS vx", "ay AS vy", "atan2(by - ay, bx - ax) AS turn", "_id", "1 AS leaves")
    around = f"PARTITION BY {_G}, vx, vy ORDER BY turn DESC, leaves"
    out = "IF(leaves = 1, _id, NULL)"
    found = arriving.unionByName(leaving).selectExpr(
        "_id", "leaves",
        f"coalesce(lead({out}) IGNORE NULLS OVER ({around}), first({out}) IGNORE NULLS OVER ("
        f"{around} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS _next",
    )
    return found.where("leaves = 0").select("_id", "_next")


def rings(edges: DataFrame, tol: float) -> DataFrame:
    """Closed rings of edges: ``_g``, ``ring`` and ``area2``, twice the signed area; holes are negative.
    A ring starts at its least vertex."""
    edges = stored(edges.withColumn("_id", F.monotonically_increasing_id()), "ring_edges")
    state = stored(_linked(edges).selectExpr("_id", "_next", "_id AS least", "0L AS dist"), "links")
    ends = state.agg(F.count("*"), F.count("_next"), F.count_distinct("_next")).first()
    if ends[0] != ends[2]:
        raise ValueError(f"an outline does not close: {ends[0]} edges, {ends[2]} of them follow another")
    reach = 1
    while True:
        after = state.selectExpr("_id AS _next", "_next AS next_", "least AS least_", "dist AS dist_")
        state = stored(state.join(after, "_next").selectExpr(
            "_id", "next_ AS _next", "least(least, least_) AS least",
            f"IF(least_ < least, {reach} + dist_, dist) AS dist", "least_ < least AS moved",
        ), "links")
        reach *= 2
        if state.where("moved").limit(1).count() == 0:
            break
        state = state.drop("moved")
    # The distance to the least edge falls along the ring.
    start = "transform(array_sort(collect_list(named_struct('k', IF(dist = 0, 0L, 1L), 'd', -dist, 'x', ax, 'y', ay))), v -> named_struct('x', v.x, 'y', v.y))"
    made = edges.join(state, "_id").groupBy(_G, "least").agg(F.expr(start).alias("r"))
    around = [f"get(r, pmod(i + {d}, size(r)))" for d in (-1, 1)]
    p, q = around
    bend = (
        f"abs((v.x - {p}.x) * ({q}.y - {p}.y) - (v.y - {p}.y) * ({q}.x - {p}.x)) > "
        f"{tol!r}D * greatest(abs({q}.x - {p}.x), abs({q}.y - {p}.y), abs(v.x - {p}.x), abs(v.y - {p}.y))"
    )
    made = made.withColumn("r", F.expr(f"filter(r, (v, i) -> {bend})")).where("size(r) > 2")
    first = "array_position(r, array_min(r))"
    closed = f"concat(slice(r, int({first}), size(r)), slice(r, 1, int({first}) - 1), array(array_min(r)))"
    return made.select(_G, F.expr(closed).alias("ring")).withColumn("area2", F.expr(_area2("ring")))


def _held_by_strips(points: DataFrame, shells: DataFrame) -> DataFrame:
    """``_hole``, ``_ring``, ``area2``: points strictly inside rings of very many edges, by the edges that a line from
    the point to the right crosses. Edges go by strips of the plane, so no task holds a ring; strips are so
    high that an edge passes five on average at most."""
    ends = "transform(slice(ring, 2, size(ring) - 1), (q, i) -> struct(get(ring, i).x AS ax, get(ring, i).y AS ay, q.x AS bx, q.y AS by))"
    edges = shells.selectExpr(_G, "_ring", "area2", f"inline({ends})").where("ay <> by")
    edges = stored(edges, "ring_sides")
    n, tall, low, high = edges.agg(
        F.count("*"), F.expr("sum(abs(by - ay))"), F.expr("min(least(ay, by))"), F.expr("max(greatest(ay, by))")
    ).first()
    strip = f"{max((high - low) * STRIP_EDGES / n, tall / (4 * n))!r}D"
    edges = edges.withColumn("_strip", F.expr(
        f"explode(sequence(bigint(floor(least(ay, by) / {strip})), bigint(floor(greatest(ay, by) / {strip}))))"
    ))
    points = points.select(_G, "_hole", F.col(f"{GEOM}.x").alias("x"), F.col(f"{GEOM}.y").alias("y")).withColumn(
        "_strip", F.expr(f"bigint(floor(y / {strip}))")
    )
    crossed = "(r.ay > l.y) <> (r.by > l.y) AND signum((r.bx - r.ax) * (l.y - r.ay) - (r.by - r.ay) * (l.x - r.ax)) = signum(r.by - r.ay)"
    met = joins.sized_join(points, edges, [_G, "_strip"], F.expr(crossed), "inner")
    return met.groupBy("l._hole", "r._ring").agg(F.count("*").alias("n"), F.min("r.area2").alias("area2")).where(
        "n % 2 = 1"
    ).select("_hole", "_ring", "area2")


def polygons(edges: DataFrame, tol: float) -> DataFrame:
    """One row per part: ``_g``, ``geom`` (a shell and its holes), box, and of it ``area``, ``vertices`` and ``rings``.
    A hole belongs to the smallest shell of its group around it. What is told of a part is summed ring by
    ring, so a part of very many holes is held by one task only where its ``geom`` or box is asked for."""
    found = stored(rings(edges, tol).withColumn("_ring", F.monotonically_increasing_id()), "rings")
    shells, holes = found.where("area2 > 0"), found.where("area2 < 0")
    owned = shells.select(_G, F.col("_ring").alias("_shell"), "area2", "ring")
    if holes.limit(1).count():
        points = holes.select(
            _G, F.col("_ring").alias("_hole"),
            F.expr("named_struct('x', (get(ring, 0).x + get(ring, 1).x) / 2, 'y', (get(ring, 0).y + get(ring, 1).y) / 2)").alias(GEOM),
        )
        few = set_bbox(shells.where(f"size(ring) <= {RING_EDGES}").select(
            _G, "_ring", "area2", F.array(F.array("ring")).alias(GEOM)
        ))
        inside = _in_parts(points, few, S.choose_cell(few), [_G], "inner", False).select("l._hole", "r._ring", "r.area2")
        many = shells.where(f"size(ring) > {RING_EDGES}")
        if many.limit(1).count():
            inside = inside.unionByName(_held_by_strips(points, many))
        owner = inside.groupBy("_hole").agg(F.min_by("_ring", "area2").alias("_shell"))
        owned = owned.unionByName(
            holes.join(owner, F.col("_ring") == F.col("_hole")).select(_G, "_shell", "area2", "ring")
        )
    made = owned.groupBy(_G, "_shell").agg(
        (F.sum("area2") / 2).alias("area"), F.sum(F.size("ring") - 1).alias("vertices"), F.count("*").alias("rings"),
        F.first(F.when(F.col("area2") > 0, F.col("ring")), True).alias("_outer"),
        F.array_sort(F.collect_list(F.when(F.col("area2") < 0, F.col("ring")))).alias("_holes"),
    )
    made = made.withColumn(GEOM, F.array(F.concat(F.array("_outer"), "_holes")))
    return set_bbox(made).select(_G, GEOM, *BBOX, *FACTS)


def union(layer: DataFrame) -> DataFrame:
    """The union of a whole layer, a row per connected part: ``geom``, box, ``area``, ``vertices`` and ``rings``."""
    rows = parts(layer.withColumn(_G, F.lit(0)), _G)
    tol = _tolerance(rows)
    return polygons(outline(rows, tol), tol).select(GEOM, *BBOX, *FACTS)


def _gathered(made: DataFrame, key: str) -> DataFrame:
    """All parts of a group in one row, in order."""
    return set_bbox(made.groupBy(F.col(_G).alias(key)).agg(
        F.expr(f"flatten(array_sort(collect_list({GEOM})))").alias(GEOM)
    ))


def dissolve(layer: DataFrame, by: str, order: str) -> DataFrame:
    """One row per non-null ``by``: the union of its polygons, without inner borders, and for each other
    column its first non-null value in ``order``."""
    attrs = [c for c in layer.columns if c not in (by, order, GEOM, *BBOX)]
    firsts = [
        F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(order))).alias(c) for c in attrs
    ]
    rows = parts(layer, by)
    tol = _tolerance(rows)
    shapes = _gathered(polygons(outline(rows, tol), tol), by)
    if not firsts:
        return shapes
    held = layer.where(F.col(by).isNotNull() & F.col(GEOM).isNotNull()).groupBy(by).agg(*firsts)
    return held.join(shapes, by).select(by, *attrs, GEOM, *BBOX)


def cut(layer: DataFrame, region: DataFrame, key: str) -> DataFrame:
    """The layer's polygons cut to the region; what only touches it, or lies outside, goes. ``key``
    names the polygons. Parts of one polygon must not overlap, those of the region may."""
    own = parts(layer, key)
    around = parts(region.withColumn(_G, F.lit(0)), _G)
    tol = _tolerance(own, around)
    border = outline(around, tol).select(
        _G, F.lit(-1).cast("long").alias(_PART), F.monotonically_increasing_id().alias(_POS), *_ENDS
    )
    border = stored(border, "region_edges")
    edges = stored(directed(own), "edges")
    cell = max(S.choose_cell(own).cell, S.choose_cell(around).cell)
    met = _judged(joins.sized_join(
        _by_cell(edges, cell, tol), _by_cell(border.drop(_G), cell, tol), ["_cx", "_cy"], F.expr(_near(tol)), "inner"
    )).selectExpr(
        f"l.{_G} AS {_G}", f"l.{_PART} AS p0", f"l.{_POS} AS e0", f"r.{_POS} AS e1",
        f"explode_outer({_meetings(tol)}) AS m",
    )
    met = stored(met.distinct(), "splits")
    mine = stored(_keyed(_pieces(edges, met.where("m.side = 0").selectExpr(
        _G, f"p0 AS {_PART}", f"e0 AS {_POS}", "m.x", "m.y"
    ))), "pieces")
    # The region's edges near a polygon, split by that polygon alone.
    close = met.selectExpr(_G, f"e1 AS {_POS}").distinct()
    theirs = stored(_keyed(_pieces(
        close.join(border.drop(_G), _POS), met.where("m.side = 1").selectExpr(_G, f"e1 AS {_POS}", "m.x", "m.y"),
        [_G, _POS],
    )), "region_pieces")
    sides = theirs.select(_G, *_LINE, F.col("fwd").alias("theirs")).distinct()
    # Along the region's border: kept where both have their inside on the same side.
    shared = mine.join(sides, [_G, *_LINE]).where("fwd = theirs").select(_G, *_LINE, "fwd")
    alone = mine.join(sides, [_G, *_LINE], "left_anti").withColumnRenamed(_G, "_own")
    within = _in_parts(
        _midpoints(alone), around.drop(_G), S.choose_cell(around), [], "left_semi", True
    ).selectExpr(f"_own AS {_G}", *_LINE, "fwd")
    # Pieces of the region's border inside a polygon, but not along its own: near it, and whole edges.
    own_plan = S.choose_cell(own)
    lone = theirs.join(mine.select(_G, *_LINE), [_G, *_LINE], "left_anti")
    reached = _in_parts(_midpoints(lone), own, own_plan, [_G], "left_semi", False).select(_G, *_LINE, "fwd")
    rest = _in_parts(_midpoints(_keyed(border.drop(_G))), own, own_plan, [], "inner", False).select(
        F.col(f"r.{_G}").alias(_G), *[F.col(f"l.{c}").alias(c) for c in (_POS, *_LINE, "fwd")]
    ).join(close, [_G, _POS], "left_anti").select(_G, *_LINE, "fwd")
    every = shared.unionByName(within).unionByName(reached).unionByName(rest).distinct().selectExpr(
        _G, "IF(fwd, lx, hx) AS ax", "IF(fwd, ly, hy) AS ay", "IF(fwd, hx, lx) AS bx", "IF(fwd, hy, ly) AS by"
    )
    shapes = _gathered(polygons(stored(every, "outline"), tol), key)
    names = [c for c in layer.columns if c not in (GEOM, *BBOX)]
    return layer.select(*names).join(shapes, key).select(*names, GEOM, *BBOX)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_own", _G).agg(F.count("*").alias("n"))


def pairs_within(layer: DataFrame, areas: DataFrame, key: str, area_key: str) -> DataFrame:
    """Pairs ``key``, ``area_key`` of a polygon and an area that holds all of it; borders may touch.

    Each piece of the polygon's edges, split at the area's outline, must lie in the area, and along
    that outline have its inside on the same side: the pieces that do are counted per pair. And no
    piece of the area's outline may lie inside the polygon. An area's touching parts are one area.
    """
    own = parts(layer, key)
    around = parts(areas, area_key)
    tol = _tolerance(own, around)
    border = stored(outline(around, tol).select(
        _G, F.lit(-1).cast("long").alias(_PART), F.monotonically_increasing_id().alias(_POS), *_ENDS
    ), "area_edges")
    edges = stored(directed(own), "edges")
    own_plan, plan = S.choose_cell(own), S.choose_cell(around)
    cell = max(own_plan.cell, plan.cell)
    met = _judged(joins.sized_join(
        _by_cell(edges, cell, tol), _by_cell(border, cell, tol), ["_cx", "_cy"], F.expr(_near(tol)), "inner"
    )).selectExpr(
        f"l.{_G} AS g0", f"l.{_PART} AS p0", f"l.{_POS} AS e0", f"r.{_G} AS g1", f"r.{_POS} AS e1",
        f"explode_outer({_meetings(tol)}) AS m",
    )
    # Every edge near the outline, split or not, is judged against that area by itself.
    met = stored(met.distinct(), "splits")
    wide = [_G, "_own", _PART, _POS]
    near = met.selectExpr(f"g1 AS {_G}", "g0 AS _own", f"p0 AS {_PART}", f"e0 AS {_POS}").distinct()
    own_edges = edges.withColumnRenamed(_G, "_own")
    close = near.join(own_edges, ["_own", _PART, _POS])
    cuts = met.where("m.side = 0").selectExpr(f"g1 AS {_G}", "g0 AS _own", f"p0 AS {_PART}", f"e0 AS {_POS}", "m.x", "m.y")
    pieces = stored(_keyed(_pieces(close, cuts, wide)), "pieces")
    sides = _keyed(_pieces(
        met.selectExpr("g0 AS _own", f"g1 AS {_G}", f"e1 AS {_POS}").distinct().join(border, [_G, _POS]),
        met.where("m.side = 1").selectExpr("g0 AS _own", f"g1 AS {_G}", f"-1L AS {_PART}", f"e1 AS {_POS}", "m.x", "m.y"),
        wide,
    ))
    sides = stored(sides, "area_pieces")
    pair = ["_own", _G]
    both = sides.select(*pair, *_LINE, F.col("fwd").alias("theirs")).distinct()
    shared = pieces.join(both, [*pair, *_LINE]).where("fwd = theirs")
    alone = pieces.join(both, [*pair, *_LINE], "left_anti")
    within = _in_parts(_midpoints(alone), around, plan, [_G], "left_semi", True)
    # Edges that come near no outline of an area are wholly in it or wholly out.
    far = _in_parts(_midpoints(_keyed(own_edges)), around, plan, [], "inner", True).select(
        F.col("l._own").alias("_own"), F.col(f"r.{_G}").alias(_G), F.col(f"l.{_PART}").alias(_PART), F.col(f"l.{_POS}").alias(_POS)
    ).distinct().join(near, wide, "left_anti")
    good = shared.select(*pair).unionByName(within.select(*pair)).unionByName(far.select(*pair))
    # To be reached: all edges, those near the outline by their pieces.
    total = own_edges.groupBy("_own").agg(F.count("*").alias("edges"))
    split = _counted(pieces).withColumnRenamed("n", "made").join(
        _counted(near).withColumnRenamed("n", "near"), pair
    )
    full = _counted(good).join(total, "_own").join(split, pair, "left").where(
        "n = edges + coalesce(made - near, 0)"
    ).select(*pair)
    # Outline inside the polygon: of edges near it by pieces, of others whole.
    mine = pieces.select(*pair, *_LINE).distinct()
    lone = sides.join(mine, [*pair, *_LINE], "left_anti").selectExpr(f"{_G} AS _area", f"_own AS {_G}", *_LINE)
    broken = _in_parts(_midpoints(lone), own, own_plan, [_G], "left_semi", False).selectExpr(f"{_G} AS _own", f"_area AS {_G}")
    rest = _in_parts(
        _midpoints(_keyed(border.withColumnRenamed(_G, "_area"))), own, own_plan, [], "inner", False
    ).select(F.col(f"r.{_G}").alias("_own"), F.col("l._area").alias(_G), F.col(f"l.{_POS}").alias(_POS))
    rest = rest.join(
        met.selectExpr("g0 AS _own", f"g1 AS {_G}", f"e1 AS {_POS}").distinct(), [*pair, _POS], "left_anti"
    )
    bad = broken.unionByName(rest.select(*pair)).distinct()
    return full.join(bad, pair, "left_anti").select(F.col("_own").alias(key), F.col(_G).alias(area_key))


def polygons_in_polygons(
    layer: DataFrame, areas: DataFrame, key: str, area_key: str
) -> DataFrame:
    """Left join of polygons to the areas that hold them, by outline; columns as in the other joins."""
    found = stored(pairs_within(layer, areas, key, area_key), "within").select(
        F.col(key).alias("_left"), F.col(area_key).alias("_right")
    )
    held = found.join(areas, F.col("_right") == F.col(area_key)).drop("_right")
    joined = layer.alias("l").join(held.alias("r"), F.col(f"l.{key}") == F.col("r._left"), "left")
    return joined.select(*S._joined_columns(layer.columns, areas.columns))
