"""The registered queries as plain SQL, for side-by-side checks in another engine.

Geometry is spelled out as edge lists and crossing counts, or, where a layer allows it, as
comparisons with the rectangles an outline is made of.
"""

from __future__ import annotations

from areametrics.plans import derived as D

_OCC = """occ AS (
SELECT l_orderkey * 8 + l_linenumber AS "gbifID",
  concat('occ-', l_orderkey, '-', l_linenumber) AS "occurrenceID",
  p_type AS kingdom, p_brand AS phylum, CAST(p_size AS VARCHAR) AS class, p_type AS "order",
  p_brand AS family, split_part(p_name, ' ', 2) AS genus,
  CASE WHEN l_linenumber <> 7 THEN p_name END AS species,
  CASE WHEN l_linenumber <> 7 THEN 'SPECIES' ELSE 'GENUS' END AS "taxonRank",
  p_name AS "scientificName", strftime(l_shipdate, '%Y-%m-%d') AS "eventDate",
  CAST(day(l_shipdate) AS INTEGER) AS day, CAST(month(l_shipdate) AS INTEGER) AS month,
  CAST(year(l_shipdate) AS INTEGER) AS year, p_partkey AS "taxonKey",
  l_returnflag AS "basisOfRecord", l_linestatus AS license,
  CAST(l_suppkey AS VARCHAR) AS "recordedBy",
  CASE WHEN l_suppkey % 10 <> 9 THEN ((l_orderkey * 7919 + l_partkey * 104729
    + l_linenumber * 31) % 100003) / CAST(100003 AS DOUBLE) END AS x,
  ((l_orderkey * 15485863 + l_suppkey * 7907 + l_linenumber * 17) % 100019)
    / CAST(100019 AS DOUBLE) AS y,
  CASE WHEN s_nationkey % 7 <> 0 THEN s_nationkey END AS park_id,
  CASE WHEN s_nationkey % 7 <> 0 THEN n_name END AS park_name
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey)"""

_GRID = f"""grid AS (
SELECT CAST(cx * {D.GRID} + cy AS INTEGER) AS id, cx / CAST({D.GRID} AS DOUBLE) AS minx,
  cy / CAST({D.GRID} AS DOUBLE) AS miny, (cx + 1) / CAST({D.GRID} AS DOUBLE) AS maxx,
  (cy + 1) / CAST({D.GRID} AS DOUBLE) AS maxy
FROM range({D.GRID}) a(cx), range({D.GRID}) b(cy))"""

_QUADS = f"""quads AS (
SELECT CAST(level AS INTEGER) AS level, left(quad, level) AS quad, species FROM (SELECT species, concat({", ".join(
    f"(cx // {1 << i}) % 2 + (cy // {1 << i}) % 2 * 2" for i in reversed(range(10))
)}) AS quad FROM (SELECT species, CAST(floor(x * 1024) AS BIGINT) AS cx, CAST(floor(y * 1024) AS BIGINT) AS cy
FROM occ WHERE x IS NOT NULL AND y IS NOT NULL) a) b, range(1, 11) l(level))"""

_NBHD = """nbhd AS (
SELECT r_regionkey AS qr_id, r_name AS qr_name, r_regionkey / CAST(5 AS DOUBLE) AS minx,
  CAST(0 AS DOUBLE) AS miny, (r_regionkey + 1) / CAST(5 AS DOUBLE) AS maxx,
  CAST(1 AS DOUBLE) AS maxy FROM region)"""

_PLOT = f"""plot AS (
SELECT c_custkey AS "OBJECTID",
  CASE WHEN c_custkey % 50 <> 7 THEN concat('Green ', c_custkey // 4) END AS "Nom",
  {D.case_of(D.PLOT_TYPES['Type'], 'c_custkey % 5')} AS "Type",
  {D.case_of(D.PLOT_TYPES['TYPO1'], 'c_custkey % 7')} AS "TYPO1",
  {D.case_of(D.PLOT_TYPES['TYPO2'], 'c_custkey % 11')} AS "TYPO2",
  c_acctbal AS area_value, {D.PLOT_SHAPE} AS shape,
  (c_custkey % {D.PLOT_ROW}) / CAST(128 AS DOUBLE) AS x0,
  (c_custkey // {D.PLOT_ROW}) / CAST(128 AS DOUBLE) AS y0
FROM customer)"""


def _edge_values(shapes: dict, unit: float) -> str:
    rows = []
    for name, parts in shapes.items():
        for i, part in enumerate(parts):
            for ring in part:
                for a, b in zip(ring, [*ring[1:], ring[0]]):
                    numbers = ", ".join(f"CAST({v * unit!r} AS DOUBLE)" for v in (*a, *b))
                    rows.append(f"('{name}', {i}, {numbers})")
    return f"(VALUES {', '.join(rows)}) s(shape, part, px, py, qx, qy)"


_PARK_EDGES = f"""park AS (
SELECT n_nationkey AS park_id, n_name AS park_name, {D.PARK_SHAPE} AS shape,
  (n_nationkey % 5) * CAST(0.2 AS DOUBLE) AS x0, (n_nationkey // 5) * CAST(0.2 AS DOUBLE) AS y0
FROM nation),
park_edge AS (
SELECT park_id, part, x0 + px AS px, y0 + py AS py, x0 + qx AS qx, y0 + qy AS qy
FROM park JOIN {_edge_values(D.PARK_SHAPES, 1.0)} USING (shape)),
park_box AS (
SELECT park_id, park_name, min(px) AS minx, min(py) AS miny, max(px) AS maxx, max(py) AS maxy
FROM park JOIN park_edge USING (park_id) GROUP BY park_id, park_name)"""

_PLOT_EDGES = f"""{_PLOT},
plot_edge AS (
SELECT "OBJECTID", part, x0 + px AS px, y0 + py AS py, x0 + qx AS qx, y0 + qy AS qy
FROM plot JOIN {_edge_values(D.PLOT_SHAPES, D.PLOT_UNIT)} USING (shape)),
plot_box AS (
SELECT "OBJECTID", min(px) AS minx, min(py) AS miny, max(px) AS maxx, max(py) AS maxy
FROM plot_edge GROUP BY "OBJECTID")"""

_CROSS = (
    "count(*) FILTER (WHERE (py > y) <> (qy > y) AND CASE WHEN qy > py "
    "THEN (x - px) * (qy - py) < (qx - px) * (y - py) "
    "ELSE (x - px) * (qy - py) > (qx - px) * (y - py) END)"
)
_ON_EDGE = (
    "count(*) FILTER (WHERE (x - px) * (qy - py) = (qx - px) * (y - py) "
    "AND x BETWEEN least(px, qx) AND greatest(px, qx) AND y BETWEEN least(py, qy) AND greatest(py, qy))"
)

_XY = "xy AS (SELECT DISTINCT x, y FROM occ WHERE x IS NOT NULL AND y IS NOT NULL)"

_PARK_HITS = f"""{_XY},
hit AS (
SELECT DISTINCT x, y, park_id FROM (
  SELECT x, y, park_id, part FROM xy, park_edge GROUP BY x, y, park_id, part
  HAVING {_CROSS} % 2 = 1 AND {_ON_EDGE} = 0) q)"""

_PARK_TOUCH = f"""{_XY},
hit AS (
SELECT DISTINCT x, y, park_id FROM (
  SELECT x, y, park_id, part FROM xy, park_edge GROUP BY x, y, park_id, part
  HAVING {_CROSS} % 2 = 1 OR {_ON_EDGE} > 0) q)"""

# A plot lies in its own lattice square, so that square is the only candidate of a point.
_PLOT_HITS = f"""{_XY},
hit AS (
SELECT DISTINCT x, y, "OBJECTID" FROM (
  SELECT x, y, "OBJECTID", part FROM xy JOIN plot_edge
  ON "OBJECTID" = CAST(floor(y * 128) AS BIGINT) * {D.PLOT_ROW} + CAST(floor(x * 128) AS BIGINT)
  GROUP BY x, y, "OBJECTID", part
  HAVING {_CROSS} % 2 = 1 AND {_ON_EDGE} = 0) q)"""

def _side(p: str, q: str, end: str) -> str:
    return (
        f"sign(({p}.qx - {p}.px) * ({q}.{end}y - {p}.py) - ({p}.qy - {p}.py) * ({q}.{end}x - {p}.px))"
    )


_PLOT_MEETS_PARK = f"""meets AS (
SELECT p."OBJECTID" FROM plot_edge p JOIN park_edge q
ON least(p.px, p.qx) <= greatest(q.px, q.qx) AND greatest(p.px, p.qx) >= least(q.px, q.qx)
AND least(p.py, p.qy) <= greatest(q.py, q.qy) AND greatest(p.py, p.qy) >= least(q.py, q.qy)
AND {_side('p', 'q', 'p')} * {_side('p', 'q', 'q')} <= 0
AND {_side('q', 'p', 'p')} * {_side('q', 'p', 'q')} <= 0
UNION
SELECT "OBJECTID" FROM (SELECT DISTINCT "OBJECTID", px AS x, py AS y FROM plot_edge) v, park_edge
GROUP BY "OBJECTID", x, y, park_id, part HAVING {_CROSS} % 2 = 1 OR {_ON_EDGE} > 0)"""

_COLS = ", ".join(
    f'{{0}}"{c}"' for c in [
        "gbifID", "occurrenceID", "kingdom", "phylum", "class", "order", "family", "genus",
        "species", "taxonRank", "scientificName", "eventDate", "day", "month", "year",
        "taxonKey", "basisOfRecord", "license", "recordedBy",
    ]
)


def _occ_cols(alias: str = "") -> str:
    return _COLS.replace("{0}", f"{alias}." if alias else "")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_RICHNESS = """count(DISTINCT "gbifID") AS observation,
count(DISTINCT kingdom) AS kingdom_richness, count(DISTINCT family) AS family_richness,
count(DISTINCT genus) AS genus_richness, count(DISTINCT species) AS species_richness"""


def _shannon(key: str, source: str) -> str:
    return f"""sc AS (SELECT {key}, species, count(*) AS n FROM {source} WHERE {key} IS NOT NULL
  GROUP BY {key}, species),
tot AS (SELECT {key}, sum(n) AS total FROM sc GROUP BY {key}),
sh AS (SELECT {key}, round(-sum(n * 1.0 / (total * 1.0) * ln(n * 1.0 / (total * 1.0))), 6) + 0.0
  AS shannon_index FROM sc JOIN tot USING ({key}) GROUP BY {key})"""


_GRID_JOINED = (
    "joined AS (SELECT o.*, g.id, g.minx, g.miny, g.maxx, g.maxy FROM occ o LEFT JOIN grid g "
    "ON o.x > g.minx AND o.x < g.maxx AND o.y > g.miny AND o.y < g.maxy)"
)

# An L is two arms from its corner; a box fits the L when it fits one arm and misses the hole.
_CELL_PARK = """arm AS (
SELECT park_id, shape, x0, y0, x0 + CAST(w AS DOUBLE) AS x1, y0 + CAST(h AS DOUBLE) AS y1
FROM park, (VALUES (0.18, 0.08), (0.08, 0.18)) v(w, h)),
fit AS (
SELECT DISTINCT g.id, a.park_id FROM grid g JOIN arm a
ON g.minx >= a.x0 AND g.maxx <= a.x1 AND g.miny >= a.y0 AND g.maxy <= a.y1
WHERE a.shape = 'ell' OR g.minx >= a.x0 + CAST(0.06 AS DOUBLE)
  OR g.maxx <= a.x0 + CAST(0.02 AS DOUBLE) OR g.miny >= a.y0 + CAST(0.06 AS DOUBLE)
  OR g.maxy <= a.y0 + CAST(0.02 AS DOUBLE))"""


def _mtm8_sql(x: str, y: str) -> str:
    """Inverse series written out as nested selects, one level per step."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    k0 = 0.9999
    m = a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)

    def d(v: float) -> str:
        return f"CAST({v!r} AS DOUBLE)"

    return f"""s1 AS (SELECT *, ({y}) / {d(k0)} / {d(m)} AS mu FROM src),
s2 AS (SELECT *, mu + {d(3 * e1 / 2 - 27 * e1**3 / 32)} * sin(2 * mu)
  + {d(21 * e1**2 / 16 - 55 * e1**4 / 32)} * sin(4 * mu) + {d(151 * e1**3 / 96)} * sin(6 * mu)
  + {d(1097 * e1**4 / 512)} * sin(8 * mu) AS phi FROM s1),
s3 AS (SELECT *, {d(ep)} * cos(phi) * cos(phi) AS c, tan(phi) * tan(phi) AS t,
  {d(a)} / sqrt(1 - {d(e2)} * sin(phi) * sin(phi)) AS n,
  {d(a * (1 - e2))} / pow(1 - {d(e2)} * sin(phi) * sin(phi), 1.5) AS r FROM s2),
s4 AS (SELECT *, (({x}) - 304800) / (n * {d(k0)}) AS dd FROM s3),
moved AS (SELECT *, degrees(phi - (n * tan(phi) / r) * (dd * dd / 2
  - (5 + 3 * t + 10 * c - 4 * c * c - 9 * {d(ep)}) * pow(dd, 4) / 24
  + (61 + 90 * t + 298 * c + 45 * t * t - 252 * {d(ep)} - 3 * c * c) * pow(dd, 6) / 720)) AS lat,
  -73.5 + degrees((dd - (1 + 2 * t + c) * pow(dd, 3) / 6
  + (5 - 2 * c + 28 * t - 3 * c * c + 8 * {d(ep)} + 24 * t * t) * pow(dd, 5) / 120) / cos(phi))
  AS lon FROM s4)"""


def _typed_terms() -> str:
    return " OR ".join(f"\"{c}\" = '{v}'" for c, v in D.PARK_TYPE_TERMS)


def _profile() -> str:
    types = {
        "gbifID": "bigint", "day": "int", "month": "int", "year": "int", "taxonKey": "bigint",
        "decimalLongitude": "double", "decimalLatitude": "double", "park_id": "int",
    }
    names = [c.strip('"') for c in _occ_cols().split(", ")]
    names += ["decimalLongitude", "decimalLatitude", "park_id", "park_name"]
    source = {"decimalLongitude": "x", "decimalLatitude": "y"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{types.get(c, 'string')}' AS type, count(*) AS rows, "
        f"count(*) FILTER (WHERE \"{source.get(c, c)}\" IS NULL) AS nulls FROM occ"
        for c in names
    )


_SEASON = (
    "CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring' "
    "WHEN month IN (6, 7, 8) THEN 'summer' WHEN month IN (9, 10, 11) THEN 'autumn' END"
)
_PLOT_SUMS = (
    "count(*) AS vertices, round(sum(px), 6) AS sum_x, round(sum(py), 6) AS sum_y"
)


def oracles() -> dict[str, str]:
    found = _oracles()
    for name in ("plot_sjoin", "layer_sjoin_cells", "clip_points"):
        found[f"{name}_shuffled"] = found[name]
    return found


def _oracles() -> dict[str, str]:
    occ = _with(_OCC)
    park_taxa = occ + """SELECT park_name, kingdom, class, genus, species,
count(species) AS species_count, min(park_id) AS park_id FROM occ
GROUP BY park_name, kingdom, class, genus, species"""
    return {
        "park_richness": occ + f"""SELECT park_name, {_RICHNESS}, min(park_id) AS park_id FROM occ
WHERE park_name IS NOT NULL GROUP BY park_name""",
        "taxa_richness_by_grid": _with(_OCC, _GRID, _GRID_JOINED) + f"""SELECT id, {_RICHNESS},
min(minx) AS minx, min(miny) AS miny FROM joined WHERE id IS NOT NULL GROUP BY id""",
        "shannon_index": _with(_OCC, _shannon("park_name", "occ")) + "SELECT * FROM sh",
        "species_proportions": _with(_OCC, _shannon("park_name", "occ")) + """SELECT park_name,
species, n AS species_count, CAST(total AS BIGINT) AS total_count,
round(n * 1.0 / (total * 1.0), 9) AS p FROM sc JOIN tot USING (park_name)""",
        "park_metrics": _with(_OCC, _shannon("park_name", "occ")) + f"""SELECT r.*, shannon_index
FROM (SELECT park_name, {_RICHNESS}, min(park_id) AS park_id FROM occ
WHERE park_name IS NOT NULL GROUP BY park_name) r LEFT JOIN sh USING (park_name)""",
        "grid_metrics": _with(_OCC, _GRID, _GRID_JOINED, _shannon("id", "joined"))
        + f"""SELECT r.*, shannon_index FROM (SELECT id, {_RICHNESS} FROM joined
WHERE id IS NOT NULL GROUP BY id) r LEFT JOIN sh USING (id)""",
        "park_taxa": park_taxa,
        "park_taxa_ordered": park_taxa,
        "annual_observations": occ
        + 'SELECT year, count(DISTINCT "gbifID") AS annual_observations FROM occ GROUP BY year',
        "most_observed_species": occ
        + "SELECT species, count(*) AS observations FROM occ GROUP BY species",
        "total_species": occ + "SELECT count(DISTINCT species) AS total_species FROM occ",
        "park_kingdom_counts": occ
        + "SELECT park_name, kingdom, count(*) AS count FROM occ GROUP BY park_name, kingdom",
        "park_class_counts": occ
        + "SELECT park_name, class, count(*) AS count FROM occ GROUP BY park_name, class",
        "park_kingdom_class_pairs": occ + """SELECT park_name, kingdom, class, pair_count,
kingdom_count, class_count FROM (SELECT park_name, kingdom, class, count(*) AS pair_count FROM occ
WHERE park_name IS NOT NULL GROUP BY ALL) p JOIN (SELECT park_name AS a, kingdom AS k, count(*)
AS kingdom_count FROM occ GROUP BY ALL) ON a = park_name AND k IS NOT DISTINCT FROM kingdom
JOIN (SELECT park_name AS b, class AS c, count(*) AS class_count FROM occ GROUP BY ALL)
ON b = park_name AND c IS NOT DISTINCT FROM class""",
        "park_taxa_summary": occ + f"""SELECT park_name, {_RICHNESS},
count(DISTINCT coalesce(kingdom, '')) AS kingdom_groups, count(*) AS kingdom_count,
count(DISTINCT coalesce(class, '')) AS class_groups, count(*) AS class_count FROM occ
WHERE park_name IS NOT NULL GROUP BY park_name""",
        "occurrence_table": occ + f"""SELECT {_occ_cols()},
CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS minx,
CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y END AS miny,
CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS maxx,
CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y END AS maxy FROM occ""",
        "prune_fields": occ + 'SELECT "gbifID", species, "order", year FROM occ',
        "layer_bbox": _with(_PLOT_EDGES) + "SELECT * FROM plot_box",
        "clean_layer": _with(_PLOT) + """SELECT "OBJECTID" AS park_id, "Nom" AS park_name,
"TYPO1" AS park_type1 FROM plot""",
        "type_filter": _with(_PLOT) + f"""SELECT "OBJECTID", "Nom", "Type", "TYPO1", "TYPO2"
FROM plot WHERE {_typed_terms()}""",
        "drop_any_null": _with(_PLOT) + """SELECT "OBJECTID", "Nom", "Type", "TYPO1", "TYPO2",
area_value FROM plot WHERE "Nom" IS NOT NULL AND "Type" IS NOT NULL AND "TYPO1" IS NOT NULL
AND "TYPO2" IS NOT NULL""",
        "limit_rows": occ + """SELECT 'occurrences' AS source, least(1000, count(*)) AS kept,
least(1000, count(*)) AS known FROM occ UNION ALL
SELECT 'nations', least(1000, count(*)), least(1000, count(*)) FROM nation""",
        "richness_with_shannon": _with(_OCC, _shannon("park_name", "occ")) + f"""SELECT r.*,
shannon_index FROM (SELECT park_name, {_RICHNESS}, min(park_id) AS park_id FROM occ
WHERE park_name IS NOT NULL GROUP BY park_name) r LEFT JOIN sh USING (park_name)""",
        "grid_over_plots": _with(_PLOT_EDGES) + """SELECT CAST(i * ny + j AS BIGINT) AS id,
minx + i * s AS minx, miny + j * s AS miny, minx + (i + 1) * s AS maxx, miny + (j + 1) * s AS maxy
FROM (SELECT min(minx) AS minx, min(miny) AS miny, CAST(0.25 AS DOUBLE) AS s,
CAST(ceil((max(maxx) - min(minx)) / 0.25::DOUBLE) AS BIGINT) AS nx,
CAST(ceil((max(maxy) - min(miny)) / 0.25::DOUBLE) AS BIGINT) AS ny FROM plot_box) b,
range(1000) x(i), range(1000) y(j) WHERE i < nx AND j < ny""",
        "staged_build": _with(_OCC, _GRID, _GRID_JOINED, _shannon("id", "joined"))
        + f"""SELECT r.*, shannon_index FROM (SELECT id, {_RICHNESS} FROM joined
WHERE id IS NOT NULL GROUP BY id) r LEFT JOIN sh USING (id)""",
        "profile_nulls": occ + _profile(),
        "park_types": _with(_PLOT) + 'SELECT DISTINCT "TYPO2" FROM plot',
        "grid_sjoin": _with(_OCC, _GRID, _GRID_JOINED)
        + f"SELECT {_occ_cols()}, id, minx, miny, maxx, maxy FROM joined",
        "layer_sjoin_points": _with(_OCC, _PARK_EDGES, _PARK_HITS) + """SELECT "gbifID", species,
b.park_id, b.park_name, b.minx, b.miny, b.maxx, b.maxy FROM occ o
LEFT JOIN hit h ON o.x = h.x AND o.y = h.y LEFT JOIN park_box b ON h.park_id = b.park_id""",
        "colliding_names": _with(_OCC, _PARK_EDGES, _PARK_HITS) + """SELECT "gbifID", species,
b.park_id, b.park_name AS species_1 FROM occ o LEFT JOIN hit h ON o.x = h.x AND o.y = h.y
LEFT JOIN park_box b ON h.park_id = b.park_id""",
        "layer_sjoin_cells": _with(_OCC, _GRID, _GRID_JOINED, _PARK_EDGES, _CELL_PARK) + """SELECT
"gbifID", species, j.id, b.park_id, b.park_name, b.minx, b.miny, b.maxx, b.maxy FROM joined j
LEFT JOIN fit f ON j.id = f.id LEFT JOIN park_box b ON f.park_id = b.park_id""",
        "layer_sjoin_nested": _with(_OCC, _GRID, _GRID_JOINED, _NBHD) + """SELECT "gbifID", j.id,
n.qr_id, n.qr_name, n.minx, n.maxx FROM joined j LEFT JOIN nbhd n
ON j.minx >= n.minx AND j.maxx <= n.maxx AND j.miny >= n.miny AND j.maxy <= n.maxy""",
        "plot_sjoin": _with(_OCC, _PLOT_EDGES, _PLOT_HITS) + """SELECT "gbifID", species,
h."OBJECTID" AS plot_id FROM occ o LEFT JOIN hit h ON o.x = h.x AND o.y = h.y""",
        "mixed_sjoin": _with(_OCC, _PLOT_EDGES, _PLOT_HITS) + """SELECT "gbifID", species,
h."OBJECTID" AS plot_id FROM occ o LEFT JOIN (SELECT * FROM hit UNION ALL
SELECT DISTINCT x, y, -1 FROM occ WHERE x < 0.7) h ON o.x = h.x AND o.y = h.y""",
        "plot_metrics": _with(
            _OCC, _PLOT_EDGES, _PLOT_HITS,
            'joined AS (SELECT o.*, h."OBJECTID" AS plot_id FROM occ o JOIN hit h '
            "ON o.x = h.x AND o.y = h.y)",
            _shannon("plot_id", "joined"),
        ) + f"""SELECT r.*, shannon_index FROM (SELECT plot_id, {_RICHNESS} FROM joined
GROUP BY plot_id) r LEFT JOIN sh USING (plot_id)""",
        "clip_points": _with(_OCC, _PARK_EDGES, _PARK_TOUCH) + """SELECT "gbifID", species, x, y
FROM occ o WHERE EXISTS (SELECT 1 FROM hit h WHERE o.x = h.x AND o.y = h.y)""",
        "clip_plots": _with(_PLOT_EDGES, _PARK_EDGES, _PLOT_MEETS_PARK)
        + 'SELECT b.* FROM plot_box b JOIN meets USING ("OBJECTID")',
        "clip_mixed": _with(_PLOT_EDGES, _PARK_EDGES, _PLOT_MEETS_PARK)
        + """SELECT b."OBJECTID" AS plot_id, minx, miny, maxx, maxy FROM plot_box b
JOIN meets USING ("OBJECTID") UNION ALL
SELECT -1, -180::DOUBLE, -90::DOUBLE, 0.7::DOUBLE, 90::DOUBLE
WHERE EXISTS (SELECT 1 FROM park_box WHERE minx <= 0.7::DOUBLE) UNION ALL
SELECT -2, 2::DOUBLE, -90::DOUBLE, 180::DOUBLE, 90::DOUBLE
WHERE EXISTS (SELECT 1 FROM park_box WHERE maxx >= 2)""",
        "mixed_boxes": _with(
            _PLOT_EDGES, _NBHD, """lot AS (SELECT "OBJECTID" AS plot_id, minx, miny, maxx, maxy
FROM plot_box UNION ALL SELECT -1, -180, -90, 0.7::DOUBLE, 90
UNION ALL SELECT -2, 0.25::DOUBLE, 0.125::DOUBLE, 0.375::DOUBLE, 0.875::DOUBLE)"""
        ) + """SELECT p.plot_id, n.qr_id, n.qr_name FROM lot p LEFT JOIN nbhd n
ON p.minx >= n.minx AND p.maxx <= n.maxx AND p.miny >= n.miny AND p.maxy <= n.maxy""",
        "clip_stacked": _with(_OCC) + """SELECT "gbifID", species FROM occ o
WHERE x <= 0.125 AND x >= -180 AND y BETWEEN -90 AND 90 OR y BETWEEN 0.25 AND 0.2578125 AND EXISTS (
  SELECT 1 FROM (SELECT DISTINCT p_partkey % 4 AS k FROM part)
  WHERE x BETWEEN 0.25 + k / 1024::DOUBLE AND 0.2578125 + k / 1024::DOUBLE)""",
        "plots_in_neighbourhoods": _with(_PLOT_EDGES, _NBHD) + """SELECT p."OBJECTID", n.qr_id,
n.qr_name FROM plot_box p LEFT JOIN nbhd n ON p.minx >= n.minx AND p.maxx <= n.maxx
AND p.miny >= n.miny AND p.maxy <= n.maxy""",
        "dissolve_plots": _with(_PLOT_EDGES) + """SELECT "Nom",
(SELECT "Type" FROM plot q WHERE q."Nom" = p."Nom" AND "Type" IS NOT NULL
  ORDER BY "OBJECTID" LIMIT 1) AS "Type",
CAST(sum(CASE shape WHEN 'pair' THEN 2 ELSE 1 END) AS BIGINT) AS parts,
min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy
FROM plot p JOIN plot_box USING ("OBJECTID") WHERE "Nom" IS NOT NULL GROUP BY "Nom" """,
        "reproject_mtm8": _with(
            _OCC, "src AS (SELECT * FROM occ WHERE x IS NOT NULL)",
            _mtm8_sql("267000 + x * 45000", "5029000 + y * 34000"),
        ) + """SELECT "gbifID", round(lon, 8) AS lon, round(lat, 8) AS lat FROM moved""",
        "reproject_plots": _with(
            _PLOT_EDGES, "src AS (SELECT * FROM plot_edge)",
            _mtm8_sql("267000 + px * 45000", "5029000 + py * 34000"),
        ) + """SELECT "OBJECTID", round(min(lon), 8) AS minx, round(min(lat), 8) AS miny,
round(max(lon), 8) AS maxx, round(max(lat), 8) AS maxy FROM moved GROUP BY "OBJECTID" """,
        "csv_to_parquet": occ
        + f'SELECT {_occ_cols()}, x AS "decimalLongitude", y AS "decimalLatitude" FROM occ',
        "csv_sniffed": occ
        + f'SELECT {_occ_cols()}, x AS "decimalLongitude", y AS "decimalLatitude" FROM occ',
        "csv_sniffed_headerless": occ + """SELECT "gbifID" AS column0, species AS column1,
CAST(day AS BIGINT) AS column2, CAST("eventDate" AS DATE) AS column3, "gbifID" / 8 AS column4,
year > 1995 AS column5 FROM occ""",
        "area_rows": occ + 'SELECT "gbifID", park_id, park_name FROM occ WHERE park_id IS NOT NULL',
        "geojson_roundtrip": _with(_PLOT_EDGES) + f"""SELECT "OBJECTID", "Nom", "Type", "TYPO1",
"TYPO2", {_PLOT_SUMS} FROM plot JOIN plot_edge USING ("OBJECTID")
WHERE "Nom" IS NOT NULL AND "Type" IS NOT NULL AND "TYPO1" IS NOT NULL AND "TYPO2" IS NOT NULL
GROUP BY ALL""",
        "choropleth_features": _with(_OCC, _PARK_EDGES) + """SELECT b.park_name,
species_richness, minx, miny, maxx, maxy FROM park_box b LEFT JOIN (SELECT park_name,
count(DISTINCT species) AS species_richness FROM occ WHERE park_name IS NOT NULL
GROUP BY park_name) m USING (park_name)""",
        "park_list": occ + "SELECT DISTINCT park_name FROM occ",
        "richness_bars": occ + """SELECT park_name, count(DISTINCT species) AS species_richness
FROM occ WHERE park_name IS NOT NULL GROUP BY park_name""",
        "top_species_by_kingdom": occ + """SELECT kingdom, species, observations,
CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kingdom
ORDER BY observations DESC, species) AS rank FROM (SELECT kingdom, species, count(*) AS observations
FROM occ WHERE species IS NOT NULL GROUP BY kingdom, species) c) q WHERE rank <= 10""",
        "top_species": occ + """SELECT species, count(*) AS observations FROM occ GROUP BY species
ORDER BY observations DESC, species NULLS LAST LIMIT 10""",
        "top_observers": occ + """SELECT "recordedBy", count(*) AS observations FROM occ
GROUP BY "recordedBy" ORDER BY observations DESC, "recordedBy" LIMIT 10""",
        "seasonal_trend": occ + f"""SELECT {_SEASON} AS season,
count(DISTINCT "gbifID") AS observations, count(DISTINCT species) AS species_richness
FROM occ GROUP BY 1""",
        "dataset_summary": occ + """SELECT 'parks' AS measure, count(DISTINCT park_name) AS value
FROM occ UNION ALL SELECT 'observations', count(DISTINCT "gbifID") FROM occ
UNION ALL SELECT 'rows', count(*) FROM occ""",
        "observations_by_kingdom": occ + """SELECT kingdom, count(DISTINCT "gbifID") AS observations
FROM occ GROUP BY kingdom""",
        "richness_hotspots": _with(_OCC, _GRID, _GRID_JOINED) + """SELECT id,
count(DISTINCT species) AS species_richness FROM joined WHERE id IS NOT NULL GROUP BY id
ORDER BY species_richness DESC, id LIMIT 20""",
        "height_map": _with(_OCC, _QUADS) + """SELECT level, quad, observations,
round(ln(1 + observations) / ln(1 + max(observations) OVER (PARTITION BY level)), 9) AS height
FROM (SELECT level, quad, count(*) AS observations FROM quads GROUP BY level, quad) q""",
        "height_map_species": _with(_OCC, _QUADS) + """SELECT level, count(*) AS cells,
CAST(sum(n) AS BIGINT) AS species, TRUE AS within FROM (SELECT level, quad, count(DISTINCT species) AS n
FROM quads GROUP BY level, quad) q GROUP BY level""",
        "closest_plots": _with(_PLOT_EDGES) + """SELECT "OBJECTID", round(d, 9) AS distance FROM (
SELECT "OBJECTID", CASE WHEN bool_or(inside) THEN CAST(0 AS DOUBLE) ELSE min(d) END AS d FROM (
SELECT "OBJECTID", part, """ + _CROSS + """ % 2 = 1 AS inside, min(sqrt(
pow(px + u * (qx - px) - x, 2) + pow(py + u * (qy - py) - y, 2))) AS d FROM (
SELECT *, greatest(0, least(1, ((x - px) * (qx - px) + (y - py) * (qy - py))
/ (pow(qx - px, 2) + pow(qy - py, 2)))) AS u FROM (SELECT *, CAST(0.3 AS DOUBLE) AS x,
CAST(0.05 AS DOUBLE) AS y FROM plot_edge) e) q GROUP BY "OBJECTID", part) w GROUP BY "OBJECTID") z
ORDER BY d, "OBJECTID" LIMIT 10""",
        "plots_within_radius": _with(_PLOT_EDGES) + """SELECT "OBJECTID", round(d, 3) AS distance
FROM (SELECT "OBJECTID", 2 * 6371008.8 * asin(sqrt(pow(sin(radians((miny + maxy) / 2 - 0.05) / 2), 2)
+ cos(radians(0.05)) * cos(radians((miny + maxy) / 2))
* pow(sin(radians((minx + maxx) / 2 - 0.5) / 2), 2))) AS d FROM plot_box) q WHERE d <= 5000""",
        "park_kingdom_matrix": occ + """SELECT park_name, """ + ", ".join(
            f"count(DISTINCT species) FILTER (WHERE kingdom = '{k}') AS {k.lower()}"
            for k in D.KINGDOMS
        ) + ", 0::BIGINT AS other FROM occ WHERE park_name IS NOT NULL AND species IS NOT NULL GROUP BY park_name",
        "park_comparison": occ + """SELECT count(*) FILTER (WHERE a AND b) AS shared,
count(*) FILTER (WHERE a AND NOT b) AS first_only, count(*) FILTER (WHERE b AND NOT a) AS second_only
FROM (SELECT species, bool_or(park_name = 'NATION_1') AS a, bool_or(park_name = 'NATION_2') AS b
FROM occ WHERE species IS NOT NULL AND park_name IN ('NATION_1', 'NATION_2') GROUP BY species) q""",
        "species_search": occ + """SELECT "gbifID", species, park_name FROM occ
WHERE lower(species) LIKE '%bolt%'""",
        **dict.fromkeys(("shapefile_roundtrip", "wkb_roundtrip"), _with(_PLOT_EDGES) + f"""SELECT "OBJECTID",
"Nom", "Type", "TYPO1", "TYPO2", {_PLOT_SUMS} FROM plot JOIN plot_edge USING ("OBJECTID") GROUP BY ALL"""),
        **_overlay(),
        **_distances(),
        **dict.fromkeys(("park_comparisons", "park_comparisons_shuffled"), occ + """SELECT first, second, shared,
a.n - shared AS first_only, b.n - shared AS second_only FROM (SELECT x.park_name AS first, y.park_name AS second,
count(DISTINCT x.species) AS shared FROM (SELECT DISTINCT park_name, species FROM occ) x JOIN (SELECT DISTINCT
park_name, species FROM occ) y ON x.species = y.species AND x.park_name < y.park_name GROUP BY 1, 2) p
JOIN (SELECT park_name, count(DISTINCT species) AS n FROM occ GROUP BY 1) a ON a.park_name = first
JOIN (SELECT park_name, count(DISTINCT species) AS n FROM occ GROUP BY 1) b ON b.park_name = second"""),
        "reproject_planes": occ + _planes(),
    }


def _planes() -> str:
    """Snyder's conformal conic from its definition, parallels 46 and 60 degrees; spherical Mercator."""
    e = "0.0818191910428158"
    m = lambda lat: f"(cos(radians({lat})) / sqrt(1 - {e} * {e} * pow(sin(radians({lat})), 2)))"
    t = lambda lat: (
        f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {e} * sin(radians({lat}))) / (1 + {e} * sin(radians({lat}))), {e} / 2))"
    )
    return f"""SELECT "gbifID", round(r * sin(a), 3) + 0.0 AS x, round(r0 - r * cos(a), 3) + 0.0 AS y,
round(6378137 * radians(lon), 3) + 0.0 AS mx, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) + 0.0 AS my,
CAST(0 AS DOUBLE) AS lon_off, CAST(0 AS DOUBLE) AS lat_off FROM (SELECT *, 6378137 * f * pow({t("lat")}, n) AS r,
6378137 * f * pow({t("44")}, n) AS r0, n * radians(lon + 68.5) AS a FROM (
SELECT *, {m("60")} / (n * pow({t("60")}, n)) AS f FROM (SELECT "gbifID", x * 20 - 80 AS lon,
y * 15 + 45 AS lat, (ln({m("60")}) - ln({m("46")})) / (ln({t("60")}) - ln({t("46")})) AS n
FROM occ WHERE x IS NOT NULL) o) q) z"""


def _distances() -> dict[str, str]:
    def across(table: str, key: str, factor: int) -> str:
        return f"""SELECT id, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS x, y FROM (SELECT {key} AS id,
179 + (({key} * {factor}) % 10007) / CAST(10007 AS DOUBLE) * 2 AS lon,
59 + (({key} * 7907) % 10009) / CAST(10009 AS DOUBLE) * 2 AS y FROM {table}) {table}_place"""

    near = f"""SELECT * FROM (SELECT a.id AS ship_id, b.id AS port_id, round(2 * 6371008.8 * asin(sqrt(
pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))), 3) AS distance
FROM ({across("customer", "c_custkey", 7919)}) a, ({across("supplier", "s_suppkey", 3571)}) b) q WHERE distance <= 4000"""
    return {
        "ships_near_ports": near, "ships_near_ports_shuffled": near,
        "nearest_plots": _with(_PLOT_EDGES) + """SELECT station_id, CAST(n AS INT) AS rank, plot_id, round(d, 9) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY d, plot_id) AS n FROM (
SELECT station_id, "OBJECTID" AS plot_id, CASE WHEN bool_or(inside) THEN CAST(0 AS DOUBLE) ELSE min(d) END AS d FROM (
SELECT station_id, "OBJECTID", part, """ + _CROSS + """ % 2 = 1 AS inside, min(sqrt(
pow(px + u * (qx - px) - x, 2) + pow(py + u * (qy - py) - y, 2))) AS d FROM (
SELECT *, greatest(0, least(1, ((x - px) * (qx - px) + (y - py) * (qy - py))
/ (pow(qx - px, 2) + pow(qy - py, 2)))) AS u FROM plot_edge, (SELECT s_suppkey AS station_id,
((s_suppkey * 7919) % 10007) / CAST(10007 AS DOUBLE) * 1.4 - 0.2 AS x,
((s_suppkey * 104729) % 10009) / CAST(10009 AS DOUBLE) * 0.3 - 0.1 AS y FROM supplier WHERE s_suppkey % 10 <> 4) s) q
GROUP BY station_id, "OBJECTID", part) w GROUP BY station_id, "OBJECTID") z) r WHERE n <= 3""",
    }


def _overlay() -> dict[str, str]:
    """Outlines on a lattice, as sets of unit squares. A lattice point with one or three squares around
    it is a corner, one with two that face each other is two."""
    squares = """lot AS (SELECT c_custkey AS k, (c_custkey % 128) * 8 AS x0, (c_custkey // 128) * 8 AS y0,
CASE WHEN c_custkey % 5 = 0 THEN 11 ELSE 8 END AS w,
CASE WHEN c_custkey % 7 = 3 THEN 8 ELSE 5 + c_custkey % 3 END AS h,
CASE WHEN c_custkey % 50 <> 7 THEN concat('Green ', c_custkey // 4) END AS "Nom" FROM customer),
lot_square AS (SELECT k, "Nom", x0 + i AS ux, y0 + j AS uy FROM lot, range(11) a(i), range(8) b(j)
WHERE i < w AND j < h AND NOT (k % 7 = 3 AND i BETWEEN 2 AND 4 AND j BETWEEN 2 AND 4)),
zone AS (SELECT n_nationkey AS z, n_name AS zone_name, (n_nationkey % 5) * 205 + 3 AS x0,
(n_nationkey // 5) * 19 + 2 AS y0, 160 + (n_nationkey % 3) * 40 AS w, 12 + (n_nationkey % 4) * 5 AS h FROM nation),
zone_square AS (SELECT z, zone_name, x0 + i AS ux, y0 + j AS uy FROM zone, range(240) a(i), range(27) b(j)
WHERE i < w AND j < h AND NOT (z % 6 = 1 AND i BETWEEN 20 AND 99 AND j BETWEEN 3 AND 7))"""
    facts = """corner AS (SELECT g, vx, vy, sum(bit) AS m FROM (
SELECT g, ux AS vx, uy AS vy, 1 AS bit FROM sq UNION ALL SELECT g, ux + 1, uy, 2 FROM sq
UNION ALL SELECT g, ux, uy + 1, 4 FROM sq UNION ALL SELECT g, ux + 1, uy + 1, 8 FROM sq) c GROUP BY ALL),
kinds AS (SELECT g, count(*) FILTER (m IN (1, 2, 4, 8)) + 2 * count(*) FILTER (m IN (6, 9)) AS outer_n,
count(*) FILTER (m IN (7, 11, 13, 14)) AS inner_n FROM corner GROUP BY g),
sizes AS (SELECT g, count(*) AS area_units FROM sq GROUP BY g),
facts AS (SELECT g, CAST(area_units AS BIGINT) AS area_units, CAST(outer_n + inner_n AS BIGINT) AS vertices,
CAST((outer_n - inner_n) // 4 AS BIGINT) AS euler FROM sizes JOIN kinds USING (g))"""
    return {
        "dissolve_lots": f"""WITH {squares}, sq AS (SELECT DISTINCT "Nom" AS g, ux, uy FROM lot_square
WHERE "Nom" IS NOT NULL), {facts} SELECT g AS "Nom", area_units, vertices, euler FROM facts""",
        "union_lots": f"""WITH {squares}, sq AS (SELECT 0 AS g, ux, uy FROM lot_square UNION
SELECT 0, ux, uy FROM zone_square), {facts} SELECT area_units, vertices, euler FROM facts""",
        "clip_lots_cut": f"""WITH {squares}, zoned AS (SELECT DISTINCT ux, uy FROM zone_square),
sq AS (SELECT k AS g, ux, uy FROM lot_square JOIN zoned USING (ux, uy)), {facts}
SELECT k AS lot_id, "Nom", area_units, vertices, euler FROM facts JOIN lot ON k = g""",
        "lots_in_zones": f"""WITH {squares}, held AS (SELECT k, z, zone_name, count(*) AS n FROM lot_square
JOIN zone_square USING (ux, uy) GROUP BY ALL), whole AS (SELECT k, count(*) AS n FROM lot_square GROUP BY k)
SELECT whole.k AS lot_id, z AS zone_id, zone_name FROM whole LEFT JOIN held ON held.k = whole.k AND held.n = whole.n""",
    }
