"""The whole build as stages with Parquet between them.

Folder layout under one root (any file system Spark reads): ``tables/`` for occurrences and
layers, ``joined/`` for spatial joins, ``processed/`` for metrics.

Beside each table lies a *fingerprint*: a digest of the options that shaped it, of its input files
(path, size, time) and of the fingerprints of the tables it was made from. A table is kept only if
its fingerprint is what a new one would have, so other options, changed inputs and rebuilt tables
before it lead to a new one.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from areametrics.operators import layers as L
from areametrics.operators import metrics as M
from areametrics.operators import spatial as S
from areametrics.operators.projection import limit_rows, occurrence_table
from areametrics.sources import readers, writers

STAGES = ["gbif", "geo", "sjoin", "metrics"]


@dataclass
class Layer:
    """Where a layer comes from and how its columns are named.

    ``mapping`` is ``{source: target}``, without geometry, which is always kept.
    """

    path: str
    properties: str
    mapping: dict[str, str]
    key: str
    srid: int = 4326
    id_col: str | None = None
    per_line: bool = False


@dataclass
class Build:
    """Inputs and options of a run. ``layers`` must hold one named ``grid``."""

    root: str
    occurrences_csv: str
    layers: dict[str, Layer] = field(default_factory=dict)
    target_srid: int = 4326
    limit: int | str | None = None
    force: bool = False
    join_on: str = "cell"

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def is_done(spark: SparkSession, path: str) -> bool:
    """A table counts as made once its success marker is there; half-written ones do not."""
    marker, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(marker)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, size and time of all files under ``path``, which may be a glob."""
    pattern, fs = _path(spark, path)
    found, files = [], fs.globStatus(pattern) or []
    for status in files:
        under = fs.listFiles(status.getPath(), True)
        while under.hasNext():
            f = under.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def _digest(**what: object) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()


def _print_path(path: str) -> str:
    return f"{path}.fingerprint"


def fingerprint(spark: SparkSession, path: str) -> str | None:
    """What the table at ``path`` was made from; None if there is no finished one."""
    if not is_done(spark, path) or not is_done(spark, _print_path(path)):
        return None
    return spark.read.text(_print_path(path)).first()["value"]


def _once(spark: SparkSession, build: Build, path: str, want: str, make) -> DataFrame:
    """The table at ``path``, written by ``make()`` unless one of fingerprint ``want`` is there.

    The old fingerprint goes before the table is written, so a broken run leaves none.
    """
    if build.force or fingerprint(spark, path) != want:
        mark, fs = _path(spark, _print_path(path))
        fs.delete(mark, True)
        made = make()
        if made is not None:
            writers.write_table(made, path)
        spark.createDataFrame([(want,)], "value string").coalesce(1).write.text(_print_path(path))
    return spark.read.parquet(path)


def load_occurrences(spark: SparkSession, build: Build) -> DataFrame:
    """CSV to Parquet, then the pruned table with points."""
    raw = build.path("tables", "gbif_raw")
    want = _digest(step="gbif_raw", limit=build.limit, inputs=listing(spark, build.occurrences_csv))
    _once(
        spark, build, raw, want,
        lambda: limit_rows(readers.read_csv(spark, build.occurrences_csv), build.limit),
    )
    return _once(
        spark, build, build.path("tables", "gbif"), _digest(step="gbif", source=want),
        lambda: occurrence_table(spark.read.parquet(raw)),
    )


def load_layer(spark: SparkSession, build: Build, name: str) -> DataFrame:
    """Read, rename, reproject and box one layer."""
    spec = build.layers[name]
    read = readers.read_features if spec.per_line else readers.read_geojson

    def make() -> DataFrame:
        source = read(spark, spec.path, spec.properties)
        mapping = {**spec.mapping, "geom": "geom"}
        return readers.layer_table(L.clean_layer(source, mapping, spec.srid, build.target_srid))

    want = _digest(
        step="layer", spec=asdict(spec), target=build.target_srid, inputs=listing(spark, spec.path)
    )
    return _once(spark, build, build.path("tables", name), want, make)


def join_layers(spark: SparkSession, build: Build) -> dict[str, DataFrame]:
    """Occurrences to grid cells, then to every other layer.

    ``join_on="cell"`` assigns a row to an area only when its whole grid cell lies inside.
    ``"point"`` asks whether the occurrence itself does. Outlines stay in the layer tables; rows
    carry keys and the box.
    """
    def made(name: str) -> tuple[DataFrame, str | None]:
        path = build.path("tables", name)
        return spark.read.parquet(path), fingerprint(spark, path)

    gbif, points = made("gbif")
    grid, cells = made("grid")
    on_grid = _digest(step="join", points=points, layer=cells)
    gridded = _once(
        spark, build, build.path("joined", "grid_sjoin"), on_grid,
        lambda: S.points_in_polygons(gbif, grid, keep_geom=False),
    )
    out = {"grid": gridded}
    for name in [n for n in build.layers if n != "grid"]:
        layer, shapes = made(name)
        if build.join_on == "cell":
            want = _digest(step="cells", rows=on_grid, cells=cells, layer=shapes, key=build.layers["grid"].key)
            make = lambda layer=layer: S.cells_in_polygons(
                gridded, layer, grid, build.layers["grid"].key, keep_geom=False
            )
        else:
            want = _digest(step="join", points=points, layer=shapes)
            make = lambda layer=layer: S.points_in_polygons(gbif, layer, keep_geom=False)
        out[name] = _once(spark, build, build.path("joined", f"{name}_sjoin"), want, make)
    return out


def area_tables(spark: SparkSession, build: Build) -> None:
    """Metrics per layer as Parquet and GeoJSON, geometry added at area grain."""
    for name, spec in build.layers.items():
        joined, shapes = build.path("joined", f"{name}_sjoin"), build.path("tables", name)
        want = _digest(
            step="metrics", rows=fingerprint(spark, joined), layer=fingerprint(spark, shapes),
            key=spec.key, id_col=spec.id_col,
        )

        def make(name=name, spec=spec, joined=joined, shapes=shapes) -> None:
            rows = readers.read_area_occurrences(spark, joined, spec.key)
            table = M.area_metrics(rows, spec.key, spec.id_col)
            outline = M.any_per_key(spark.read.parquet(shapes), spec.key, "geom")
            writers.export_metric(
                table.join(outline, spec.key), f"{name}_metrics", build.path("processed"), "geom"
            )

        _once(spark, build, build.path("processed", f"{name}_metrics.parquet"), want, make)


def run(spark: SparkSession, build: Build, stages: list[str] | None = None) -> None:
    """Run the named stages in order (all by default). Finished tables of the same fingerprint are
    kept unless forced."""
    wanted = STAGES if stages in (None, ["full"]) else stages
    unknown = set(wanted) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}; choose from {STAGES} or full")
    for stage in [s for s in STAGES if s in wanted]:
        if stage == "gbif":
            load_occurrences(spark, build)
        elif stage == "geo":
            for name in build.layers:
                load_layer(spark, build, name)
        elif stage == "sjoin":
            join_layers(spark, build)
        else:
            area_tables(spark, build)
