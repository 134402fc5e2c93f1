"""Readers, writers and the staged build, in new temporary folders."""

from __future__ import annotations

import json

import pytest
from helpers import layer, square

from areametrics.functions import geojson
from areametrics.plans import build as B
from areametrics.schemas import OCCURRENCE_COLUMNS
from areametrics.sources import readers, writers


def _csv(path, header, *rows, sep="\t"):
    path.write_text("\n".join(sep.join(map(str, r)) for r in [header, *rows]) + "\n", "utf-8")


def test_csv_types_follow_names_not_positions(spark, tmp_path):
    _csv(tmp_path / "a.csv", ["year", "extra", "gbifID", "species", "decimalLongitude"],
         [2020, "x", 5, 'Picea "glauca', -73.5], ["", "y", 6, "", ""])
    rows = {r.gbifID: r for r in readers.read_csv(spark, str(tmp_path)).collect()}
    assert rows[5].year == 2020 and rows[5].species == 'Picea "glauca'
    assert rows[5].decimalLongitude == -73.5 and rows[5].extra == "x"
    assert rows[6].year is None and rows[6].species is None


def test_csv_rejects_bad_values_and_differing_headers(spark, tmp_path):
    bad = tmp_path / "bad"
    bad.mkdir()
    _csv(bad / "a.csv", ["gbifID"], ["five"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.read_csv(spark, str(bad)).collect()
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    _csv(mixed / "a.csv", ["gbifID", "species"], [1, "a"])
    _csv(mixed / "b.csv", ["species", "gbifID"], ["b", 2])
    with pytest.raises(Exception):
        readers.read_csv(spark, str(mixed)).collect()


def test_csv_reads_every_file(spark, tmp_path):
    import gzip

    (tmp_path / "in").mkdir()
    lines = "gbifID\tspecies\n" + "".join(f"{{}}{i}\ts\n" for i in range(5))
    (tmp_path / "in" / "a.csv").write_text(lines.replace("{}", "1"))
    (tmp_path / "in" / "c.txt").write_text(lines.replace("{}", "2"))
    with gzip.open(tmp_path / "in" / "b.csv.gz", "wt") as f:
        f.write(lines.replace("{}", "3"))
    assert readers.read_csv(spark, str(tmp_path / "in")).count() == 15
    assert readers.read_csv(spark, str(tmp_path / "in"), pattern="*.txt").count() == 5


def test_csv_bad_values_raise_without_ansi(spark, tmp_path):
    _csv(tmp_path / "a.csv", ["gbifID"], ["five"])
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            readers.read_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_mapping(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"Nom": "park_name",\n "É": "e"}', "utf-8")
    assert readers.load_mapping(spark, str(tmp_path / "m.json")) == {"Nom": "park_name", "É": "e"}


def test_shared_folder(spark):
    from types import SimpleNamespace as Fake

    from areametrics.sources import shared

    assert shared.stored(spark.range(3), "x").count() == 3

    def session(master, **conf):
        context = Fake(master=master, applicationId=master)
        return Fake(sparkContext=context, conf=Fake(get=lambda k, d: conf.get("folder", d)))

    assert shared.new_path(session("yarn", folder="s3://b/c/"), "x").startswith("s3://b/c/x-")
    own = session("local[2]")
    assert shared.shared_folder(own) == shared.shared_folder(own)
    assert shared.new_path(own, "x") != shared.new_path(own, "x")
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="share"):
            shared.shared_folder(session(master))


def test_csv_to_parquet_limit(spark, tmp_path):
    _csv(tmp_path / "in.csv", ["gbifID", "species"], *[(i, f"s{i}") for i in range(10)])
    for limit, n in [(None, 10), ("None", 10), (3, 3)]:
        out = str(tmp_path / f"out{limit}")
        writers.csv_to_parquet(spark, str(tmp_path / "in.csv"), out, limit)
        assert readers.read_occurrences(spark, out).count() == n


def _collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": list(features)}, indent=1)


def _feature(props, kind, coordinates):
    shape = None if kind is None else {"type": kind, "coordinates": coordinates}
    return {"type": "Feature", "properties": props, "geometry": shape}


def test_feature_collection(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1.5], [0, 0]]
    (tmp_path / "a.geojson").write_text(_collection(
        _feature({"id": 1, "n": "one"}, "Polygon", [ring]),
        _feature({"id": 2, "n": None}, "MultiPolygon", [[ring], [ring, ring]]),
        _feature({"id": 3}, None, None),
    ))
    rows = {r.id: r for r in readers.read_geojson(spark, str(tmp_path), "id INT, n STRING").collect()}
    assert [(v.x, v.y) for v in rows[1].geom[0][0]] == [tuple(map(float, v)) for v in ring]
    assert [len(p) for p in rows[2].geom] == [1, 2]
    assert rows[3].geom is None and rows[3].n is None


def test_unsupported_geometry_raises(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(_collection(_feature({"id": 1}, "Point", [0, 1])))
    with pytest.raises(Exception, match="unsupported geometry"):
        readers.read_geojson(spark, str(tmp_path), "id INT").collect()


def test_features_drop_rows_with_nulls(spark, tmp_path):
    df = layer(spark, {"a": [[square(0, 0)]], "b": [[square(0, 0)], [square(3, 3)]]}).select("pid", "geom")
    df = df.selectExpr("pid", "CASE WHEN pid = 'a' THEN 1 END AS n", "geom")
    path = str(tmp_path / "out")
    writers.write_features(df, path)
    back = readers.read_features(spark, path, "pid STRING, n INT").collect()
    assert [(r.pid, len(r.geom)) for r in back] == [("a", 1)]
    every = writers.features(df, keep_null_rows=True).collect()
    assert len(every) == 2
    kinds = {json.loads(r.value)["properties"]["pid"]: json.loads(r.value) for r in every}
    assert kinds["b"]["properties"]["n"] is None
    assert kinds["b"]["geometry"]["type"] == "MultiPolygon"
    assert kinds["a"]["geometry"]["type"] == "Polygon"


def test_geometry_text_round_trip(spark):
    df = layer(spark, {"a": [[square(0, 0, 0.1)], [square(3, 3)]]})
    text = df.select("pid", "geom", geojson.polygon_to_text("geom").alias("t"))
    back = text.selectExpr("geom", "t", "get_json_object(t, '$.type') k", "get_json_object(t, '$.coordinates') c")
    row = back.select("geom", geojson.polygon_from_text("k", "c").alias("again")).first()
    assert row.geom == row.again


def test_table_and_view(spark):
    df = spark.range(3)
    writers.save_table(df, "t_saved")
    writers.save_table(spark.range(5), "t_saved")
    assert spark.table("t_saved").count() == 5
    writers.as_view(df, "v_rows")
    assert spark.sql("SELECT count(*) FROM v_rows").first()[0] == 3
    spark.sql("DROP TABLE t_saved")


@pytest.fixture
def project(tmp_path):
    header = [*OCCURRENCE_COLUMNS, "decimalLongitude", "decimalLatitude"]
    rows = []
    for i in range(200):
        values = dict.fromkeys(header, "")
        values |= {
            "gbifID": i, "kingdom": "Plantae", "class": "c", "family": "f", "genus": "g",
            "species": f"s{i % 5}", "year": 2020, "month": 5, "day": 1,
            "decimalLongitude": (i % 20) / 5 + 0.1, "decimalLatitude": (i // 20) / 5 + 0.1,
        }
        rows.append([values[h] for h in header])
    _csv(tmp_path / "occ.csv", header, *rows)
    cells = [
        _feature({"id": x * 4 + y}, "Polygon",
                 [[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]])
        for x in range(4) for y in range(4)
    ]
    (tmp_path / "grid.geojson").write_text(_collection(*cells))
    ell = [[0, 0], [3.5, 0], [3.5, 1], [1, 1], [1, 2], [0, 2], [0, 0]]
    (tmp_path / "parks.geojson").write_text(_collection(
        _feature({"OBJECTID": 9, "Nom": "ell", "junk": 1}, "Polygon", [ell])
    ))
    return B.Build(
        root=str(tmp_path / "out"),
        occurrences_csv=str(tmp_path / "occ.csv"),
        layers={
            "grid": B.Layer(str(tmp_path / "grid.geojson"), "id INT", {"id": "id"}, "id"),
            "parks": B.Layer(
                str(tmp_path / "parks.geojson"), "OBJECTID INT, Nom STRING, junk INT",
                {"OBJECTID": "park_id", "Nom": "park_name"}, "park_name", id_col="park_id",
            ),
        },
    )


def test_build_by_cell_then_point(spark, project):
    B.run(spark, project)
    joined = spark.read.parquet(project.path("joined", "parks_sjoin"))
    assert joined.count() == 200
    assert "park_name" in joined.columns and "junk" not in joined.columns
    # Whole cells only: the half cell at x = 3 is not in the park.
    assert sorted({r.id for r in joined.where("park_name = 'ell'").select("id").collect()}) == [0, 1, 4, 8]
    metrics = spark.read.parquet(project.path("processed", "parks_metrics.parquet")).first()
    assert metrics.species_richness == 5 and metrics.observation == 100
    lines = spark.read.text(project.path("processed", "parks_metrics.geojson")).collect()
    assert json.loads(lines[0].value)["properties"]["park_name"] == "ell"

    # The same run keeps every table; another option rebuilds what depends on it.
    before = B.listing(spark, project.path("*"))
    B.run(spark, project)
    assert B.listing(spark, project.path("*")) == before
    project.join_on = "point"
    B.run(spark, project, ["sjoin", "metrics"])
    after = B.listing(spark, project.path("*"))
    kept = {f for f in before if "/tables/" in f[0] or "grid" in f[0]}
    assert kept <= set(after) and set(after) != set(before)
    metrics = spark.read.parquet(project.path("processed", "parks_metrics.parquet")).first()
    assert metrics.observation == 110


def test_build_limit_and_stage_names(spark, project):
    project.limit = 7
    B.run(spark, project, ["gbif"])
    assert spark.read.parquet(project.path("tables", "gbif")).count() == 7
    assert not B.is_done(spark, project.path("tables", "grid"))
    # A cap does not outlive its run.
    project.limit = None
    B.run(spark, project, ["gbif"])
    assert spark.read.parquet(project.path("tables", "gbif")).count() == 200
    # Nor does an old input.
    with open(project.occurrences_csv) as f:
        lines = f.readlines()
    with open(project.occurrences_csv, "w") as f:
        f.writelines(lines[:-50])
    B.run(spark, project, ["gbif"])
    assert spark.read.parquet(project.path("tables", "gbif")).count() == 150
    with pytest.raises(ValueError):
        B.run(spark, project, ["nope"])
