"""Shapefiles as a Spark source and sink.

``.shp`` holds shapes, ``.shx`` where each begins, ``.dbf`` attributes in rows of fixed width and
``.prj`` the coordinate system. A file is read by many tasks: the index gives every task a range of
records, whose bytes lie together in each of the files, and a task holds ``BATCH`` records at a time.
Nothing but heads and the ends of ranges is read on the driver. Files are opened through Arrow's file
systems, so a path may be a URI. Several shapefiles in a folder are one layer, if they agree.

Polygons become parts, shell first: outer rings run clockwise in the format, holes the other way, and a
hole belongs to the outer ring of its record that holds it. Points become points. Heights and measures
are left out. Null shapes and blank attributes are null; deleted rows are left out.

The sink writes one shapefile per task, under names that become final when the job commits.
"""

from __future__ import annotations

import re
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from areametrics.functions.crs import TransverseMercator, projection
from areametrics.schemas import GEOM, POINT, POLYGON
from areametrics.session import importable

FORMAT = "areametrics_shapefile"
#: Records of a batch, and bytes of shapes that a task is given unless the option says otherwise.
BATCH, SPLIT_BYTES = 2048, 32 << 20

# Numbers of shape kinds; those with heights or measures begin alike.
_NULL, _POINTS, _POLYGONS = 0, (1, 11, 21), (5, 15, 25)
_MAGIC, _VERSION = 9994, 1000


@dataclass(frozen=True)
class Field:
    """An attribute of a ``.dbf``: its place in a row and its type."""

    name: str
    kind: str
    start: int
    width: int
    decimals: int

    @property
    def type(self) -> T.DataType:
        if self.kind in "NF":
            whole = self.kind == "N" and not self.decimals and self.width <= 18
            return T.LongType() if whole else T.DoubleType()
        return {"D": T.DateType(), "L": T.BooleanType()}.get(self.kind, T.StringType())


@dataclass(frozen=True)
class Layer:
    """Heads of one shapefile."""

    base: str
    points: bool
    fields: tuple[Field, ...]
    head: int
    width: int
    records: int
    encoding: str


def file_system(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system, inner


def _read(path: str, start: int = 0, size: int | None = None) -> bytes:
    system, inner = file_system(path)
    with system.open_input_file(inner) as f:
        return f.read_at(f.size() - start if size is None else size, start)


def _exists(path: str) -> bool:
    system, inner = file_system(path)
    return system.get_file_info(inner).type == fs.FileType.File


def layers(path: str) -> list[str]:
    """Paths, without their ending, of the shapefiles at ``path``: a file or a folder."""
    system, inner = file_system(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if system.get_file_info(inner).type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        names = [f.path for f in found if f.extension.lower() == "shp" and not f.base_name.startswith(("_", "."))]
    else:
        names = [inner]
    if not names:
        raise FileNotFoundError(f"no shapefile at {path}")
    return sorted(prefix + n[:-4] for n in names)


def heads(base: str) -> Layer:
    raw = _read(f"{base}.shp", 0, 100)
    if len(raw) < 100 or struct.unpack(">i", raw[:4])[0] != _MAGIC:
        raise ValueError(f"{base}.shp is not a shapefile")
    (kind,) = struct.unpack("<i", raw[32:36])
    if kind not in (*_POINTS, *_POLYGONS):
        raise ValueError(f"{base}.shp holds shapes of kind {kind}; points and polygons are read")
    start = _read(f"{base}.dbf", 0, 32)
    records, head, width = struct.unpack("<IHH", start[4:12])
    fields, at = [], 1
    rows = _read(f"{base}.dbf", 32, head - 32)
    for i in range(0, len(rows) - 31, 32):
        if rows[i] == 0x0D:
            break
        name = rows[i : i + 11].split(b"\0")[0].decode("latin-1")
        fields.append(Field(name, chr(rows[i + 11]), at, rows[i + 16], rows[i + 17]))
        at += rows[i + 16]
    index = _read(f"{base}.shx", 24, 4)
    if (struct.unpack(">i", index)[0] * 2 - 100) // 8 != records:
        raise ValueError(f"{base}: .shx and .dbf disagree about the number of records")
    encoding = _read(f"{base}.cpg").decode("ascii").strip() if _exists(f"{base}.cpg") else "utf-8"
    return Layer(base, kind in _POINTS, tuple(fields), head, width, records, encoding or "utf-8")


def schema_of(layer: Layer) -> T.StructType:
    fields = [T.StructField(f.name, f.type) for f in layer.fields]
    return T.StructType([*fields, T.StructField(GEOM, POINT if layer.points else POLYGON)])


# --- records ----------------------------------------------------------------------------------

def _turn(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]))


def _holds(ring: np.ndarray, point: np.ndarray) -> bool:
    (ax, ay), (bx, by) = ring[:-1].T, ring[1:].T
    crossed = (ay > point[1]) != (by > point[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool(np.sum(crossed & (point[0] < ax + (point[1] - ay) * (bx - ax) / (by - ay))) % 2)


def _polygon(raw: bytes) -> list[list[np.ndarray]]:
    """Parts of a polygon record: each a shell and its holes."""
    rings_n, points_n = struct.unpack_from("<ii", raw, 36)
    starts = np.frombuffer(raw, "<i4", rings_n, 44)
    points = np.frombuffer(raw, "<f8", 2 * points_n, 44 + 4 * rings_n).reshape(-1, 2)
    rings = [r for r in np.split(points, starts[1:]) if len(r) > 3]
    outer = [r for r in rings if _turn(r) < 0]
    if not outer:  # drawn the wrong way round
        outer, rings = [r[::-1] for r in rings[:1]], rings[1:]
    parts = [[r[::-1]] for r in outer]
    for hole in (r for r in rings if _turn(r) > 0):
        inside = [p for p in parts if _holds(p[0], (hole[0] + hole[1]) / 2)] if len(parts) > 1 else parts
        if not inside:
            raise ValueError("a hole lies in no outer ring of its record")
        min(inside, key=lambda p: abs(_turn(p[0]))).append(hole[::-1])
    return parts


def _attribute(field: Field, rows: list[bytes], encoding: str) -> list:
    raw = [r[field.start : field.start + field.width] for r in rows]
    if field.kind in "NF":
        parse = int if isinstance(field.type, T.LongType) else float
        return [parse(v) if (v := t.strip(b" \0*")) else None for t in raw]
    if field.kind == "D":
        texts = [t.strip(b" \0").decode("ascii") for t in raw]
        return [np.datetime64(f"{t[:4]}-{t[4:6]}-{t[6:]}").item() if t.strip("0") else None for t in texts]
    if field.kind == "L":
        return [True if t[:1] in b"TtYy" and t[:1].strip() else False if t[:1] in b"FfNn" and t[:1].strip() else None for t in raw]
    return [t.decode(encoding) or None for t in (x.rstrip(b" \0") for x in raw)]


def records(layer: Layer, first: int, last: int):
    """Batches of the records ``first`` to ``last`` (not included)."""
    target = schema_of(layer)
    kinds = [pa.date32() if f.kind == "D" else {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}.get(
        f.type.typeName(), pa.string()) for f in layer.fields]
    xy = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    for i in range(first, last, BATCH):
        j = min(i + BATCH, last)
        index = np.frombuffer(_read(f"{layer.base}.shx", 100 + 8 * i, 8 * (j - i)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        low, high = int(index[:, 0].min()), int((index[:, 0] + 8 + index[:, 1]).max())
        shapes = _read(f"{layer.base}.shp", low, high - low)
        table = _read(f"{layer.base}.dbf", layer.head + i * layer.width, (j - i) * layer.width)
        rows = [table[k * layer.width : (k + 1) * layer.width] for k in range(j - i)]
        alive = [k for k, r in enumerate(rows) if r[:1] != b"*"]
        made = []
        for k in alive:
            at = int(index[k, 0]) - low + 8
            raw = shapes[at : at + int(index[k, 1])]
            (kind,) = struct.unpack_from("<i", raw)
            if kind == _NULL:
                made.append(None)
            elif layer.points:
                x, y = struct.unpack_from("<2d", raw, 4)
                made.append({"x": x, "y": y})
            else:
                made.append([[[{"x": x, "y": y} for x, y in r.tolist()] for r in p] for p in _polygon(raw)])
        geometry = pa.array(made, xy if layer.points else pa.list_(pa.list_(pa.list_(xy))))
        columns = [
            pa.array(_attribute(f, [rows[k] for k in alive], layer.encoding), t) for f, t in zip(layer.fields, kinds)
        ]
        yield pa.RecordBatch.from_arrays([*columns, geometry], names=target.names)


@dataclass
class Range(InputPartition):
    layer: Layer
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self):
        out = []
        for base in layers(self.path):
            layer = heads(base)
            system, inner = file_system(f"{base}.shp")
            tasks = max(1, -(-system.get_file_info(inner).size // self.split))
            step = max(1, -(-layer.records // tasks))
            out += [Range(layer, i, min(i + step, layer.records)) for i in range(0, layer.records, step)]
        return out

    def read(self, partition):
        return records(partition.layer, partition.first, partition.last)


# --- sink -------------------------------------------------------------------------------------

def _dbf_field(name: str, kind: pa.DataType, column: list) -> tuple[bytes, list[bytes]]:
    """Head of an attribute and its values as bytes of one width."""
    if pa.types.is_boolean(kind):
        letter, decimals, texts = b"L", 0, [b"?" if v is None else b"T" if v else b"F" for v in column]
    elif pa.types.is_integer(kind):
        letter, decimals, texts = b"N", 0, [b"" if v is None else str(v).encode() for v in column]
    elif pa.types.is_floating(kind):
        letter, decimals, texts = b"F", 15, [b"" if v is None else repr(v).encode() for v in column]
    elif pa.types.is_date(kind):
        letter, decimals, texts = b"D", 0, [b"" if v is None else v.strftime("%Y%m%d").encode() for v in column]
    else:
        letter, decimals, texts = b"C", 0, [b"" if v is None else str(v).encode() for v in column]
    fixed = {b"L": 1, b"N": 18, b"F": 24, b"D": 8}
    width = fixed.get(letter, max([1, *map(len, texts)]))
    if max([0, *map(len, texts)]) > min(width, 254):
        raise ValueError(f"a value of {name} is too long for a .dbf")
    short = name.encode()
    if len(short) > 10:
        raise ValueError(f"attribute name {name} is longer than ten bytes")
    pad = bytes.ljust if letter == b"C" else bytes.rjust
    head = short.ljust(11, b"\0") + letter + bytes(4) + bytes([width, decimals]) + bytes(14)
    return head, [pad(t, width) for t in texts]


def _shape(geometry, points: bool) -> tuple[bytes, np.ndarray]:
    """A record's body and its vertices."""
    if geometry is None:
        return struct.pack("<i", _NULL), np.zeros((0, 2))
    if points:
        xy = np.array([[geometry["x"], geometry["y"]]])
        return struct.pack("<i2d", _POINTS[0], *xy[0]), xy
    rings = []
    for part in geometry:
        for n, ring in enumerate(part):
            r = np.array([[v["x"], v["y"]] for v in ring])
            rings.append(r if (_turn(r) < 0) == (n == 0) else r[::-1])
    if not rings:
        return struct.pack("<i", _NULL), np.zeros((0, 2))
    xy = np.concatenate(rings)
    starts = np.cumsum([0, *map(len, rings[:-1])]).astype("<i4")
    box = [*xy.min(axis=0), *xy.max(axis=0)]
    return struct.pack("<i4dii", _POLYGONS[0], *box, len(rings), len(xy)) + starts.tobytes() + xy.astype("<f8").tobytes(), xy


@dataclass
class Written(WriterCommitMessage):
    base: str | None


class Writer(DataSourceArrowWriter):
    """One shapefile per task: rows are held until the width of every text is known."""

    def __init__(self, path: str, schema: T.StructType, prj: str | None):
        self.path, self.prj = path.rstrip("/"), prj
        self.points = schema[GEOM].dataType == POINT

    def write(self, iterator):
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written(None)
        table = pa.Table.from_batches(batches)
        name = f"{self.path}/_{uuid.uuid4().hex}"
        bodies, low, high = [], np.full(2, np.inf), np.full(2, -np.inf)
        for geometry in table.column(GEOM).to_pylist():
            body, xy = _shape(geometry, self.points)
            bodies.append(body)
            if len(xy):
                low, high = np.minimum(low, xy.min(axis=0)), np.maximum(high, xy.max(axis=0))
        box = [*low, *high] if np.isfinite(low).all() else [0.0] * 4
        sizes = np.array([len(b) for b in bodies]) // 2
        starts = 50 + np.cumsum(sizes + 4) - (sizes + 4)

        def head(words: int) -> bytes:
            kind = _POINTS[0] if self.points else _POLYGONS[0]
            return struct.pack(">i20xi", _MAGIC, words) + struct.pack("<ii4d32x", _VERSION, kind, *box)

        shp = b"".join(struct.pack(">ii", i + 1, n) + b for i, (n, b) in enumerate(zip(sizes.tolist(), bodies)))
        shx = np.stack([starts, sizes], axis=1).astype(">i4").tobytes()
        made = [
            _dbf_field(f.name, f.type, table.column(f.name).to_pylist()) for f in table.schema if f.name != GEOM
        ] or [_dbf_field("row", pa.int64(), list(range(len(bodies))))]
        width = 1 + sum(len(texts[0]) for _, texts in made)
        dbf = struct.pack("<B3BIHH20x", 3, 100, 1, 1, len(bodies), 33 + 32 * len(made), width)
        dbf += b"".join(h for h, _ in made) + b"\r" + b"".join(b" " + b"".join(r) for r in zip(*(t for _, t in made))) + b"\x1a"
        files = {"shp": head(50 + len(shp) // 2) + shp, "shx": head(50 + len(shx) // 2) + shx, "dbf": dbf, "cpg": b"utf-8"}
        if self.prj:
            files["prj"] = self.prj.encode()
        system, inner = file_system(name)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        for ending, raw in files.items():
            with system.open_output_stream(f"{inner}.{ending}") as f:
                f.write(raw)
        return Written(name)

    def _each(self, messages, action):
        for m in messages:
            if m is not None and m.base:
                for ending in ("shx", "dbf", "cpg", "prj", "shp"):
                    if _exists(f"{m.base}.{ending}"):
                        action(m.base, ending)

    def commit(self, messages):
        def rename(base, ending):
            system, inner = file_system(base)
            folder, name = inner.rsplit("/", 1)
            system.move(f"{inner}.{ending}", f"{folder}/part-{name[1:]}.{ending}")

        self._each(messages, rename)

    def abort(self, messages):
        def remove(base, ending):
            system, inner = file_system(base)
            system.delete_file(f"{inner}.{ending}")

        self._each(messages, remove)


class Shapefile(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        found = [heads(b) for b in layers(self.options["path"])]
        kinds = {schema_of(h).simpleString() for h in found}
        if len(kinds) > 1:
            raise ValueError(f"shapefiles at {self.options['path']} differ: {sorted(kinds)}")
        return schema_of(found[0])

    def reader(self, schema):
        return Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], schema, self.options.get("prj"))


def read_shapefile(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Attributes and ``geom`` of the shapefiles at ``path``."""
    importable(spark)
    spark.dataSource.register(Shapefile)
    return spark.read.format(FORMAT).option("splitBytes", str(split_bytes)).load(path)


def write_shapefile(df: DataFrame, path: str, srid: int | None = None) -> None:
    """``df`` (attributes and ``geom``) as shapefiles in a folder, one per partition."""
    importable(df.sparkSession)
    df.sparkSession.dataSource.register(Shapefile)
    writer = df.write.format(FORMAT).mode("append")
    if srid:
        writer = writer.option("prj", prj_text(srid))
    writer.save(path)


def prj_text(srid: int) -> str:
    """What a ``.prj`` says of a coordinate system."""
    plane = projection(srid)
    if plane and not isinstance(plane, TransverseMercator):
        raise ValueError(f"no .prj text for coordinate system {srid}")
    axis, flat = (plane.axis, plane.inverse_flattening) if plane else (6378137.0, 298.257223563)
    # Names of the two datums.
    datum = ("D_WGS_1984", "WGS_1984") if flat == 298.257223563 else ("D_North_American_1983", "GRS_1980")
    degrees = (
        f'GEOGCS["GCS",DATUM["{datum[0]}",SPHEROID["{datum[1]}",{axis!r},{flat!r}]],PRIMEM["Greenwich",0.0],'
        'UNIT["Degree",0.0174532925199433]]'
    )
    if plane is None:
        return degrees
    values = {
        "False_Easting": plane.easting, "False_Northing": 0.0, "Central_Meridian": plane.meridian,
        "Scale_Factor": plane.scale, "Latitude_Of_Origin": 0.0,
    }
    listed = ",".join(f'PARAMETER["{k}",{v!r}]' for k, v in values.items())
    return f'PROJCS["EPSG_{srid}",{degrees},PROJECTION["Transverse_Mercator"],{listed},UNIT["Meter",1.0]]'


def srid_of(path: str) -> int | None:
    """The code of the ``.prj`` beside a shapefile: longitude and latitude, or a transverse Mercator of
    the MTM or UTM series by its central meridian. None without a ``.prj``; others raise."""
    codes = set()
    for base in layers(path):
        if not _exists(f"{base}.prj"):
            return None
        text = _read(f"{base}.prj").decode("utf-8", "replace")
        if text.startswith("GEOGCS"):
            codes.add(4326)
            continue
        values = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\["(\w+)",\s*(-?[\d.]+)', text)}
        middle, east = values.get("central_meridian"), values.get("false_easting")
        if "Transverse_Mercator" in text and middle is not None:
            if east == 304800.0 and abs(values.get("scale_factor", 0) - 0.9999) < 1e-9:
                codes.add(32180 + round((-middle - 49.5) / 3))
                continue
            if east == 500000.0 and abs(values.get("scale_factor", 0) - 0.9996) < 1e-9:
                codes.add(32600 + round((middle + 183) / 6))
                continue
        raise ValueError(f"{base}.prj names a coordinate system that is not known: {text[:80]}")
    if len(codes) > 1:
        raise ValueError(f"shapefiles at {path} differ in their coordinate systems: {sorted(codes)}")
    return codes.pop()
