"""Delimited text of unknown dialect: separator, quoting and header found by a look at each file.

A task per share of the files reads the first ``LOOK_BYTES`` of each (compressed ones too); the
driver gets the different dialects only, and files that disagree raise. What a look cannot show is
never guessed at silently: a row that has another number of fields further down raises when it is
read. Column types come from all rows, in one aggregate.

* *Separator*: of tab, semicolon, comma and bar the one that divides all lines into equally many
  fields, the most if several do. A file without any is one column and agrees with all separators.
* *Quoting*: on where fields that begin with ``"`` all end with one, quotes inside doubled or after a
  backslash; off where one is left open. A file without such fields agrees with both; if all
  are, tab means off and the others mean on.
* *Header*: the first line, if its fields are distinct, none empty, and one of them is an occurrence
  column, or stands over values of another type; or if there is nothing but text (a single line
  too). Columns without a header are ``column0``, ``column1``, ...
"""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from areametrics.schemas import CSV_TYPES
from areametrics.sources.readers import typed
from areametrics.sources.shapefile import file_system

LOOK_BYTES = 1 << 18
SEPARATORS = "\t;,|"
#: More different dialects than this are not looked at: two that differ are enough to raise.
_MOST_DIALECTS = 64
#: Rows that are tried for every type; all others only for the types that these leave.
FIRST_ROWS = 1000

#: Types from narrow to wide, each with the form of its values. Numbers with leading zeros are codes.
FORMS = {
    "boolean": r"(?i)^(true|false)$",
    "bigint": r"^[+-]?(0|[1-9][0-9]*)$",
    "double": r"^[+-]?((0|[1-9][0-9]*)([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp_ntz": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?$",
}


@dataclass(frozen=True)
class Dialect:
    """``sep`` and ``quoting`` (``doubled``, ``backslash``, ``off``) are ``None`` where a file does not
    show them."""

    sep: str | None
    quoting: str | None
    header: bool
    names: tuple[str, ...]
    width: int
    multiline: bool


def _parsed(text: str, whole: bool, sep: str, quoting: str) -> list[list[str]] | None:
    """Rows with a field, or ``None`` if the quotes do not fit."""
    how = {
        "doubled": {"quotechar": '"', "doublequote": True},
        "backslash": {"quotechar": '"', "doublequote": False, "escapechar": "\\"},
        "off": {"quoting": csv.QUOTE_NONE, "quotechar": None},
    }[quoting]
    rows = []
    try:
        for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep, strict=True, **how):
            if row:
                rows.append(row)
    except csv.Error as error:
        # The look may end inside a field that goes over lines.
        if whole or not rows or "end of data" not in str(error):
            return None
    return rows


def kind_of(values: list[str]) -> str:
    """The narrowest type of :data:`FORMS` that all values have the form of."""
    return next((k for k, form in FORMS.items() if all(re.match(form, v) for v in values)), "string")


def _has_header(rows: list[list[str]]) -> bool:
    first, rest = rows[0], rows[1:]
    if len(set(first)) < len(first) or not all(v.strip() for v in first):
        return False
    if any(v in CSV_TYPES for v in first):
        return True
    kinds = [kind_of([r[i] for r in rest if r[i]]) if any(r[i] for r in rest) else None for i in range(len(first))]
    typed_ = [(v, k) for v, k in zip(first, kinds) if k not in (None, "string")]
    if typed_:
        return any(not re.match(FORMS[k], v) for v, k in typed_)
    return all(kind_of([v]) == "string" for v in first)


def look(head: bytes, whole: bool) -> Dialect | None:
    """The dialect of a file that starts with ``head``; ``None`` for one without a line."""
    if not whole:
        end = head.rfind(b"\n")
        if end < 0:
            raise ValueError(f"no line ends within the first {len(head)} bytes")
        head = head[: end + 1]
    text = head.decode("utf-8-sig", "replace")
    found, ragged = [], False
    for sep in SEPARATORS:
        rows = quoting = None
        for quoting in ("doubled", "backslash", "off"):
            rows = _parsed(text, whole, sep, quoting)
            if rows is not None:
                break
        if not rows:
            continue
        widths = {len(r) for r in rows}
        ragged |= len(widths) > 1 and min(widths) > 1
        if len(widths) == 1:
            opened = re.search(f'(^|[\n\r{re.escape(sep)}])"', text)
            found.append((len(rows[0]), sep, quoting if opened or quoting == "off" else None, rows))
    if not found and not ragged:
        # Lines with a separator here and there: one column of text.
        rows = [[line] for line in text.splitlines() if line]
        found = [(1, None, None, rows)] if rows else []
    if not found:
        if not text.strip("\r\n"):
            return None
        raise ValueError("no separator divides all lines equally; give one")
    width, sep, quoting, rows = max(found, key=lambda f: f[0])
    if width == 1 and ragged:
        raise ValueError("no separator divides all lines equally; give one")
    header = _has_header(rows)
    return Dialect(
        None if width == 1 else sep, quoting, header, tuple(rows[0]) if header else (), width,
        any("\n" in v or "\r" in v for r in rows for v in r),
    )


def _looks(spark: SparkSession, path: str, look_bytes: int) -> DataFrame:
    """A row per file with lines: its dialect and path. Nothing but the start of a file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    tasks = spark.sparkContext.defaultParallelism
    names = files.where("length > 0").select("path").repartition(tasks)

    def run(batches):
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                system, inner = file_system(name)
                with system.open_input_stream(inner, compression="detect") as f:
                    head = b""
                    while len(head) <= look_bytes and (more := f.read(look_bytes + 1 - len(head))):
                        head += more
                try:
                    seen = look(head[:look_bytes], len(head) <= look_bytes)
                except ValueError as error:
                    raise ValueError(f"{name}: {error}") from None
                if seen is not None:
                    rows.append({**vars(seen), "names": list(seen.names), "path": name})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([
        ("sep", pa.string()), ("quoting", pa.string()), ("header", pa.bool_()), ("names", pa.list_(pa.string())),
        ("width", pa.int32()), ("multiline", pa.bool_()), ("path", pa.string()),
    ])
    return names.mapInArrow(
        run, "sep string, quoting string, header boolean, names array<string>, width int, multiline boolean, path string"
    )


def sniff(spark: SparkSession, path: str, look_bytes: int = LOOK_BYTES) -> Dialect:
    """The dialect that all files under ``path`` (a file, folder or glob) agree on; else raises and
    names two that differ."""
    kinds = ["sep", "quoting", "header", "names", "width", "multiline"]
    seen = _looks(spark, path, look_bytes).groupBy(*kinds).agg(F.min("path").alias("path")).orderBy("path")
    rows = seen.limit(_MOST_DIALECTS).collect()
    if not rows:
        raise ValueError(f"{path}: no file has a line")
    agreed: dict[str, object] = {}
    for field in kinds[:-1]:
        shown = [(r[field], r["path"]) for r in rows if r[field] is not None]
        for value, where in shown[1:]:
            if value != shown[0][0]:
                raise ValueError(f"files disagree: {field} is {shown[0][0]!r} in {shown[0][1]}, {value!r} in {where}")
        agreed[field] = shown[0][0] if shown else None
    agreed["names"] = tuple(agreed["names"])
    return Dialect(**agreed, multiline=any(r["multiline"] for r in rows))


def _types(raw: DataFrame, columns: list[str]) -> dict[str, str]:
    """The narrowest type of every column by all its rows; one without a value is text."""
    if not columns:
        return {}

    def counted(rows: DataFrame, kinds: list[list[str]]) -> Row:
        tests = []
        for i, c in enumerate(columns):
            value = F.col(f"`{c}`")
            tests.append(F.count(value).alias(f"n{i}"))
            for kind in kinds[i]:
                fits = value.rlike(FORMS[kind]) & value.try_cast(kind).isNotNull()
                tests.append(F.count_if(fits).alias(f"{kind}{i}"))
        return rows.agg(*tests).first()

    # A type that some of the first rows rule out need not be tried on the others.
    first = counted(raw.limit(FIRST_ROWS), [[*FORMS]] * len(columns))
    left = [[k for k in FORMS if first[f"{k}{i}"] == first[f"n{i}"]] for i in range(len(columns))]
    counts = counted(raw, left)
    return {
        c: next((k for k in left[i] if counts[f"n{i}"] and counts[f"{k}{i}"] == counts[f"n{i}"]), "string")
        for i, c in enumerate(columns)
    }


def read_delimited(
    spark: SparkSession, path: str, look_bytes: int = LOOK_BYTES, dialect: Dialect | None = None
) -> DataFrame:
    """Delimited text of a dialect found by :func:`sniff`, unless one is given. Occurrence columns are
    typed by name, others by all their rows; empty fields are null. A row with another number of fields
    raises, and so does a value that does not fit an occurrence column."""
    dialect = dialect or sniff(spark, path, look_bytes)
    quoting = dialect.quoting or ("off" if dialect.sep == "\t" else "doubled")
    reader = (
        spark.read.option("sep", dialect.sep or "\t")
        .option("quote", "" if quoting == "off" else '"')
        .option("escape", '"' if quoting == "doubled" else "\\")
        .option("multiLine", dialect.multiline)
        # Fields are counted whichever columns are asked for.
        .option("columnPruning", False)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
    )
    if dialect.header:
        raw = reader.option("header", True).option("enforceSchema", False).csv(path)
    else:
        columns = ", ".join(f"column{i} STRING" for i in range(dialect.width))
        raw = reader.schema(columns).csv(path)
    kinds = _types(raw, [c for c in raw.columns if c not in CSV_TYPES])

    def column(c: str) -> Column:
        return typed(c, CSV_TYPES[c]) if c in CSV_TYPES else F.col(f"`{c}`").try_cast(kinds[c]).alias(c)

    return raw.select(*map(column, raw.columns))
