"""Dialects found by a look at files, and types by all rows."""

from __future__ import annotations

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from areametrics.sources import readers, sniff


def _write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.txt").write_text(text, "utf-8")
    return str(folder)


@pytest.mark.parametrize("sep", ["\t", ";", ",", "|"])
@pytest.mark.parametrize("header", [True, False])
def test_separators_with_and_without_header(spark, tmp_path, sep, header):
    lines = [["id", "name", "when", "share", "code"]] * header + [
        ["1", "Érable", "2020-01-31", "0.5", "007"], ["2", "", "2021-12-01", "1e3", "010"], ["-3", "Pin", "", "2", "5"],
    ]
    path = _write(tmp_path / "in", a="\n".join(map(sep.join, lines)) + "\n")
    df = sniff.read_delimited(spark, path)
    assert df.columns == (lines[0] if header else [f"column{i}" for i in range(5)])
    assert [t for _, t in df.dtypes] == ["bigint", "string", "date", "double", "string"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [
        (-3, "Pin", None, 2.0, "5"), (1, "Érable", dt.date(2020, 1, 31), 0.5, "007"), (2, None, dt.date(2021, 12, 1), 1e3, "010"),
    ]


def test_types_come_from_all_rows_not_from_the_look(spark, tmp_path):
    body = "".join(f"{i};{i}\n" for i in range(5000)) + "5000;x\n"
    df = sniff.read_delimited(spark, _write(tmp_path / "in", a="n;m\n" + body), look_bytes=200)
    assert [t for _, t in df.dtypes] == ["bigint", "string"] and df.count() == 5001


def test_occurrence_columns_are_typed_by_name(spark, tmp_path):
    path = _write(tmp_path / "in", a='gbifID\tyear\tspecies\n1\t\tPicea "glauca\n2\t2020\t"Acer\n')
    df = sniff.read_delimited(spark, path)
    assert [t for _, t in df.dtypes] == ["bigint", "int", "string"]
    assert {r.species for r in df.collect()} == {'Picea "glauca', '"Acer'}
    bad = _write(tmp_path / "bad", a="gbifID\tyear\n1\t2000\n2\tMMXX\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sniff.read_delimited(spark, bad).collect()


def test_quoting(spark, tmp_path):
    doubled = 'a,b\n"x, ""y""",1\nz,2\n'
    slashed = 'a,b\n"x, \\"y\\"",1\nz,2\n'
    lines = 'a,b\n"x\ny",1\nz,2\n'
    for name, text, first in [("d", doubled, 'x, "y"'), ("s", slashed, 'x, "y"'), ("l", lines, "x\ny")]:
        df = sniff.read_delimited(spark, _write(tmp_path / name, f=text))
        assert sorted(tuple(r) for r in df.collect()) == [(first, 1), ("z", 2)]
    assert sniff.sniff(spark, str(tmp_path / "l")).multiline


def test_many_files_agree_or_raise(spark, tmp_path):
    agree = tmp_path / "agree"
    _write(agree, a="k;v\n1;x\n", b='k;v\n2;"y;z"\n', c="", d="k;v\n")
    with gzip.open(agree / "e.csv.gz", "wt") as f:
        f.write("k;v\n3;w\n")
    df = sniff.read_delimited(spark, str(agree))
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, "y;z"), (3, "w")]
    for name, other in [("sep", "k,v\n1,x\n"), ("header", "1;x\n2;y\n"), ("names", "v;k\nx;1\n"), ("width", "k;v;w\n1;2;3\n")]:
        path = _write(tmp_path / name, a="k;v\n1;x\n", b=other)
        with pytest.raises(ValueError, match=f"files disagree: .*{'sep' if name == 'sep' else name}"):
            sniff.sniff(spark, path)


def test_rows_of_another_width_raise(spark, tmp_path):
    for start in ("k;v\n", ""):
        path = _write(tmp_path / f"w{len(start)}", a=start + "1;2\n" * 200 + "1;2;3\n")
        with pytest.raises(Exception, match="(?i)malformed"):
            sniff.read_delimited(spark, path, look_bytes=100).select(F.lit(1)).collect()
    with pytest.raises(Exception, match="no separator divides"):
        sniff.sniff(spark, _write(tmp_path / "r", a="1;2\n1;2;3\n"))
    with pytest.raises(Exception, match="no line ends"):
        sniff.sniff(spark, _write(tmp_path / "one", a="x" * 500), look_bytes=100)
    with pytest.raises(ValueError, match="no file has a line"):
        sniff.sniff(spark, _write(tmp_path / "none", a="", b="\n\n"))


def test_a_column_without_separators(spark, tmp_path):
    df = sniff.read_delimited(spark, _write(tmp_path / "in", a="note\nhello, world\nbye\n"))
    assert sorted(r.note for r in df.collect()) == ["bye", "hello, world"]


def test_a_given_dialect(spark, tmp_path):
    path = _write(tmp_path / "in", a="a;b\nc;d\n")
    assert sniff.sniff(spark, path).header
    given = sniff.Dialect(";", "off", False, (), 2, False)
    assert sniff.read_delimited(spark, path, dialect=given).count() == 2


def test_types_by_all_rows(spark, tmp_path, monkeypatch):
    """First rows rule types out, but a type holds only if all rows have it."""
    monkeypatch.setattr(sniff, "FIRST_ROWS", 2)
    (tmp_path / "a.csv").write_text("a;b;c;d\n" + "1;2;;x\n" * 3 + "1.5;2;2020-01-02;x\n")
    kinds = dict(sniff.read_delimited(spark, str(tmp_path)).dtypes)
    assert kinds == {"a": "double", "b": "bigint", "c": "date", "d": "string"}


def test_text_is_not_cast(spark):
    """A text column is read as it is, without a test that no value fails."""
    read = spark.range(1).selectExpr("'x' AS a").select(readers.typed("a", "string"))
    assert "raise_error" not in read._jdf.queryExecution().analyzed().toString()
