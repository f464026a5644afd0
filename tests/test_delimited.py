"""Delimited text in splits against a plain reader of whole files."""

from __future__ import annotations

import csv
import io
import random

import pytest

from lakemill.sources.delimited import best_delimiter, read_delimited


def plain(text):
    text = text.lstrip("﻿")
    sep = best_delimiter(text.split("\n", 1)[0])
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep, skipinitialspace=True, quoting=csv.QUOTE_NOTNULL))
    clean = [[x if not x else x.strip() or None for x in r] for r in rows]
    return clean[0], [r for r in clean[1:] if any(r)]


def written(rows, sep, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_line_breaks_in_quotes_over_many_splits(spark, tmp_path, small_splits):
    r = random.Random(4)
    value = lambda: "".join(r.choice(['a', '"', "\n", ",", ";", " ", "é", "\r\n", "long " * 40]) for _ in range(r.randint(0, 12)))
    want = []
    for n, (sep, end) in enumerate([(",", "\n"), (";", "\r\n"), ("\t", "\n")]):
        head = ["id", "text", "more"] if n != 1 else ["more", "id", "text"]
        rows = [[f"{n}-{i}", value(), value()] for i in range(300)]
        rows[7][1] = "x\n" * 9000  # one row over several splits
        text = ("﻿" if n == 0 else "") + written([head], sep, end) + written(rows, sep, end)
        (tmp_path / f"f{n}.csv").write_bytes(text.encode())
        names, body = plain(text)
        order = [names.index(c) for c in ("id", "text", "more")]
        want += [tuple(row[i] if i < len(row) else None for i in order) for row in body]
    df = read_delimited(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 10
    assert df.columns == ["id", "text", "more"]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
    places = read_delimited(spark, str(tmp_path), places=True).select("file_", "split_", "line_").collect()
    assert len(set(places)) == len(want)


def test_archives_by_entry_over_many_splits(spark, tmp_path, small_splits):
    import zipfile

    from lakemill.sources.archives import entries_of
    from lakemill.sources.files import read_zipped_rows, zipped_rows

    r = random.Random(8)
    for n in range(2):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for e in range(6):
                text = written([[f"{e}", "臺北市議員名冊" if e == 3 else "é", "".join(r.choice("ab,\n") for _ in range(9))] for _ in range(900)], ";" if e == 2 else ",")
                z.writestr(zipfile.ZipInfo(f"103年/{e}.csv"), text.encode("big5" if e == 3 else "utf-8") if e != 3 else text.encode("big5", "replace"), zipfile.ZIP_STORED if e == 1 else zipfile.ZIP_DEFLATED)
            z.writestr("none.txt", "x")
            z.writestr("empty.csv", "")
    path = str(tmp_path)
    want = {tuple(x[:3]) + (tuple(x["cells"]),) for x in zipped_rows(spark.read.format("binaryFile").load(path)).collect()}
    df = read_zipped_rows(spark, path)
    assert df.rdd.getNumPartitions() == 14 and {(x["path"], x["entry"], x["line"], tuple(x["cells"])) for x in df.collect()} == want
    assert len(want) > 9000 and len({x[1] for x in want}) == 6
    assert [e.name for e in entries_of(spark, f"{path}/0.zip", ".txt")] == ["none.txt"]
    assert read_zipped_rows(spark, path, ".none").count() == 0


def test_a_damaged_entry_raises(spark, tmp_path):
    import zipfile

    from lakemill.sources.files import read_zipped_rows

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.csv", "a,b\n1,2\n")
    data = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(data.replace(b"1,2", b"1,3", 1))
    with pytest.raises(Exception, match="damaged"):
        read_zipped_rows(spark, str(tmp_path)).collect()


def test_each_file_has_its_own_delimiter_and_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;n\n Ann ; 1\n;\n\"\";x\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("n,other,name\n2,\"o, o\",Bo\n", encoding="utf-8")
    (tmp_path / "c.csv").write_bytes("name\tn\n臺北市議員名冊資料\t3\n".encode("big5"))
    (tmp_path / "d.csv").write_text("")
    got = {tuple(r) for r in read_delimited(spark, str(tmp_path)).select("name", "n", "other").collect()}
    assert got == {("Ann", "1", None), ("", "x", None), ("Bo", "2", "o, o"), ("臺北市議員名冊資料", "3", None)}
    typed = read_delimited(spark, str(tmp_path), schema="n int, name string, none double")
    assert typed.columns == ["n", "name", "none"] and {tuple(r) for r in typed.collect()} == {(1, "Ann", None), (None, "", None), (2, "Bo", None), (3, "臺北市議員名冊資料", None)}


def test_a_header_with_a_line_break_and_an_open_quote(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"a\nb",c\n1,"2\n3', encoding="utf-8")
    df = read_delimited(spark, str(tmp_path))
    assert df.columns == ["a\nb", "c"] and [tuple(r) for r in df.collect()] == [("1", "2\n3")]
