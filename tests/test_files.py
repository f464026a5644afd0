"""Readers on small files."""

from __future__ import annotations

import zipfile


from lakemill.sources import files


def test_delimiters_are_told_from_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿name;note\n Ann ;"say ""hi"""\n;\n', encoding="utf-8")
    rows = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["name", "note"] and [tuple(r) for r in rows.collect()] == [("Ann", 'say "hi"')]


def test_big5_is_read_when_utf8_fails(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("臺北市議員名冊資料".encode("big5"))
    (tmp_path / "u.txt").write_bytes("臺北".encode())
    assert {r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()} == {"臺北市議員名冊資料", "臺北"}


def test_archives_give_rows_of_their_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("103年/議員/cand.csv", "a,b\n'1, x\n\n")
        z.writestr("readme.txt", "no")
    rows = files.named_cells(files.read_zipped_rows(spark, str(tmp_path / "a.zip")), ["first", "second", "third"]).withColumn("kind", files.archive_kind())
    assert [(r["line"], r["first"], r["second"], r["third"], r["kind"]) for r in rows.orderBy("line").collect()] == [(0, "a", "b", None, "councilor"), (1, "'1", "x", None, "councilor")]


def test_json_in_its_wrappings(spark, tmp_path):
    df = spark.createDataFrame([('x = {"people": ["Ann", {"personId": "7", "name": " Bo "}, {"id": "7", "name": "Bo"}]};',), ("none",)], "text string")
    inner = df.select(files.json_inside().alias("text"))
    assert inner.where("text IS NULL").count() == 1
    assert {tuple(r) for r in files.targets(inner).collect()} == {(None, "Ann"), ("7", "Bo")}
    assert files.read_json_or(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "seed.json").write_text('{"people": [{"a": 1}, {"a": 2}], "x": 1}')
    seed = spark.read.schema("people array<struct<a: int>>, x int").option("multiLine", "true").json(str(tmp_path / "seed.json"))
    assert files.seed_collection(seed, "people").count() == 2


def test_html_parts(spark):
    df = spark.createDataFrame([('<title>T&amp;x</title><span id="n">Ann<b>!</b></span><a class="y" href="/p">x</a>',)], "html string")
    row = df.select(files.html_title().alias("t"), files.element_text("html", "n").alias("n"), files.links().alias("l")).first()
    assert (row["t"], row["n"], row["l"]) == ("T&amp;x", "Ann<b>!", ["/p"])


def test_nested_candidates(spark):
    df = spark.createDataFrame([('{"groups": [{"name": "g", "candidates": [{"no": 1}, {"no": 2}]}, {"name": "h", "candidates": []}]}',)], "text string")
    assert [tuple(r) for r in files.nested_candidates(df, "groups array<struct<name: string, candidates: array<struct<no: int>>>>").collect()] == [("g", 1), ("g", 2)]


def test_rings_bounds_and_paths(spark):
    df = spark.createDataFrame([("a", '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,1.234],[0,0]]]}'), ("b", '{"type":"MultiPolygon","coordinates":[[[[5,5],[6,6],[5,5]]],[[[7,7],[8,9],[7,7]]]]}')], "feature string, geometry string")
    points = files.rings(df)
    assert points.count() == 10
    assert {tuple(r) for r in files.bounds(points).collect()} == {("a", 0.0, 2.0, 0.0, 1.234), ("b", 5.0, 8.0, 5.0, 9.0)}
    assert files.svg_path(points).where("feature = 'a'").first()["path"] == "M0.0 0.0 L2.0 0.0 L2.0 1.23 L0.0 0.0 Z"


def test_text_mentions(spark):
    from lakemill.operators import serving

    texts = [(1, "the red fox"), (2, None), (3, ""), (4, "臺北市議員名冊 and a very long name that nobody has"), (5, "x" * 300_000 + "needle in it"), (1, "the red fox")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    names = spark.createDataFrame([(1, "red"), (2, "fox"), (3, "x"), (4, "blue"), (5, "議員名"), (6, "a very long name that"), (7, "a very long name tha!"), (8, "needle in"), (8, "ox"), (9, None)], "name_id long, name string")
    want = {(d, n) for d, t in texts for n, name in [tuple(r) for r in names.collect()] if t and name and len(name) > 1 and name in t}
    found = [tuple(r) for r in serving.mentions(docs, names).collect()]
    assert set(found) == want and len(found) == len(want)
    assert serving.mentions(docs, names.limit(0)).count() == 0 and serving.mentions(docs.limit(0), names).count() == 0
