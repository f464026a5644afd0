"""Incremental ingest takes each file once, and a rerun changes nothing."""

from __future__ import annotations

import json

from lakemill.sources.snapshots import Store
from lakemill.streaming.incremental import ingest_available, late_tolerant_counts

SCHEMA = "id string, name string, at long"


def test_new_files_are_upserted(spark, tmp_path):
    source, folder, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")
    source.mkdir()

    def put(name, *rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        ingest_available(spark, str(source), SCHEMA, folder, "people", ["id"], "at", state)
        return {(r["id"], r["name"]) for r in Store(spark, folder).read("people").collect()}

    put("1.json", {"id": "a", "name": "x", "at": 1}, {"id": "a", "name": "y", "at": 2}, {"id": None, "name": "z", "at": 1})
    assert run() == {("a", "y")}
    assert run() == {("a", "y")}
    put("2.json", {"id": "a", "name": "w", "at": 3}, {"id": "b", "name": "v", "at": 1})
    assert run() == {("a", "w"), ("b", "v")}
    assert Store(spark, folder).manifest()["batches"] == {f"people from {source}": 1}


def test_counts_by_window(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("2024-01-01 00:10:00", "view"), ("2024-01-01 00:50:00", "view"), ("2024-01-01 01:10:00", "view")], "t string, kind string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in late_tolerant_counts(df, "t", "kind").collect()) == [1, 2]
