"""Readers: delimited text, zipped files, JSON in its wrappings, HTML, map rings.

Files are read by Spark's readers; Python only decodes bytes, a file at a time,
inside tasks. Delimited files and archives of any size are read in splits: see
delimited and archives.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.sources.archives import ROW, read_zipped_rows
from lakemill.sources.delimited import best_delimiter, read_delimited

__all__ = ["best_delimiter", "read_delimited", "read_zipped_rows"]

def decoded(data: bytes) -> str:
    """UTF-8, or Big5 when more than five characters can't be read; a byte order mark is dropped."""
    plain = data.decode("utf-8", "replace")
    if plain.count("�") > 5:
        plain = data.decode("big5", "replace")
    return plain.lstrip("﻿")


def _parsed(text: str) -> list[list[str]]:
    import csv

    lines = text.splitlines()
    rows = csv.reader(io.StringIO(text), delimiter=best_delimiter(lines[0] if lines else ""))
    return [cells for cells in ([c.strip() for c in row] for row in rows) if any(cells)]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files in UTF-8 or Big5."""
    return decoded_texts(spark.read.format("binaryFile").load(path))


def decoded_texts(files: DataFrame) -> DataFrame:
    """(path, text) of files given as (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "text": [decoded(bytes(b)) for b in part["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def zipped_rows(archives: DataFrame, suffix: str = ".csv") -> DataFrame:
    """Cells of all delimited files in archives given as (path, content), which are held whole; see archives.read_zipped_rows for those that are files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for source, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content)), metadata_encoding="big5") as archive:
                    for info in archive.infolist():
                        if not info.is_dir() and info.filename.lower().endswith(suffix):
                            if rows := _parsed(decoded(archive.read(info))):
                                yield pd.DataFrame({"path": source, "entry": info.filename, "line": range(len(rows)), "cells": rows}, columns=["path", "entry", "line", "cells"])

    return archives.select("path", "content").mapInPandas(run, ROW)


def named_cells(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows of cells as columns by place; cells that lack are null."""
    return rows.select("path", "entry", "line", *(F.get("cells", i).alias(n) for i, n in enumerate(names)))


def archive_kind(entry: str = "entry") -> Column:
    """Kind of an election from the path of its file, tried in order."""
    e = F.col(entry)
    kinds = [("總統", "president"), ("立委", "legislator"), ("立法委員", "legislator"), ("縣市長", "mayor"), ("市長", "mayor"), ("議員", "councilor"), ("里長", "village_chief")]
    out = None
    for word, kind in kinds:
        out = F.when(e.contains(word), kind) if out is None else out.when(e.contains(word), kind)
    return out


def json_inside(text: str = "text") -> Column:
    """The outermost JSON object of a text with other things around it; null if there is none."""
    return F.nullif(F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0), F.lit(""))


def read_json_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file's records, or none if the path does not exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def seed_collection(seed: DataFrame, name: str) -> DataFrame:
    """A named array of a seed document as rows."""
    return seed.select(F.inline(name))


def targets(df: DataFrame, wrappers: tuple[str, ...] = ("targets", "people", "records", "items", "data", "results", "rows")) -> DataFrame:
    """(person_id, name) of a target file in text form: a list, or a list under one of the wrappers; entries are names or objects."""
    lists = [F.from_json(F.get_json_object("text", f"$.{w}"), "array<string>") for w in wrappers]
    entry = F.explode(F.coalesce(F.from_json("text", "array<string>"), *lists)).alias("entry")
    rows = df.select(entry)
    is_object = F.col("entry").startswith("{")
    name = F.when(is_object, F.coalesce(F.get_json_object("entry", "$.name"), F.get_json_object("entry", "$.person_name"))).otherwise(F.col("entry"))
    pid = F.when(is_object, F.coalesce(F.get_json_object("entry", "$.personId"), F.get_json_object("entry", "$.person_id"), F.get_json_object("entry", "$.id")))
    return rows.select(pid.alias("person_id"), F.trim(name).alias("name")).where("name <> ''").distinct()


def element_text(html: str, element_id: str) -> Column:
    """What stands in the element with an id, up to the next closing tag of any kind."""
    return F.regexp_extract(F.col(html), rf'(?s)id="{element_id}"[^>]*>(.*?)</', 1)


def html_title(html: str = "html") -> Column:
    return F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)


def links(html: str = "html") -> Column:
    """Targets of all links, in order."""
    return F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def nested_candidates(df: DataFrame, schema: str) -> DataFrame:
    """Groups with lists of candidates (text in JSON) as a row a candidate."""
    groups = df.select(F.explode(F.from_json("text", schema)["groups"]).alias("g"))
    return groups.select(F.col("g.name").alias("group_name"), F.explode("g.candidates").alias("c")).select("group_name", "c.*")


def rings(df: DataFrame) -> DataFrame:
    """(feature, ring, place, x, y) of polygons and multipolygons given as GeoJSON geometry text."""
    deep = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<array<double>>>>")
    flat = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<double>>>")
    polygons = F.when(F.get_json_object("geometry", "$.type") == "MultiPolygon", F.flatten(deep)).otherwise(flat)
    out = df.select("feature", F.posexplode(polygons).alias("ring", "points")).select("feature", "ring", F.posexplode("points").alias("place", "p"))
    return out.select("feature", "ring", "place", F.get("p", 0).alias("x"), F.get("p", 1).alias("y"))


def bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("feature").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def svg_path(points: DataFrame, digits: int = 2) -> DataFrame:
    """(feature, path): rings as closed drawing paths with rounded coordinates."""
    step = F.concat(F.round("x", digits).cast("string"), F.lit(" "), F.round("y", digits).cast("string"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", step.alias("s")))), lambda p: p["s"])
    per_ring = points.groupBy("feature", "ring").agg(F.concat(F.lit("M"), F.array_join(ordered, " L"), F.lit(" Z")).alias("d"))
    return per_ring.groupBy("feature").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ring", "d"))), lambda r: r["d"]), " ").alias("path"))
