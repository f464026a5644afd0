"""Delimited text, read in splits although quotes may hold line breaks.

A line begins a row if the number of quotes before it in its file is even. Each
split of a file counts its quotes; sums over the splits before tell with which
parity a split begins, so every split knows its rows by itself. A row that runs
over the end of a split is put together from its pieces. Each file has its own
delimiter, header and encoding.

What the driver holds is a row for each split, as it does for any scan.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: A file is in Big5 if more characters than this can't be read as UTF-8.
UNREADABLE = 5
MARK = "﻿"


def best_delimiter(header: str) -> str:
    """The one of comma, semicolon and tab that stands most often; the first of them in ties."""
    return max((",", ";", "\t"), key=lambda d: (header.count(d), -",;\t".index(d)))


@dataclass
class File:
    """How a file is read: delimiter, encoding, where its cells go, and of each split the parity it begins with and the split that owns a row which began before."""

    sep: str
    encoding: str
    header: list[str]
    places: list[int] = field(default_factory=list)  # of each column of the result, the cell; -1 for none
    odd: dict[int, bool] = field(default_factory=dict)
    owner: dict[int, int] = field(default_factory=dict)
    ends_odd: dict[int, bool] = field(default_factory=dict)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """Consecutive lines of the same split."""
    for rows in batches:
        path, block, lines = (rows.column(i).to_pylist() for i in range(3))
        low = 0
        for at in range(1, len(lines) + 1):
            if at == len(lines) or block[at] != block[low] or path[at] != path[low]:
                yield (path[low], block[low]), lines[low:at]
                low = at


def _counted(lines: DataFrame) -> DataFrame:
    """A row for each split: its quotes, whether a line in it begins at an even and an odd number of them, unreadable characters, and the first row of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], dict[str, Any]] = {}
        for key, own in _runs(batches):
            s = seen.setdefault(key, {"quotes": 0, "odd": False, "bad": 0, "first": b"", "open": key[1] == 0})
            counts = [x.count(b'"') for x in own]
            before = np.concatenate([[0], np.cumsum(counts)]) + s["quotes"]
            s["odd"] |= bool((before[:-1] % 2 == 1).any())
            for x, q in zip(own, before[1:].tolist(), strict=True):
                if not s["open"]:
                    break
                s["first"] += x + b"\n"
                s["open"] = q % 2 == 1
            s["quotes"] = int(before[-1])
            whole = b"\n".join(own)
            if not whole.isascii():
                s["bad"] += whole.decode("utf-8", "replace").count("�")
        yield pa.RecordBatch.from_pylist([{"path": p, "block": b, **{c: s[c] for c in ("quotes", "odd", "bad", "first")}} for (p, b), s in seen.items()], schema=pa.schema({"path": pa.string(), "block": pa.int64(), "quotes": pa.int64(), "odd": pa.bool_(), "bad": pa.int64(), "first": pa.binary()}))

    return lines.mapInArrow(run, "path string, block long, quotes long, odd boolean, bad long, first binary")


def _cell(x: str | None) -> str | None:
    return x if not x else x.strip() or None


def _parsed(lines: Iterator[str], sep: str) -> Iterator[tuple[int, list[str | None]]]:
    """Rows with the number of lines read up to their end; a quoted empty cell is empty, an empty one null."""
    csv.field_size_limit(1 << 31)
    reader = csv.reader(lines, delimiter=sep, skipinitialspace=True, quoting=csv.QUOTE_NOTNULL)
    for row in reader:
        yield reader.line_num, [_cell(x) for x in row]


def _files(lines: DataFrame, sep: str | None) -> dict[str, File]:
    by_path: dict[str, list] = {}
    for r in _counted(lines).collect():  # a row for each split
        by_path.setdefault(r["path"], []).append(r)
    out = {}
    for path in sorted(by_path):
        splits = sorted(by_path[path], key=lambda r: r["block"])
        encoding = "big5" if sum(r["bad"] for r in splits) > UNREADABLE else "utf-8"
        first = bytes(splits[0]["first"] or b"").decode(encoding, "replace").lstrip(MARK)
        own_sep = sep or best_delimiter(first.split("\n", 1)[0])
        header = next((cells for _, cells in _parsed(iter(first.splitlines(keepends=True)), own_sep)), [])
        f = File(own_sep, encoding, [x or "" for x in header])
        odd, owner = False, splits[0]["block"]
        for r in splits:
            f.odd[r["block"]], f.owner[r["block"]] = odd, owner
            if r["odd"] if odd else True:  # a line begins a row here
                owner = r["block"]
            odd ^= r["quotes"] % 2 == 1
            f.ends_odd[r["block"]] = odd
        f.ends_odd[splits[-1]["block"]] = False  # an open quote ends with the file
        out[path] = f
    return out


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str | None = None, places: bool = False) -> DataFrame:
    """Rows of delimited files with headers, by name.

    Without ``sep`` each file's first line tells its delimiter. Columns are those
    of all headers, in the order of files and cells, null where a file lacks
    one; with ``schema`` the columns that it names, in its types, null where a
    cell isn't of the type. A doubled quote inside quotes is a quote. Cells are
    trimmed, empty ones are null unless they are quoted, rows without any cell
    are dropped; a byte order mark is dropped; files are in UTF-8, or in Big5 if
    more than five characters can't be read. ``places`` adds file, split and
    line. No files, or only headers, give no rows.
    """
    lines = _lines(spark, path)
    files = _files(lines, sep)
    columns = list(dict.fromkeys(x for f in files.values() for x in f.header if x))
    for f in files.values():
        f.places = [f.header.index(c) if c in f.header else -1 for c in columns]
    shared = spark.sparkContext.broadcast(files)  # a few bytes for each split
    text = StructType([*(StructField(f"c{i}", StringType()) for i in range(len(columns))), StructField("file_", StringType()), StructField("split_", LongType()), StructField("line_", LongType())])

    def batch_of(found: list[tuple[str, int, int, list[str | None]]]) -> pa.RecordBatch:
        laid = []
        for name, block, at, cells in found:
            own = [cells[p] if 0 <= p < len(cells) else None for p in shared.value[name].places]
            if any(own):
                laid.append((own, name, block, at))
        arrays = [pa.array([x[0][i] for x in laid], pa.string()) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([x[1] for x in laid], pa.string()), pa.array([x[2] for x in laid], pa.int64()), pa.array([x[3] for x in laid], pa.int64())], names=text.names)

    def walked(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple]:
        """Rows of a split as (path, block, at, cells), or else the pieces of rows that cross splits as (path, owner, block, at, line)."""
        key, at, odd, held, held_at = None, 0, False, [], 0

        def close() -> Iterator[tuple]:
            if key is None or not held:
                return
            crosses = held_at < 0 or shared.value[key[0]].ends_odd[key[1]]
            if whole and not crosses:
                yield from parsed(held, held_at)
            elif not whole and crosses:
                owner = shared.value[key[0]].owner[key[1]] if held_at < 0 else key[1]
                yield from ((key[0], owner, key[1], at - len(held) + i, x) for i, x in enumerate(held))

        def parsed(lines: list[bytes], first: int) -> Iterator[tuple]:
            f = shared.value[key[0]]
            before = 0
            for upto, cells in _parsed((x.decode(f.encoding, "replace").lstrip(MARK if key[1] == 0 and first + i == 0 else "") + "\n" for i, x in enumerate(lines)), f.sep):
                if (key[1], first + before) != (0, 0):
                    yield key[0], key[1], first + before, cells
                before = upto

        for run_key, own in _runs(batches):
            if run_key != key:
                yield from close()
                key, at, odd, held = run_key, 0, shared.value[run_key[0]].odd[run_key[1]], []
                held_at = -1 if odd else 0  # below zero: what goes on from a split before
            begins = []
            for i, x in enumerate(own):
                if not odd:
                    begins.append(i)
                odd ^= x.count(b'"') % 2 == 1
            if begins:
                if held and held_at < 0:
                    held += own[: begins[0]]
                    at += begins[0]
                    yield from close()
                    at -= begins[0]
                    ready, first = own[begins[0] : begins[-1]], at + begins[0]
                elif held_at < 0:  # the split begins inside a row
                    held, at = own[: begins[0]], at + begins[0]
                    yield from close()
                    at -= begins[0]
                    ready, first = own[begins[0] : begins[-1]], at + begins[0]
                else:
                    ready, first = held + own[: begins[-1]], held_at if held else at
                if whole and ready:
                    yield from parsed(ready, first)
                held, held_at = own[begins[-1] :], at + begins[-1]
            else:
                held = held + own
            at += len(own)
        yield from close()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = []
        for row in walked(batches, True):
            some.append(row)
            if len(some) == 4096:
                yield batch_of(some)
                some = []
        yield batch_of(some)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"path": pa.string(), "owner": pa.int64(), "block": pa.int64(), "at": pa.int64(), "line": pa.binary()})
        for piece in walked(batches, False):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, piece, strict=True))], schema=schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = []
            for name, owner, lines in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                f, at = shared.value[name], lines[0]["at"]
                for _, cells in _parsed((x["line"].decode(f.encoding, "replace") + "\n" for x in lines), f.sep):
                    if (owner, at) != (0, 0):
                        found.append((name, owner, at, cells))
            yield batch_of(found)

    out = lines.mapInArrow(rows, text)
    if any(b for f in files.values() for b in f.ends_odd.values()):  # some row crosses splits
        parts = lines.mapInArrow(pieces, "path string, owner long, block long, at long, line binary")
        parts = parts.groupBy("path", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "at", "line"))).alias("lines"))  # of one row
        out = out.unionByName(parts.mapInArrow(joined, text))
    kept = ["file_", "split_", "line_"] if places else []
    if schema is None:
        return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), *kept)
    wanted = spark.createDataFrame([], schema).schema
    named = {c: F.col(f"c{i}") for i, c in enumerate(columns)}
    return out.select(*(named.get(f.name, F.lit(None)).try_cast(f.dataType).alias(f.name) for f in wanted), *kept)
