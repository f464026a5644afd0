"""ZIP archives of any size, entry by entry.

The driver reads the archives' directories, a few bytes an entry, by range. The
bytes themselves are read in splits: Spark's text reader gives lines as they
are, and sums of the splits' lengths tell where in its file each line lies.
Pieces of entries go to the entry's task, in order, and are inflated as a stream
that is read line by line, so no archive and no entry is held whole.
"""

from __future__ import annotations

import csv
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.sources.delimited import MARK, UNREADABLE, _lines, _runs, best_delimiter

ROW = "path string, entry string, line long, cells array<string>"
PIECE_BYTES = 1 << 20
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


@dataclass(frozen=True)
class Entry:
    """A file in an archive: where its bytes lie and what they must give."""

    path: str
    name: str
    deflated: bool
    start: int
    end: int
    size: int
    crc: int


class _Bytes:
    """Ranges of a file, through the file system that Spark uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.where = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.size = self.fs.getFileStatus(self.where).getLen()

    def read(self, start: int, count: int) -> bytes:
        stream = self.fs.open(self.where)
        try:
            stream.seek(start)
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, count))
        finally:
            stream.close()


def entries_of(spark: SparkSession, path: str, suffix: str = "") -> list[Entry]:
    """The files of one archive whose names end so. Names are in UTF-8 where the archive says so, else in Big5."""
    data = _Bytes(spark, path)
    tail_at = max(0, data.size - 65_557)
    tail = data.read(tail_at, data.size - tail_at)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError(f"not an archive: {path}")
    count, size, start = struct.unpack("<H2I", tail[at + 10 : at + 20])
    if (locator := tail.rfind(_LOCATOR64, 0, at)) >= 0 and (count == 0xFFFF or 0xFFFFFFFF in (size, start)):
        end64 = data.read(struct.unpack("<Q", tail[locator + 8 : locator + 16])[0], 56)
        size, start = struct.unpack("<2Q", end64[40:56])
    directory, found, at = data.read(start, size), [], 0
    while directory[at : at + 4] == _CENTRAL:
        flags, method = struct.unpack("<2H", directory[at + 8 : at + 12])
        crc, packed, plain, name_size, extra_size, comment_size = struct.unpack("<3I3H", directory[at + 16 : at + 34])
        local = struct.unpack("<I", directory[at + 42 : at + 46])[0]
        raw, extra = directory[at + 46 : at + 46 + name_size], directory[at + 46 + name_size : at + 46 + name_size + extra_size]
        at += 46 + name_size + extra_size + comment_size
        while len(extra) >= 4:  # sizes beyond 32 bits
            kind, length = struct.unpack("<2H", extra[:4])
            if kind == 1:
                values = iter(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            extra = extra[4 + length :]
        name = raw.decode("utf-8" if flags & 0x800 else "big5", "replace")
        if name.endswith("/") or not name.lower().endswith(suffix):
            continue
        if flags & 1 or method not in (0, 8):
            raise ValueError(f"{path}: {name} is encrypted or packed in a way that isn't known")
        head = data.read(local, 30)
        if head[:4] != _LOCAL:
            raise ValueError(f"{path}: {name} is not where the directory says")
        begin = local + 30 + sum(struct.unpack("<2H", head[26:30]))
        found.append(Entry(path, name, method == 8, begin, begin + packed, plain, crc))
    return found


def _archives(spark: SparkSession, path: str) -> list[str]:
    return sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())  # names alone: no content is read


def _pieces(spark: SparkSession, path: str, entries: list[Entry]) -> DataFrame:
    """(entry, at, data): the entries' bytes in pieces; entry is a place in the list."""
    lines = _lines(spark, path)
    sizes = lines.groupBy("path", "block").agg(F.sum(F.octet_length("line") + 1).alias("bytes")).collect()  # a row for each split
    starts: dict[tuple[str, int], int] = {}
    for name in {r["path"] for r in sizes}:
        at = 0
        for r in sorted((r for r in sizes if r["path"] == name), key=lambda r: r["block"]):
            starts[name, r["block"]] = at
            at += r["bytes"]
    ranges: dict[str, list[tuple[int, int, int]]] = {}
    for i, e in enumerate(entries):
        ranges.setdefault(e.path, []).append((e.start, e.end, i))
    shared = spark.sparkContext.broadcast((starts, {p: sorted(r) for p, r in ranges.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, ranges = shared.value

        def cut(name: str, at: int, data: bytes) -> pa.RecordBatch:
            own = [(i, max(at, a), data[max(a - at, 0) : b - at]) for a, b, i in ranges.get(name, ()) if a < at + len(data) and b > at]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["entry", "at", "data"])

        key, at, some, size = None, 0, [], 0
        for run_key, own in _runs(batches):
            if run_key != key or size >= PIECE_BYTES:
                if some:
                    yield cut(key[0], at, b"\n".join(some) + b"\n")
                at = starts[run_key] if run_key != key else at + size
                key, some, size = run_key, [], 0
            some += own
            size += sum(map(len, own)) + len(own)
        if some:
            yield cut(key[0], at, b"\n".join(some) + b"\n")

    return lines.mapInArrow(run, "entry int, at long, data binary")


def _texts(pieces: Iterator[tuple[int, bytes]], entries: list[Entry]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Each entry's lines, from its pieces in order. Raises if size or checksum differ from the directory's."""
    pending = next(pieces, None)
    while pending is not None:
        number, entry = pending[0], entries[pending[0]]

        def lines() -> Iterator[bytes]:
            nonlocal pending
            inflate, rest, size, crc = zlib.decompressobj(-15) if entry.deflated else None, b"", 0, 0
            while pending is not None and pending[0] == number:
                data = inflate.decompress(pending[1]) if inflate else pending[1]
                pending = next(pieces, None)
                if inflate and (pending is None or pending[0] != number):
                    data += inflate.flush()
                size, crc = size + len(data), zlib.crc32(data, crc)
                *whole, rest = (rest + data).split(b"\n")
                yield from whole
            if rest:
                yield rest
            if (size, crc) != (entry.size, entry.crc):
                raise ValueError(f"{entry.path}: {entry.name} is damaged")

        own = lines()
        yield number, own
        for _ in own:  # what wasn't read
            pass


def read_zipped_rows(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """Cells of all delimited files in the archives at a path: (path, entry, line, cells).

    Each entry is a unit of work for a task. Its text is in UTF-8, or in Big5 if
    more than five characters can't be read; its first line tells the delimiter.
    Cells are trimmed, rows without any cell are dropped. To tell encodings, the
    archives are read once before.
    """
    entries = [e for archive in _archives(spark, path) for e in entries_of(spark, archive, suffix)]
    if not entries:
        return spark.createDataFrame([], ROW)
    pieces = _pieces(spark, path, entries).repartition(len(entries), "entry").sortWithinPartitions("entry", "at")
    shared = spark.sparkContext.broadcast(entries)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for rows in batches:
            yield from zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True)

    def unreadable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, lines in _texts(stream(batches), shared.value):
            bad = sum(x.decode("utf-8", "replace").count("�") for x in lines if not x.isascii())
            yield pa.RecordBatch.from_pydict({"entry": pa.array([number], pa.int32()), "bad": pa.array([bad], pa.int64())})

    bad = {r["entry"] for r in pieces.mapInArrow(unreadable, "entry int, bad long").where(F.col("bad") > UNREADABLE).collect()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema({"path": pa.string(), "entry": pa.string(), "line": pa.int64(), "cells": pa.list_(pa.string())})
        csv.field_size_limit(1 << 31)
        for number, lines in _texts(stream(batches), shared.value):
            entry, encoding = shared.value[number], "big5" if number in bad else "utf-8"
            text = (x.decode(encoding, "replace") + "\n" for x in lines)
            first = next(text, "").lstrip(MARK)

            def all_lines(first: str = first, text: Iterator[str] = text) -> Iterator[str]:
                if first:
                    yield first
                yield from text

            some, line = [], 0
            for row in csv.reader(all_lines(), delimiter=best_delimiter(first)):
                cells = [c.strip() for c in row]
                if any(cells):
                    some.append((line, cells))
                    line += 1
                if len(some) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array([entry.path] * len(some)), pa.array([entry.name] * len(some)), pa.array([x for x, _ in some], pa.int64()), pa.array([x for _, x in some], pa.list_(pa.string()))], schema=kinds)
                    some = []
            yield pa.RecordBatch.from_arrays([pa.array([entry.path] * len(some), pa.string()), pa.array([entry.name] * len(some), pa.string()), pa.array([x for x, _ in some], pa.int64()), pa.array([x for _, x in some], pa.list_(pa.string()))], schema=kinds)

    return pieces.mapInArrow(rows, ROW)
