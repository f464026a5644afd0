"""What the operators of this subpackage share: reading, folds, byte buffers, words and their hashes.

Texts reach Python as Arrow batches. A batch's strings lie in one buffer of
UTF-8 bytes, so most operators look at the bytes of many documents at once with
numpy and never make a Python object for a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.session import scratch, shared_folder

CHUNK_BYTES = 1 << 20

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder: lost executors lose none of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Written as a table in the shared folder, by the values of some columns, and read again: no lineage, and smaller than a checkpoint."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Narrow rows up to which a table is broadcast: a few megabytes.
BROADCAST_ROWS = 100_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if it has no more than so many rows; else the join shuffles. Texts then move no more than they must."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and each row's start, with the end at last; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def chunks(starts: np.ndarray, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes; a longer row is a range of its own."""
    low, rows = 0, len(starts) - 1
    while low < rows:
        high = int(np.searchsorted(starts, starts[low] + target, side="right")) - 1
        high = min(rows, max(high, low + 1))
        yield low, high
        low = high


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the buffer, and for each row the number of words before it (the total at last)."""
    space = IS_SPACE[data]
    n = len(data)
    begin, end = ~space, ~space
    begin[1:] &= space[:-1] | False
    end[:-1] &= space[1:]
    inner = starts[(starts > 0) & (starts < n)]
    begin[inner] |= ~space[inner]
    end[inner - 1] |= ~space[inner - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return first, last, np.searchsorted(first, starts)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the byte values; powers of an odd multiplier and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        up, down = np.full(size, _MULTIPLIER, np.uint64), np.full(size, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers["value"] = np.random.default_rng(20260101).integers(1, _MASK, 256, dtype=np.uint64) | np.uint64(1)
    return _powers["value"], _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums that give the hash of any stretch of the buffer: see stretch_hash."""
    value, up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=sums[1:])
    return sums, down


def stretch_hash(sums: np.ndarray, down: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches; equal bytes give equal hashes wherever they stand."""
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def pieces(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[pa.RecordBatch]:
    """The rows in smaller batches, without a copy: what Python makes of a batch stays small."""
    for rows in batches:
        for at in range(0, rows.num_rows, most):
            yield rows.slice(at, most)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with one batch in and batches out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            yield from f(rows)

    return df.mapInArrow(run, schema)


def batch(**columns: object) -> pa.RecordBatch:
    """A record batch of named columns."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array,)) else pa.array(x) for x in columns.values()], names=list(columns))


def extend(df: DataFrame, f: Callable[[pa.RecordBatch], list], added: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """The input's columns, less ``drop`` and any named as an added one, and the columns that ``f`` makes of a batch."""
    names = [x.strip().split()[0] for x in added.split(",")]
    keep = [c for c in df.columns if c not in drop and c not in names]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            own = [x if isinstance(x, pa.Array) else pa.array(x) for x in f(rows)]
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in keep), *own], names=[*keep, *names])

    return df.mapInArrow(run, schema)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, limits: tuple[int, int], most_bytes: int):
    """Training rows of a classifier, by class at most ``limits`` documents, together of at most ``most_bytes`` bytes.

    Ids are taken in the order of a hash of the id from the labelled rows whose
    remainder isn't the one left out; a document labelled twice has its smaller
    label, one that stands twice its smallest text. Documents of any length are
    taken whole in that order; one that doesn't fit in the bytes that are left
    is passed over alone. Returns a pandas frame
    (text, label) and the number of labelled rows of each class.
    """
    known = labels.where(F.col(label).isin(0, 1) & (fold("doc_id", modulus) != left_out)).groupBy("doc_id").agg(F.min(label).alias("label_"))
    counts = {r["label_"]: r["n"] for r in known.groupBy("label_").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id").cast("string"))
    ids = [known.where(F.col("label_") == c).orderBy(order, "doc_id").limit(limits[c]) for c in (0, 1)]
    rows = documents.select("doc_id", "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").groupBy("doc_id", "label_").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = first_bytes(stored(rows.select("doc_id", "label_", "text", order.alias("order"))), ["order", "doc_id"], most_bytes)  # of a bounded number of rows
    return rows.select("doc_id", "label_", "text").toPandas().sort_values("doc_id", ignore_index=True), (counts.get(0, 0), counts.get(1, 0))


def first_bytes(rows: DataFrame, order: list[str], most_bytes: int) -> DataFrame:
    """Of a stored table with a bounded number of rows, those whose texts together have no more than so many bytes.

    Rows are taken in the order; one whose text doesn't fit in what is left is
    passed over, those behind it are still taken if they fit.
    """
    sizes = rows.select(*order, F.octet_length("text").alias("bytes")).toPandas().sort_values(order)
    left, fits = most_bytes, []
    for size in sizes["bytes"].fillna(0).astype(int).tolist():
        fits.append(size <= left)
        left -= size if fits[-1] else 0
    if all(fits):
        return rows
    taken = sizes[np.array(fits, bool)]
    keys = rows.sparkSession.createDataFrame(taken[order].values.tolist(), rows.select(*order).schema)
    return rows.join(F.broadcast(keys), order, "left_semi")


def class_weights(y: np.ndarray, counts: tuple[int, int]) -> np.ndarray:
    """Weights that give the sample the classes' shares among all labelled rows."""
    own = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    weights = np.array(counts, float) / own
    weights = weights[y.astype(int)]
    return weights / max(weights.mean(), 1e-9) if len(y) else weights


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """The usual first-order optimiser over a list of arrays."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.step_ = arrays, rate, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.step_ += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step_) / (1 - 0.9**self.step_)
        for a, g, m, v in zip(self.arrays, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= scale * m / (np.sqrt(v) + 1e-8)
