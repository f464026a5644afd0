"""Importance resampling towards a target, over hashed n-grams that suffix arrays of word ids enumerate.

A task lays the words of many texts one behind the other, numbers the different
ones and sorts all places by the words that follow them: a suffix array, as deep
as the longest n-gram. Places whose suffixes share their first n words stand in
one run of it; a run is one n-gram however often it occurs. Each run is hashed
once, from the run of its first n-1 words and its last word, as crc32 is linear;
the bucket is then scattered back to all places of the run, to be counted in the
first pass and scored in the second.

Bucket counts and gains have one row a bucket, a bound that no input moves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lakemill.llm.common import LOWER, chunks, pieces, prefix_sums, stored, stretch_hash, table, utf8

BUCKETS = 10_000
LONGEST = 3
PERCENT, FEWEST_WORDS, SEED = 5, 20, 42
#: Bytes of text that one suffix array is built of, and words; a longer text is taken in stretches that overlap.
ARRAY_BYTES, ARRAY_WORDS = 4 << 20, 1 << 20

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_in(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of lower-cased bytes, and for each row the number of words before it (the total at last)."""
    inside = WORD_BYTE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    begin[inner] |= inside[inner]
    end[inner - 1] |= inside[inner - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return first, last, np.searchsorted(first, starts)


def suffix_order(ids: np.ndarray, rest: np.ndarray, depth: int) -> np.ndarray:
    """The places sorted by the ``depth`` ids from each on (from 1), nothing beyond ``rest`` ids; equal ones by place."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    a_key = max(1, 63 // bits)
    padded = np.concatenate([ids.astype(np.int64), np.zeros(depth, np.int64)])
    keys = []
    for low in range(0, depth, a_key):
        key = np.zeros(len(ids), np.int64)
        for k in range(low, min(low + a_key, depth)):
            key = (key << bits) | np.where(rest > k, padded[k : k + len(ids)], 0)
        keys.append(key)
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def runs(ids: np.ndarray, rest: np.ndarray, order: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n from 1 on: the slots of the suffix array that begin a run of a shared n-gram, and which slots lie in one at all."""
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    shared = np.zeros(len(order), bool)
    shared[1:] = True  # slots that share the first n words with the slot before: the longest common prefix is n or more
    for n in range(1, depth + 1):
        whole = rest[order] >= n
        word = padded[order + (n - 1)]
        shared[1:] &= (word[1:] == word[:-1]) & whole[1:] & whole[:-1]
        yield n, np.flatnonzero(whole & ~shared), whole


@lru_cache(maxsize=4096)
def _shift(count: int) -> np.ndarray:
    """Tables (4, 256) that move a crc register over ``count`` zero bytes, a table for each of its bytes."""
    moved = np.array([zlib.crc32(bytes(count), (1 << i) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(32)], np.uint32)
    has = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.stack([np.bitwise_xor.reduce(np.where(has, moved[8 * byte : 8 * byte + 8], 0).astype(np.uint32), axis=1) for byte in range(4)])


def appended(crc: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of texts put together: of the first ones' crc32, the second ones' and their lengths."""
    out = np.empty_like(crc)
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            shift = _shift(int(length[part[0]]))
            x = crc[part]
            out[part] = shift[0][x & 255] ^ shift[1][x >> 8 & 255] ^ shift[2][x >> 16 & 255] ^ shift[3][x >> 24] ^ tail[part]
    return out


def buckets_of(data: np.ndarray, first: np.ndarray, last: np.ndarray, rest: np.ndarray, owned: int, longest: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram at each place, (longest, owned), -1 where the text ends before; places from ``owned`` on are only looked at.

    Equal words have equal 64-bit hashes; two different ones among a few million
    collide with a chance of one in a million.
    """
    out = np.full((longest, owned), -1, np.int32)
    if not owned:
        return out
    sums, down = prefix_sums(data)
    _, sample, ids = np.unique(stretch_hash(sums, down, first, last), return_index=True, return_inverse=True)
    ids = ids.astype(np.int32) + 1
    raw = data.tobytes()
    bare = np.zeros(len(sample) + 1, np.uint32)
    spaced, size = bare.copy(), np.zeros(len(sample) + 1, np.int64)
    for i, (a, b) in enumerate(zip(first[sample].tolist(), last[sample].tolist(), strict=True), 1):
        word = raw[a:b]
        bare[i], spaced[i], size[i] = zlib.crc32(word), zlib.crc32(b" " + word), b - a + 1
    order = suffix_order(ids, rest, longest)
    crc = np.zeros(len(order), np.uint32)  # of the slot's first n words, by the run it lies in
    for n, begins, whole in runs(ids, rest, order, longest):
        if not len(begins):
            break
        word = ids[order[begins] + (n - 1)]
        hashed = bare[word] if n == 1 else appended(crc[begins], spaced[word], size[word])
        run = np.searchsorted(begins, np.arange(len(order)), side="right") - 1
        crc = np.where(whole, hashed[np.maximum(run, 0)], 0).astype(np.uint32)
        slots = np.flatnonzero(whole & (order < owned))
        out[n - 1, order[slots]] = (crc[slots] % np.uint32(buckets)).astype(np.int32)
    return out


def stretches(text: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each place, buckets (longest, places)) of whole texts, a suffix array's worth at a time."""
    data, starts = utf8(text)
    data = LOWER[data]
    for low, high in chunks(starts, ARRAY_BYTES):
        own, base = data[starts[low] : starts[high]], starts[low : high + 1] - starts[low]
        first, last, before = words_in(own, base)
        row = np.repeat(np.arange(low, high), np.diff(before))
        rest = np.repeat(before[1:], np.diff(before)) - np.arange(len(first))
        for at in range(0, len(first), ARRAY_WORDS):
            owned = min(ARRAY_WORDS, len(first) - at)
            seen = min(len(first), at + owned + longest - 1)  # the n-grams of the last places reach into what follows
            a, b = first[at], last[seen - 1]
            yield row[at : at + owned], buckets_of(own[a:b], first[at:seen] - a, last[at:seen] - a, np.minimum(rest[at:seen], seen - np.arange(at, seen)), owned, longest, buckets)


def bucket_counts(texts: DataFrame, column: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many of all n-grams of 1 to ``longest`` words of a column of texts fall into each bucket.

    Repeats count, n-grams never cross rows; null and empty texts have none. A
    task adds up its own before anything moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for rows in batches:
            for _, found in stretches(rows.column(0), longest, buckets):
                counts += np.bincount(found[found >= 0], minlength=buckets)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit])], names=["bucket", "n"])

    return texts.select(F.col(f"`{column}`").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of bucket counts of a source and a target: a bucket's log ratio with one count added to each bucket, in whole thousandths rounded down.

    The counts come to the driver: at most one row a bucket.
    """

    def counted(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for row in df.collect():
            out[row["bucket"]] = row["n"]
        return out

    s, t = counted(source).astype(float), counted(target).astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def score_documents(documents: DataFrame, gain: np.ndarray, longest: int = LONGEST, names: tuple[str, str, str] = ("n_words", "n_features", "weight"), keep_text: bool = True) -> DataFrame:
    """Adds words, n-grams and the sum of their buckets' gains to each document; other columns pass through, the text if it is kept."""
    keep = [f for f in documents.schema if f.name not in names and (keep_text or f.name != "text")]
    shared, buckets = documents.sparkSession.sparkContext.broadcast(gain), len(gain)

    def sums(row: np.ndarray, values: np.ndarray, total: np.ndarray) -> None:
        begins = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        total[row[begins]] += np.add.reduceat(values, begins)  # whole numbers: nothing is rounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows in pieces(batches):
            words, features, weight = (np.zeros(rows.num_rows, np.int64) for _ in range(3))
            for row, found in stretches(rows.column(rows.schema.get_field_index("text")), longest, buckets):
                if len(row):
                    has = found >= 0
                    sums(row, np.ones(len(row), np.int64), words)
                    sums(row, has.sum(axis=0), features)
                    sums(row, np.where(has, own[found], 0).sum(axis=0), weight)
            kept = [rows.column(rows.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in (words, features, weight))], names=[*(f.name for f in keep), *names])

    return documents.mapInArrow(run, StructType([*keep, *(StructField(n, LongType()) for n in names)]))


def chance(doc_id: str = "doc_id", seed: int = SEED):
    """A draw of the Gumbel distribution in whole thousandths rounded down, from a hash of the id (null: empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    documents: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    fewest_words: int = FEWEST_WORDS,
    seed: int = SEED,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    keep_text: bool = True,
) -> DataFrame:
    """The documents' columns with n_words, n_features, weight, score and rank: the drawn ones have ranks from 1.

    Drawing without replacement by weight: so many percent (rounded down) of the
    documents with enough words, those of the highest score (weight and chance),
    ties to the smaller doc_id, null first. Repeated rows are documents of their own, drawn
    each. Null and empty texts have weight 0. Columns named as an added one are
    replaced; an empty table gives an empty table. The rows are sorted in ranges
    and numbered range by range, so no task sees all.
    """
    added = ("n_words", "n_features", "weight", "score", "rank")
    rest = [c for c in documents.columns if c not in added and (keep_text or c != "text")]
    row = F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row") if rest else F.lit(None).alias("row")
    gain = gains(bucket_counts(documents, longest=longest, buckets=buckets), bucket_counts(target, longest=longest, buckets=buckets), buckets)
    scored = score_documents(documents.select(row, F.col("doc_id").alias("id"), "text"), gain, longest, keep_text=False)
    scored = stored(scored.select("*", (F.col("weight") + chance("id", seed)).alias("score"), (F.col("n_words") >= fewest_words).alias("open")))  # the sort reads its input twice
    order = [F.col("open").desc(), F.col("score").desc(), F.col("id").asc_nulls_first(), "weight", "n_features"]
    sorted_ = stored(scored.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted_.where("open").groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = stored(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.expr(f"{int(percent)} * sum(n) over () div 100").alias("drawn")))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = sorted_.join(F.broadcast(offsets), part == F.col("part"), "left")
    return ranked.select(
        *(F.col(f"row.`{c}`").alias(c) for c in rest), "n_words", "n_features", "weight", "score", F.when(F.col("open") & (place <= F.col("drawn")), place).alias("rank")
    )


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their features, weight, score and rank in a draw of a twentieth towards the benchmark."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resample(documents, table(spark, sf_dir, "benchmark"), keep_text=False)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS step FROM range(256) r(i)),
texts AS (
  SELECT row_number() OVER () AS r, * FROM (
    SELECT TRUE AS source, doc_id, text FROM {documents} UNION ALL SELECT FALSE, NULL, text FROM {benchmark})),
worded AS (
  SELECT r, source, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (SELECT r, source, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM worded, range(1, 4) k(n)),
counted AS (SELECT r, source, gram, count(*) AS c FROM grams GROUP BY ALL),
hashed AS (
  SELECT gram, xor(list_reduce(list_transform(range(len(digits) // 2), lambda i: CAST(('0x' || digits[2 * i + 1:2 * i + 2]) AS BIGINT)),
                               lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT gram, hex(encode(gram)) AS digits FROM (SELECT DISTINCT gram FROM counted)), crc),
parts AS (SELECT r, source, bucket, sum(c) AS c FROM counted JOIN hashed USING (gram) GROUP BY ALL),
buckets AS (SELECT bucket, coalesce(sum(c) FILTER (WHERE source), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (WHERE NOT source), 0)::DOUBLE AS t FROM parts GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM buckets),
gained AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM buckets, totals),
weighed AS (SELECT r, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * gain) AS BIGINT) AS weight FROM parts JOIN gained USING (bucket) WHERE source GROUP BY r),
scored AS (
  SELECT w.doc_id, len(w.w) >= 20 AS open, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM worded w LEFT JOIN weighed USING (r) WHERE w.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY open ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place, count(*) FILTER (WHERE open) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
"""
