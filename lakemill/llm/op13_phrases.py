"""Phrases whose words stand together more often than their parts, by naming pairs level by level.

A name is the id of a frequent sequence of k words: of a word at first, then of
two adjacent names of k-1 words that overlap in all but their ends. So a name of
level k has two parents of level k-1, the sequence without its last and without
its first word; a sequence that is frequent has frequent parents, so what isn't
named falls away at each level. The parents give the counts of a cut's parts
(for up to three words these are the parents and their parents) and say which
candidates a longer one contains.

Names are exact and global. Texts are cut into blocks of some megabytes; a block
numbers its own different sequences and sends each once with its count. Those of
a bucket of keys meet: equal keys are added up, and the place of the first
(block and number) becomes the name of all, which goes back to the blocks that
have it. What moves are packed columns, a row for each block and bucket; there
are so many buckets that one has some hundred thousand keys, whatever the size
of the corpus, and of a key only one row for each block. Texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.llm.common import LOWER, batch, chunks, mix, pieces, prefix_sums, scratch, stored, stretch_hash, table, utf8

FEWEST, CONTAINED_PERCENT, TOP = 10, 50, 2000
BLOCK_BYTES = 2 << 20
#: Buckets that keys meet in: one for so many of the blocks' keys, and no fewer than the least.
BUCKET_KEYS, BUCKETS = 1 << 19, 256
#: A name is block << LOCAL | number in the block.
LOCAL = 31
#: Blocks of a task: more would run into the next task's numbers, and raise.
TASK_BLOCKS = 12
#: Shards that a language's phrases are dealt into before its first ones are taken.
SHARDS = 64

CUT = np.zeros(256, bool)
CUT[[ord(x) for x in ".,;:!?\n\v\f\r"]] = True
GAP = np.zeros(256, bool)
GAP[[0x20, 0x09]] = True


def words_and_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, the row it lies in, and whether a piece begins with it."""
    out = GAP[data] | CUT[data]
    begin, end = ~out, ~out
    begin[1:] &= out[:-1]
    end[:-1] &= out[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    begin[inner] |= ~out[inner]
    end[inner - 1] |= ~out[inner - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    cuts = np.concatenate([[0], np.cumsum(CUT[data])])
    row = np.searchsorted(starts, first, side="right") - 1
    fresh = np.ones(len(first), bool)
    fresh[1:] = (cuts[first[1:]] != cuts[first[:-1]]) | (row[1:] != row[:-1])
    return first, last, row, fresh


def pack(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Whole numbers in columns of one length, by planes of bytes, and some bytes behind them, compressed."""
    planes = [np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return zstandard.compress(b"".join([len(columns[0]).to_bytes(8, "little"), *planes, tail]), 3)


def unpack(packed: bytes, columns: int) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.decompress(packed)
    n = int.from_bytes(raw[:8], "little")
    out = [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 + 8 * n * i).reshape(8, n).T).view("<i8").ravel() for i in range(columns)]
    return out, raw[8 + 8 * n * columns :]


def in_buckets(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each bucket's entries, in their order."""
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        yield int(bucket[part[0]]), part


def blocks_of(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of texts (lang, text) as rows of two kinds: the sequence of a block's words as numbers, and its different words.

    sequence: packed numbers, 0 between pieces, as many as n; a word's number is
    its place in the block's list. Words as key, which is the language, a space
    and the word, with n, their count.
    """
    schema = "kind string, block long, sequence binary, number long, key string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, index = TaskContext.get().partitionId(), 0
        for rows in pieces(batches, 2048):
            data, starts = utf8(rows.column(1))
            data = LOWER[data]
            coded = rows.column(0).dictionary_encode()
            langs, code = [x.encode() + b" " for x in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64)
            for low, high in chunks(starts, block_bytes):
                own = data[starts[low] : starts[high]]
                first, last, row, fresh = words_and_pieces(own, starts[low : high + 1] - starts[low])
                if not len(first):
                    continue
                if index >> TASK_BLOCKS or task >> (62 - LOCAL - TASK_BLOCKS):
                    raise ValueError("more blocks than there are numbers for; take larger ones")
                lang = code[low:high][row]
                sums, down = prefix_sums(own)
                key = mix(stretch_hash(sums, down, first, last) + lang.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                del sums
                _, sample, number, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")  # frequent words get small numbers, which pack well
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(1, len(order) + 1)
                sequence = np.insert(rank[number], np.flatnonzero(fresh)[1:], 0)
                sample, n = sample[order], n[order]
                raw = own.tobytes()
                keys = [langs[i] + raw[a:b] for i, a, b in zip(lang[sample].tolist(), first[sample].tolist(), last[sample].tolist(), strict=True)]
                block, count = (task << TASK_BLOCKS) | index, len(sample)
                index += 1
                yield batch(kind=["sequence"], block=[block], sequence=pa.array([pack(sequence)], pa.binary()), number=pa.nulls(1, pa.int64()), key=pa.nulls(1, pa.string()), n=[len(sequence)])
                yield batch(kind=["word"] * count, block=np.full(count, block), sequence=pa.nulls(count, pa.binary()), number=np.arange(1, count + 1), key=pa.array(keys, pa.binary()).cast(pa.string()), n=n.astype(np.int64))

    return documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, schema)


def word_rows(words: DataFrame, buckets: int) -> DataFrame:
    """(bucket, packed): the words of blocks, packed by bucket of their key."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        some: list[pa.RecordBatch] = []
        for rows in batches:
            some.append(rows)
            if sum(r.num_rows for r in some) >= 1 << 17:
                yield pa.Table.from_batches(some)
                some = []
        if some:
            yield pa.Table.from_batches(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches):
            block, number, n = (rows.column(i).to_numpy() for i in (0, 1, 3))
            data, starts = utf8(rows.column(2))
            sums, down = prefix_sums(data)
            bucket = (stretch_hash(sums, down, starts[:-1], starts[1:]) % np.uint64(buckets)).astype(np.int64)
            raw, out = data.tobytes(), []
            begin, end = starts[:-1].tolist(), starts[1:].tolist()
            for b, at in in_buckets(bucket):
                out.append((b, pack((block[at] << LOCAL) | number[at], n[at], np.diff(starts)[at], tail=b"".join(raw[begin[i] : end[i]] for i in at.tolist()))))
            yield batch(bucket=pa.array([b for b, _ in out], pa.int64()), packed=pa.array([x for _, x in out], pa.binary()))

    return words.select("block", "number", "key", "n").mapInArrow(run, "bucket long, packed binary")


def _sent_back(place: np.ndarray, name: np.ndarray) -> list[tuple[int, bytes]]:
    """For each block its numbers and their names, packed."""
    return [(b, pack(place[at] & ((1 << LOCAL) - 1), name[at])) for b, at in in_buckets(place >> LOCAL)]


NAMED = "block long, packed binary, name long, key string, left long, right long, f long"


def _named(back: list[tuple[int, bytes]], name: np.ndarray, f: np.ndarray, key: pa.Array | None = None, left: np.ndarray | None = None, right: np.ndarray | None = None) -> pa.Table:
    m, n = len(back), len(name)
    null = lambda kind: pa.nulls(m + n, kind)

    def after(values: object, kind: pa.DataType) -> pa.Array:
        return pa.concat_arrays([pa.nulls(m, kind), values if isinstance(values, pa.Array) else pa.array(values, kind)])

    return pa.table({
        "block": pa.concat_arrays([pa.array([b for b, _ in back], pa.int64()), pa.nulls(n, pa.int64())]),
        "packed": pa.concat_arrays([pa.array([x for _, x in back], pa.binary()), pa.nulls(n, pa.binary())]),
        "name": after(name, pa.int64()),
        "key": null(pa.string()) if key is None else after(key, pa.string()),
        "left": null(pa.int64()) if left is None else after(left, pa.int64()),
        "right": null(pa.int64()) if right is None else after(right, pa.int64()),
        "f": after(f, pa.int64()),
    })


def named_words(rows: DataFrame, fewest: int) -> DataFrame:
    """Names of the words that occur often enough: for each block that has one (block, packed numbers and names), and (name, key, f)."""

    def run(rows: pa.Table) -> pa.Table:
        place, n, keys = [], [], []
        for packed in rows.column("packed").to_pylist():
            (p, m, size), raw = unpack(packed, 3)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            place.append(p)
            n.append(m)
            keys.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(p), [None, pa.py_buffer(ends), pa.py_buffer(raw)]))
        place, n = np.concatenate(place), np.concatenate(n)
        coded = pa.chunked_array(keys).combine_chunks().dictionary_encode()
        own = coded.indices.to_numpy()
        f, name = np.zeros(len(coded.dictionary), np.int64), np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.add.at(f, own, n)
        np.minimum.at(name, own, place)
        often = np.flatnonzero(f >= fewest)
        kept = np.flatnonzero(f[own] >= fewest)
        return _named(_sent_back(place[kept], name[own[kept]]), name[often], f[often], key=coded.dictionary.take(pa.array(often)).cast(pa.binary()).cast(pa.string()))

    return rows.groupBy("bucket").applyInArrow(run, NAMED)


def named_pairs(rows: DataFrame, fewest: int, send: bool = True) -> DataFrame:
    """Names of the pairs that occur often enough: for each block that has one (block, packed numbers and names), and (name, left, right, f)."""

    def run(rows: pa.Table) -> pa.Table:
        left, right, n, place = [], [], [], []
        for block, base, packed in zip(*(rows.column(c).to_pylist() for c in ("block", "base", "packed")), strict=True):
            (a, b, m), _ = unpack(packed, 3)
            left.append(np.cumsum(a))
            right.append(b)
            n.append(m)
            place.append((block << LOCAL) + base + np.arange(len(a)))
        left, right, n, place = (np.concatenate(x) for x in (left, right, n, place))
        order = np.lexsort((place, right, left))
        left, right, n, place = left[order], right[order], n[order], place[order]
        begin = np.flatnonzero(np.append(True, (np.diff(left) != 0) | (np.diff(right) != 0)))
        f, size = np.add.reduceat(n, begin), np.diff(np.append(begin, len(left)))
        often = f >= fewest
        kept = np.repeat(often, size)
        back = _sent_back(place[kept], np.repeat(place[begin], size)[kept]) if send else []
        at = begin[often]
        return _named(back, place[at], f[often], left=left[at], right=right[at])

    return rows.groupBy("bucket").applyInArrow(run, NAMED)


def adjacent(sequence: np.ndarray, name: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """The different pairs of adjacent names by bucket, left and right name: bucket, left, right, count; and for each place the pair's number (0: none there).

    sequence: numbers, 0 for none; name: of each number, -1 if it has none.
    Numbers of pairs begin with 1.
    """
    own = name[sequence]
    at = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))
    out = np.zeros(max(0, len(sequence) - 1), np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4 + (out,)
    used, small = np.unique(own, return_inverse=True)  # names by size: pairs sort as their names do
    key, number, n = np.unique(small[at] * len(used) + small[at + 1], return_inverse=True, return_counts=True)
    left, right = used[key // len(used)], used[key % len(used)]
    bucket = (mix(left.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mix(right.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    out[at] = rank[number]
    return bucket[order], left[order], right[order], n[order], out


def pair_rows(blocks: DataFrame, words: DataFrame, buckets: int, pairs: DataFrame | None = None) -> DataFrame:
    """(bucket, block, base, packed): each block's different pairs of adjacent named words, or of adjacent named pairs of these, packed by bucket."""
    second = pairs is not None
    level = words.where(F.col("block").isNotNull()).select("block", F.lit(1).alias("level"), "packed")
    if second:
        level = level.unionByName(pairs.where(F.col("block").isNotNull()).select("block", F.lit(2).alias("level"), "packed"))

    def lookup(mapping: pa.Table, level: int, size: int) -> np.ndarray:
        out = np.full(size + 1, -1, np.int64)
        for own, packed in zip(mapping.column("level").to_pylist(), mapping.column("packed").to_pylist(), strict=True):
            if own == level:
                (number, name), _ = unpack(packed, 2)
                out[number] = name
        return out

    def run(sequence: pa.Table, mapping: pa.Table) -> pa.Table:
        out = []
        for block, packed in zip(sequence.column("block").to_pylist(), sequence.column("sequence").to_pylist(), strict=True):
            (own,), _ = unpack(packed, 1)
            bucket, left, right, n, place = adjacent(own, lookup(mapping, 1, int(own.max())), buckets)
            if second:
                bucket, left, right, n, _ = adjacent(place, lookup(mapping, 2, int(place.max(initial=0))), buckets)
            for b, at in in_buckets(bucket):
                out.append((b, block, int(at[0]) + 1, pack(np.diff(left[at], prepend=0), right[at], n[at])))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([x[1] for x in out], pa.int64()), "base": pa.array([x[2] for x in out], pa.int64()), "packed": pa.array([x[3] for x in out], pa.binary())})

    return blocks.groupBy("block").cogroup(level.groupBy("block")).applyInArrow(run, "bucket long, block long, base long, packed binary")


def candidates(documents: DataFrame, fewest: int = FEWEST, percent: int = CONTAINED_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, dropped) of all phrases of two and three words of documents (lang, text).

    A null lang counts as ``und``, a null or empty text has no words; a repeated
    row counts again, other columns are ignored, an empty table has no phrases.
    Counts are exact, so is the score: its products are decimals of 38 digits,
    good for a phrase's count of up to 10^16. dropped: a longer candidate that
    contains the phrase has at least so many percent of its count.
    """
    spark = documents.sparkSession
    path = scratch(spark)
    cut = blocks_of(documents, block_bytes)
    cut.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    read = spark.read.schema(cut.schema).parquet(path)
    blocks = read.where(F.col("kind") == "sequence").select("block", "sequence")
    listed = read.where(F.col("kind") == "word")
    size = read.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()  # a row for each kind
    rows = {r["kind"]: r["rows"] if r["kind"] == "word" else r["n"] for r in size}
    many = {k: max(BUCKETS, rows.get(k, 0) // BUCKET_KEYS) for k in ("word", "sequence")}
    words = stored(named_words(word_rows(listed, many["word"]), fewest))
    pairs = stored(named_pairs(pair_rows(blocks, words, many["sequence"]), fewest))
    triples = stored(named_pairs(pair_rows(blocks, words, many["sequence"], pairs), fewest, send=False).select("left", "right", F.col("f").alias("a")))
    spelled = F.substring_index("key", " ", -1)
    lang = F.substr("key", F.lit(1), F.char_length("key") - F.char_length(spelled) - 1)
    word = words.where(F.col("name").isNotNull()).select("name", lang.alias("lang"), spelled.alias("word"), "f")
    pair = pairs.where(F.col("name").isNotNull()).select("name", "left", "right", "f")
    total = listed.groupBy(lang.alias("lang")).agg(F.sum("n").alias("n"))

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))

    first, second = side(word, "p"), side(word, "q")
    twos = stored(
        pair.join(first, F.col("left") == F.col("p_name")).join(second, F.col("right") == F.col("q_name"))
        .select("name", F.col("p_lang").alias("lang"), F.col("p_word").alias("one"), F.col("q_word").alias("two"), F.col("f").alias("a"), F.col("p_f").alias("l"), F.col("q_f").alias("r"))
    )
    whole = stored(
        triples.join(side(twos.drop("lang"), "p"), F.col("left") == F.col("p_name")).join(side(twos, "q"), F.col("right") == F.col("q_name"))
        .select("left", "right", F.col("q_lang").alias("lang"), F.concat_ws(" ", "p_one", "p_two", "q_two").alias("phrase"), "a", F.col("p_l").alias("l1"), F.col("q_a").alias("r1"), F.col("p_a").alias("l2"), F.col("q_r").alias("r2"))
    )
    longer = whole.select(F.col("left").alias("name"), "a").unionByName(whole.select(F.col("right").alias("name"), "a")).groupBy("name").agg(F.max("a").alias("longer"))
    two = twos.join(longer, "name", "left").select(
        "lang", F.concat_ws(" ", "one", "two").alias("phrase"), "a", "l", "r", score("a", "l", "r").alias("score"), (F.lit(100) * F.coalesce("longer", F.lit(0)) >= F.lit(percent) * F.col("a")).alias("dropped")
    )
    cuts = whole.withColumn("s1", score("a", "l1", "r1")).withColumn("s2", score("a", "l2", "r2"))
    at_first = F.col("s1") <= F.col("s2")
    three = cuts.select("lang", "phrase", "a", F.when(at_first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(at_first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"), F.lit(False).alias("dropped"))
    return two.unionByName(three).join(total, "lang").select("lang", "phrase", "a", "l", "r", "n", "score", "dropped")


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000*a*a/(left*right)), exactly: decimals of 38 digits hold the products, div gives a whole number."""
    return F.expr(f"(CAST({a} AS decimal(16,0)) * CAST({a} AS decimal(16,0)) * CAST(1000000 AS decimal(7,0))) div (CAST({left} AS decimal(19,0)) * CAST({right} AS decimal(18,0)))")


def phrases(documents: DataFrame, fewest: int = FEWEST, percent: int = CONTAINED_PERCENT, top: int = TOP) -> DataFrame:
    """Each language's first phrases by score, count and phrase: (lang, rank, phrase, a, l, r, n, score)."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = candidates(documents, fewest, percent).where(~F.col("dropped")).drop("dropped").withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(SHARDS)))
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "shard").orderBy(*order))).where(F.col("rank") <= top)  # a language may hold most phrases
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return phrases(table(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM {documents}),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM worded, range(1, 4) t(k)),
freq AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM freq WHERE k = 1 GROUP BY lang),
halves AS (
  SELECT lang, k, g, f, j, array_to_string(string_split(g, ' ')[1:j], ' ') AS head, array_to_string(string_split(g, ' ')[j + 1:], ' ') AS tail
  FROM freq JOIN range(1, 3) s(j) ON k > j WHERE f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.g, c.f AS a, x.f AS l, y.f AS r, c.j,
         CAST(1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM halves c JOIN freq x ON x.lang = c.lang AND x.g = c.head JOIN freq y ON y.lang = c.lang AND y.g = c.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inside AS (
  SELECT DISTINCT s.lang, s.g FROM lowest s JOIN (
    SELECT lang, array_to_string(string_split(g, ' ')[i:i + 1], ' ') AS part, a FROM lowest, range(1, 3) t(i) WHERE k = 3) t
  ON s.lang = t.lang AND s.g = t.part AND 100 * t.a >= 50 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM lowest JOIN sizes USING (lang) ANTI JOIN inside USING (lang, g)
QUALIFY rank <= 2000
"""
