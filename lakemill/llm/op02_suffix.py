"""Exact removal of long byte strings that repeat anywhere in the corpus, by run-length indexes.

A string of LENGTH bytes contains a smallest KMER-byte hash, its anchor, whose
place depends on the string's bytes alone; so all copies of a string share an
anchor at the same place. Anchors are first only counted: one that occurs once
settles that nothing repeats there, and only the others move with their places.
What surrounds a repeated anchor as far as the string may reach, its context, is
folded with identical contexts: those repeat as a whole. Where the contexts of an
anchor differ, one of each kind goes to the index of its anchor's bucket. Texts
that stand more than once are folded before all this and go wholly.

A bucket's index is a run-compressed Burrows-Wheeler transform with the suffix
array sampled at the ends of runs. Inside a run the suffix before (in sorted
order) moves along with the text, so the samples give each text position's
neighbour, and the match with the neighbour, measured at the samples only,
shrinks by one with each step: streaming over the text gives its matching
statistics against everything else in the bucket. Matches of LENGTH bytes and
more are marked on both sides.

A crowd of different contexts around one anchor (the edge of a passage that very
many documents quote) is too large for an index. It is split by where the
string starts relative to the anchor, first into ranges, by the bytes that all
strings of the range share, then into single starts, whose strings are compared
by their hashes. That is exact, and hashes are aggregated before they move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import batch, chunks, mix, pieces, prefix_sums, stored, stretch_hash, table, utf8

LENGTH, KMER = 400, 128
#: A row's id, of 128 bits.
RID = ["rid", "rid2"]
#: Different contexts of an anchor beyond which its crowd is split; bytes of a bucket.
CROWD, BUCKET_BYTES = 1500, 1 << 20
#: Starts in a range of a crowd's first split.
RANGE = 18


def sliding(x: np.ndarray, width: int, f: np.ufunc, pad: int) -> np.ndarray:
    """f over x[i : i+width] for each i, with ``pad`` beyond the end."""
    n = len(x)
    blocks = -(-(n + width) // width)
    full = np.full(blocks * width, pad, x.dtype)
    full[:n] = x
    full = full.reshape(blocks, width)
    ahead = f.accumulate(full, axis=1).ravel()
    behind = f.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, ...]:
    """Row, place in the row, hash and context hash of the anchors of all strings of ``length`` bytes inside the rows."""
    n, width, top = len(data), length - kmer + 1, np.iinfo(np.uint32).max
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    sums, down = prefix_sums(data)
    hashes = mix((sums[kmer:] - sums[:-kmer]) * down[: n - kmer + 1])
    order = np.minimum((hashes >> np.uint64(32)).astype(np.uint32), top - 1)  # anchors are least in the upper half
    least = sliding(order, width, np.minimum, top)[: n - length + 1]
    valid = np.zeros(n + 1, np.int32)  # strings that start here lie inside a row
    long = np.diff(starts) >= length
    np.add.at(valid, starts[:-1][long], 1)
    np.add.at(valid, starts[1:][long] - length + 1, -1)
    least[np.cumsum(valid)[: len(least)] == 0] = 0
    # A place is an anchor if its hash is the least of some string: the largest least of the strings around it.
    padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(max(0, len(order) - len(least)), np.uint32)])
    best = sliding(padded, width, np.maximum, 0)[: len(order)]
    place = np.flatnonzero(best == order)
    row = np.searchsorted(starts, place, side="right") - 1
    low, high = np.maximum(starts[row], place - (length - kmer)), np.minimum(starts[row + 1], place + length)
    context = mix(stretch_hash(sums, down, low, high) + (place - low).astype(np.uint64))
    return row, place - starts[row], hashes[place], context


def find_anchors(documents: DataFrame, length: int, kmer: int) -> DataFrame:
    """(rid, rid2, pos, h, c): rows' anchors with the hash of their context; of texts that a task meets again only the first row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for rows in batches:
            data, starts = utf8(rows.column(2))
            first = np.ones(rows.num_rows, bool)
            for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                if b - a < length:
                    first[i] = False
                elif (digest := hashlib.blake2b(data[a:b], digest_size=16).digest()) in met:
                    first[i] = False
                else:
                    met.add(digest)
            if not first.all():
                rows = rows.filter(pa.array(first))
                data, starts = utf8(rows.column(2))
            rid, rid2 = (rows.column(i).to_numpy() for i in (0, 1))
            for low, high in chunks(starts):
                row, place, h, c = anchors(data[starts[low] : starts[high]], starts[low : high + 1] - starts[low], length, kmer)
                yield batch(rid=rid[low:high][row], rid2=rid2[low:high][row], pos=place.astype(np.int32), h=h.view(np.int64), c=c.view(np.int64))

    return documents.select(*RID, "text").mapInArrow(run, "rid long, rid2 long, pos int, h long, c long")


def suffix_array(text: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """By doubling; only what is unsettled is sorted again.

    text: symbols from 1 on, 0 for a separator; separators are in the order of
    their places. rest: how far each place is from the next separator.
    """
    n, depth = len(text), 7
    padded, packed = np.concatenate([text, np.zeros(depth, text.dtype)]), np.zeros(n, np.int64)
    for k in range(depth):
        packed = (packed << 9) | padded[k : k + n]
    short = rest < depth
    packed[short] &= ~((np.int64(1) << (9 * (depth - rest[short]))) - 1)  # nothing counts beyond a separator
    order = np.argsort(packed).astype(np.int32)
    slots = np.flatnonzero(short[order])  # equal up to a separator: by place
    order[slots] = order[slots][np.lexsort((order[slots], packed[order[slots]]))]
    new = np.ones(n, bool)
    new[1:] = packed[order[1:]] != packed[order[:-1]]
    new |= short[order]
    del packed, padded
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    while depth < n:
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = np.flatnonzero(~alone)  # places in the order that share a rank with a neighbour
        if not len(slots):
            break
        who = order[slots]
        ahead = who.astype(np.int64) + depth
        key = rank[who].astype(np.int64) * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        again = np.argsort(key)
        who, key = who[again], key[again]
        order[slots] = who
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[slots] = fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, slots, 0)).astype(np.int32)
        depth *= 2
    return order.astype(np.int64)


def common_prefix(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix at a and b, at most ``most``, by halving over hashes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = stretch_hash(sums, down, a, a + middle) == stretch_hash(sums, down, b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def run_index(segments: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The run-length index of some byte strings.

    begin, end: of the segments in the joined text. symbol, times: the
    run-compressed transform, separators as negative numbers of their own.
    sample: the text positions before which a run begins, in text order;
    neighbour: the position of the suffix before theirs; match: how far the two
    agree.
    """
    lengths = np.array([len(s) for s in segments])
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    end = begin + lengths
    raw = np.zeros(int(end[-1]) + 1, np.uint8)
    for s, a, b in zip(segments, begin, end, strict=True):
        raw[a:b] = s
    text = raw.astype(np.int16) + 1
    text[end] = 0
    rest = np.repeat(end, lengths + 1) - np.arange(len(raw))
    order = suffix_array(text, rest)
    before = text[order - 1].astype(np.int64)  # the transform; before the first symbol stands the last separator
    before[before == 0] = -order[before == 0]  # separators are symbols of their own
    head = np.ones(len(order), bool)
    head[1:] = before[1:] != before[:-1]
    head[0] = False  # nothing stands before the first suffix
    heads = np.flatnonzero(head)
    sample, neighbour = order[heads], order[heads - 1]
    runs = np.append(0, heads)
    sums, down = prefix_sums(raw)
    match = common_prefix(sums, down, sample, neighbour, np.minimum(rest[sample], rest[neighbour]))
    by_text = np.argsort(sample)
    return {"begin": begin, "end": end, "sample": sample[by_text], "neighbour": neighbour[by_text], "match": match[by_text], "symbol": before[runs], "times": np.diff(np.append(runs, len(order))), "size": np.array(len(raw))}


def long_matches(index: dict[str, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (start, end) of the joined text that lie in a string of ``length`` that stands twice in it.

    From a sample on, up to the next, the match with the neighbour shrinks by one
    a step; both sides are marked while it is long enough.
    """
    sample, match = index["sample"], index["match"]
    following = np.append(sample[1:], index["size"])
    good = match >= length
    steps = np.minimum(following[good] - 1 - sample[good], match[good] - length)
    a, b = sample[good], index["neighbour"][good]
    return np.concatenate([a, b]), np.concatenate([a, b]) + np.tile(steps, 2) + length


def united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches joined where they overlap or touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _marks_of_bucket(length: int):
    def run(rows: pa.Table) -> pa.Table:
        rid, rid2, at = (rows.column(c).to_numpy() for c in ("rid", "rid2", "at"))
        data, starts = utf8(rows.column("bytes"))
        own = np.unique(np.stack([rid, rid2, at]), axis=1, return_index=True)[1]  # of rows that repeat with their id one
        index = run_index([data[starts[i] : starts[i + 1]] for i in own])
        start, end = united(*long_matches(index, length))
        seg = np.searchsorted(index["begin"], start, side="right") - 1
        shift = at[own[seg]] - index["begin"][seg]
        return pa.table({"rid": rid[own[seg]], "rid2": rid2[own[seg]], "start": (start + shift).astype(np.int64), "end": (end + shift).astype(np.int64)})

    return run


class _Pieces:
    """Rows of contexts that wait to be sent on."""

    def __init__(self) -> None:
        self.columns: tuple[list, ...] = ([], [], [], [], [], [], [])

    def put(self, bucket: int, rid: tuple[int, int], at: int, h: int, pos: int, piece: np.ndarray) -> int:
        for column, value in zip(self.columns, (bucket, *rid, at, h, pos, piece.tobytes()), strict=True):
            column.append(value)
        return len(piece)

    def batch(self) -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 6, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)], names=["bucket", *RID, "at", "h", "pos", "bytes"])


def _contexts(length: int, kmer: int, buckets: int):
    """From documents with their chosen anchors: segments for buckets, and single contexts of crowds (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, starts = utf8(rows.column(2))
            out, waiting = _Pieces(), 0
            for i in range(rows.num_rows):
                rid, low, high = (rows.column(0)[i].as_py(), rows.column(1)[i].as_py()), int(starts[i]), int(starts[i + 1])
                own: dict[int, list[list[int]]] = {}
                for x in sorted(rows.column(3)[i].as_py(), key=lambda x: x["pos"]):
                    a, b = max(0, x["pos"] - (length - kmer)), min(high - low, x["pos"] + length)
                    if x["crowd"]:
                        waiting += out.put(-1, rid, a, x["h"], x["pos"], data[low + a : low + b])
                        continue
                    spans = own.setdefault((x["h"] >> 7) % buckets, [])
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                for bucket, spans in own.items():
                    for a, b in spans:
                        waiting += out.put(bucket, rid, a, 0, 0, data[low + a : low + b])
                if waiting > 1 << 22:
                    yield out.batch()
                    out, waiting = _Pieces(), 0
            if waiting:
                yield out.batch()

    return run


def _crowd_keys(length: int, kmer: int, width: int, single: bool):
    """Hashes of what strings around a crowd's anchor share: of each range of starts, or of each start of the ranges that are given.

    whole: the hash of all bytes that strings of the range cover, if the row has
    them all; rows that agree in it agree in all strings of the range.
    """
    last = length - kmer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            rid, rid2, at, h, pos = (rows.column(k).to_numpy() for k in (*RID, "at", "h", "pos"))
            data, starts = utf8(rows.column("bytes"))
            given = rows.column("part").to_numpy() if single else None
            for low, high in chunks(starts):
                sums, down = prefix_sums(data[starts[low] : starts[high]])
                s, e = starts[low:high] - starts[low], starts[low + 1 : high + 1] - starts[low]
                p = s + (pos - at)[low:high]
                least, most = np.maximum(0, p + length - e), np.minimum(last, p - s)  # bytes of the string before the anchor
                for k in range(width if single else -(-(last + 1) // width)):
                    a = given[low:high] * width + k if single else np.full(high - low, k * width)
                    b = a if single else np.minimum(a + width - 1, last)
                    ok = np.flatnonzero((np.maximum(a, least) <= np.minimum(b, most)) & (a <= last))
                    if not len(ok):
                        continue
                    a, b, q, salt = a[ok], b[ok], p[ok], h[low:high][ok].view(np.uint64) + a[ok].astype(np.uint64)
                    key = mix(stretch_hash(sums, down, q - a, q + length - b) + salt)
                    x, y = np.maximum(q - b, s[ok]), np.minimum(q + length - a, e[ok])
                    whole = mix(stretch_hash(sums, down, x, y) + key + (q - x).astype(np.uint64))
                    yield batch(rid=rid[low:high][ok], rid2=rid2[low:high][ok], pos=pos[low:high][ok], part=a if single else np.full(len(ok), k), key=key.view(np.int64), whole=whole.view(np.int64))

    return run


def runs_shared(asked: DataFrame, alone: DataFrame, keys: list[str]) -> DataFrame:
    """asked's rows (keys, low, high and others) with the runs (first, last) of the numbers from low to high that don't stand in ``alone`` (keys, part).

    What is shared is told by what is not: a number that nobody shares is known by its one row, so that
    shared ones needn't be found again among all, and a row of asked meets at most one other.
    """
    own = alone.groupBy(*keys).agg(F.collect_list("part").alias("alone"))
    numbers = F.array_except(F.sequence("low", "high"), F.coalesce("alone", F.array().cast("array<long>")))
    rest = asked.where("low <= high").join(own, keys, "left").withColumn("rest", numbers).drop("alone")
    first, last = F.filter("rest", lambda x: ~F.array_contains("rest", x - 1)), F.filter("rest", lambda x: ~F.array_contains("rest", x + 1))
    run = F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("run")
    return rest.select(*(c for c in asked.columns if c not in ("low", "high")), run).select("*", "run.first", "run.last").drop("run")


def crowd_marks(contexts: DataFrame, length: int, kmer: int, width: int = RANGE) -> DataFrame:
    """(rid, rid2, start, end) of the repeated strings around the anchors of crowds, given as (rid, rid2, at, upto, h, pos, bytes).

    Marks may reach beyond the document's ends; they are cut there. Rows of
    contexts are told apart by their id and place.
    """
    schema, last = "rid long, rid2 long, pos long, part long, key long, whole long", length - kmer
    kinds = contexts.mapInArrow(_crowd_keys(length, kmer, width, False), schema)
    kinds = stored(kinds.groupBy("key", "whole").agg(F.count("*").alias("m"), *(F.first(c).alias(c) for c in (*RID, "pos", "part"))))
    # Starts relative to the anchor that the row has whole strings for, and their ranges.
    places = contexts.select(*RID, "pos", F.greatest(F.lit(0).cast("long"), F.col("pos") + length - F.col("upto")).alias("least"), F.least(F.lit(last).cast("long"), F.col("pos") - F.col("at")).alias("most"))
    ranges = places.where("least <= most").select(*RID, "pos", F.expr(f"least div {width}").alias("low"), F.expr(f"most div {width}").alias("high"))
    alike = runs_shared(ranges, kinds.where("m = 1").select(*RID, "pos", "part"), [*RID, "pos"]).select(
        *RID, F.greatest(F.lit(0), F.col("pos") - (F.col("last") + 1) * width + 1, F.col("pos") - last).alias("start"), (F.col("pos") - F.col("first") * width + length).alias("end")
    )
    several = stored(kinds.groupBy("key").count().where("count > 1").select("key"))  # stored: the join can then split a hot key's rows
    again = stored(kinds.join(several, "key", "left_semi").select(*RID, "pos", "part"))
    starts = contexts.join(again, [*RID, "pos"]).select(*RID, "at", "h", "pos", "bytes", "part").mapInArrow(_crowd_keys(length, kmer, width, True), schema)
    alone = starts.groupBy("key").agg(F.count("*").alias("m"), *(F.first(c).alias(c) for c in (*RID, "pos", "part"))).where("m = 1")
    asked = places.join(again, [*RID, "pos"]).select(
        *RID, "pos", F.col("part").alias("range_"), F.greatest("least", F.col("part") * width).alias("low"), F.least("most", F.col("part") * width + width - 1).alias("high")
    )
    single = runs_shared(asked, alone.select(*RID, "pos", F.expr(f"part div {width}").alias("range_"), "part"), [*RID, "pos", "range_"])
    return alike.unionByName(single.select(*RID, (F.col("pos") - F.col("last")).alias("start"), (F.col("pos") - F.col("first") + length).alias("end")))


def repeated_spans(documents: DataFrame, length: int = LENGTH, kmer: int = KMER, crowd: int = CROWD, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(rid, rid2, start, end) of byte stretches, possibly overlapping or repeated, whose union is what repeated strings cover.

    Documents are given as (rid, rid2, doc_id, text); rows with equal ids have
    equal texts. Rows whose whole text stands again may lack other stretches than
    the one over all of it, which may reach beyond their end. All columns go with
    the texts to the rows' anchors, so that the caller's own join with the
    documents uses the same exchange.
    """
    texts = documents.where(F.octet_length("text") >= length).select(*RID, F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("t2"))
    times = stored(texts.groupBy("t", "t2").count().where(F.col("count") > 1).select("t", "t2"))
    spans = texts.join(times, ["t", "t2"], "left_semi").select(*RID, F.lit(0).cast("long").alias("start"), F.lit(1 << 62).alias("end"))
    found = find_anchors(documents, length, kmer)
    # Anchors are found twice: to count them, and to send on those that are shared. Keeping all of them would take more disk than the texts.
    counted = found.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    shared = stored(counted.where(F.col("n") > 1).select("h", (F.col("low") != F.col("high")).alias("several")))
    hits = stored(found.join(shared, "h").select(*RID, "pos", "h", "c", "several"))
    # The first values come from the same row.
    kinds = stored(hits.where("several").groupBy("h", "c").agg(F.count("*").alias("m"), *(F.first(c).alias(c) for c in (*RID, "pos"))))
    alike = hits.where("not several").select(*RID, "pos").unionByName(hits.where("several").join(kinds.where(F.col("m") > 1).select("h", "c"), ["h", "c"], "left_semi").select(*RID, "pos"))
    spans = spans.unionByName(alike.select(*RID, F.greatest(F.lit(0), F.col("pos") - (length - kmer)).cast("long").alias("start"), (F.col("pos") + length).cast("long").alias("end")))
    of_anchor = kinds.groupBy("h").agg(F.count("*").alias("d"))
    amount = of_anchor.agg(F.sum("d"), F.max("d")).first()
    if not amount[0]:
        return spans
    buckets = max(1, -(-amount[0] * (2 * length - kmer) // bucket_bytes))
    crowded = of_anchor.where(F.col("d") > crowd).select("h", F.lit(True).alias("crowd"))
    chosen = kinds.join(crowded, "h", "left").groupBy(*RID).agg(F.collect_list(F.struct("pos", "h", F.coalesce("crowd", F.lit(False)).alias("crowd"))).alias("chosen"))
    joined = documents.join(chosen.hint("shuffle_hash"), RID).select(*RID, "text", "chosen", *(c for c in documents.columns if c not in (*RID, "text")))
    contexts = joined.mapInArrow(_contexts(length, kmer, buckets), "bucket long, rid long, rid2 long, at long, h long, pos long, bytes binary")
    indexed = contexts.where("bucket >= 0").groupBy("bucket").applyInArrow(_marks_of_bucket(length), "rid long, rid2 long, start long, end long")
    spans = spans.unionByName(indexed)
    if amount[1] > crowd:
        alone = stored(contexts.where("bucket < 0").dropDuplicates([*RID, "h", "pos"]).select(*RID, "at", (F.col("at") + F.octet_length("bytes")).alias("upto"), "h", "pos", "bytes"))
        spans = spans.unionByName(crowd_marks(alone, length, kmer))
    return spans


def remove_repeats(documents: DataFrame, length: int = LENGTH, kmer: int = KMER, crowd: int = CROWD, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text (what is kept, as bytes), n_bytes, n_removed, n_spans of every row.

    Every byte that a string of ``length`` bytes covers which also starts
    anywhere else in the corpus, in the same document or another, is removed;
    strings are judged on the input. A null text is empty. Repeated rows are
    documents of their own, so their long texts go wholly. Texts shorter than
    ``length`` stay. An empty table gives an empty table; columns other than
    doc_id and text are ignored.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"rid": F.xxhash64(F.col("doc_id").cast("string"), "text"), "rid2": F.xxhash64(F.lit(1), F.col("doc_id").cast("string"), "text")})
    spans = repeated_spans(rows, length, kmer, crowd, bucket_bytes)
    marks = spans.groupBy(*RID).agg(F.collect_set(F.struct("start", "end")).alias("marks"))
    joined = rows.join(marks.hint("shuffle_hash"), RID, "left").select("doc_id", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            data, starts = utf8(b.column(1))
            kept, removed, n_spans = [], [], []
            lists = b.column(2)
            fields = lists.flatten()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            start_, end_ = fields.field(0).to_numpy(), fields.field(1).to_numpy()
            raw = data.tobytes()
            for i, (low, high) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                text = raw[low:high]
                s, e = united(start_[ends[i] : ends[i + 1]], np.minimum(end_[ends[i] : ends[i + 1]], high - low))
                if len(s):
                    cuts = np.concatenate([[0], e]), np.concatenate([s, [high - low]])
                    text = b"".join(text[x:y] for x, y in zip(*cuts, strict=True))
                kept.append(text)
                removed.append(int((e - s).sum()))
                n_spans.append(len(s))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.binary()), pa.array(np.diff(starts)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64())],
                names=["doc_id", "text", "n_bytes", "n_removed", "n_spans"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, text binary, n_bytes long, n_removed long, n_spans long")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and the digest of what is kept."""
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))
