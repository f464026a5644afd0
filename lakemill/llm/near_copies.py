"""Near copies of similarity 0.8 and more on five-word shingles, found by SimHash fingerprints in BK-trees.

At this similarity fingerprints differ in some ten bits and up to RADIUS, too many
for groups of bits to deal them by. Shards come from the smallest shingle hashes
instead: two texts that share BAND_ROWS of them in one of BANDS bands meet in a
shard. A shard's fingerprints are searched in a BK-tree; pairs within the radius
that aren't in one component yet are compared by their sketches, the smallest
SKETCH hashes of each text, which are all of them for texts of that many
shingles and less: nearest first, and only until they are linked. So a crowd of
near copies takes few comparisons, and gives as many links as members.

A sketch that isn't whole decides nothing but what is clearly below the
similarity (by MARGIN). Links it proposes are verified on both texts' whole sets
of shingle hashes, joined in Spark. Where one fails, its shard is searched again
with what is known to be linked, and every pair that is left is verified.

A band that more than CROWD different texts share is dealt into shards of about
that many; some leaders, drawn by a hash, stand in each of them, so that what is
alike all over the crowd is linked by way of them. What isn't linked with the
crowd's largest component then meets every shard of the crowd. So no pair of a
crowd is left out, and no task gets more than a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import batch, chunks, if_small, mix, pieces, stored, utf8
from lakemill.llm.components import components
from lakemill.llm.op09_simhash import bits, fingerprint_of, forest, near, shingle_hashes

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24
BANDS, BAND_ROWS, SKETCH = 20, 4, 256
#: Nearly five standard deviations of what sketches say of a pair at the similarity.
MARGIN = 0.12
#: Bytes of sketches of a partition of shards.
PARTITION_BYTES = 16 << 20
#: Different texts of a band beyond which it is dealt into shards of so many, and how many texts of it stand in each.
CROWD, LEADERS = 4096, 64


def hash_set(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    parts = list(shingle_hashes(text, SHINGLE))
    return np.unique(mix(np.concatenate(parts))) if parts else np.zeros(0, np.uint64)


def sketched(text: bytes) -> tuple[int, list[int], bytes, int]:
    """Fingerprint of the distinct shingles, band keys, sketch and number of shingles of a text; without words no keys."""
    hashes = hash_set(text)
    if not len(hashes):
        return 0, [], b"", 0
    fp = fingerprint_of(iter([hashes]))  # of distinct shingles, as similarity is: lines that repeat turn no bits
    slots = BANDS * BAND_ROWS
    slot, value = (hashes & np.uint64(0xFFFF)) % np.uint64(slots), hashes >> np.uint64(16)
    least = np.full(slots, np.iinfo(np.uint64).max)
    order = np.argsort(slot, kind="stable")  # hashes are sorted: the first of a slot is its least
    first = np.flatnonzero(np.append(True, np.diff(slot[order].astype(np.int64)) != 0))
    least[slot[order][first].astype(np.int64)] = value[order][first]
    full = np.flatnonzero(least != np.iinfo(np.uint64).max)
    after = full[np.searchsorted(full, np.arange(slots)) % len(full)]  # an empty slot takes the next one's
    least = least[after] + ((after - np.arange(slots)) % slots).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = mix(least).reshape(BANDS, BAND_ROWS)
    keys = mix((keys * np.array([1, 3, 5, 7], np.uint64)).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return fp, keys.view(np.int64).tolist(), hashes[:SKETCH].tobytes(), len(hashes)


def similarity(a: np.ndarray, b: np.ndarray, whole: bool = False) -> float:
    """Of two sketches: the share in both among the smallest of their union; exact if both are whole."""
    both = np.intersect1d(a, b, assume_unique=True)
    if whole or len(a) < SKETCH and len(b) < SKETCH:
        return len(both) / max(1, len(a) + len(b) - len(both))
    union = np.union1d(a, b)[:SKETCH]
    return np.searchsorted(both, union[-1], side="right") / len(union)


def shard_links(
    keys: np.ndarray, fps: np.ndarray, sizes: np.ndarray, texts: np.ndarray, sketches: list[np.ndarray], roots: np.ndarray | None = None, least: float = SIMILARITY, radius: int = RADIUS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between rows of a shard, as (key, text, text, whether it is certain); rows are sorted by key.

    At first, links that aren't certain count as links too if the sketches say
    so, and those within the margin below are given if nothing else links their
    ends. With ``roots``, each text's component by verified links, only what is
    certain counts, and every other pair that isn't ruled out is given.
    """
    out: list[tuple[int, int, int, bool]] = []
    doubtful: list[tuple[int, int]] = []
    tree, label = forest(keys, fps), np.arange(len(keys))
    low, high = np.searchsorted(keys, keys), np.searchsorted(keys, keys, side="right")
    if roots is not None:
        _, first, which = np.unique(np.stack([low, roots]), axis=1, return_index=True, return_inverse=True)
        label = first[which.ravel()]
    for at in range(0, len(keys), 256):
        pairs = list(near(tree, fps, np.arange(at, min(at + 256, len(keys))), radius))
        a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])
        later = (b < a) & (np.minimum(sizes[a], sizes[b]) >= least * np.maximum(sizes[a], sizes[b]))  # each pair once; sizes further apart rule it out
        a, b = a[later], b[later]
        order = np.lexsort((bits(fps[a] ^ fps[b]), a))
        a, b = a[order], b[order]
        for start, end in zip(*(np.searchsorted(a, np.unique(a), side=side) for side in ("left", "right")), strict=True):
            x, others = int(a[start]), b[start:end]
            while len(others):  # nearest first; those of a component that is joined need no comparison
                y, others = int(others[0]), others[1:]
                if label[x] == label[y]:
                    continue
                certain = bool(max(sizes[x], sizes[y]) <= SKETCH)
                share = similarity(sketches[x], sketches[y], certain)
                if share < least - (0 if certain else MARGIN):
                    continue
                if not certain and (share < least or roots is not None):
                    doubtful.append((x, y))
                    continue
                own = label[low[x] : high[x]]
                first, second = sorted((label[x], label[y]))
                own[own == second] = first
                out.append((keys[x], texts[x], texts[y], certain))
                others = others[label[others] != first]
    out += [(keys[x], texts[x], texts[y], False) for x, y in doubtful if label[x] != label[y]]
    return tuple(np.array([o[i] for o in out], kind) for i, kind in enumerate((np.int64, np.int64, np.int64, bool)))


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of texts and whether they are that similar (linked), by their whole sets of shingle hashes. texts: (tid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            data, starts = utf8(b.column(1))
            for low, high in chunks(starts):
                sets = [hash_set(data[x:y].tobytes()).view(np.int64) for x, y in zip(starts[low:high].tolist(), starts[low + 1 : high + 1].tolist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], names=["tid", "set"])

    ends = stored(pairs.select(F.col("a").alias("tid")).union(pairs.select("b")).distinct())
    wanted = texts.join(if_small(ends), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    sets = stored(wanted.mapInArrow(run, "tid binary, set array<long>"))
    one, two = (sets.select(F.col("tid").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return stored(joined.select("a", "b", (F.col("both") >= least * (F.col("sum") - F.col("both"))).alias("linked")))


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition of shards: rows (shard, tid, fp, size, sketch), and root if it is known."""
    own = [b for b in batches if b.num_rows]
    if not own:
        return
    rows = pa.Table.from_batches(own).combine_chunks()
    shard, fp, size = (rows.column(c).to_numpy() for c in ("shard", "fp", "size"))
    text = rows.column("tid").dictionary_encode().combine_chunks()
    code = text.indices.to_numpy()
    order = np.lexsort((code, shard))
    once = np.append(True, (np.diff(shard[order]) != 0) | (np.diff(code[order]) != 0))  # a text may come to a shard twice
    order = order[once]
    sketches = [np.frombuffer(x, np.uint64) for x in rows.column("sketch").take(pa.array(order)).to_pylist()]
    roots = rows.column("root").dictionary_encode().combine_chunks().indices.to_numpy()[order] if "root" in rows.column_names else None
    key, a, b, certain = shard_links(shard[order], fp[order].view(np.uint64), size[order], code[order], sketches, roots)
    tid = text.dictionary
    yield batch(shard=key, a=tid.take(pa.array(a)), b=tid.take(pa.array(b)), certain=certain)


def one_of_each(documents: DataFrame, crowd: int = CROWD, leaders: int = LEADERS) -> DataFrame:
    """The documents less near copies: of each group the one with the smallest doc_id stays, null ids last.

    Groups are components of links between texts; equal texts are linked, and a
    null text is an empty one, so of documents without text one stays. Texts
    without words other than that are linked to nothing. Of repeated rows one
    stays. Other columns pass through, whatever their names.
    """
    spark = documents.sparkSession
    tid = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("tid")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col("doc_id").alias("doc"), tid)
    texts = documents.select(tid, "text")
    order = F.struct(F.col("doc").isNull().alias("without"), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            data, starts = utf8(b.column(2))
            raw = data.tobytes()
            fp, keys, sketch, size = zip(*(sketched(raw[x:y]) for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["tid", "doc", "fp", "size", "keys", "sketch"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    made = stored(documents.select(tid, F.col("doc_id").alias("doc"), "text").mapInArrow(run, f"tid binary, doc {kind}, fp long, size long, keys array<long>, sketch binary"))
    sketches = made.groupBy("tid").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))  # before any join: copies fold before they move
    met = made.select("tid", F.explode("keys").alias("key")).distinct()
    sizes = stored(met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    parts = F.ceil(F.col("n") / crowd)
    met = stored(met.join(sizes, "key").select("key", "tid", "n", F.when(F.col("n") > crowd, F.pmod(F.xxhash64("tid"), parts)).alias("part")))
    sketches = stored(sketches.join(met.select("tid").distinct(), "tid", "left_semi"))  # of the texts that meet others, once for all searches
    crowds = met.where("part IS NOT NULL")
    many = not crowds.isEmpty()
    shards = met.select(F.when(F.col("part").isNull(), F.col("key")).otherwise(F.xxhash64("key", "part")).alias("shard"), "tid", "key")
    if many:
        drawn = F.pmod(F.xxhash64("tid", "key"), F.lit(1 << 32)) < F.lit(float(leaders << 32)) / F.col("n")
        stand = crowds.where(drawn).select("key", "tid", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part"))
        shards = shards.unionByName(stand.select(F.xxhash64("key", "part").alias("shard"), "tid", "key"))

    def search(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links by shard, and the distinct pairs that are to be verified."""
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards.count() * SKETCH * 8 // PARTITION_BYTES))
        found = shards.join(sketches, "tid").repartition(partitions, "shard").mapInArrow(_link, "shard long, a binary, b binary, certain boolean")
        found = stored(found.select("shard", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "certain"))
        return found, found.where("not certain").select("a", "b").distinct()

    found, open_ = search(shards.select("shard", "tid"))
    known = verified(open_, texts)
    links = found.where("certain").select("a", "b").unionByName(known.where("linked").select("a", "b"))
    roots = components(links)
    failed = found.where("not certain").join(known.where("not linked"), ["a", "b"], "left_semi").select("shard").distinct()
    again = shards.select("shard", "tid").join(failed, "shard", "left_semi")
    if many:
        again = again.unionByName(_apart(crowds, roots, crowd))
    if not again.isEmpty():
        rooted = again.join(roots.withColumnRenamed("node", "tid"), "tid", "left").select("shard", "tid", F.coalesce("root", "tid").alias("root"))
        found, open_ = search(rooted)
        more = verified(open_.join(known, ["a", "b"], "left_anti"), texts)
        links = links.unionByName(more.where("linked").select("a", "b")).unionByName(found.where("certain").select("a", "b"))
        roots = components(links)
    first = made.groupBy("tid").agg(F.min(order).alias("least"))
    rooted = first.join(roots, first["tid"] == roots["node"], "left").select("tid", "least", F.coalesce("root", "tid").alias("root"))
    stay = rooted.groupBy("root").agg(F.min(F.struct("least", "tid")).alias("one")).select(F.col("one.tid").alias("k_tid"), F.col("one.least.doc").alias("k_doc"))
    times = made.groupBy("tid", "doc").count().where(F.col("count") > 1).select(F.col("tid").alias("r_tid"), F.col("doc").alias("r_doc"), F.lit(True).alias("again"))
    stay = stored(stay.join(times, (F.col("k_tid") == F.col("r_tid")) & F.col("k_doc").eqNullSafe(F.col("r_doc")), "left").select("k_tid", "k_doc", F.coalesce("again", F.lit(False)).alias("again")))
    kept = rows.join(stay.hint("shuffle_hash"), (F.col("tid") == F.col("k_tid")) & F.col("doc").eqNullSafe(F.col("k_doc")))
    out = kept.where(~F.col("again"))
    if not stay.where("again").isEmpty():  # rows that repeat with their id: one of each
        out = out.unionByName(kept.where("again").dropDuplicates(["tid"]))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in documents.columns))


def _apart(crowds: DataFrame, roots: DataFrame, crowd: int) -> DataFrame:
    """(shard, tid): every shard of a crowd beside the texts that aren't linked with the crowd's largest component, in blocks.

    crowds: (key, tid, n, part).
    """
    members = stored(crowds.join(roots, crowds["tid"] == roots["node"], "left").select("key", "tid", "n", "part", F.coalesce("root", "tid").alias("root")))
    largest = members.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
    largest = stored(largest)
    rest = members.join(largest, "key").where(F.col("root") != F.col("largest"))
    blocks = stored(rest.groupBy("key").agg(F.ceil(F.count("*") / crowd).alias("blocks")))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    here = members.join(blocks, "key").select("key", "tid", "part", upto(F.col("blocks")).alias("block"))
    there = rest.join(blocks, "key").select("key", "tid", upto(F.ceil(F.col("n") / crowd)).alias("part"), F.pmod(F.xxhash64("tid", "part"), F.col("blocks")).alias("block"))
    return here.unionByName(there.select(*here.columns)).select(F.xxhash64("key", "part", "block").alias("shard"), "tid")
