"""Language-model scores by causal self-attention over subword ids, trained and run in numpy.

A text in lower case becomes subword ids of a public byte-level vocabulary. One
block of causal self-attention over a window of ids gives weights of MIX + 1
distributions over all ids, whose mixture is the next id's probability. MIX of
them are the model's own, learned; the last is that of the ids that follow the id
before, by counts over the whole training part of the corpus. Windows overlap by
half: each scores its second half only, with the first as context (a text's first
window scores all), so each id is scored once. All windows of a batch are computed
together, with a mask for what lies ahead and for padding.

What the model is made of comes from counts over the whole training part: which ids
have an embedding or stand for themselves as the id before, and the clusters of ids
that the learned distributions begin as, found by how often the frequent ids stand
before and behind each id. Training takes all training texts: each id is learned
from once at least, in windows that don't overlap. In a round each task descends on its windows from the same weights; Spark adds up the
tasks' weights, and how much each id owes to each distribution, and the next round
begins from the mean and with distributions made of those sums.

The base score comes from counts of words over the whole training part. Frequent
words (found in some documents; which ones they are changes no result) are
counted in place; of the others, a row for each document and word goes to its
word's partition and a sum for each document comes back.
"""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.llm.common import LOWER, Adam, batch, chunks, fold, map_batches, mix, pieces, prefix_sums, stored, stretch_hash, table, utf8, words_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's pre-tokenizer, as published with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
IDS, END = 50257, 50256
WINDOW, HALF = 16, 8
WIDTH, HIDDEN, MIX = 8, 16, 64
#: Ids with an embedding of their own; the others share some rows.
OWN, SHARED = 4096, 1024
#: Frequent ids that stand for themselves as the id before; the others stand for their cluster. Weight of ids' plain shares beside such counts.
KEYS, SMOOTHING = 64, 8.0
#: The words that are counted in place, and about how many documents propose them.
FREQUENT, PROPOSERS = 1 << 17, 8000
#: What ids are clustered by: the most frequent ids beside them, each by itself, and the others in so many heaps.
NEAR, HEAPS = 96, 32
#: Tasks that count pairs of ids, for each core: what they send has a bound a task, so it doesn't grow with the texts.
COUNTING = 4
#: Training windows of a round at least, if there are; windows of a task, up to four times as many in a large corpus; rounds; and how much of a distribution is that which it began with.
LEAST_WINDOWS, TASK_WINDOWS, ROUNDS, KEPT = 40000, 50000, 6, 0.1
#: Training steps: windows of one, rate at first, and the longest gradient that is followed as it is.
STEP_WINDOWS, RATE, STEEPEST = 64, 0.01, 1.0
#: Weights in a row of what a task sends.
SENT = 1024
FOLDS, LEFT_OUT = 7, 2
_SLOTS = 1 << 21


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    if SparkFiles._is_running_on_worker:  # executors have it from Spark, at whatever path
        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def subwords(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Ids of a text in lower case (A-Z only)."""
    lower = text.encode("utf-8", "replace").lower().decode("utf-8")
    return np.frombuffer(array("H", encoding(path).encode_ordinary(lower)), np.uint16)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    first, last, upto = words_of(data, starts)
    return stretch_hash(*prefix_sums(data), first, last), upto


def pairs_of(ids: np.ndarray, key_of: np.ndarray) -> np.ndarray:
    """key * IDS + id of each of a text's ids and its end, the key being of the id before; the end sign stands before the first."""
    ids = ids.astype(np.int64)
    return key_of[np.append(END, ids)] * IDS + np.append(ids, END)


@dataclass
class Frequent:
    """Words that are counted in place. A word that finds its slot taken in a table goes to the next one."""

    hashes: np.ndarray
    tables: list[np.ndarray]

    @staticmethod
    def of(hashes: np.ndarray) -> Frequent:
        hashes = hashes if len(hashes) else np.zeros(1, np.uint64)
        tables, waiting = [], np.arange(len(hashes))
        for level in range(3):
            slots = np.zeros(_SLOTS, np.int32)
            at = Frequent._slot(hashes[waiting], level)
            slots[at] = waiting
            tables.append(slots)
            waiting = waiting[slots[at] != waiting]
        return Frequent(hashes, tables)

    def __reduce__(self):
        return Frequent.of, (self.hashes,)  # tables are made anew where they are used: they are larger than what they are made of

    @staticmethod
    def _slot(hashes: np.ndarray, level: int) -> np.ndarray:
        return (hashes >> np.uint64(21 * level) & np.uint64(_SLOTS - 1)).astype(np.int64)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Of each word its place, or -1."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, slots in enumerate(self.tables):
            own = hashes[left]
            at = slots[self._slot(own, level)]
            hit = self.hashes[at] == own
            out[left[hit]] = at[hit]
            left = left[~hit]
        return out


def propose_words(documents: DataFrame, rows: int, proposers: int = PROPOSERS, frequent: int = FREQUENT) -> Frequent:
    """The most frequent words of about so many documents, chosen by a hash of their id."""
    some = documents.where(F.pmod(F.xxhash64("rid"), F.lit(max(1, rows // proposers))) == 0).select("text")

    def run(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, starts = utf8(rows.column(0))
        for low, high in chunks(starts):
            words, n = np.unique(word_hashes(data[starts[low] : starts[high]], starts[low : high + 1] - starts[low])[0], return_counts=True)
            yield batch(word=words.view(np.int64), n=n)

    top = map_batches(some, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(frequent).select("word")
    return Frequent.of(np.sort(top.toPandas()["word"].to_numpy(np.int64)).view(np.uint64))


def tokenized(documents: DataFrame, words: Frequent, path: str) -> DataFrame:
    """kind 0: a row a document with its ids, which telling whether it is for training. kind 1 and 2: counts over the training part, of frequent words and of ids;
    word -1 counts the training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "rid", "ids", "which", "n"]
        counts, seen, total = np.zeros(len(words.hashes), np.int64), np.zeros(IDS, np.int64), 0

        def rows_of(kind: int, which: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            m = len(which)
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(which), pa.array(n)], names=names)

        for rows in pieces(batches):
            train = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            texts = rows.column(1)
            data, starts = utf8(texts)
            for low, high in chunks(starts):
                hashes, upto = word_hashes(data[starts[low] : starts[high]], starts[low : high + 1] - starts[low])
                mine = np.repeat(train[low:high], np.diff(upto))
                place = words.place(hashes[mine])
                counts += np.bincount(place[place >= 0], minlength=len(counts))
                total += int(mine.sum()) + int(train[low:high].sum())
            out, learned = [], []
            for i, text in enumerate(texts.to_pylist()):
                ids = subwords(text or "", path)
                out.append(ids.tobytes())
                if train[i]:
                    learned.append(ids)
                    seen[END] += 1
            if learned:
                seen += np.bincount(np.concatenate(learned), minlength=IDS)
            m = rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int32)), rows.column(0).cast(pa.int64()), pa.array(out, pa.binary()), pa.array(train.astype(np.int64)), pa.nulls(m, pa.int64())], names=names
            )
        for kind, own in ((1, counts), (2, seen)):
            some = np.flatnonzero(own)
            yield rows_of(kind, some, own[some])
        yield rows_of(1, np.array([-1]), np.array([total]))

    return stored(documents.select("rid", "text", "train").mapInArrow(run, "kind int, rid long, ids binary, which long, n long"), "kind")


def beside(tokens: DataFrame, before: np.ndarray, ahead: np.ndarray | None = None) -> np.ndarray:
    """Counts (keys x ids) over the whole training part: of ids beside the key of the id before, and in further rows beside that of the id ahead.

    The end sign stands around each text. The driver gets a row of at most IDS counts a key.
    """
    behind = int(before.max()) + 1
    keys = behind + (0 if ahead is None else int(ahead.max()) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(keys * IDS, np.int32)
        for rows in pieces(batches, 256):
            own = [np.frombuffer(x, np.uint16) for x in rows.column(0).to_pylist()]
            if own:
                np.add.at(counts, np.concatenate([pairs_of(x, before) for x in own]), 1)
                if ahead is not None:
                    np.add.at(counts, behind * IDS + np.concatenate([pairs_of(x[::-1], ahead) for x in own]), 1)
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 1 << 18):
            yield batch(which=some[at : at + (1 << 18)], n=counts[some[at : at + (1 << 18)]].astype(np.int64))

    training = tokens.where("kind = 0 AND which = 1").select("ids").coalesce(COUNTING * tokens.sparkSession.sparkContext.defaultParallelism)
    found = training.mapInArrow(run, "which long, n long").groupBy("which").agg(F.sum("n").alias("n"))
    out = np.zeros(keys * IDS, np.float32)
    for row in found.groupBy((F.col("which") / IDS).cast("int").alias("key")).agg(F.collect_list("which").alias("which"), F.collect_list("n").alias("n")).toLocalIterator():
        out[np.array(row["which"])] = row["n"]
    return out.reshape(keys, IDS)


def base_parts(documents: DataFrame, words: Frequent, counts: np.ndarray) -> DataFrame:
    """For each rid: copies (rows with it), n_words, n_known, logs (sum over words of log10(c+1)) and fresh (words whose count it stands for)."""
    logs = np.log10(counts + 1.0)

    def run(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rid, train = rows.column(0).to_numpy(), rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
        data, starts = utf8(rows.column(1))
        for low, high in chunks(starts):
            hashes, upto = word_hashes(data[starts[low] : starts[high]], starts[low : high + 1] - starts[low])
            row = np.repeat(np.arange(high - low), np.diff(upto))
            place = words.place(hashes)
            own = place >= 0
            m = high - low
            known = np.bincount(row[own], counts[place[own]] > 0, m).astype(np.int64)
            sums = np.bincount(row[own], logs[place[own]], m)
            # What is known of a document as a whole goes with a word that no text has, so that it is dealt as evenly as words are.
            yield batch(word=mix(rid[low:high].view(np.uint64) + np.arange(m, dtype=np.uint64)).view(np.int64), rid=rid[low:high], n=np.zeros(m, np.int32), train=train[low:high], words=np.diff(upto), known=known, logs=sums)
            rare, row = hashes[~own], row[~own]
            order = np.lexsort((rare, row))
            rare, row = rare[order], row[order]
            new = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (row[1:] != row[:-1]))) if len(rare) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(rare))).astype(np.int32)
            m = len(new)
            yield batch(
                word=rare[new].view(np.int64), rid=rid[low:high][row[new]], n=n, train=train[low:high][row[new]], words=pa.nulls(m, pa.int64()), known=pa.nulls(m, pa.int64()), logs=pa.nulls(m, pa.float64())
            )

    rows = map_batches(documents.select("rid", "text", "train"), run, "word long, rid long, n int, train boolean, words long, known long, logs double")
    same = Window.partitionBy("word")
    rows = rows.withColumn("c", F.coalesce(F.sum(F.when(F.col("train"), F.col("n"))).over(same), F.lit(0))).withColumn("first", F.row_number().over(same.orderBy("rid")) == 1)
    seen = F.col("c") > 0
    per = rows.groupBy("rid").agg(
        F.count("words").alias("copies"), F.sum("words").alias("n"), (F.sum("known") + F.sum(F.when(seen, F.col("n")).otherwise(F.lit(0)))).alias("known"),
        (F.sum("logs") + F.sum(F.col("n") * F.log10(F.col("c") + 1.0))).alias("logs"), F.sum((seen & F.col("first")).cast("long")).alias("fresh"),
    )
    copies = F.col("copies")
    return per.select("rid", "copies", (F.col("n") / copies).cast("long").alias("n_words"), (F.col("known") / copies).cast("long").alias("n_known"), (F.col("logs") / copies).alias("logs"), "fresh")


@dataclass
class Model:
    row: np.ndarray  # of each id: its row of the embeddings
    cluster_of: np.ndarray  # of each id
    key_of: np.ndarray  # of each id
    spread: np.ndarray  # ids x MIX: probabilities of the ids in each of the model's own distributions
    beside: np.ndarray  # keys of the id before x ids: probabilities by counts
    embedding: np.ndarray
    place: np.ndarray
    qkv: np.ndarray
    out: np.ndarray
    up: np.ndarray
    up_bias: np.ndarray
    down: np.ndarray
    mixing: np.ndarray
    mixing_bias: np.ndarray
    packed: bytes = b""  # the counts, compressed

    def __getstate__(self) -> dict:
        """Without the probabilities that the counts tell, which are many times as large."""
        return self.__dict__ | {"beside": None} if self.packed else self.__dict__

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.packed:
            self.beside = beside_of(np.frombuffer(zlib.decompress(self.packed), np.float32).reshape(-1, IDS))

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.place, self.qkv, self.out, self.up, self.up_bias, self.down, self.mixing, self.mixing_bias]


def ranks_of(seen: np.ndarray) -> np.ndarray:
    """Each id's place among all by its count, from 0."""
    rank = np.empty(IDS, np.int64)
    rank[np.argsort(-seen, kind="stable")] = np.arange(IDS)
    return rank


def neighbours_of(rank: np.ndarray) -> np.ndarray:
    """What each id counts as beside another: itself if it is frequent, or a heap."""
    return np.where(rank < NEAR, rank, NEAR + rank % HEAPS)


def clusters_of(seen: np.ndarray, around: np.ndarray, classes: int = MIX, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and key of each id, from the ids' counts and those of their neighbours (neighbours x ids).

    Ids are clustered by the square roots of their neighbours' counts, in cosine;
    unseen ids make up the last cluster.
    """
    rank, ids = ranks_of(seen), np.flatnonzero(seen)
    cluster_of = np.full(IDS, classes - 1)
    if len(ids):
        x = np.sqrt(around[:, ids].T)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        weight = np.sqrt(seen[ids]).astype(np.float32)
        centres = x[np.argsort(-weight, kind="stable")[: classes - 1]].copy()
        label = (x @ centres.T).argmax(1)
        for _ in range(rounds):
            for c in range(len(centres)):
                if (label == c).any():
                    centres[c] = weight[label == c] @ x[label == c]
                    centres[c] /= np.linalg.norm(centres[c]) + 1e-9
            label = (x @ centres.T).argmax(1)
        cluster_of[ids] = label
    return cluster_of, np.where(rank < KEYS, rank, KEYS + cluster_of)


def share_of(beside: np.ndarray) -> np.ndarray:
    """Each id's share of all, by counts; none is zero."""
    plain = beside.sum(0, dtype=np.float64) + 1
    return (plain / plain.sum()).astype(np.float32)


def beside_of(beside: np.ndarray) -> np.ndarray:
    """Probabilities of ids by the key of the id before."""
    return (beside + SMOOTHING * share_of(beside)) / (beside.sum(1, dtype=np.float64)[:, None] + SMOOTHING).astype(np.float32)


def with_counts(m: Model, beside: np.ndarray) -> None:
    """Sets the distributions by counts (keys x ids), and the model's own as they begin: each is a cluster's, with a little of all ids."""
    share = share_of(beside)
    m.beside, m.packed = beside_of(beside), zlib.compress(beside.astype(np.float32).tobytes(), 1)
    m.spread = np.repeat(0.02 * share[:, None], MIX, axis=1)
    m.spread[np.arange(IDS), m.cluster_of] += 0.98 * share / np.bincount(m.cluster_of, share, MIX)[m.cluster_of].astype(np.float32)
    m.spread /= m.spread.sum(0, dtype=np.float64).astype(np.float32)
    mass = np.bincount(m.cluster_of, share, MIX)
    m.mixing_bias[:MIX] = np.log(np.maximum(mass, 1e-9))


def new_model(cluster_of: np.ndarray, key_of: np.ndarray, seen: np.ndarray, seed: int = 17) -> Model:
    """An untrained model without counts; the most frequent ids have embeddings of their own."""
    row = ranks_of(seen)
    late = row >= OWN
    row[late] = OWN + (mix(np.flatnonzero(late).astype(np.uint64)) % np.uint64(SHARED)).astype(np.int64)
    r = np.random.default_rng(seed)

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (r.standard_normal(shape) * scale).astype(np.float32)

    return Model(
        row, cluster_of, key_of, np.zeros((1, MIX), np.float32), np.zeros((1, IDS), np.float32), draw(OWN + SHARED, WIDTH, scale=0.5), draw(WINDOW, WIDTH, scale=0.1), draw(WIDTH, 3 * WIDTH, scale=0.35),
        draw(WIDTH, WIDTH, scale=0.35), draw(WIDTH, HIDDEN, scale=0.35), np.zeros(HIDDEN, np.float32), draw(HIDDEN, WIDTH, scale=0.25), draw(WIDTH, MIX + 1, scale=0.3), np.zeros(MIX + 1, np.float32),
    )


_ONES = np.ones(max(WINDOW, MIX + 1), np.float32)
AHEAD = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def forward(m: Model, inputs: np.ndarray, asked: int) -> tuple[np.ndarray, ...]:
    """Logits of the mixture at the last ``asked`` places of each window, and what the gradient needs. Padding stands behind and is never looked at."""
    x = m.embedding[inputs] + m.place
    b = len(x)
    qkv = (x.reshape(-1, WIDTH) @ m.qkv).reshape(b, WINDOW, 3 * WIDTH)
    q, k, v = qkv[:, -asked:, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]
    a = np.matmul(q, k.transpose(0, 2, 1))
    a *= WIDTH**-0.5
    np.minimum(a, 60, out=a)  # instead of a shift: no sum of exponentials overflows
    a += AHEAD[-asked:]
    np.exp(a, out=a)
    a /= (a.reshape(-1, WINDOW) @ _ONES[:WINDOW]).reshape(b, asked, 1)  # a product sums rows faster than a reduction
    mixed = np.matmul(a, v).reshape(-1, WIDTH)
    h = x[:, -asked:].reshape(-1, WIDTH) + mixed @ m.out
    u = np.maximum(h @ m.up + m.up_bias, 0)
    g = h + u @ m.down
    return g @ m.mixing + m.mixing_bias, x, qkv, a, mixed, h, u, g


def by_counts(m: Model, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The targets' probabilities by counts beside the id before."""
    return m.beside[m.key_of[inputs], targets]


def gradients(m: Model, inputs: np.ndarray, targets: np.ndarray, counted: np.ndarray, real: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
    """Mean loss over the real places of windows of ids, the gradients of the weights, and what each target owes to each own distribution.

    counted: the targets' probabilities by counts.
    """
    logits, x, qkv, a, mixed, h, u, g = forward(m, m.row[inputs], WINDOW)
    np.minimum(logits, 60, out=logits)  # as in scoring: no sum of exponentials overflows
    p = np.exp(logits, out=logits)
    t, real = targets.ravel(), real.ravel()
    n = max(1, int(real.sum()))
    p *= (real / (p @ _ONES[: MIX + 1]))[:, None].astype(np.float32)
    owed = m.spread[t]
    owed *= p[:, :MIX]
    by = counted.ravel() * p[:, MIX]
    total = owed @ _ONES[:MIX] + by
    loss = float(-(np.log(total[real] + 1e-30)).sum() / n)
    total = (real / np.maximum(total, 1e-30)).astype(np.float32)
    owed *= total[:, None]
    p[:, :MIX] -= owed
    p[:, MIX] -= by * total
    p *= np.float32(1 / n)
    dg = p @ m.mixing.T
    du = (dg @ m.down.T) * (u > 0)
    dh = dg + du @ m.up.T
    dmixed = (dh @ m.out.T).reshape(len(x), WINDOW, WIDTH)
    q, k, v = qkv[:, :, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]
    da = np.matmul(dmixed, v.transpose(0, 2, 1))
    da -= ((da * a).reshape(-1, WINDOW) @ _ONES[:WINDOW]).reshape(len(x), WINDOW, 1)
    da *= a
    ds = da * np.float32(WIDTH**-0.5)
    dqkv = np.concatenate([np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q), np.matmul(a.transpose(0, 2, 1), dmixed)], axis=2).reshape(-1, 3 * WIDTH)
    dx = dh + dqkv @ m.qkv.T
    flat = x.reshape(-1, WIDTH)
    rows = m.row[inputs].ravel()
    de = np.stack([np.bincount(rows, dx[:, d], len(m.embedding)) for d in range(WIDTH)], axis=1).astype(np.float32)
    return loss, [de, dx.reshape(-1, WINDOW, WIDTH).sum(0), flat.T @ dqkv, mixed.T @ dh, h.T @ du, du.sum(0), u.T @ dg, g.T @ p, p.sum(0)], owed


def windows_of(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets (windows x WINDOW), how many of them are real, and which are the first of a text; targets of 0 ids beyond the end are padding.

    A text's inputs are the end sign and its ids, its targets the ids and the end sign.
    """
    lengths = np.array([len(s) + 1 for s in sequences])
    windows = np.maximum(1, -(-(lengths - WINDOW) // HALF) + 1)
    first = np.cumsum(lengths + WINDOW) - lengths - WINDOW
    total = int((lengths + WINDOW).sum())
    inputs, targets = np.full(total + WINDOW, END, np.int64), np.full(total + WINDOW, END, np.int64)
    joined = np.concatenate(sequences).astype(np.int64) if sequences else np.zeros(0, np.int64)
    place = np.arange(len(joined)) + np.repeat(first - (np.cumsum(lengths - 1) - (lengths - 1)), lengths - 1)
    targets[place], inputs[place + 1] = joined, joined
    owner = np.repeat(np.arange(len(sequences)), windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = first[owner] + number * HALF
    real = np.minimum(WINDOW, first[owner] + lengths[owner] - at)
    grid = at[:, None] + np.arange(WINDOW)
    return inputs[grid], targets[grid], real, number


def log_probabilities(m: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each text's probability."""
    inputs, targets, real, number = windows_of(sequences)
    owner = np.cumsum(number == 0) - 1
    out = np.zeros(len(sequences))
    for asked, chosen in ((WINDOW, np.flatnonzero(number == 0)), (HALF, np.flatnonzero(number > 0))):
        for at in range(0, len(chosen), 256):  # what is computed of them stays in the cache
            w = chosen[at : at + 256]
            logits = forward(m, m.row[inputs[w]], asked)[0]
            t = targets[w][:, -asked:].ravel()
            np.minimum(logits, 60, out=logits)
            np.exp(logits, out=logits)
            whole = logits @ _ONES[: MIX + 1]
            own = logits[:, :MIX] * m.spread[t]
            score = np.log((own @ _ONES[:MIX] + logits[:, MIX] * m.beside[m.key_of[inputs[w]][:, -asked:].ravel(), t]) / whole)
            score = score.reshape(len(w), asked)
            score[np.arange(WINDOW - asked, WINDOW)[None, :] >= real[w][:, None]] = 0
            out += np.bincount(owner[w], score.sum(1), len(sequences))
    return out


def descend(m: Model, inputs: np.ndarray, targets: np.ndarray, counted: np.ndarray, real: np.ndarray, rate: float, seed: int, size: int = 256) -> tuple[list[np.ndarray], np.ndarray]:
    """A pass over some windows: the weights that it ends with, and how much each id owes to each own distribution."""
    mine = replace(m, **{f: getattr(m, f).copy() for f in _BODY})
    adam, owed = Adam(mine.weights(), rate), np.zeros((IDS, MIX), np.float32)
    order = np.random.default_rng(seed).permutation(len(inputs))
    for at in range(0, len(order), size):
        w = order[at : at + size]
        _, g, o = gradients(mine, inputs[w], targets[w], counted[w], np.arange(WINDOW)[None, :] < real[w][:, None])
        norm = float(np.sqrt(sum(float(np.vdot(x, x)) for x in g)))
        if norm > STEEPEST:
            g = [x * np.float32(STEEPEST / norm) for x in g]
        adam.rate = rate * (1 - 0.5 * at / len(order))
        adam.step(g)
        t = targets[w].ravel()
        by = np.argsort(t, kind="stable")
        new = np.flatnonzero(np.append(True, np.diff(t[by]) != 0))
        owed[t[by][new]] += np.add.reduceat(o[by], new)
    return mine.weights(), owed


_BODY = ("embedding", "place", "qkv", "out", "up", "up_bias", "down", "mixing", "mixing_bias")


def training_windows(m: Model, tokens: DataFrame, every: int = 1) -> DataFrame:
    """Windows of the training texts in which each id is a target: (chosen, ids, counted, real); ids are the inputs and then the targets.

    Windows that don't overlap, and a text's last one. ``every``: only one of so many, chosen by a hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            own = [np.frombuffer(x, np.uint16) for x in b.column(1).to_pylist()]
            if own:
                inputs, targets, real, number = windows_of(own)
                rid = b.column(0).to_numpy().view(np.uint64)[np.cumsum(number == 0) - 1]
                chosen = mix(rid + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                last = np.append(number[1:] == 0, True)
                w = np.flatnonzero(((number % 2 == 0) | last) & (chosen % np.uint64(every) == 0))
                ids = np.concatenate([inputs[w], targets[w]], axis=1).astype(np.uint16)
                counted = by_counts(m, inputs[w], targets[w])
                columns = (pa.FixedSizeBinaryArray.from_buffers(pa.binary(a.itemsize * a.shape[1]), len(a), [None, pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary()) for a in (ids, counted))
                yield pa.RecordBatch.from_arrays([pa.array((chosen[w] // np.uint64(every)).view(np.int64)), *columns, pa.array(real[w].astype(np.int32))], names=["chosen", "ids", "counted", "real"])

    return tokens.where("kind = 0 AND which = 1").select("rid", "ids").mapInArrow(run, "chosen long, ids binary, counted binary, real int")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for rows in batches:
        for k, v in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            v = np.frombuffer(v, np.float32)
            sums[k] = sums[k] + v if k in sums else v
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["key", "row"])


def sent(weights: list[np.ndarray], owed: np.ndarray, windows: int) -> pa.RecordBatch:
    """What a task's pass comes to: rows of so many weights, times its windows and with their number at last, under keys below 0, and a row an id under the id."""
    flat = np.concatenate([*(w.ravel() for w in weights), np.ones(1)]).astype(np.float32) * np.float32(windows)
    rows = [flat[at : at + SENT] for at in range(0, len(flat), SENT)]  # none is large: the rows of a key meet in one task
    some = np.flatnonzero(owed.any(1))
    keys = np.append(-1 - np.arange(len(rows)), some)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([*(r.tobytes() for r in rows), *(owed[i].tobytes() for i in some)], pa.binary())], names=["key", "row"])


def in_tasks(texts: DataFrame, tasks: int) -> DataFrame:
    """Dealt by id to so many tasks, not to more if a session deals to more: each task sends a row an id, whatever it has learned from."""
    return texts.repartition(tasks, "rid").coalesce(tasks)


def fit(m: Model, tokens: DataFrame, windows: int, rounds: int = ROUNDS, least: int = LEAST_WINDOWS, rate: float = RATE, size: int = STEP_WINDOWS) -> None:
    """Trains the model on all training texts, which have about so many windows.

    A round takes one of as many parts of the texts as have the least number of
    windows, up to the number of rounds: all parts are taken, of a small corpus
    each several times.
    """
    many = windows // 2  # windows that don't overlap
    parts = max(1, min(rounds, many // least))
    of_task = min(4 * TASK_WINDOWS, max(TASK_WINDOWS, many // parts // 16))  # of a larger corpus more, as each task sends a row an id
    training = tokens.withColumn("part_", F.pmod(F.xxhash64(F.lit(2), "rid"), F.lit(parts)))
    began, of_part = m.spread.copy(), {}
    for number in range(rounds):
        bare = replace(m, beside=None, packed=b"")  # what a round sends to its tasks

        def run(batches: Iterator[pa.RecordBatch], number: int = number, bare: Model = bare) -> Iterator[pa.RecordBatch]:
            own = [b for b in batches if b.num_rows]
            if own:
                ids = np.frombuffer(b"".join(x for b in own for x in b.column(1).to_pylist()), np.uint16).astype(np.int64).reshape(-1, 2 * WINDOW)
                counted = np.frombuffer(b"".join(x for b in own for x in b.column(2).to_pylist()), np.float32).reshape(-1, WINDOW)
                real = np.concatenate([b.column(3).to_numpy() for b in own])
                order = np.argsort(np.concatenate([b.column(0).to_numpy() for b in own]), kind="stable")  # whatever order the rows come in
                weights, owed = descend(bare, ids[order, :WINDOW], ids[order, WINDOW:], counted[order], real[order], rate * (1 - number / rounds), number, size)
                yield sent(weights, owed, len(real))

        told = replace(m, spread=began[:1])  # windows ask for counts alone; what is sent is kept on disk
        dealt = training_windows(told, in_tasks(training.where(F.col("part_") == number % parts), max(1, many // parts // of_task)))
        owed, sums = np.zeros((IDS, MIX), np.float32), {}
        for r in dealt.mapInArrow(run, "key long, row binary").repartition("key").mapInArrow(_sums, "key long, row binary").toPandas().itertuples():  # a row an id, and some of weights
            if r.key < 0:
                sums[-1 - r.key] = np.frombuffer(r.row, np.float32)
            else:
                owed[r.key] = np.frombuffer(r.row, np.float32)
        if not sums:
            continue
        of_part[number % parts] = owed
        flat = np.concatenate([sums[i] for i in range(len(sums))])
        flat, at = flat[:-1] / flat[-1], 0
        for w in m.weights():
            w[...] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
        owed = sum(of_part.values())  # what each part owed when it was last taken
        mass = owed.sum(0, dtype=np.float64)
        kept = KEPT * mass + 1
        m.spread = ((owed + kept * began) / (mass + kept)).astype(np.float32)


def score_texts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null text is empty and has one token, the end. Repeated rows are documents
    of their own and count as often; other columns are ignored; an empty table
    gives an empty table. Without training rows the counts are zero and the model
    is untrained. Training windows, counts of words and counts of ids are of the
    whole training part, texts of any length included.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64(F.col("doc_id").cast("string"), "text")).withColumn("train", fold("doc_id", FOLDS) != LEFT_OUT)
    many = rows.count()
    if not many:
        return rows.select("doc_id", ~F.col("train"), *(F.lit(0).cast("long").alias(c) for c in "abc"), *(F.lit(0.0).alias(c) for c in "de")).toDF(
            "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
        )
    rows.sparkSession.sparkContext.addFile(vocabulary)  # executors need no path of their own
    words = propose_words(rows, many)
    tokens = tokenized(rows, words, vocabulary)
    counted = tokens.where("kind > 0").groupBy("kind", "which").agg(F.sum("n").alias("n")).toPandas()  # a row for each frequent word and each id
    total = int(counted.loc[counted["which"] == -1, "n"].sum())
    counts, seen = np.zeros(len(words.hashes), np.int64), np.zeros(IDS, np.int64)
    for sort, out in ((1, counts), (2, seen)):
        own = counted[(counted["kind"] == sort) & (counted["which"] >= 0)]
        out[own["which"].to_numpy()] = own["n"].to_numpy()
    ends = int(seen[END])
    neighbours = neighbours_of(ranks_of(seen))
    cluster_of, key_of = clusters_of(seen, beside(tokens, neighbours, neighbours))
    model = new_model(cluster_of, key_of, seen)
    with_counts(model, beside(tokens, key_of))
    fit(model, tokens, int(seen.sum()) // HALF)
    base = stored(base_parts(rows, words, counts))
    distinct = int((counts > 0).sum()) + (base.agg(F.sum("fresh")).first()[0] or 0) + (ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            own = [np.frombuffer(x, np.uint16) for x in b.column(1).to_pylist()]
            score, at = np.zeros(len(own)), 0
            while at < len(own):  # so many ids at once that the windows stay small
                high, ids = at, 0
                while high < len(own) and (high == at or ids + len(own[high]) < 1 << 17):
                    ids, high = ids + len(own[high]), high + 1
                score[at:high] = log_probabilities(model, own[at:high])
                at = high
            if len(own):
                yield batch(rid=b.column(0), score=score / np.log(10))

    # A row for each rid is enough: rows that share it have the same text.
    scored = tokens.where("kind = 0").select("rid", "ids").mapInArrow(run, "rid long, score double").groupBy("rid").agg(F.max("score").alias("score"))
    heads = documents.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("rid")).withColumn("train", fold("doc_id", FOLDS) != LEFT_OUT)
    size, end_log = F.lit(float(np.log10(total + distinct + 1.0))), F.lit(float(np.log10(ends + 1.0)))
    tokens_of = F.col("n_words") + 1
    return heads.join(base, "rid").join(scored, "rid").select(
        F.col("doc_id").cast(kind).alias("doc_id"), (~F.col("train")).alias("held_out"), tokens_of.alias("n_tokens"), (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") + end_log - tokens_of * size).alias("base_score"), "score",
    )


def op7_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model score."""
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
