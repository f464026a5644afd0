"""Benchmark decontamination by latent semantic retrieval.

Terms are the benchmark's words, weighed by inverse document frequency over the
whole corpus; words that are too common weigh nothing. The rows of a term matrix
are the corpus' passages and the benchmark's items, these cut into pieces of a
passage's length. Its dominant right singular vectors come from a distributed
randomised SVD: each task multiplies its passages with a random matrix and back,
Spark adds up the products, and an orthonormal basis of the sum is the range; a
second pass multiplies that basis, and the small matrix of its products is
decomposed on the driver. There is one space for all items, however many passes
their search takes. Items and overlapping passages are projected on it; a
passage that lies near an item in cosine is a candidate. Around a candidate, the
longest common subsequence of words with the item, and whether the item's last
sentence (its answer) is there, decide.

A cosine takes the passage's length for no less than half of the piece's: else a
passage with one rare word of an item would point just where the item points.

Items with a piece that weighs little more than ordinary text can drown in what stands
around them (all of an item's words are common if many documents hold it). They
are not looked for by cosine: each stretch of twice their length that holds as
many of their words as a leak needs is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import LOWER, batch, chunks, extend, prefix_sums, stretch_hash, table, utf8, words_of

PASSAGE, STEP = 32, 16
DIMENSIONS, SEED = 128, 5
#: Terms in a larger share of the documents weigh nothing.
COMMON = 0.05
COSINE, SHORTEST = 0.45, 0.5
#: Items are looked for by cosine if the mean square of each piece's weights is so many times that of the corpus' words, or more.
ORDINARY = 2.0
#: Share of an item's words in the common subsequence: alone, or with the answer (an item without one has but the first way).
ALONE, WITH_ANSWER = 0.65, 0.5
#: Items of fewer words leak where all their words stand one behind the other; a single word, which says nothing inside a text, only where it is all of the text.
FEWEST_WORDS = 5
#: Items that are searched in one pass; more items take more passes, with the same results.
BLOCK_ITEMS = 5000
#: More columns than are kept, for the sketch; bytes of the vectors that go to the tasks, beyond which fewer are kept.
SPARE, SPACE_BYTES = 16, 256 << 20

_GLUE = np.arange(256, dtype=np.uint8)
_GLUE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words, punctuation counting as space; each row's first word, the total at last."""
    data = _GLUE[LOWER[data]]
    first, last, upto = words_of(data, starts)
    return stretch_hash(*prefix_sums(data), first, last), upto


@dataclass
class Item:
    number: int
    words: list[int]
    answer: list[int]


@dataclass
class Space:
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray
    basis: np.ndarray  # terms x dimensions
    items: list[Item]
    latent: np.ndarray  # pieces of items x dimensions, of length one
    lengths: np.ndarray
    item_of: np.ndarray  # of each piece, a row of latent and lengths
    plain: list[tuple[int, np.ndarray]]  # items that are looked for by their words, and their terms


def as_items(rows: list[tuple[int, str]]) -> list[Item]:
    """Items with words, given as (number, text); the answer is what follows the last sentence end inside the text, if that has three words or more."""
    items = []
    for number, text in rows:
        raw = (text or "").strip()
        cut = max(raw.rfind(c, 0, max(0, len(raw) - 1)) for c in ".?!\n")
        words = []
        for part in (raw, raw[cut + 1 :]):
            data = np.frombuffer(part.encode("utf-8", "replace"), np.uint8)
            words.append(word_hashes(data, np.array([0, len(data)]))[0].tolist())
        if words[0]:
            items.append(Item(number, words[0], words[1] if len(words[1]) >= 3 else []))
    return items


def term_of(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place among the terms, or -1. A table of flags by low bits spares most words the search."""
    flags = np.zeros(1 << 16, bool)
    flags[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = np.full(len(hashes), -1, np.int64)
    maybe = np.flatnonzero(flags[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(terms, hashes[maybe]), len(terms) - 1)
    hit = terms[at] == hashes[maybe]
    out[maybe[hit]] = at[hit]
    return out


def _per_chunk(rows: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, starts = utf8(rows.column(rows.schema.get_field_index(name)))
    for low, high in chunks(starts):
        yield low, high, *word_hashes(data[starts[low] : starts[high]], starts[low : high + 1] - starts[low])


def document_frequencies(documents: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """In how many documents and how often each term stands, and the number of documents and of words."""
    many = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, times, n, words = np.zeros(many, np.int64), np.zeros(many, np.int64), 0, 0
        for rows in batches:
            n += rows.num_rows
            for low, high, hashes, upto in _per_chunk(rows):
                term = term_of(terms, hashes)
                has = np.flatnonzero(term >= 0)
                words += len(hashes)
                times += np.bincount(term[has], minlength=many)
                row = np.repeat(np.arange(high - low), np.diff(upto))[has]
                seen += np.bincount(np.unique(row * many + term[has]) % many, minlength=many)
        some = np.flatnonzero(seen)
        yield batch(term=np.append(some, -1), n=np.append(seen[some], n), times=np.append(times[some], words))

    counted = documents.select("text").mapInArrow(run, "term long, n long, times long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))
    out, times, total, words = np.zeros(many, np.int64), np.zeros(many, np.int64), 0, 0
    for r in counted.toPandas().itertuples():  # a row a term of the benchmark block
        if r.term < 0:
            total, words = int(r.n), int(r.times)
        else:
            out[r.term], times[r.term] = r.n, r.times
    return out, times, total, words


def _products(term: np.ndarray, row: np.ndarray, weights: np.ndarray, random: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the matrix with these entries, what its transpose gives on its product with the random matrix: terms and their rows."""
    order = np.argsort(row, kind="stable")
    term, row = term[order], row[order]
    new = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    values = weights[term][:, None] * random[term]
    product = np.add.reduceat(values, new)
    back = weights[term][:, None] * np.repeat(product, np.diff(np.append(new, len(row))), axis=0)
    order = np.argsort(term, kind="stable")
    new = np.flatnonzero(np.append(True, np.diff(term[order]) != 0))
    return term[order][new], np.add.reduceat(back[order], new)


def sketch(documents: DataFrame, terms: np.ndarray, weights: np.ndarray, random: np.ndarray) -> np.ndarray:
    """The corpus' share of the sketch, terms x dimensions, summed by Spark."""
    many, dims = random.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((many, dims), np.float32), np.zeros(many, bool)
        for rows in batches:
            for low, high, hashes, upto in _per_chunk(rows):
                term = term_of(terms, hashes)
                has = np.flatnonzero((term >= 0) & (weights[term] > 0))
                if len(has):
                    row = np.repeat(np.arange(high - low), np.diff(upto))
                    passage = (row[has] << 32) + (has - upto[row[has]]) // PASSAGE
                    t, z = _products(term[has], passage, weights, random)
                    total[t] += z
                    seen[t] = True
        some = np.flatnonzero(seen)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([total[t].tobytes() for t in some], pa.binary())], names=["term", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows in batches:
            for t, z in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                z = np.frombuffer(z, np.float32)
                sums[t] = sums[t] + z if t in sums else z
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([z.tobytes() for z in sums.values()], pa.binary())], names=["term", "row"])

    added = documents.select("text").mapInArrow(run, "term long, row binary").repartition("term").mapInArrow(add, "term long, row binary")
    out = np.zeros((many, dims), np.float32)
    for r in added.toLocalIterator():
        out[r["term"]] = np.frombuffer(r["row"], np.float32)
    return out


def fit_space(documents: DataFrame, items: list[Item], dimensions: int = DIMENSIONS) -> Space:
    """The latent space of all items."""
    terms = np.unique(np.array([w for i in items for w in i.words], np.uint64))
    seen, times, total, words = document_frequencies(documents, terms)
    weights = np.log((total + 1.0) / (seen + 1.0)) + 0.1
    weights[seen > COMMON * total] = 0 if (seen <= COMMON * total).any() else 0.1
    weights = weights.astype(np.float32)
    dimensions = max(1, min(dimensions, len(terms), SPACE_BYTES // 4 // len(terms)))
    own = [np.searchsorted(terms, np.array(i.words, np.uint64)) for i in items]
    at, piece = np.concatenate(own), np.repeat(np.arange(len(own)), [len(o) for o in own])
    scales: list[float] = []

    def multiplied(x: np.ndarray) -> np.ndarray:
        """The matrix' transpose times the matrix times x; corpus and items count alike, whatever their numbers."""
        ours = np.zeros_like(x)
        t, z = _products(at, piece, weights, x)
        ours[t] = z
        parts = (ours, sketch(documents, terms, weights, x))
        scales[:] = scales or [1 / max(float(np.linalg.norm(p)), 1e-9) for p in parts]
        return sum(p * scale for p, scale in zip(parts, scales, strict=True))

    random = np.random.default_rng(SEED).standard_normal((len(terms), min(dimensions + SPARE, len(terms)))).astype(np.float32)
    basis = np.linalg.qr(multiplied(random))[0].astype(np.float32)
    small = basis.T @ multiplied(basis)
    vectors = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, :dimensions]
    basis = (basis @ vectors).astype(np.float32)
    cut = [(i, o[at : at + PASSAGE]) for i, o in enumerate(own) for at in starts_of(len(o))]
    item_of = np.array([i for i, _ in cut])
    latent = np.array([(weights[o][:, None] * basis[o]).sum(0) for _, o in cut])
    ordinary = (times * weights.astype(float) ** 2).sum() / max(words, 1)
    light = np.unique([i for i, o in cut if (weights[o].astype(float) ** 2).mean() < ORDINARY * ordinary or not weights[o].any()])
    plain = [(int(i), np.unique(own[int(i)])) for i in light]
    lengths = np.linalg.norm(latent, axis=1)
    heavy = ~np.isin(item_of, light)
    return Space(terms, weights, basis, items, (latent / np.maximum(lengths, 1e-9)[:, None])[heavy], lengths[heavy], item_of[heavy], plain)


def block_of(space: Space, low: int, high: int) -> Space:
    """The space with only the items from low to high to be searched."""
    own = (space.item_of >= low) & (space.item_of < high)
    return Space(space.terms, space.weights, space.basis, space.items[low:high], space.latent[own], space.lengths[own], space.item_of[own] - low, [(i - low, t) for i, t in space.plain if low <= i < high])


def starts_of(many: int) -> list[int]:
    """Where the pieces of an item begin: all are of a passage's length, if the item is."""
    return sorted({min(at, max(0, many - PASSAGE)) for at in range(0, max(1, many - PASSAGE + STEP), STEP)})


def common_subsequence(words: list[int], masks: dict[int, int], length: int) -> int:
    """Length of the longest common subsequence with an item, whose words' places are bits."""
    full = (1 << length) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def short_items(items: list[Item]) -> dict[tuple[int, ...], list[int]]:
    """Places of the items of too few words for a comparison, by their words."""
    out: dict[tuple[int, ...], list[int]] = {}
    for i, item in enumerate(items):
        if len(item.words) < FEWEST_WORDS:
            out.setdefault(tuple(item.words), []).append(i)
    return out


def find_short(short: dict[tuple[int, ...], list[int]], hashes: np.ndarray, upto: np.ndarray) -> list[tuple[int, int, float, bool]]:
    """(row, item's place, 1, True) where all words of a short item stand one behind the other in a row."""
    out = []
    counts = np.diff(upto)
    row = np.repeat(np.arange(len(counts)), counts)
    rest = np.repeat(upto[1:], counts) - np.arange(len(hashes))
    for first in sorted({w[0] for w in short}):
        for at in np.flatnonzero(hashes == np.uint64(first)).tolist():
            for many in range(1, FEWEST_WORDS):
                if rest[at] >= many and (many > 1 or counts[row[at]] == 1) and (own := short.get(tuple(hashes[at : at + many].tolist()))):
                    out += [(int(row[at]), i, 1.0, True) for i in own]
    return list(dict.fromkeys(out))


def find(space: Space, masks: list[tuple[dict, dict]], hashes: np.ndarray, upto: np.ndarray) -> list[tuple[int, int, float, bool]]:
    """(row, item's place, share of the item in the subsequence, whether it counts as a leak), for each candidate."""
    term = term_of(space.terms, hashes)
    weight = np.where(term >= 0, space.weights[term], 0)
    if not len(hashes):
        return []
    counts = np.diff(upto)
    windows = np.where(counts > 0, np.maximum(1, -(-(counts - PASSAGE) // STEP) + 1), 0)
    row = np.repeat(np.arange(len(counts)), windows)
    at = upto[row] + (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * STEP
    end = np.minimum(at + PASSAGE, upto[row + 1])
    sums = np.concatenate([[0], np.cumsum(weight)])
    # No projection is longer than the sum of the weights; shorter ones can't reach the cosine with any item.
    rich = np.flatnonzero(sums[end] - sums[at] >= COSINE * SHORTEST * space.lengths.min()) if len(space.lengths) else at[:0]
    found: dict[tuple[int, int], list[list[int]]] = {}
    for part in np.array_split(rich, max(1, len(rich) // 8192)):
        if not len(part):
            continue
        size = end[part] - at[part]
        inside = np.repeat(at[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(part)), size)
        heavy = weight[inside] > 0
        inside, owner = inside[heavy], owner[heavy]
        latent = np.zeros((len(part), space.basis.shape[1]), np.float32)
        new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        latent[owner[new]] = np.add.reduceat(weight[inside][:, None] * space.basis[term[inside]], new)
        length = np.linalg.norm(latent, axis=1)
        cosine = latent @ space.latent.T / np.maximum(length[:, None], SHORTEST * space.lengths[None, :])
        for p, piece in zip(*np.nonzero(cosine >= COSINE), strict=True):
            i = space.item_of[piece]
            w, many = int(part[p]), len(space.items[i].words)
            r = int(row[w])
            low, high = max(int(upto[r]), int(at[w]) - many), min(int(upto[r + 1]), int(end[w]) + many)
            own = found.setdefault((r, int(i)), [])
            if own and low <= own[-1][1]:
                own[-1][1] = max(own[-1][1], high)
            else:
                own.append([low, high])
    for i, own_terms in space.plain:
        flags = np.zeros(len(space.terms) + 1, bool)  # the last is for words that are no terms
        flags[own_terms] = True
        many = len(space.items[i].words)
        held = np.concatenate([[0], np.cumsum(flags[term])])
        blocks = -(-counts // many)
        row = np.repeat(np.arange(len(counts)), blocks)
        at = upto[row] + (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * many
        end = np.minimum(at + 2 * many, upto[row + 1])
        for w in np.flatnonzero(held[end] - held[at] >= WITH_ANSWER * many):
            found.setdefault((int(row[w]), i), []).append([int(at[w]), int(end[w])])
    out = []
    for (r, i), regions in found.items():
        item, (mine, answer) = space.items[i], masks[i]
        many = len(item.words)
        if many < FEWEST_WORDS:
            continue  # find_short looks for these
        for low, high in regions:
            best, leak = 0.0, False
            reach = 2 * many
            for a in range(low, max(low + 1, high - reach + many), many):  # a common subsequence must lie within twice the item's length
                words = hashes[a : min(high, a + reach)].tolist()
                share = common_subsequence(words, mine, many) / many
                best = max(best, share)
                said = answer and share >= WITH_ANSWER and common_subsequence(words, answer, len(item.answer)) >= 0.8 * len(item.answer)
                leak |= share >= ALONE or bool(said)
            out.append((r, i, best, leak))
    return out


NAMES = ("item_id", "share", "contaminated")


def _mark(documents: DataFrame, shared: Broadcast, low_item: int, high_item: int, ids: list, kind: str, names: tuple[str, str, str]) -> DataFrame:
    made: list = []  # in each task: the block of items, what they are compared by

    def run(rows: pa.RecordBatch) -> list:
        if not made:
            own = block_of(shared.value, low_item, high_item)
            made.extend((own, [(masks_of(i.words), masks_of(i.answer)) for i in own.items], short_items(own.items)))
        space, masks, short = made
        best: dict[int, tuple[bool, float, int]] = {}
        place = {x: n for n, x in enumerate(ids)}
        old = {n: rows.schema.get_field_index(n) for n in names}
        for r, (item, share, leak) in enumerate(zip(*(rows.column(i).to_pylist() for i in old.values()), strict=True)):  # of the blocks of items before
            if item is not None:
                best[r] = (leak, share, -place[item])
        for low, _, hashes, upto in _per_chunk(rows):
            for r, i, share, leak in [*find(space, masks, hashes, upto), *(find_short(short, hashes, upto) if short else [])]:
                best[low + r] = max(best.get(low + r, (False, 0.0, 0)), (leak, share, -space.items[i].number))
        got = [best.get(r) for r in range(rows.num_rows)]
        column = rows.schema.field(names[0]).type
        return [pa.array([g and ids[-g[2]] for g in got], column), pa.array([g[1] if g else 0.0 for g in got]), pa.array([bool(g and g[0]) for g in got])]

    return extend(documents, run, f"{names[0]} {kind}, {names[1]} double, {names[2]} boolean")


def find_leaks(documents: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, dimensions: int = DIMENSIONS, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """Adds item_id (the best candidate, or null), share (of its words) and contaminated to the documents.

    Texts that are null or empty, on either side, match nothing; item ids may be
    of any type that has an order, rows with a null one are ignored. Items that
    repeat are searched each; of equal shares the smaller id is given. Other
    columns pass through, columns named as an added one (``names``) are replaced;
    an empty benchmark marks nothing. Items of two to four words are leaked
    where they stand whole, of one word where the text has no other. The
    benchmark's items go to every task, in blocks if there are many, a pass over
    the documents each.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull()).orderBy("item_id", "text").collect()
    ids = list(dict.fromkeys(r["item_id"] for r in rows))
    number = {x: n for n, x in enumerate(ids)}
    out = documents.drop(*names).withColumns({names[0]: F.lit(None).cast(kind), names[1]: F.lit(0.0), names[2]: F.lit(False)})
    if items := as_items([(number[r["item_id"]], r["text"]) for r in rows]):
        shared = documents.sparkSession.sparkContext.broadcast(fit_space(documents, items, dimensions))  # once for all blocks; bounded by SPACE_BYTES and the items' words
        for low in range(0, len(items), block_items):
            out = _mark(out, shared, low, low + block_items, ids, kind, names)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's nearest benchmark item and whether it leaks it."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(documents, table(spark, sf_dir, "benchmark")).drop("text")
