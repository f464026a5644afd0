"""Toxicity by a factorization machine over hashed terms.

A document's terms are its words and their first four, six and seven bytes, lower
case, hashed into BINS bins. The machine scores the set of terms that a document
has: a constant, a weight of each term, and for each pair of terms the product
of their factor vectors, which lets a pair (an insult beside the mention of a
group) weigh more than its parts. All pairs together cost no more than the
terms: half of the squared sum of factors less the sum of squared factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import LOWER, Adam, chunks, class_weights, extend, fold, labelled_sample, prefix_sums, sigmoid, stretch_hash, table, utf8, words_of

BINS, FACTORS, TERMS = 1 << 18, 6, 3072
PREFIXES = (4, 6, 7)
#: The classifier's training sample: documents of each class (0, 1), and their bytes together, at most.
SAMPLE, SAMPLE_BYTES = (4000, 3000), 64 << 20
THRESHOLD = 0.3
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


@dataclass
class Machine:
    term: np.ndarray  # of each bin: the place among the terms that carry weight, or -1
    constant: float
    weights: np.ndarray
    factors: np.ndarray


def terms_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and bin of each term, repeats included. Punctuation counts as space."""
    data = LOWER[data]
    data = np.where(PUNCTUATION[data], np.uint8(0x20), data)
    first, last, upto = words_of(data, starts)
    sums, down = prefix_sums(data)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(upto))
    documents, bins = [rows], [stretch_hash(sums, down, first, last)]
    for k in PREFIXES:
        longer = np.flatnonzero(last - first > k)
        documents.append(rows[longer])
        bins.append(stretch_hash(sums, down, first[longer], first[longer] + k) ^ np.uint64(k << 20))
    return np.concatenate(documents), (np.concatenate(bins) & np.uint64(BINS - 1)).astype(np.int64)


def machine_logits(m: Machine, documents: np.ndarray, bins: np.ndarray, rows: int) -> np.ndarray:
    """Scores before the logistic function."""
    term = m.term[bins]
    has = np.flatnonzero(term >= 0)
    pairs = np.unique(documents[has] * len(m.weights) + term[has])
    rows_of, term = pairs // max(1, len(m.weights)), pairs % max(1, len(m.weights))
    out = m.constant + np.bincount(rows_of, m.weights[term], rows)
    for f in range(m.factors.shape[1]):
        v = m.factors[term, f]
        out += 0.5 * (np.bincount(rows_of, v, rows) ** 2 - np.bincount(rows_of, v * v, rows))
    return out


def predict(m: Machine, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts) - 1)
    for low, high in chunks(starts):
        documents, bins = terms_of(data[starts[low] : starts[high]], starts[low : high + 1] - starts[low])
        out[low:high] = sigmoid(machine_logits(m, documents, bins, high - low))
    return out


def train(texts: list[str], y: np.ndarray, weights: np.ndarray, steps: int = 400, rate: float = 0.03, terms: int = TERMS, seed: int = 3) -> Machine:
    """Chooses the terms that differ most between the classes, then fits the machine by full-batch descent."""
    encoded = [t.encode("utf-8", "replace") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
    data = np.frombuffer(b"".join(encoded), np.uint8)
    pairs = [np.zeros(0, np.int64)]
    for low, high in chunks(starts):
        documents, bins = terms_of(data[starts[low] : starts[high]], starts[low : high + 1] - starts[low])
        pairs.append(np.unique((documents + low) * BINS + bins))
    pairs = np.concatenate(pairs)
    documents, bins = pairs // BINS, pairs % BINS
    n = max(1, len(y))
    have = np.bincount(bins, minlength=BINS)
    mass, toxic = np.bincount(bins, weights[documents], BINS) / n, np.bincount(bins, (weights * y)[documents], BINS) / n
    share = float((weights * y).sum() / n)
    chi = (toxic - mass * share) ** 2 / np.maximum(mass * (1 - mass), 1e-9)
    chi[have < 4] = 0
    best = np.argsort(-chi, kind="stable")[:terms]
    best = best[chi[best] > 0]
    term = np.full(BINS, -1, np.int64)
    term[best] = np.arange(len(best))
    random = np.random.default_rng(seed)
    m = Machine(term, 0.0, np.zeros(len(best), np.float32), (random.standard_normal((len(best), FACTORS)) * 0.01).astype(np.float32))
    x = np.zeros((len(y), len(best)), np.float32)
    chosen = term[bins] >= 0
    x[documents[chosen], term[bins[chosen]]] = 1
    constant = np.array([np.log(max(share, 1e-4) / max(1 - share, 1e-4))], np.float32)
    adam = Adam([constant, m.weights, m.factors], rate)
    scale = (weights / n).astype(np.float32)
    for _ in range(steps if len(y) else 0):
        summed = x @ m.factors
        logits = constant[0] + x @ m.weights + 0.5 * ((summed**2).sum(1) - x @ (m.factors**2).sum(1))
        error = ((sigmoid(logits) - y) * scale).astype(np.float32)
        grown = x.T @ (error[:, None] * summed) - (x.T @ error)[:, None] * m.factors
        adam.step([np.array([error.sum()], np.float32), x.T @ error + 2e-4 * m.weights, grown + 2e-3 * m.factors])
    m.constant = float(constant[0])
    return m


def fit_toxicity(documents: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Machine:
    """Learns labels.toxic from a bounded sample of the training fold."""
    rows, counts = labelled_sample(documents, labels, "toxic", 4, 2, sample, most_bytes)
    y = rows["label_"].to_numpy(float)
    return train(rows["text"].tolist(), y, class_weights(y, counts))


def score_toxicity(documents: DataFrame, machine: Machine, threshold: float = THRESHOLD, drop: tuple[str, ...] = (), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds score and predicted to the documents.

    A null or empty text has no terms and gets the score of the constant.
    Repeated rows are scored alike; other columns pass through, and a column
    named as an added one is replaced. Whole texts are read.
    """

    def run(rows: pa.RecordBatch) -> list:
        score = predict(machine, *utf8(rows.column(rows.schema.get_field_index("text"))))
        return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]

    return extend(documents, run, f"{names[0]} double, {names[1]} int", drop)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit_toxicity(documents, table(spark, sf_dir, "labels"))
    return score_toxicity(documents, machine, drop=("text",)).select("doc_id", (fold("doc_id", 4) == F.lit(2)).alias("held_out"), "score", "predicted")
