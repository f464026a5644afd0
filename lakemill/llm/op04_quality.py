"""Document quality by a convolutional network over bytes, trained and run in numpy.

A document's bytes are laid into cells of CELL bytes; two neighbouring cells are
a chunk, so chunks overlap by half and cover the whole document. At every second
byte, each filter adds up learned values of the next WIDTH bytes. A chunk keeps
each filter's largest response; the document's probability is a logistic
function of the filters' largest and mean chunk values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import Adam, chunks, class_weights, extend, fold, labelled_sample, sigmoid, table, utf8

WIDTH, STRIDE, CELL, FILTERS = 8, 2, 128, 16
#: The classifier's training sample: documents of each class (0, 1), and their bytes together, at most.
SAMPLE, SAMPLE_BYTES = (2000, 2000), 32 << 20
#: Bytes of a training batch at most, unless a document alone has more.
BATCH_BYTES = 2 << 20
THRESHOLD = 0.3


@dataclass
class Network:
    taps: np.ndarray  # WIDTH x 256 x FILTERS: each filter's value of a byte at a place
    bias: np.ndarray
    dense: np.ndarray  # of the largest and the mean chunk values, and a constant at last


def lay_out(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents padded with zeros to whole cells, with room for a filter on both sides, so that none sees two documents; each document's first cell."""
    lengths = np.diff(starts)
    cells = (lengths + 2 * WIDTH + CELL - 1) // CELL
    first = np.concatenate([[0], np.cumsum(cells)])
    laid = np.zeros(first[-1] * CELL + WIDTH, np.uint8)
    laid[np.arange(len(data)) + np.repeat(first[:-1] * CELL + WIDTH - starts[:-1], lengths)] = data
    return laid, first


def responses(net: Network, laid: np.ndarray) -> np.ndarray:
    """cells x positions x filters."""
    places = (len(laid) - WIDTH) // STRIDE
    out = np.zeros((places, net.taps.shape[2]), np.float32)
    for k in range(WIDTH):
        out += np.take(net.taps[k], laid[k : k + places * STRIDE : STRIDE], axis=0)
    return out.reshape(-1, CELL // STRIDE, net.taps.shape[2])


def pooled(cells: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A chunk's value: the larger of its cell's and the next cell's of the same document."""
    out = cells.copy()
    follows = np.ones(len(cells), bool)
    follows[first[1:] - 1] = False
    follows = np.flatnonzero(follows)
    out[follows] = np.maximum(cells[follows], cells[follows + 1])
    return out


def features(net: Network, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rectified chunk values; for each document the largest, the mean and a one."""
    active = np.maximum(values + net.bias, 0)
    largest = np.maximum.reduceat(active, first[:-1])
    mean = np.add.reduceat(active, first[:-1]) / np.diff(first)[:, None]
    return active, np.concatenate([largest, mean, np.ones((len(mean), 1), np.float32)], axis=1)


def predict(net: Network, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each document's probability, some bytes at a time; of a very long one the cells are made piece by piece."""
    out = np.zeros(len(starts) - 1)
    for low, high in chunks(starts, 1 << 18):
        laid, first = lay_out(data[starts[low] : starts[high]], starts[low : high + 1] - starts[low])
        piece = (1 << 18) // CELL
        cells = np.concatenate([responses(net, laid[c * CELL : (c + piece) * CELL + WIDTH]).max(1) for c in range(0, first[-1], piece)])
        out[low:high] = sigmoid(features(net, pooled(cells, first), first)[1] @ net.dense)
    return out


def train(texts: list[str], y: np.ndarray, weights: np.ndarray, epochs: int = 6, size: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Gradient descent on the logistic loss; only the places that won a pool get a gradient."""
    random = np.random.default_rng(seed)
    net = Network(
        (random.standard_normal((WIDTH, 256, FILTERS)) * 0.1).astype(np.float32), np.zeros(FILTERS, np.float32), (random.standard_normal(2 * FILTERS + 1) * 0.1).astype(np.float32)
    )
    net.dense[-1] = 0
    encoded = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    adam = Adam([net.taps, net.bias, net.dense], rate)
    column = np.arange(FILTERS)
    for epoch in range(epochs):
        adam.rate = rate * (1 - epoch / epochs)
        order = random.permutation(len(encoded))
        lengths = np.array([len(encoded[i]) for i in order])
        at = 0
        while at < len(order):
            rows = order[at : at + max(1, min(size, int(np.searchsorted(np.cumsum(lengths[at : at + size]), BATCH_BYTES, side="right"))))]
            at += len(rows)
            starts = np.concatenate([[0], np.cumsum([len(encoded[i]) for i in rows])])
            laid, first = lay_out(np.concatenate([encoded[i] for i in rows]), starts)
            inside = responses(net, laid)
            cells = inside.max(1)
            values = pooled(cells, first)
            active, x = features(net, values, first)
            error = ((sigmoid(x @ net.dense) - y[rows]) * weights[rows] / len(rows)).astype(np.float32)
            by_max, by_mean = np.outer(error, net.dense[:FILTERS]), np.outer(error, net.dense[FILTERS:-1])
            documents = np.repeat(np.arange(len(rows)), np.diff(first))
            slope = by_mean[documents] / np.diff(first)[documents][:, None]
            slope += by_max[documents] * (active == x[documents, :FILTERS])
            slope *= active > 0
            winner = np.arange(len(cells))[:, None] + (values > cells)  # the chunk's cell that has the largest value
            chunk, filters = np.nonzero(slope)
            cell = winner[chunk, filters]
            won = inside.argmax(1)
            place = cell * CELL + won[cell, filters] * STRIDE
            g, grown = slope[chunk, filters], np.zeros_like(net.taps)
            for k in range(WIDTH):
                grown[k] = np.bincount(laid[place + k].astype(np.int64) * FILTERS + column[filters], g, 256 * FILTERS).reshape(256, FILTERS)
            adam.step([grown + 1e-5 * net.taps, slope.sum(0), x.T @ error + 1e-4 * net.dense])
    return net


def fit_quality(documents: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Network:
    """Learns labels.quality from a bounded sample of the training fold."""
    rows, counts = labelled_sample(documents, labels, "quality", 5, 0, sample, most_bytes)
    y = rows["label_"].to_numpy(float)
    return train(rows["text"].tolist(), y, class_weights(y, counts))


def score_quality(documents: DataFrame, net: Network, threshold: float = THRESHOLD, drop: tuple[str, ...] = (), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds score and predicted to the documents.

    A null or empty text is one cell of zeros and gets that score. Repeated rows
    are scored alike; other columns pass through, and a column named as an added
    one is replaced. Whole texts are read, whatever their length. With no
    labelled rows the score is that of an untrained network.
    """

    def run(rows: pa.RecordBatch) -> list:
        score = predict(net, *utf8(rows.column(rows.schema.get_field_index("text"))))
        return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]

    return extend(documents, run, f"{names[0]} double, {names[1]} int", drop)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit_quality(documents, table(spark, sf_dir, "labels"))
    return score_quality(documents, net, drop=("text",)).select("doc_id", (fold("doc_id", 5) == F.lit(0)).alias("held_out"), "score", "predicted")
