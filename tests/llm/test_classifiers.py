"""Toxicity and quality: held-out accuracy and odd rows."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from lakemill.llm import op03_toxicity as X
from lakemill.llm import op04_quality as Q
from tests.conftest import SMALL
from tests.llm.helpers import documents, odd_rows, prose

MEDIUM = SMALL.replace("0.001", "0.1")


def auc(score, y):
    pos, neg = np.sort(score[y == 1]), np.sort(score[y == 0])
    return np.searchsorted(neg, pos).sum() / len(pos) / len(neg)


@pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="no test tables here")
@pytest.mark.parametrize("query, label, least", [(X.op3_toxicity, "toxic", 0.95), (Q.op4_quality, "quality", 0.97)])
def test_ranks_held_out_documents(spark, query, label, least):
    rows = query(spark, MEDIUM).where("held_out").join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").toPandas()
    y, score = rows[label].to_numpy(), rows["score"].to_numpy()
    assert auc(score, y) > least and score.min() >= 0 and score.max() <= 1
    assert (score[y == 1] >= 0.3).mean() > 0.8 and (rows["predicted"] == (score >= 0.3)).all()


def machine():
    r = random.Random(4)
    texts = [prose(r, 40) + (" insult the group" if i % 2 else " praise the group") for i in range(200)]
    return X.train(texts, np.array([i % 2 for i in range(200)], float), np.ones(200), steps=60)


def network():
    r = random.Random(4)
    texts = [prose(r, 40).upper() + "!!" if i % 2 else prose(r, 40) for i in range(200)]
    return Q.train(texts, np.array([1 - i % 2 for i in range(200)], float), np.ones(200), epochs=3)


@pytest.mark.parametrize("score, model", [(X.score_toxicity, machine), (Q.score_quality, network)])
def test_odd_rows_and_other_columns(spark, score, model):
    df = documents(spark, [(d, t, 9.0, "kept") for d, t in odd_rows()], "doc_id long, text string, score double, predicted string")
    out = score(df, model())
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] == 4}
    assert len(same) == 1 and len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert score(df.limit(0), model()).count() == 0


def test_pairs_count_beside_single_terms():
    texts = ["slur", "group", "slur group", "other"] * 100
    y = np.array([0.0, 0.0, 1.0, 0.0] * 100)
    m = X.train(texts, y, np.ones(400), steps=400)
    data = np.frombuffer(b"slurgroupslur group", np.uint8)
    scores = X.predict(m, data, np.array([0, 4, 9, 19]))
    assert scores[2] > 0.7 and scores[0] < 0.3 and scores[1] < 0.3


def test_long_text_is_scored_in_pieces_as_a_whole():
    net, r = network(), random.Random(6)
    data = np.frombuffer(prose(r, 60_000).encode(), np.uint8)
    laid, first = Q.lay_out(data, np.array([0, len(data)]))
    whole = Q.sigmoid(Q.features(net, Q.pooled(Q.responses(net, laid).max(1), first), first)[1] @ net.dense)
    assert abs(float(Q.predict(net, data, np.array([0, len(data)]))[0]) - float(whole[0])) < 1e-6


def test_training_without_labels(spark):
    df, labels = documents(spark, [(1, "a b c")]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert X.score_toxicity(df, X.fit_toxicity(df, labels)).count() == 1 and Q.score_quality(df, Q.fit_quality(df, labels)).count() == 1


def test_the_sample_passes_over_only_what_does_not_fit(spark):
    from lakemill.llm.common import labelled_sample

    df = documents(spark, [(i, "x" * (100_000 if i % 5 == 0 else 10)) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows, counts = labelled_sample(df, labels, "toxic", 4, 2, (100, 100), 1 << 30)
    assert len(rows) == sum(counts) and (rows["text"].str.len() == 100_000).any()
    short = int((rows["text"].str.len() == 10).sum())
    some, _ = labelled_sample(df, labels, "toxic", 4, 2, (100, 100), 250_000)
    assert (some["text"].str.len() == 100_000).sum() == 2 and (some["text"].str.len() == 10).sum() == short


@pytest.mark.parametrize("long_one", range(0, 50, 7))
def test_one_long_text_costs_no_other(spark, long_one):
    from lakemill.llm.common import first_bytes

    df = documents(spark, [(i, "x" * (3000 if i == long_one else 50)) for i in range(50)])
    assert {r["doc_id"] for r in first_bytes(df, ["doc_id"], 2500).collect()} == set(range(50)) - {long_one}


def test_machine_equals_a_loop_over_pairs():
    m, r = machine(), random.Random(8)
    texts = [prose(r, n) + t for n, t in ((0, ""), (3, " insult the group"), (40, " insult insult group praise"), (1, ""))]
    raw = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    rows, bins = X.terms_of(np.frombuffer(b"".join(raw), np.uint8), starts)
    got = X.machine_logits(m, rows, bins, len(texts))
    for i in range(len(texts)):
        own = sorted({int(m.term[b]) for b in bins[rows == i]} - {-1})
        want = float(m.constant) + sum(float(m.weights[t]) for t in own)
        want += sum(float(m.factors[a] @ m.factors[b]) for n, a in enumerate(own) for b in own[n + 1 :])
        assert abs(got[i] - want) < 1e-4 * max(1, abs(want))


def test_network_equals_a_plain_convolution():
    net = network()
    raw = [b"", b"ab", b"x" * 255, bytes(range(256)) * 3]
    data, starts = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    laid, first = Q.lay_out(data, starts)
    got = Q.responses(net, laid)
    for i, text in enumerate(raw):
        own = np.frombuffer(bytes(Q.WIDTH) + text + bytes((first[i + 1] - first[i]) * Q.CELL - len(text)), np.uint8)
        cells = got[first[i] : first[i + 1]].reshape(-1, got.shape[2])
        for p in range(len(cells)):
            want = sum(net.taps[k, int(b)] for k, b in enumerate(own[p * Q.STRIDE : p * Q.STRIDE + Q.WIDTH]))
            assert np.abs(cells[p] - want).max() < 1e-4


def test_a_score_does_not_depend_on_the_next_document():
    net = network()
    texts = [b"", b"ab", b"x" * 113, b"y" * 120, bytes([255]) * 300]
    alone = [float(Q.predict(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) for t in texts]
    together = Q.predict(net, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert np.abs(together - alone).max() < 1e-6
