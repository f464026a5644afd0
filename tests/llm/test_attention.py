"""Language-model scores: exact base, gradients, each id scored once."""

from __future__ import annotations

import collections
import math
import pickle
import zlib

import numpy as np
import pytest

from lakemill.llm import op07_attention as A
from tests.llm.helpers import documents, odd_rows, prose


def counted(seqs, key_of, turned=False):
    out = np.zeros((int(key_of.max()) + 1) * A.IDS, np.float32)
    for s in seqs:
        np.add.at(out, A.pairs_of(s[::-1] if turned else s, key_of), 1)
    return out.reshape(-1, A.IDS)


def made(seqs):
    """A model that knows the counts of some texts."""
    seen = np.bincount(np.concatenate([np.append(s, A.END) for s in seqs]), minlength=A.IDS)
    near = A.neighbours_of(A.ranks_of(seen))
    m = A.new_model(*A.clusters_of(seen, np.concatenate([counted(seqs, near), counted(seqs, near, turned=True)])), seen)
    A.with_counts(m, counted(seqs, m.key_of))
    return m


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(0)
    seqs = [r.integers(0, 300, n).astype(np.uint16) for n in (3, 0, 40, 17)]
    return made(seqs), seqs


def test_gradients(model):
    m, seqs = model
    inputs, targets, real, _ = A.windows_of(seqs)
    real = np.arange(A.WINDOW)[None, :] < real[:, None]

    def loss():
        return A.gradients(m, inputs, targets, A.by_counts(m, inputs, targets), real)

    _, g, owed = loss()
    assert owed.shape == (inputs.size, A.MIX) and (owed >= 0).all() and owed.sum(1).max() <= 1 + 1e-5
    for w, d in zip(m.weights(), g, strict=True):
        i = np.unravel_index(np.argmax(np.abs(d)), d.shape)
        old, step = w[i], 1e-2
        w[i] = old + step
        up = loss()[0]
        w[i] = old - step
        down = loss()[0]
        w[i] = old
        assert abs((up - down) / (2 * step) - d[i]) < 0.05 * abs(d[i]) + 1e-4


def test_probabilities_sum_to_one(model):
    m, _ = model
    logits = A.forward(m, m.row[np.full((1, A.WINDOW), A.END)], A.WINDOW)[0][0]
    p = np.exp(logits - logits.max())
    p = (p / p.sum()).astype(np.float64)
    total = m.spread.astype(np.float64) @ p[: A.MIX] + m.beside[m.key_of[A.END]].astype(np.float64) * p[A.MIX]
    assert abs(total.sum() - 1) < 1e-4 and total.min() > 0


def test_a_pass_lowers_the_loss_of_ids(model):
    m, _ = model
    r = np.random.default_rng(2)
    seqs = [np.resize(r.permutation(40)[:7], 60).astype(np.uint16) for _ in range(40)]
    inputs, targets, real, _ = A.windows_of(seqs)
    mask = np.arange(A.WINDOW)[None, :] < real[:, None]
    counted = A.by_counts(m, inputs, targets)
    before = A.gradients(m, inputs, targets, counted, mask)[0]
    weights, owed = A.descend(m, inputs, targets, counted, real, 0.02, 1, size=32)
    better = A.replace(m, **dict(zip(A._BODY, weights, strict=True)))
    assert A.gradients(better, inputs, targets, counted, mask)[0] < before - 0.05
    assert owed.sum() <= real.sum() + 1e-3 and (owed[50:A.END] == 0).all()


def test_training_grows_with_the_corpus_and_lowers_held_out_loss(spark):
    import random

    r = random.Random(3)
    vocabulary = prose(r, 60).split()

    def text():
        at = r.randrange(60)
        return " ".join(vocabulary[(at + 7 * i) % 60] for i in range(80))

    def tokens(n):
        rows = [(0, i, A.subwords(text()).tobytes(), 1) for i in range(n)]
        return spark.createDataFrame(rows, "kind int, rid long, ids binary, which long")

    m = made([A.subwords(text()) for _ in range(40)])
    fresh = [A.subwords(text()) for _ in range(20)]
    before = A.log_probabilities(m, fresh).sum()
    few, many = tokens(100), tokens(400)
    assert 3 < A.training_windows(m, many, 8).count() / A.training_windows(m, few, 8).count() < 5
    A.fit(m, many, 1, rounds=3)
    assert A.log_probabilities(m, fresh).sum() > before * 0.95  # of negative numbers: at least a twentieth better
    assert abs(m.spread.sum(0, dtype=np.float64) - 1).max() < 1e-4


def test_what_is_sent_is_small_and_the_same(model):
    m, _ = model
    sent = pickle.dumps(m)
    assert len(sent) < 20 << 20 and np.array_equal(pickle.loads(sent).beside, m.beside)
    f = A.Frequent.of(np.sort(A.mix(np.arange(1, 1000, dtype=np.uint64))))
    assert len(pickle.dumps(f)) < 20_000 and (pickle.loads(pickle.dumps(f)).place(f.hashes) == np.arange(999)).all()


def test_no_frequent_word_is_pushed_out():
    hashes = np.sort(A.mix(np.arange(1, 1 + A.FREQUENT, dtype=np.uint64)))
    f = A.Frequent.of(hashes)
    assert (f.place(hashes) == np.arange(len(hashes))).mean() > 0.9999
    assert (f.place(A.mix(np.arange(1 << 30, (1 << 30) + 1000, dtype=np.uint64))) == -1).all()


def test_each_id_is_scored_once(model):
    m, _ = model
    text = np.arange(100).astype(np.uint16)
    inputs, targets, real, number = A.windows_of([text])
    scored = []
    for w in range(len(inputs)):
        scored += targets[w][(0 if number[w] == 0 else A.WINDOW - A.HALF) : real[w]].tolist()
    assert scored == [*range(100), A.END]
    both = A.log_probabilities(m, [text, text[:5]])
    assert np.allclose(both, [A.log_probabilities(m, [text])[0], A.log_probabilities(m, [text[:5]])[0]], atol=1e-3)


def test_nothing_ahead_is_seen(model):
    m, _ = model
    a, b = (np.array(x, np.int64)[None, :] for x in ([*range(A.WINDOW)], [*range(A.WINDOW - 1), 299]))
    x, y = (A.forward(m, m.row[i], A.WINDOW)[0] for i in (a, b))
    assert np.allclose(x[:-1], y[:-1], atol=1e-5) and not np.allclose(x[-1], y[-1], atol=1e-5)


def test_counts_beside_ids_are_of_all_training_texts(spark):
    r = np.random.default_rng(5)
    seqs = [r.integers(0, 900, n).astype(np.uint16) for n in (0, 1, 2, 700, 40, 5000)] * 3
    rows = [(0, i, s.tobytes(), int(i % 4 != 1)) for i, s in enumerate(seqs)]
    tokens = spark.createDataFrame([*rows, (2, None, None, 7)], "kind int, rid long, ids binary, which long").repartition(5)
    near = A.neighbours_of(np.arange(A.IDS))
    used = [s for i, s in enumerate(seqs) if i % 4 != 1]
    before, ahead = (np.zeros((A.NEAR + A.HEAPS, A.IDS)) for _ in range(2))
    for s in used:
        whole = [A.END, *s.tolist(), A.END]
        for a, b in zip(whole, whole[1:], strict=False):
            before[near[a], b] += 1
            ahead[near[b], a] += 1
    found = A.beside(tokens, near, near)
    assert np.array_equal(found[: len(before)], before) and np.array_equal(found[len(before) :], ahead)


def test_ids_with_like_neighbours_share_a_cluster():
    r = np.random.default_rng(6)
    kinds = [np.arange(200 + 30 * k, 230 + 30 * k) for k in range(3)]  # a text goes round the kinds, any of their ids each time
    seqs = [np.concatenate([[r.choice(k) for k in kinds] for _ in range(60)]).astype(np.uint16) for _ in range(80)]
    seen = np.bincount(np.concatenate([np.append(s, A.END) for s in seqs]), minlength=A.IDS)
    near = A.neighbours_of(A.ranks_of(seen))
    cluster_of, _ = A.clusters_of(seen, np.concatenate([counted(seqs, near), counted(seqs, near, turned=True)]), classes=4)
    found = [set(cluster_of[k].tolist()) for k in kinds]
    assert not (found[0] & found[1] or found[1] & found[2] or found[0] & found[2])


def slow_log_probability(m, ids):
    """Natural logarithm of a text's probability, id by id with plain loops over the window."""
    text, total = [A.END, *ids, A.END], 0.0
    for t in range(1, len(text)):
        window = 0 if t <= A.WINDOW else -(-(t - A.WINDOW) // A.HALF)  # the first that scores this id
        seen = text[window * A.HALF : t]
        x = [m.embedding[m.row[a]].astype(float) + m.place[i] for i, a in enumerate(seen)]
        q, keys, values = x[-1] @ m.qkv[:, : A.WIDTH], [v @ m.qkv[:, A.WIDTH : 2 * A.WIDTH] for v in x], [v @ m.qkv[:, 2 * A.WIDTH :] for v in x]
        weight = [math.exp(float(q @ k) / math.sqrt(A.WIDTH)) for k in keys]
        h = x[-1] + sum(w / sum(weight) * v for w, v in zip(weight, values, strict=True)) @ m.out
        g = h + np.maximum(h @ m.up + m.up_bias, 0) @ m.down
        mixture = [math.exp(z) for z in (g @ m.mixing + m.mixing_bias).tolist()]
        own = [*m.spread[text[t]].tolist(), float(m.beside[m.key_of[text[t - 1]], text[t]])]
        total += math.log(sum(w * p for w, p in zip(mixture, own, strict=True)) / sum(mixture))
    return total


def test_scores_equal_a_plain_loop_over_whole_texts(model):
    m, seqs = model
    r = np.random.default_rng(11)
    texts = [*seqs, *(r.integers(0, 400, n).astype(np.uint16) for n in (1, 7, 8, 15, 16, 17, 23, 24, 25, 33, 120))]
    assert np.allclose(A.log_probabilities(m, texts), [slow_log_probability(m, t.tolist()) for t in texts], rtol=1e-4, atol=1e-3)


def test_base_equals_brute_force(spark):
    import random

    r = random.Random(8)
    rows = [(i, prose(r, r.randrange(1, 60))) for i in range(80)] + odd_rows()
    got = A.score_texts(documents(spark, [(*x, 1.0) for x in rows], "doc_id long, text string, score double")).collect()
    words = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    train = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for d, _ in rows]
    counts = collections.Counter(w for ws, yes in zip(words, train, strict=True) if yes for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    found = sorted((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got)
    expected = sorted(
        (str(d), not yes, len(ws), sum(w in counts for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 6)) for (d, _), yes, ws in zip(rows, train, words, strict=True)
    )
    assert found == expected
    assert all(x["score"] < 0 and math.isfinite(x["score"]) for x in got)


def test_empty_table(spark):
    assert A.score_texts(documents(spark, [])).count() == 0


def test_each_id_of_the_training_texts_is_learned_from(spark):
    """Rounds take all parts of a corpus: an id that one text alone has is learned from, whichever text that is."""
    base = [np.resize(np.arange(30 + i % 5), 40 + i).astype(np.uint16) for i in range(60)]
    texts = [np.append(x, np.full(9, 1000 + i, np.uint16)) for i, x in enumerate(base)]
    tokens = spark.createDataFrame([(0, i, x.tobytes(), 1) for i, x in enumerate(texts)], "kind int, rid long, ids binary, which long")
    m = made(texts)
    learned = np.zeros(A.IDS, np.int64)
    for x in A.training_windows(m, tokens).collect():
        learned += np.bincount(np.frombuffer(x["ids"], np.uint16)[A.WINDOW :][: x["real"]], minlength=A.IDS)
    assert all(learned[1000 + i] >= 9 for i in range(60)) and learned[A.END] == 60
    began = m.spread.copy()
    A.fit(m, tokens, sum(len(x) for x in texts) // A.HALF, rounds=3, least=40)
    share = m.spread / began  # of ids that nothing was learned from it is the same
    assert (np.abs(share[1000:1060] / share[40000] - 1).max(1) > 1e-4).all()


def test_training_tasks_are_as_many_as_planned(spark, monkeypatch):
    """Each task sends a row an id: where a session deals to many more partitions than asked for, what is sent would grow with them."""
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols, f=frame.repartition: f(self, max(40, n) if cols and isinstance(n, int) else n, *cols))
    texts = [np.resize(np.arange(30 + i % 5), 200).astype(np.uint16) for i in range(60)]
    tokens = spark.createDataFrame([(0, i, x.tobytes(), 1) for i, x in enumerate(texts)], "kind int, rid long, ids binary, which long")
    tasks, m = [], made(texts)
    summed = frame.mapInArrow

    def counting(self, f, schema, **other):
        if schema == "key long, row binary" and f is not A._sums:
            tasks.append(self.rdd.getNumPartitions())
        return summed(self, f, schema, **other)

    monkeypatch.setattr(frame, "mapInArrow", counting)
    A.fit(m, tokens, sum(len(x) for x in texts) // A.HALF, rounds=2)
    assert tasks == [1, 1]


def test_weights_travel_in_small_rows(model):
    m, _ = model
    owed = np.zeros((A.IDS, A.MIX), np.float32)
    owed[[3, 500]] = 0.25
    rows = A.sent(m.weights(), owed, 7)
    keys, values = rows.column(0).to_pylist(), rows.column(1).to_pylist()
    assert max(len(v) for v in values) <= 4 * A.SENT and [k for k in keys if k >= 0] == [3, 500]
    flat = np.concatenate([np.frombuffer(v, np.float32) for k, v in zip(keys, values, strict=True) if k < 0])
    assert flat[-1] == 7 and np.allclose(flat[:-1] / 7, np.concatenate([w.ravel() for w in m.weights()]), atol=1e-6)
