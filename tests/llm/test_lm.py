import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bundlelens.llm import lm


def corpus(n, rng=None):
    """Two kinds of texts with words of their own: what a state that is carried along can tell apart."""
    rng = rng or random.Random(1)
    for i in range(n):
        kind = rng.choice("ab")
        yield i, " ".join(f"{kind}{min(int(rng.expovariate(0.05)), 400)}" for _ in range(rng.choice([5, 40, 200])))


def brute(rows):
    train = Counter()
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            train.update((t or "").encode().lower().split())
            train[None] += 1
    n, v = sum(train.values()), len(train)
    for i, t in rows:
        own = [*(t or "").encode().lower().split(), None]
        yield i, zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, len(own), sum(train[w] > 0 for w in own), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own)


SMALL = lm.Sizes(head=64, neural=20, group=6, suffix_classes=3, suffix_inputs=5, lanes=5, window=4)


def vocabulary(rows, sizes=SMALL):
    counts = Counter()
    for _, t in rows:
        counts.update(lm.words(t))
        counts[lm.END] += 1
    head = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: sizes.head]
    return lm.Vocabulary(head, sum(counts.values()), len(counts), sizes), counts


def test_probabilities_sum_to_one():
    v, counts = vocabulary(list(corpus(50)))
    net = lm.Network(v)
    net.flat[:] = np.random.default_rng(2).normal(0, 0.5, net.flat.shape)
    h = np.repeat(np.random.default_rng(3).normal(size=(1, SMALL.hidden)).astype(np.float32), v.tail + 1, axis=0)
    assert np.exp(net.outputs(h, np.arange(v.tail + 1, dtype=np.int32))).sum() == pytest.approx(1, abs=1e-5)
    tail = [c for w, c in counts.items() if w not in v.ids]
    assert sum(c + 1 for c in tail) + 1 == pytest.approx(v.tail_total)


def naive(net, ids, inputs):
    """One text, step by step, in plain double arithmetic."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    v, n, h, total = net.v, SMALL.hidden, np.zeros(SMALL.hidden), 0.0
    for target, row in zip(ids, inputs):
        logits = h @ net.class_w + net.class_b
        c = v.class_of[target]
        total += logits[c] - np.log(np.exp(logits).sum()) + v.share[target]
        if c < v.n_neural:
            part = range(c * SMALL.group, min((c + 1) * SMALL.group, v.neural))
            scores = np.array([h @ net.word_w[i] + net.word_b[i] for i in part])
            total += scores[target - part[0]] - np.log(np.exp(scores).sum())
        x, a = net.table[row], h @ net.recurrent
        z, r = sigmoid(x[:n] + a[:n]), sigmoid(x[n : 2 * n] + a[n : 2 * n])
        h = (1 - z) * np.tanh(x[2 * n :] + r * a[2 * n :]) + z * h
    return total


def test_scores_whole_texts():
    """Lanes, windows and resets change nothing."""
    rows = list(corpus(40))
    v, _ = vocabulary(rows[:25])
    net = lm.Network(v)
    texts = [v.encode(t)[:2] for _, t in rows] + [v.encode("")[:2]]
    lm.train_texts(net, texts[:20])
    assert lm.score_texts(net, texts) == pytest.approx([naive(net, *t) for t in texts], abs=1e-3)


def test_gradients(monkeypatch):
    """Against differences of the loss, over a window with a text's start inside."""
    v, _ = vocabulary(list(corpus(30)))
    net = lm.Network(v)
    net.flat[:] = np.random.default_rng(4).normal(0, 0.4, net.flat.shape)
    texts = [v.encode(t)[:2] for _, t in list(corpus(30))[:6]]
    inputs, targets, number, fresh = (x[:6] for x in lm.lanes(texts, 3))
    fresh = fresh.copy()
    fresh[3, 1] = True
    h0 = np.random.default_rng(5).normal(0, 0.5, (inputs.shape[1], SMALL.hidden)).astype(np.float32)
    found = {}
    monkeypatch.setattr(lm.Network, "update", lambda self, grads, rows, row_grads, n: found.update(grads, rows=rows, row_grads=row_grads))
    net.learn(inputs, targets, number >= 0, fresh, h0)
    table = np.zeros_like(net.table)
    np.add.at(table, found["rows"], found["row_grads"])

    def loss():
        h, total = h0.copy(), 0.0
        for t in range(len(inputs)):
            h = h * ~fresh[t][:, None]
            on = number[t] >= 0
            total -= float(net.outputs(h[on], targets[t][on]).sum())
            h, _ = net.step(net.table[inputs[t]], h)
        return total

    rng = np.random.default_rng(6)
    for name, grad in {**{k: found[k] for k in ("recurrent", "class_w", "class_b", "word_w", "word_b")}, "table": table}.items():
        own = getattr(net, name)
        direction = rng.normal(size=own.shape).astype(np.float32)
        start, eps = own.copy(), 2e-3
        own[...] = start + eps * direction
        up = loss()
        own[...] = start - eps * direction
        down = loss()
        own[...] = start
        assert (up - down) / (2 * eps) == pytest.approx(float((grad * direction).sum()), rel=0.02, abs=0.05), name


@pytest.mark.parametrize("head", [64, 1 << 18])
def test_query(spark, tmp_path, head):
    sizes = lm.Sizes(head=head, neural=400, group=50, lanes=32)
    rows = [*corpus(400), (7, None), (8, ""), (8, "b1 UNSEEN b2"), (None, "a1 a1"), (9, "a1 " * 20_000)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, words string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, lm.score_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"), sizes).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(brute(rows), key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in found)
    standard = lm.op7_lm(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in standard), key=lambda r: (str(r[0]), r[2])) == [r[:5] for r in want]
    # held-out texts are likelier than by counts
    out = [r for r in found if r[1] and r[2] > 30]
    assert sum(r[6] for r in out) > sum(r[5] for r in out) + 0.05 * sum(r[2] for r in out)


def test_registered_query_on_given_documents(spark):
    """As registered, on a whole given table: texts held out are likelier than by counts, nearly each of them."""
    rows = [r for r in lm.op7_lm(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.n_tokens > 50]
    assert len(rows) > 1000
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.1 * sum(r.n_tokens for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.95 * len(rows)


def test_scores_dont_depend_on_files(spark, tmp_path):
    """The same documents in 1, 7 and 40 files, learned by several replicas, in any order of rows."""
    sizes = lm.Sizes(head=64, neural=400, group=50, lanes=32, replica=3000)
    docs = spark.createDataFrame([*corpus(400), (7, None), (None, "a1 a1")], "doc_id long, text string")
    found = []
    for n in (1, 7, 40):
        docs.repartition(n).sortWithinPartitions(F.rand(n)).write.parquet(f"{tmp_path}/{n}.parquet")
        found.append(sorted(((r.doc_id, r.n_tokens, r.score) for r in lm.score_documents(spark.read.parquet(f"{tmp_path}/{n}.parquet"), sizes).collect()), key=str))
    tokens = sum(r[1] for r in found[0])
    assert tokens > 3 * sizes.replica
    for other in found[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in found[0]] and [r[2] for r in other] == pytest.approx([r[2] for r in found[0]], rel=1e-5)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if lm.held_out(i))
    row = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert tuple(row)[:5] == (held, True, 3, 0, 0) and row.base_score == pytest.approx(0) and math.isfinite(row.score)
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
