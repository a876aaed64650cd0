import random
from zlib import crc32

import numpy as np
import pytest

from bundlelens.llm import gam


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    values, rank = np.unique(scores[order], return_inverse=True)
    places = np.bincount(rank, np.arange(1, len(order) + 1)) / np.bincount(rank)
    ranks = np.empty(len(order))
    ranks[order] = places[rank]
    positive = labels == 1
    return (ranks[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())


def test_features():
    assert gam.features(None) == gam.features("") == gam.features(" \n\t") == [0.0] * len(gam.FEATURES)
    found = dict(zip(gam.FEATURES, gam.features("THE the the é#\nx 12\nx 12\n\n"), strict=True))
    raw = "THE the the é#\nx 12\nx 12\n\n".encode()
    want = {"words": np.log1p(8), "distinct": 5 / 8, "repeats": 1 / 8, "top_word": 2 / 8, "upper": 3 / len(raw), "symbols": 1 / len(raw), "digits": 4 / len(raw), "high_bytes": 2 / len(raw), "dup_lines": 1 / 3, "line_words": np.log1p(8 / 3), "plain_words": 5 / 8}
    assert {k: found[k] for k in want} == pytest.approx(want)


def best_tree(g, h, leaves):
    """The largest gain of all ways to cut a histogram, one cut after the other."""
    parts = [(0, len(g))]
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + gam.RIDGE)
    while len(parts) < leaves:
        options = [(gain(a, m) + gain(m, b) - gain(a, b), i, m) for i, (a, b) in enumerate(parts) for m in range(a + 1, b) if h[a:m].sum() >= gam.LEAST and h[m:b].sum() >= gam.LEAST]
        if not options or max(options)[0] <= 1e-9:
            break
        _, i, m = max(options)
        parts[i : i + 1] = [(parts[i][0], m), (m, parts[i][1])]
    return sum(gain(a, b) for a, b in parts)


def test_trees_against_all_cuts():
    rng = np.random.default_rng(1)
    for _ in range(30):
        g, h = rng.normal(size=12), rng.uniform(0, 3, 12)
        tree = gam.shallow_tree(g, h)
        assert len(set(np.round(tree, 12))) <= 3
        assert sum(g * tree) == pytest.approx(best_tree(g, h, 3))
        g, h = rng.normal(size=(5, 4)), rng.uniform(2, 4, (5, 4))
        gain, table = gam.pair_tree(g, h)
        of = lambda a, b: a.sum() ** 2 / (b.sum() + gam.RIDGE)
        split = lambda a, b: max([of(a, b), *(of(a[:, :j], b[:, :j]) + of(a[:, j:], b[:, j:]) for j in range(1, a.shape[1]))])
        all_cuts = [split(x[:i], w[:i]) + split(x[i:], w[i:]) for x, w in ((g, h), (g.T, h.T)) for i in range(1, len(x))]
        assert gain == pytest.approx(max(all_cuts) - of(g, h)) and (g * table).sum() == pytest.approx(gain + of(g, h))


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    new = rng.uniform(size=(1000, 4))
    want = (new[:, 0] > 0.5) ^ (new[:, 2] > 0.5)
    with_pairs, without = gam.fit(x, y, cycles=10), gam.fit(x, y, cycles=10, n_pairs=0)
    assert (0, 2) in with_pairs.pairs and auc(with_pairs.scores(new), want) > 0.97 and auc(without.scores(new), want) < 0.65


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(500, 3)), 1)
    model = gam.fit(x, (x[:, 0] + rng.normal(size=500) > 0).astype(float), cycles=5, pair_cycles=5)
    for row, score in zip(x[:50], model.scores(x[:50]), strict=True):
        own = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, own, strict=True)) + sum(t[gam.coarse(own[a]), gam.coarse(own[b])] for (a, b), t in model.pairs.items())
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def documents():
    rng = random.Random(5)
    for i in range(600):
        bad = rng.random() < 0.3
        text = " ".join((rng.choice("abcdefgh") * rng.randint(1, 6) + "###" * bad) for _ in range(rng.randint(0, 60)))
        yield (i if i % 50 else None, None if i % 41 == 0 else text, 0 if bad else 1)


def test_rows(spark):
    rows = list(documents()) + [(7, "same id again", 1)] * 3
    docs = spark.createDataFrame([(*r[:2], "x", 1.0) for r in rows], "doc_id long, text string, features string, score double")
    labels = spark.createDataFrame([(i, q, "x") for i, _, q in rows] + [(3, None, "x")], "doc_id long, quality int, label string")
    found = gam.classify(docs.repartition(1), labels)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted(map(tuple, gam.classify(docs.repartition(5), labels.repartition(3)).collect()), key=str)
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=str)
    assert all(held == (i is not None and crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == (score >= 0.3) for i, held, score, predicted in got)
    quality = {i: q for i, t, q in rows if t and i is not None}
    wrong = [g for g in got if g[0] in quality and g[1] and g[3] != quality[g[0]]]
    assert len(wrong) <= 3


def test_labels_of_held_out_rows_say_nothing(spark):
    rows = [r for r in documents() if r[0] is not None]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    of = lambda change: sorted(map(tuple, gam.classify(docs, spark.createDataFrame([(i, 1 - q if change and crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in rows], "doc_id long, quality int")).collect()))
    assert of(False) == of(True)


def test_sample_is_bounded(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "array(double(id)) AS features", "int(id % 2) AS label")
    x, y = gam.sampled(rows.repartition(7), 900)
    again, _ = gam.sampled(rows.repartition(2), 900)
    assert len(x) == len(y) == 900 and (x == again).all()


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None)]])
def test_little_to_learn(spark, labels):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (None, "")], "doc_id long, text string")
    found = gam.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(found) == 3 and len({r.score for r in found}) == 1
    assert gam.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_held_out_accuracy(spark):
    """The registered query on a given table: documents whose labels weren't learned from."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in gam.op12_quality_gam(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    score, label, predicted = np.array([r.score for r in rows]), np.array([labels[r.doc_id] for r in rows]), np.array([r.predicted for r in rows])
    print(len(rows), auc(score, label), (predicted == label).mean(), predicted[label == 1].mean(), (predicted[label == 0] == 0).mean())
    assert len(rows) > 600 and auc(score, label) > 0.95 and (predicted == label).mean() > 0.97
    assert predicted[label == 1].mean() > 0.99 and (predicted[label == 0] == 0).mean() > 0.85
