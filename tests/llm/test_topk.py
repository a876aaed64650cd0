import math
import random

import duckdb
import numpy as np
import pytest

from bundlelens.llm import topk


def brute(rows, every=50, k=5):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(i, []).append([math.floor(256 * float(np.float32(c))) for c in x])
    flat = [(i, x) for i, xs in v.items() for x in xs]
    found = []
    for q, x in flat:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in flat if i != q)[:k]
            found += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(found)


def rows_of(rng, n, kind):
    for i in range(n):
        scale = {"unit": 1.0, "spread": 10 ** rng.uniform(-2, 2), "ties": 1.0}[kind]
        x = [rng.gauss(0, 1) for _ in range(8)]
        norm = math.sqrt(sum(c * c for c in x))
        x = [scale * c / norm for c in x]
        yield i, [float(round(c)) for c in x] if kind == "ties" else x


@pytest.mark.parametrize("kind", ["unit", "spread", "ties"])
@pytest.mark.parametrize("bucket", [7, 2048])
def test_query(spark, tmp_path, monkeypatch, kind, bucket):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "SEEDS", 20)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rows = list(rows_of(random.Random(kind), 400, kind))
    rows += [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8), (1200, [0.0] * 8)]
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, topk.op6_topk(spark, str(tmp_path)).collect())) == brute(rows)


def test_few_and_none(spark):
    few = topk.quantised(spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, [])], "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, topk.top_k(few, few, 5).collect())) == [(0, 1, 1, 256 * 768), (0, 2, 2, 0), (1, 1, 0, 256 * 768), (1, 2, 2, 0), (2, 1, 0, 0), (2, 2, 1, 0)]
    none = few.limit(0)
    assert topk.top_k(none, none, 5).count() == 0 and topk.top_k(few, none, 5).count() == 0


def test_pruning_is_used():
    """On lengths that differ, most buckets are never multiplied."""
    rng = np.random.default_rng(0)
    vectors = np.floor(rng.normal(size=(4000, 16)) * (2.0 ** -(np.arange(4000) / 200))[:, None] * 4096).astype(np.int64)
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    calls = []
    best = topk.Best(1, 5)
    for i in range(0, 4000, 100):
        bucket = topk.Bucket(order[i : i + 100], vectors[order[i : i + 100]], norms[order[i : i + 100]])
        real = bucket.products
        bucket.products = lambda *a, real=real: calls.append(1) or real(*a)
        bucket.search(best, np.array([-1]), vectors[:1], norms[:1])
    assert len(calls) < 20
    want = sorted(range(4000), key=lambda j: (-int(vectors[0] @ vectors[j]), j))[:5]
    assert best.id.tolist() == want


def test_repeated_ids(spark, tmp_path):
    """Only the query's own row is left out: rows that repeat its id are candidates, and queries of their own."""
    rows = list(rows_of(random.Random(3), 60, "ties")) + [(0, [2.0] * 8), (0, [2.0] * 8), (50, [1.0] * 8), (7, [1.0] * 8), (7, [1.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = [(i, [math.floor(256 * c) for c in x]) for i, x in rows]
    want = []
    for at, (q, x) in enumerate(v):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for other, (i, y) in enumerate(v) if other != at)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert sorted(map(tuple, topk.op6_topk(spark, str(tmp_path)).collect())) == sorted(want)
    views = f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')"
    con = duckdb.connect()
    con.execute(views)
    assert sorted(con.execute(topk.OP6_SQL).fetchall()) == sorted(want)
