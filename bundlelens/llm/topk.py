"""Exact top-k inner-product search by norm-bucketed retrieval.

Candidate vectors are sorted by length and cut into buckets. For a query q whose k-th best score so far is t, a bucket
whose longest vector has length l is skipped when |q| l < t. Otherwise t / (|q| l) is the bucket's local cosine
threshold, and it chooses how the bucket is pruned: below COORDINATE_FROM by length (only vectors with |q| |p| >= t are
products worth computing), from there by coordinate (a vector within that cosine of q has its component in the focus
coordinate inside an interval, which a sorted list of the coordinate gives at once). What is left is verified by exact
integer products. Pruning never loses a tie: only what is strictly below t goes.

The longest SEEDS vectors of all give every query its first t. Queries are read in blocks from the shared folder, so
neither their number nor that of the candidates is bounded by the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bundlelens.llm.shared import filesystem, fresh_path, stash

SCALE = 256
BUCKET, BLOCK, SEEDS = 2048, 512, 1024
#: Candidates of a partition.
PARTITION = 20_000
#: From this local cosine threshold on, a bucket is pruned by coordinate.
COORDINATE_FROM = 0.5
FOCUS = 4
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>, norm2): floor(256 x) of each component. Vectors that are null or hold a null or
    non-finite component, and rows without an id, take no part; columns of other names aren't read."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE)))).alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))


def _matrix(column, width: int):
    """Rows of integers as a matrix of doubles (or of integers, where doubles could be inexact), padded by zeros."""
    import numpy as np

    rows = column.to_pylist()
    found = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        found[i, : len(row)] = row
    return found


class Best:
    """The k best of each query of a block: scores descending, ties by id."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.k, self.n = k, n
        self.q, self.id, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.threshold = np.full(n, -np.inf)

    def add(self, q, ids, scores) -> None:
        import numpy as np

        if not len(q):
            return
        q, ids, scores = (np.concatenate(x) for x in ((self.q, q), (self.id, ids), (self.score, scores)))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.id, self.score = q[keep], ids[keep], scores[keep]
        last = rank == self.k - 1
        self.threshold[q[last]] = np.maximum(self.threshold[q[last]], scores[last])


class Bucket:
    """Candidates of similar length, longest first. A query is no candidate for itself: that is told by `own`, the ids
    unless given."""

    def __init__(self, ids, vectors, norms, own=None):
        import numpy as np

        self.ids, self.vectors, self.norms = ids, vectors, norms
        self.own = ids if own is None else own
        self.longest = float(norms[0]) if len(norms) else 0.0
        self.doubles = vectors.astype(np.float64)
        self.unit = self.doubles / np.where(norms > 0, norms, 1)[:, None]
        self.lists: dict[int, tuple] = {}

    def sorted_list(self, f: int):
        import numpy as np

        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = (self.unit[order, f], order)
        return self.lists[f]

    def products(self, rows, vectors, norms):
        """Exact products of some rows with query vectors."""
        import numpy as np

        if self.longest * float(np.max(norms, initial=0)) < EXACT:
            return (vectors.astype(np.float64) @ self.doubles[rows].T).astype(np.int64)
        return vectors @ self.vectors[rows].T

    def search(self, best: Best, own, vectors, norms) -> None:
        """Add to `best` all that this bucket has for the block's queries."""
        import numpy as np

        reach = norms * self.longest
        slack = 1e-9 * reach + 1e-6
        live = np.nonzero(reach + slack >= best.threshold)[0]
        local = np.where(reach[live] > 0, best.threshold[live] / np.where(reach[live] > 0, reach[live], 1), -np.inf)
        by_length = live[local < COORDINATE_FROM]
        if len(by_length):
            # the shortest vector that any of these queries can use ends the prefix
            need = np.where(norms[by_length] > 0, (best.threshold[by_length] - slack[by_length]) / np.where(norms[by_length] > 0, norms[by_length], 1), -np.inf)
            prefix = int(np.searchsorted(-self.norms, -float(need.min()), side="right"))
            scores = self.products(slice(0, prefix), vectors[by_length], norms[by_length])
            good = (scores >= best.threshold[by_length][:, None]) & (self.own[:prefix][None, :] != own[by_length][:, None])
            i, j = np.nonzero(good)
            best.add(by_length[i], self.ids[j], scores[i, j])
        found = []
        for q in live[local >= COORDINATE_FROM]:
            rows = self.by_coordinate(vectors[q] / norms[q], (best.threshold[q] - slack[q]) / reach[q])
            if len(rows):
                scores = self.products(rows, vectors[q : q + 1], norms[q : q + 1])[0]
                good = (scores >= best.threshold[q]) & (self.own[rows] != own[q])
                found.append((np.full(int(good.sum()), q), self.ids[rows[good]], scores[good]))
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def by_coordinate(self, unit, cosine: float):
        """Rows whose components are feasible in all focus coordinates, the narrowest interval first."""
        import numpy as np

        focus = np.argsort(-np.abs(unit))[:FOCUS]
        spread = np.sqrt(max(0.0, 1 - cosine * cosine) * np.maximum(0, 1 - unit[focus] ** 2)) + 1e-9
        # a cosine above the threshold lies in a narrower cone; the interval's ends are those of the threshold's cone,
        # or +-1 where the cone holds the axis itself
        low = np.where(unit[focus] <= -cosine, -1.0, unit[focus] * cosine - spread)
        high = np.where(unit[focus] >= cosine, 1.0, unit[focus] * cosine + spread)
        ranges = []
        for f, a, b in zip(focus, low, high, strict=True):
            values, order = self.sorted_list(int(f))
            ranges.append((int(np.searchsorted(values, a - 1e-9, side="left")), int(np.searchsorted(values, b + 1e-9, side="right")), order))
        begin, end, order = min(ranges, key=lambda r: r[1] - r[0])
        rows = order[begin:end]
        for f, a, b in zip(focus, low, high, strict=True):
            rows = rows[(self.unit[rows, f] >= a - 1e-9) & (self.unit[rows, f] <= b + 1e-9)]
        return rows


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of quantised rows: each query's k best, all where there are fewer.

    A query's own id is no candidate for it. Ties go to the smaller vec_id. Rows that repeat an id are candidates each,
    and queries each. Vectors of different lengths count as padded by zeros. Products must fit 64 bits. Without queries
    or candidates the result is empty.
    """
    columns = ["vec_id", "v", "norm2", F.col("vec_id").alias("own")]
    return _retrieved(stash(candidates.select(*columns), "topk-candidates"), queries.select(*columns), k)


def top_k_within(vectors: DataFrame, wanted: Column, k: int) -> DataFrame:
    """`top_k` of the quantised rows that are `wanted` among all. A query's own row is no candidate for it; others with
    its id are."""
    rows = stash(vectors.select("vec_id", "v", "norm2", F.monotonically_increasing_id().alias("own")), "topk-candidates")
    return _retrieved(rows, rows.where(wanted), k)


def _retrieved(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best candidates, a written table, of each query; rows of both with the same `own` aren't compared."""
    import pyarrow as pa

    spark = candidates.sparkSession
    path = fresh_path(spark, "topk-queries")
    queries.select("vec_id", "v", F.sqrt("norm2").alias("norm"), "own").write.parquet(path)
    n, width = candidates.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 0, spark.read.parquet(path).agg(F.max(F.size("v"))).first()[0] or 0, 1)
    longest = candidates.orderBy(F.desc("norm2"), "vec_id").limit(SEEDS).toArrow()  # a fixed number, for the thresholds
    seeds = spark.sparkContext.broadcast((longest.column("vec_id").to_numpy(), _matrix(longest.column("v"), width), longest.column("own").to_numpy()))
    parts = max(-(-n // PARTITION), min(spark.sparkContext.defaultParallelism, -(-n // BUCKET)), 1)
    dealt = candidates.repartitionByRange(parts, F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")

    def blocks() -> Iterator:
        import pyarrow.dataset as ds

        fs, at = filesystem(path)
        first = 0
        for batch in ds.dataset(at, filesystem=fs, format="parquet").to_batches(batch_size=BLOCK):
            if batch.num_rows:
                yield first, batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), width), batch.column("norm").to_numpy(), batch.column("own").to_numpy()
            first += batch.num_rows

    def run(batches: Iterable) -> Iterator:
        import numpy as np

        ids, vectors, norms, own = [], [], [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            vectors.append(_matrix(batch.column(1), width))
            norms.append(np.sqrt(batch.column(2).to_numpy()))
            own.append(batch.column(3).to_numpy())
        if not sum(map(len, ids)):
            return
        columns = [np.concatenate(x) for x in (ids, vectors, norms, own)]
        buckets = [Bucket(*(x[i : i + BUCKET] for x in columns)) for i in range(0, len(columns[0]), BUCKET)]
        seed_ids, seed_vectors, seed_own = seeds.value
        seed = Bucket(seed_ids, seed_vectors, np.sqrt((seed_vectors.astype(np.float64) ** 2).sum(axis=1)), seed_own)
        for first, query_ids, query_vectors, query_norms, query_own in blocks():
            lower = Best(len(query_ids), k)
            seed.search(lower, query_own, query_vectors, query_norms)
            best = Best(len(query_ids), k)
            best.threshold = lower.threshold.copy()
            for bucket in buckets:
                bucket.search(best, query_own, query_vectors, query_norms)
            yield pa.RecordBatch.from_arrays([pa.array(first + best.q), pa.array(query_ids[best.q]), pa.array(best.id), pa.array(best.score)], ["at", "query_id", "vec_id", "score"])

    found = dealt.select("vec_id", "v", "norm2", "own").mapInArrow(run, "at long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "at").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast(T.IntegerType())).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k_within(vectors, F.col("vec_id") % 50 == 0, 5)


OP6_SQL = """
WITH v AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
