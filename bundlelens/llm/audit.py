"""Filter interaction audit by an incidence matrix product.

Which filters a document fails is a mask of one bit for each. Spark counts the masks of each part of the corpus, for all
documents, the good and the toxic ones: histograms that are stacked as rows. Whatever the order in which n filters are
applied, what becomes of a mask at a step is known beforehand, so that each outcome is an integer matrix of 2^n masks by
n! * n steps, and the counts of all orders are products of the histograms with these matrices. No order is replayed on
documents, and what is shuffled are counts and ids, never texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.shared import stash

#: Filters that a text alone decides, as SQL over text and w, its words; E, that of repeated texts, looks at the table.
TEXT_FILTERS = {
    "A": "size(w) < 200",
    "B": "100 * size(array_distinct(w)) < 50 * size(w)",
    "C": f"100 * (length(text) - length(translate(text, '{''.join(map(chr, range(65, 91)))}', ''))) > 3 * length(text)",
    "D": "text RLIKE '[#$%&*|]'",
}
FILTERS = "ABCDE"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts whose histograms are multiplied at once; each gives 600 rows.
STACKED = 64


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", " " * 5), " ", -1), "")


def masks(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of every row: bit i is set where the row fails the filter FILTERS[i].

    Null texts are empty, null parts "". A row fails E if its whole text (by SHA-256) is also that of a smaller id: rows
    that repeat an id don't fail for each other, and a row without an id neither fails E nor makes others fail. Other
    columns aren't read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    docs = docs.select("*", F.explode(F.array(_words(F.col("text")))).alias("w"))  # a generator: words are made once
    bits = [F.when(F.expr(rule), 1 << FILTERS.index(name)).otherwise(0) for name, rule in TEXT_FILTERS.items()]
    docs = stash(docs.select("doc_id", "part", sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-masks")
    named = docs.where("doc_id IS NOT NULL")
    firsts = named.groupBy(F.col("digest").alias("of")).agg(F.min("doc_id").alias("first"))
    # joined by id and digest, not by digest alone: copies are many rows of one digest, but of as many ids
    found = named.join(firsts, (F.col("doc_id") == F.col("first")) & (F.col("digest") == F.col("of")), "left")
    repeated = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    found = found.select("doc_id", "part", (F.col("mask") + repeated).alias("mask"))
    return found.unionByName(docs.where("doc_id IS NULL").select("doc_id", "part", "mask"))


def labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """`df` (doc_id, ...) with good and toxic: whether any row of `labels` (doc_id, quality, toxic) says 1 of the id.
    Rows without a label or an id are neither."""
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    named = df.where("doc_id IS NOT NULL").join(said, F.col("doc_id") == F.col("of"), "left").drop("of").fillna(False, ["good", "toxic"])
    return named.unionByName(df.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))


@cache
def matrices(n: int):
    """(orders, {outcome: matrix of 2^n masks by n! * n steps}); the columns are the steps of the first order, then those
    of the second, and so on. `shapley` has, for the filter of a step, the orders in which it is the one that removes."""
    import numpy as np

    orders = np.array(list(permutations(range(n))))
    mask = np.arange(1 << n)[:, None]
    own = (1 << orders).reshape(1, -1)
    earlier = np.concatenate([np.zeros((len(orders), 1), dtype=int), np.cumsum(1 << orders, axis=1)[:, :-1]], axis=1).reshape(1, -1)
    fails, gone = (mask & own) > 0, (mask & earlier) > 0
    found = {"kept": (mask & (own | earlier)) == 0, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own}
    found = {k: m.astype(np.int64) for k, m in found.items()}
    by_filter = np.stack([(found["removed"] * (orders.reshape(1, -1) == f)).sum(axis=1) for f in range(n)], axis=1)
    found["shapley"] = by_filter[:, orders.reshape(-1)]
    return orders, found


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, order of the filters and step, what becomes of the rows (part, mask, good, toxic).

    (part, filter_order, step from 1, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): zeros are
    rows too; no rows give no parts. Null parts are "". Parts are counted by Spark and multiplied where they are.
    """
    import pyarrow as pa

    n = len(filters)
    counts = rows.groupBy(F.coalesce("part", F.lit("")).alias("part"), "mask").agg(F.count("*").alias("all"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    stacked = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "all", "good", "toxic")).alias("counts"))  # 2^n at most

    def run(batches: Iterable) -> Iterator:
        import numpy as np

        orders, of = matrices(n)
        names = ["".join(filters[f] for f in o) for o in orders]
        for whole in batches:
            for batch in (whole.slice(i, STACKED) for i in range(0, whole.num_rows, STACKED)):
                lists, k = batch.column(1), batch.num_rows
                row = np.repeat(np.arange(k), lists.value_lengths().to_numpy())
                mask, *counts = (c.to_numpy() for c in lists.flatten().flatten())
                histograms = np.zeros((3, k, 1 << n), dtype=np.int64)
                for h, c in zip(histograms, counts, strict=True):
                    np.add.at(h, (row, mask), c)
                everything, good, toxic = histograms
                found = {name: everything @ m for name, m in of.items()} | {"good_lost": good @ of["removed"], "toxic_lost": toxic @ of["removed"]}
                steps = len(orders) * n
                columns = [
                    batch.column(0).take(pa.array(np.repeat(np.arange(k), steps))),
                    pa.array(np.tile(np.repeat(names, n), k).tolist()), pa.array(np.tile(np.arange(1, n + 1), k * len(orders)), pa.int32()),
                    *(pa.array(found[o].reshape(-1)) for o in OUTCOMES),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *OUTCOMES])

    return stacked.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{o} long" for o in OUTCOMES))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return audit(labelled(masks(read("documents")), read("labels")))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
             + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
b AS (SELECT unnest(range(5)) AS b),
o AS (SELECT x.b AS b1, y.b AS b2, z.b AS b3, v.b AS b4, w.b AS b5 FROM b x, b y, b z, b v, b w WHERE (1 << x.b) | (1 << y.b) | (1 << z.b) | (1 << v.b) | (1 << w.b) = 31),
s AS (SELECT substr('ABCDE', (b1 + 1)::INT, 1) || substr('ABCDE', (b2 + 1)::INT, 1) || substr('ABCDE', (b3 + 1)::INT, 1) || substr('ABCDE', (b4 + 1)::INT, 1) || substr('ABCDE', (b5 + 1)::INT, 1) AS filter_order,
             step, (1 << [b1, b2, b3, b4, b5][step]) AS own, list_sum(list_transform([b1, b2, b3, b4, b5][1:step], lambda i: 1 << i))::BIGINT - (1 << [b1, b2, b3, b4, b5][step]) AS earlier
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
c AS (SELECT part, filter_order, step::INT AS step, own,
             coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
      FROM h, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM c
"""
