"""Clusters by overlap with leaders: what one pass over the items in their order would make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.operators.closure import numbered
from bundlelens.operators.graphs import Rounds, written

#: Items in the first batch; each batch is twice as large as all before it together.
FIRST_BATCH = 256


def _probes(items: DataFrame, share: float) -> DataFrame:
    """(at, n, feature): so many of each item's features, its rarest ones, that whatever shares enough with it has one."""
    rows = items.select("at", "n", F.explode("features").alias("feature"))
    rarity = rows.groupBy("feature").agg(F.count("*").alias("_df"))
    place = F.row_number().over(Window.partitionBy("at").orderBy("_df", "feature"))
    return rows.join(rarity, "feature").withColumn("_place", place).where(F.col("_place") <= F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1).select("at", "n", "feature")


def _near(first: DataFrame, later: DataFrame, share: float) -> DataFrame:
    """(a, b): items a of `first` before items b of `later` that share enough of the smaller one's features.

    Only the smaller item must be probed for, so either side's probes meet the other side's features.
    """
    all_ = lambda items, name: items.select(F.col("at").alias(name), F.col("n").alias(f"{name}n"), F.explode("features").alias("feature"))
    probe = lambda items, name: _probes(items, share).select(F.col("at").alias(name), F.col("n").alias(f"{name}n"), "feature")
    small_first = probe(first, "a").join(all_(later, "b"), "feature").where("a < b AND an <= bn")
    small_later = all_(first, "a").join(probe(later, "b"), "feature").where("a < b AND an > bn")
    pairs = small_first.select("a", "b").unionByName(small_later.select("a", "b")).distinct()
    of = lambda items, name: items.select(F.col("at").alias(name), F.col("n").alias(f"{name}n"), F.col("features").alias(f"{name}f"))
    both = pairs.join(of(first, "a"), "a").join(of(later, "b"), "b")
    return both.where(F.size(F.array_intersect("af", "bf")) >= F.lit(share) * F.least("an", "bn") - 1e-9).select("a", "b")


def _undominated(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(at): the items that no earlier leader among them is near to, decided in rounds: an item leads once all that are
    before it and near to it are known to follow."""
    pairs, open_, found = written(pairs), items.select("at"), None
    while True:
        # an item is decided if it has no open pair with an earlier one
        lead = written(open_.join(pairs.select(F.col("b").alias("at")).distinct(), "at", "left_anti"))
        found = Rounds(lead) if found is None else found
        if found.parts[0] is not lead:
            found.add(lead)
        follow = written(pairs.join(lead, F.col("a") == F.col("at"), "left_semi").select(F.col("b").alias("at")).distinct())
        if follow.isEmpty():
            return found.rows()
        gone = written(lead.unionByName(follow))
        open_ = written(open_.join(gone, "at", "left_anti"))
        pairs = written(pairs.join(gone, F.col("a") == F.col("at"), "left_anti").join(follow, F.col("b") == F.col("at"), "left_anti"))


def clusters(items: DataFrame, share: float = 0.5) -> DataFrame:
    """(key, leader): items (key, ord, features: array) in the order of ord and key; each joins the first leader whose
    features it shares `share` of the smaller set of, or leads a cluster of its own. Leaders lead themselves.

    Features count once, nulls not at all; items without features (or with null ones) all follow the first of their
    kind. Keys differ and aren't null. Items are taken in batches that double: a batch holds only what no earlier leader
    attracts, so its leaders depend on each other alone, and all later items that they attract leave with them. An index
    of features brings pairs together, rarest features first, so common ones meet only in sets that have no others.
    """
    sets = items.select("key", "ord", F.array_compact(F.array_distinct(F.coalesce("features", F.array().cast(items.schema["features"].dataType)))).alias("features"))
    placed = written(numbered(sets, ["ord", "key"], "at").select("key", "at", "features", F.size("features").alias("n")))
    names, total = placed.select("key", "at"), placed.count()
    bare = placed.where("n = 0")
    found = Rounds(written(bare.select("at").crossJoin(F.broadcast(bare.agg(F.min("at").alias("leader"))))))
    left, low, high = placed.where("n > 0").drop("key"), 0, FIRST_BATCH
    while low < total:
        batch = written(left.where(F.col("at") < high))  # all before `low` is decided
        leaders = written(batch.join(_undominated(batch, _near(batch, batch, share)), "at", "left_semi"))
        follows = _near(leaders, left, share).groupBy(F.col("b").alias("at")).agg(F.min("a").alias("leader"))
        decided = written(leaders.select("at", F.col("at").alias("leader")).unionByName(follows))
        found.add(decided)
        left = written(left.join(decided.select("at"), "at", "left_anti"))
        low, high = high, 3 * high
    leader = names.select(F.col("key").alias("leader"), F.col("at").alias("_at"))
    return found.rows().join(names, "at").join(leader.withColumnRenamed("leader", "_leader"), F.col("leader") == F.col("_at")).select("key", F.col("_leader").alias("leader"))
