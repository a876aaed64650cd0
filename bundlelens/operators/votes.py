"""Votes and ranks: weighted argmax, margins, consensus, first-wins duplicates, unique names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.operators.graphs import cut


def argmax(votes: DataFrame, by: list[str], choice: str, weight: str, order: str) -> DataFrame:
    """(by.., choice, weight): the choice with the largest sum of weights, the first seen where sums are equal.

    Sums are made before the shuffle, so a group with very many votes costs a row for each choice.
    """
    sums = votes.groupBy(*by, choice).agg(F.sum(weight).alias("_w"), F.min(order).alias("_first"))
    best = sums.groupBy(*by).agg(F.max_by(F.struct(F.col(choice).alias("c"), F.col("_w").alias("w")), F.struct("_w", -F.col("_first"))).alias("_b"))
    return best.select(*by, F.col("_b.c").alias(choice), F.col("_b.w").alias(weight))


def strongest(hints: DataFrame, by: list[str], weight: str) -> DataFrame:
    return hints.groupBy(*by).agg(F.max(weight).alias(weight))


def with_margin(scores: DataFrame, by: list[str], choice: str, score: str) -> DataFrame:
    """(by.., choice, score, runner_up, margin): the best choice and its distance to the next one."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), choice)
    ranked = scores.withColumn("_rank", F.row_number().over(w)).withColumn("runner_up", F.lead(choice).over(w)).withColumn("_next", F.lead(score).over(w))
    return ranked.where("_rank = 1").select(*by, choice, score, "runner_up", (F.col(score) - F.coalesce("_next", F.lit(0.0))).alias("margin"))


def consensus(votes: DataFrame, by: list[str], choice: str, least: int = 2, share: float = 2 / 3) -> DataFrame:
    """(by.., choice, n, total): choices that have enough votes and share of their group."""
    counts = votes.groupBy(*by, choice).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.max_by(F.struct(F.col(choice).alias("c"), F.col("n").alias("n")), F.struct(F.col("n"), F.col(choice))).alias("_b"))
    return totals.where((F.col("_b.n") >= least) & (F.col("_b.n") >= F.lit(share) * F.col("total"))).select(*by, F.col("_b.c").alias(choice), F.col("_b.n").alias("n"), "total")


def unanimous(votes: DataFrame, by: list[str], choice: str) -> DataFrame:
    """(by.., choice) of the groups whose votes all name one choice."""
    return votes.groupBy(*by).agg(F.min(choice).alias(choice), F.max(choice).alias("_other")).where(F.col(choice) == F.col("_other")).drop("_other")


def first_of_equal(rows: DataFrame, content: Column, key: str, order: str) -> DataFrame:
    """Adds duplicate_of: the key of the first row with equal content, null for that itself.

    Contents are compared by SHA-256, so only digests travel; the first of a digest is found by partial aggregation and
    joined back, which splits where one content has most rows.
    """
    hashed = rows.withColumn("_h", F.sha2(content.cast("binary"), 256))
    firsts = hashed.groupBy("_h").agg(F.min_by(key, F.struct(order, key)).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_h").alias("_of"), "_first")
    joined = hashed.join(firsts, F.col("_h") == F.col("_of"), "left")
    return joined.withColumn("duplicate_of", F.when(F.col("_first") != F.col(key), F.col("_first"))).drop("_h", "_of", "_first")


def first_free(rows: DataFrame, taken: DataFrame, candidate: Callable[[int], Column], order: str, fold: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Adds unique_name: for each row the first of candidate(1), candidate(2).. that is neither taken (column _taken, folded)
    nor another row's. Of rows that want one name the first in order gets it. A round for each further candidate; rows that
    have a name take no part in the next ones."""
    done, k, rest = [], 1, rows
    while True:
        tried = rest.withColumn("unique_name", candidate(k)).withColumn("_low", fold(F.col("unique_name")))
        marked = tried.join(taken, F.col("_low") == F.col("_taken"), "left").withColumn("_free", F.col("_taken").isNull()).drop("_taken")
        rank = F.row_number().over(Window.partitionBy("_low").orderBy(order))
        settled = cut(marked.withColumn("_free", F.col("_free") & (rank == 1)))
        won = settled.where("_free")
        done.append(won.drop("_free", "_low"))
        rest = settled.where("NOT _free").drop("_free", "_low", "unique_name")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        taken, k = taken.unionByName(won.select(F.col("_low").alias("_taken"))), k + 1


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Adds unique_name: names with -2, -3.. for the second, third.. of those that differ in case at most. A suffixed name
    that another row has is left to it; the next ones are `-n-2`, `-n-3`.. until one is free."""
    low = F.lower(F.col(name))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(low).orderBy(order)))
    first = numbered.where("_n = 1").withColumn("unique_name", F.col(name))
    further = numbered.where("_n > 1")
    again = lambda k: F.concat(F.col(name), F.lit("-"), F.col("_n"), F.lit(f"-{k}" if k > 1 else ""))
    return first.unionByName(first_free(further, rows.select(low.alias("_taken")).distinct(), again, order, F.lower)).drop("_n")


def shares_of(rows: DataFrame, by: list[str], test: Column) -> DataFrame:
    """(by.., n, hits, share): how many rows of a group pass a test; shares have three places."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(test).alias("hits"))
    return counts.select(*by, "n", "hits", F.round(F.col("hits") / F.col("n"), 3).alias("share"))


def sole_owner(rows: DataFrame, value: str, owner: str) -> DataFrame:
    """(value, owner) of the values that one owner alone has."""
    return unanimous(rows, [value], owner)


def baseline(rows: DataFrame, item: str, group: str, share: float) -> DataFrame:
    """(item, groups): items that at least that share of all groups has."""
    total = rows.agg(F.count_distinct(group)).first()[0]
    pairs = rows.select(item, group).distinct()
    return pairs.groupBy(item).agg(F.count("*").alias("groups")).where(F.col("groups") >= F.lit(share * total))
