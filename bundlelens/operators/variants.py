"""Functions as they may look once others were inlined into them: variants with the features of what they hold.

Bundlers put a function that is called from one place into its caller. A function that was published on its own is then
found by the features of both. With one caller each, what is inlined hangs together as trees, so every feature goes to
one variant at most. Where sets run along all calls, small sketches of them do so in place of the sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.operators import identify
from bundlelens.operators.graphs import Rounds, written

FUNCTION = ["module", "function"]


def _whole(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows of these columns without a null."""
    return df.select(*columns).dropna().distinct()


def members(features: DataFrame, calls: DataFrame, exported: DataFrame, hops: int = 1) -> DataFrame:
    """(module, function, member, depth): which functions of its module may have been inlined into an exported one.

    features: (module, function, feature); calls: (module, function, callee); exported: (module, function). A member has
    a single caller, isn't exported and has features; it lies `hops` calls deep at most, each step by such members. A
    function has one caller then, so a round never makes more rows than there are calls, and a cycle of such functions
    has no way in from an exported one. Rows with a null are none, repeated ones count once, other columns are ignored.
    """
    calls, exported = _whole(calls, *FUNCTION, "callee"), written(_whole(exported, *FUNCTION))
    callers = calls.groupBy("module", "callee").agg(F.count("*").alias("_callers"), F.min("function").alias("_caller"))
    single = callers.where("_callers = 1 AND callee <> _caller").select("module", F.col("callee").alias("member"), "_caller")
    known = _whole(features, *FUNCTION).withColumnRenamed("function", "member")
    single = written(single.join(known, ["module", "member"], "left_semi").join(exported.withColumnRenamed("function", "member"), ["module", "member"], "left_anti"))
    # who is at the end of a path, and in which exported function
    at = exported.select("module", "function", F.col("function").alias("_caller"))
    found = None
    for depth in range(1, hops + 1):
        now = written(at.join(single, ["module", "_caller"]).select(*FUNCTION, "member", F.lit(depth).alias("depth")))
        if found is None:
            found = Rounds(now)
        elif now.isEmpty():
            break
        else:
            found.add(now)
        at = now.select(*FUNCTION, F.col("member").alias("_caller"))
    return found.rows()


def inlined(features: DataFrame, calls: DataFrame, exported: DataFrame, hops: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((module, function, feature), (module, function, callee), members): features and calls of the exported functions
    that have members, with those of their members, and the members. Features of shape (`A:`) are a function's own and
    don't come from members; calls of members, and of the function itself by them, go. Inputs are those of `members`.
    """
    held = written(members(features, calls, exported, hops))
    mine, roots = features.select(*FUNCTION, "feature").dropna(), held.select(*FUNCTION).distinct()
    lent = mine.where(~F.col("feature").startswith("A:")).withColumnRenamed("function", "member").join(held, ["module", "member"]).select(*FUNCTION, "feature")
    links = _whole(calls, *FUNCTION, "callee")
    theirs = links.withColumnRenamed("function", "member").join(held, ["module", "member"]).where("callee <> function").select(*FUNCTION, "callee")
    all_links = links.join(roots, FUNCTION, "left_semi").unionByName(theirs)
    left = all_links.join(held.select(*FUNCTION, F.col("member").alias("callee")), [*FUNCTION, "callee"], "left_anti")
    return mine.join(roots, FUNCTION, "left_semi").unionByName(lent).distinct(), left.distinct(), held


def variant_matches(features: DataFrame, calls: DataFrame, exported: DataFrame, library: DataFrame, hops: int = 1, threshold: float = 0.8, margin: float = 0.1) -> DataFrame:
    """(module, function, match, score, margin): the library function (function, feature) that the variant of an exported
    function clearly is, for those that aren't clearly one as they stand."""
    asked = lambda rows: rows.select(F.struct(*FUNCTION).alias("function"), "feature")
    plain = identify.rare_matches(asked(_whole(features, *FUNCTION, "feature").join(_whole(exported, *FUNCTION), FUNCTION, "left_semi")), library, threshold, margin)
    variants, _, _ = inlined(features, calls, exported, hops)
    found = identify.rare_matches(asked(variants), library, threshold, margin).join(plain.select("function"), "function", "left_anti")
    return found.select("function.module", "function.function", "match", "score", "margin")


def _smallest(rows: DataFrame, most: int) -> DataFrame:
    # the bound of the rank is applied before rows are shuffled
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy("node").orderBy("hash"))).where(F.col("_place") <= most).drop("_place")


def sketches(features: DataFrame, edges: DataFrame, most: int = 256, hops: int = 1 << 30, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(node, hash): of all features (node, feature) of a node and of what edges (src, dst) lead to from it within `hops`
    steps, the `most` smallest hashes.

    A node with fewer than `most` hashes has them all, so its set is exact. A hash that is too large for a node's sketch
    is too large for that of everything that leads to it, so the rounds send sketches and not sets, and only the hashes
    that a round has brought in: an edge carries `most` rows in a round at most, cycles come to rest. Rows with a null are
    none.
    """
    edges = written(_whole(edges, "src", "dst"))
    state = written(_smallest(_whole(features, "node", "feature").select("node", hashed(F.col("feature")).alias("hash")).distinct(), most))
    fresh, n = state, 0
    while n < hops and not fresh.isEmpty():
        sent = written(fresh.join(edges, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "hash").distinct().join(state, ["node", "hash"], "left_anti"))
        new = sent.withColumn("_new", F.lit(True))
        met = state.join(sent.select("node").distinct(), "node", "left_semi").withColumn("_new", F.lit(False)).unionByName(new)
        kept = written(_smallest(met, most))
        fresh = kept.where("_new").drop("_new")
        state = written(state.join(sent.select("node").distinct(), "node", "left_anti").unionByName(kept.drop("_new")))
        n += 1
    return state


def set_sizes(sketch: DataFrame, most: int = 256, bits: int = 64, lowest: int = -(1 << 63)) -> DataFrame:
    """(node, size, exact): how many features stand behind sketches (node, hash) of `most` hashes: counted below that
    number, else reckoned from how small the largest hash is among `bits`-bit hashes from `lowest` on."""
    full = sketch.groupBy("node").agg(F.count("*").alias("_n"), F.max("hash").alias("_top"))
    share = (F.col("_top").cast("double") - F.lit(float(lowest))) / F.lit(float(1 << bits))
    return full.select("node", F.when(F.col("_n") < most, F.col("_n")).otherwise(F.round((F.lit(most) - 1) / share).cast("long")).alias("size"), (F.col("_n") < most).alias("exact"))
