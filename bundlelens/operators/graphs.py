"""Graphs as edge tables: reachability, alias chains, propagation, pruning, components, levels.

Every loop writes its rounds to the session's checkpoint folder, so that lineage stays short and a lost executor costs
a round at most. Loops stop when a round adds nothing; only counts come to the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; on one machine without it, one of our own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        context.setCheckpointDir(shared or f"file://{tempfile.mkdtemp(prefix='bundlelens-')}")
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows without lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder. Unlike a checkpoint it is made in one pass, and it doesn't hand on
    the constraints of its plan, which double with each round of a loop that renames by joins."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """What the rounds of a loop have found: each round's rows are written once, and joined to one table now and then
    so that the plan stays small."""

    def __init__(self, first: DataFrame):
        self.parts, self.n = [first], 1

    def add(self, rows: DataFrame) -> None:
        self.parts.append(rows)
        self.n += 1
        if len(self.parts) > 16:
            self.parts = [cut(self.rows())]

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def reach(edges: DataFrame, seeds: DataFrame, most: int = 1 << 30) -> DataFrame:
    """(node, depth): nodes reached from the seeds (node) along edges (src, dst), with the fewest hops, `most` at most."""
    frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    rounds = Rounds(frontier)
    while rounds.n <= most and not frontier.isEmpty():
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(rounds.rows(), "node", "left_anti").withColumn("depth", F.lit(rounds.n)))
        rounds.add(frontier)
    return rounds.rows()


def aliases(edges: DataFrame, hops: int = 10) -> DataFrame:
    """(src, dst, hops): where chains of aliases (src, dst), one for each src, end after `hops` hops at most."""
    edges = cut(edges.select("src", "dst"))
    at = edges.withColumn("hops", F.lit(1))
    step = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    for i in range(1, hops):
        moved = at.join(step, F.col("dst") == F.col("_from"), "left")
        after = moved.select("src", F.coalesce("_to", "dst").alias("dst"), F.when(F.col("_to").isNull(), F.col("hops")).otherwise(i + 1).alias("hops"))
        at = cut(after)
        if at.where(F.col("hops") == i + 1).isEmpty():
            break
    return at


def all_importers(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): the seeds, and every node all of whose importers are in the result. Edges go from importer to module."""
    edges = cut(edges.select("src", "dst").distinct())
    needed = cut(edges.groupBy("dst").agg(F.count("*").alias("needed")))
    fresh = cut(seeds.select("node").distinct())
    inside, met = Rounds(fresh), None
    while not fresh.isEmpty():
        # counts of importers that are in are carried along: each edge is read once, when its importer comes in
        added = fresh.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.count("*").alias("met"))
        met = cut(added if met is None else met.unionByName(added).groupBy("dst").agg(F.sum("met").alias("met")))
        whole = met.join(needed, "dst").where("met = needed").select(F.col("dst").alias("node"))
        fresh = cut(whole.join(inside.rows(), "node", "left_anti"))
        inside.add(fresh)
    return inside.rows()


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, owner, conflict): of each node that edges (src, dst) lead to from the seeds (node, owner), whose it is.

    A value is unset, one owner, or a conflict, and only rises: each node carries the smallest and the largest owner that
    reach it, which are equal while there is one. A round sends the values that changed and no others, so cycles come to
    rest; nodes out of reach aren't in the result. In a conflict owner is null.
    """
    edges = written(edges.select("src", "dst").distinct())
    state = written(seeds.groupBy("node").agg(F.min("owner").alias("low"), F.max("owner").alias("high")))
    changed = state
    while True:
        sent = changed.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
        met = sent.join(state, F.col("dst") == F.col("node"), "left")
        risen = met.where(F.col("node").isNull() | (F.col("_low") < F.col("low")) | (F.col("_high") > F.col("high")))
        # least and greatest leave out nulls: a node that had no value takes the one that was sent
        changed = written(risen.select(F.col("dst").alias("node"), F.least("_low", "low").alias("low"), F.greatest("_high", "high").alias("high")))
        if changed.isEmpty():
            conflict = F.col("low") < F.col("high")
            return state.select("node", F.when(~conflict, F.col("low")).alias("owner"), conflict.alias("conflict"))
        state = written(state.join(changed.select("node"), "node", "left_anti").unionByName(changed))


def owned_by_importers(edges: DataFrame, seeds: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(node, owner): the seeds (node, owner), and every node all of whose importers have one and the same owner.

    Edges go from importer to module. `closed` (node) never get an owner. How many importers have an owner, and the
    smallest and largest of these, are carried along: each edge is read once, when its importer gets its owner. A node
    whose importers disagree, or wait for each other, gets none.
    """
    edges = written(edges.select("src", "dst").distinct())
    needed = edges.groupBy(F.col("dst").alias("_of")).agg(F.count("*").alias("needed"))
    if closed is not None:
        needed = needed.join(closed.select(F.col("node").alias("_of")), "_of", "left_anti")
    needed = written(needed)
    fresh = written(seeds.groupBy("node").agg(F.min("owner").alias("owner")))
    inside, met = Rounds(fresh), None
    while not fresh.isEmpty():
        added = fresh.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.count("*").alias("met"), F.min("owner").alias("low"), F.max("owner").alias("high"))
        met = written(added if met is None else met.unionByName(added).groupBy("dst").agg(F.sum("met").alias("met"), F.min("low").alias("low"), F.max("high").alias("high")))
        whole = met.join(needed, F.col("dst") == F.col("_of")).where("met = needed AND low = high").select(F.col("dst").alias("node"), F.col("low").alias("owner"))
        fresh = written(whole.join(inside.rows().select("node"), "node", "left_anti"))
        inside.add(fresh)
    return inside.rows()


def first_owners(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, owner, shared): which of the roots (node, ord) a walk that starts at one after the other reaches a node
    from first, and whether a later one comes upon it too.

    A walk stops at what an earlier one owns, so a node is its first root's however deep it lies, and it is shared where
    a parent of another owner, or another root, meets it. Orders of roots differ.
    """
    edges = written(edges.select("src", "dst").distinct())
    # the smallest root that reaches a node owns it
    state = written(roots.groupBy("node").agg(F.min("ord").alias("owner")))
    changed = state
    while not changed.isEmpty():
        sent = changed.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("owner").alias("_owner"))
        met = sent.join(state, F.col("dst") == F.col("node"), "left").where(F.col("node").isNull() | (F.col("_owner") < F.col("owner")))
        changed = written(met.select(F.col("dst").alias("node"), F.col("_owner").alias("owner")))
        state = written(state.join(changed.select("node"), "node", "left_anti").unionByName(changed))
    to = state.select(F.col("node").alias("dst"), F.col("owner").alias("_own"))
    crossing = edges.join(state, F.col("src") == F.col("node")).join(to, "dst").where(F.col("owner") > F.col("_own")).select(F.col("dst").alias("_hit"))
    crossing = crossing.unionByName(roots.join(state.withColumnRenamed("owner", "_own"), "node").where(F.col("ord") > F.col("_own")).select(F.col("node").alias("_hit"))).distinct()
    return state.join(crossing, F.col("node") == F.col("_hit"), "left").select("node", "owner", F.col("_hit").isNotNull().alias("shared"))


def groups_with_hub(edges: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(hub, members, size): the connected components of two nodes or more whose sizes (node, size) add up to `most` at
    most. The hub is the member with most neighbours, then the first; edges to oneself don't count, nodes without a size
    have 0."""
    edges = written(edges.where("src <> dst").select("src", "dst").distinct())
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    members = components(edges).join(degree, "node").join(sizes.groupBy("node").agg(F.sum("size").alias("size")), "node", "left")
    found = members.groupBy("component").agg(F.min_by("node", F.struct(-F.col("degree"), "node")).alias("hub"), F.count("*").alias("members"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    return found.where(F.col("size") <= most).select("hub", "members", "size")


def bounded_groups(edges: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(node, group): groups that a scan of the edges (src, dst, ord) in their order makes when it joins the groups of both
    ends wherever their sizes (node, size) add up to `most` at most; a group goes by its smallest node.

    In each round an edge is decided if no open edge of either of its groups comes before it: all that the scan would
    know of both groups is settled then. Groups only grow unless a size is negative, so what is too large stays too large,
    and such edges are struck out at once, whatever comes before them. Edges of equal orders are in the order of their
    src, then of their dst; a node of an edge has a size of 0 unless given, and nodes without edges are groups of their
    own.
    """
    own = F.struct("ord", "src", "dst")
    apart = written(edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(own).alias("ord")))
    nodes = sizes.select("node", "size").unionByName(apart.select(F.explode(F.array("a", "b")).alias("node"), F.lit(0).cast("long").alias("size")))
    weight = written(nodes.groupBy("node").agg(F.sum("size").alias("size")))
    names, kind, joined = weight.select("node"), weight.schema["size"].dataType, None
    fits = F.col("a.size") + F.col("b.size") <= most
    hopeful = fits if weight.where("size < 0").isEmpty() else F.lit(True)
    # open edges carry both their groups with their sizes
    of = lambda side: weight.select(F.col("node").alias(side), F.struct("node", "size").alias(f"_{side}"))
    sized = apart.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "ord")
    open_ = written(sized.where(hopeful))
    while not open_.isEmpty():
        ends = open_.select(F.explode(F.array("a.node", "b.node")).alias("end"), "ord").groupBy("end").agg(F.min("ord").alias("first"))
        first = lambda side: ends.select(F.col("end").alias(f"{side}_end"), F.col("first").alias(f"{side}_first"))
        ready = open_.join(first("a"), F.col("a.node") == F.col("a_end")).join(first("b"), F.col("b.node") == F.col("b_end")).where("a_first = ord AND b_first = ord")
        decided = written(ready.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), "ord", (F.col("a.size") + F.col("b.size")).cast(kind).alias("size"), fits.alias("joined")))
        # a group is decided upon once in a round, so joins are pairs: b goes into a
        pairs = decided.where("joined")
        moved = pairs.select(F.col("b").alias("_from"), F.col("a").alias("_to"))
        if joined is None:
            joined = Rounds(moved)
        else:
            joined.add(moved)
        now = pairs.select(F.explode(F.array("a", "b")).alias("_of"), F.struct(F.col("a").alias("node"), "size").alias("_now"))
        move = lambda df, c: df.join(now, F.col(f"{c}.node") == F.col("_of"), "left").withColumn(c, F.coalesce("_now", c)).drop("_of", "_now")
        left = move(move(open_.join(decided.select("ord"), "ord", "left_anti").select("a", "b", "ord"), "a"), "b").where("a.node <> b.node").where(hopeful)
        open_ = written(left.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("ord").alias("ord")))
    if joined is None:
        return names.select("node", F.col("node").alias("group"))
    groups = components(joined.rows().select(F.col("_from").alias("src"), F.col("_to").alias("dst"))).withColumnRenamed("node", "_of")
    return names.join(groups, F.col("node") == F.col("_of"), "left").select("node", F.coalesce("component", "node").alias("group"))


def prune(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node): candidates that nothing left imports, again and again until none goes. A module importing only itself
    is not held by that."""
    edges = edges.where("src <> dst").select("src", "dst").distinct()
    left, gone, live = cut(candidates.select("node").distinct()), None, cut(edges)
    while True:
        now = cut(left.join(live.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if now.isEmpty():
            return now if gone is None else gone.rows()
        if gone is None:
            gone = Rounds(now)
        else:
            gone.add(now)
        left = cut(left.join(now, "node", "left_anti"))
        live = cut(live.join(now, F.col("src") == F.col("node"), "left_anti"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component, for every node of an undirected edge.

    Stars: each round links a node's larger neighbours, then the node and its smaller ones, to its smallest neighbour.
    """
    edges = cut(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    stars = edges.where("a <> b")
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).withColumnRenamed("a", "hub")
        wide = both.join(least, F.col("a") == F.col("hub")).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lows = wide.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "hub")
        narrow = wide.join(lows, F.col("a") == F.col("hub"))
        stars = cut(narrow.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lows.select(F.col("hub").alias("a"), F.col("m").alias("b"))).distinct())
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    members = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return members.unionByName(loops.join(members, "node", "left_anti").select("node", F.col("node").alias("component"))).distinct()


#: Rows of a round that are sent to every task; more are dealt out with what they meet.
FEW = 100_000


def _dealt(round_: DataFrame, n: int) -> DataFrame:
    """A round of n rows for a join, broadcast while they are few: files say little of how many rows are in them."""
    return round_.hint("broadcast" if n <= FEW else "merge")


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): how many steps a module stands above those it needs (edges src needs dst): the longest way down.
    Modules on cycles, and those that need them, have no level and are left out. A round sends its modules through the
    driver only while they are few."""
    open_ = written(edges.select("src", "dst").distinct())
    left = written(open_.select(F.col("src").alias("node")).unionByName(open_.select(F.col("dst").alias("node"))).distinct())
    found, level = None, 0
    while True:
        waiting = open_.select(F.col("src").alias("node")).distinct()
        fresh = written(left.join(waiting.hint("merge"), "node", "left_anti").withColumn("level", F.lit(level)))
        n = fresh.count()
        if not n:
            return fresh if found is None else found.rows()
        if found is None:
            found = Rounds(fresh)
        else:
            found.add(fresh)
        left = written(left.join(_dealt(fresh, n), "node", "left_anti"))
        open_ = written(open_.join(_dealt(fresh.select(F.col("node").alias("dst")), n), "dst", "left_anti"))
        level += 1


def missing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(dst, importers): what is needed and isn't there, with the number of those who need it."""
    gone = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti")
    return gone.groupBy("dst").agg(F.count_distinct("src").alias("importers"))
