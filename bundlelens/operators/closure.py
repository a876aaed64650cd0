"""Resource closure: what a set of pages needs, and what that needs, in rounds over several producers of references.

Each round reads only what the one before has loaded. A row keeps where it was first asked for, in which round, and its
place in the order of discovery, as if everything had been asked for one after the other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.operators.graphs import Rounds, written

Producer = Callable[[DataFrame], DataFrame]
MOST_ROUNDS = 12


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """`rows` with a column `name`: their numbers in that order, from `first`. Rows are dealt out by ranges of the order,
    and each task numbers its own from the count of those before, so that no task sees all rows. Rows that are equal in
    `order` are in any order."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row for each task
    before, total = [], first
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_part long, _before long"))
    return placed.join(offsets, part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def closure(seeds: DataFrame, captured: DataFrame, producers: list[Producer], most: int = MOST_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((url, parent, round, place, loaded), (url, parent) that was left after `most` rounds).

    seeds: (url, ord); captured: (url, ..) that can be loaded. A producer takes the rows of `captured` that a round has
    loaded and gives their references (parent, url, ord). A round's references are in the order of their parents' places,
    then of the producers, then of `ord`; a URL counts where it is first asked for, and once. What isn't captured has
    loaded = false and no references. Null URLs are none. The second table is empty if the closure is whole.
    """
    wanted = numbered(seeds.where("url IS NOT NULL").groupBy("url").agg(F.min("ord").alias("ord")), ["ord", "url"], "place").select("url", F.lit(None).cast("string").alias("parent"), "place")
    known, n = None, 0
    while True:
        # what is captured is dealt out once in a round
        read = written(captured.join(wanted.select("url"), "url", "left_semi"))
        have = read.select(F.col("url").alias("_have")).distinct()
        fresh = written(wanted.join(have, F.col("url") == F.col("_have"), "left").select("url", "parent", F.lit(n).alias("round"), "place", F.col("_have").isNotNull().alias("loaded")))
        if known is None:
            known = Rounds(fresh)
        else:
            known.add(fresh)
        asked = [f(read).select("parent", "url", "ord", F.lit(i).alias("by")) for i, f in enumerate(producers)]
        placed = reduce(DataFrame.unionByName, asked).where("url IS NOT NULL").join(fresh.select(F.col("url").alias("_of"), F.col("place").alias("at")), F.col("parent") == F.col("_of"))
        first = placed.groupBy("url").agg(F.min(F.struct("at", "by", "ord", "parent")).alias("f"))
        new = written(first.join(known.rows().select("url"), "url", "left_anti").select("url", "f.*"))
        count = new.count()
        if not count or n == most:
            return known.rows(), new.select("url", "parent")
        total = known.rows().count()
        wanted = numbered(new, ["at", "by", "ord", "url"], "place", total).select("url", "parent", "place")
        n += 1


def expanded(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, target, place): what each of the roots (node) stands for when nodes with edges (src, dst, ord) are replaced by
    what these lead to, all the way: the nodes without edges, in the order in which a depth-first walk comes upon them,
    each once. A walk that comes back to what it is replacing goes no further; a root without edges stands for itself.

    Each node under a root keeps the smallest list of places on a path to it, and passes it on when it gets smaller. The
    smallest lists are in the walk's order: a way around a cycle only adds to a list, and where two paths meet in a node
    the smaller one is first whatever follows. No path is listed twice, though the paths may be very many. Edges of a
    node are in the order of ord and dst; null ends are none. Numbers are given out by ranges of (root, list), so a root
    of very many targets isn't one task's.
    """
    rows = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    step = written(rows.select("src", "dst", F.struct(F.col("ord"), F.col("dst")).alias("step")))
    changed = written(roots.where("node IS NOT NULL").select(F.col("node").alias("root"), "node", F.array().cast(f"array<{step.schema['step'].dataType.simpleString()}>").alias("path")).distinct())
    state = changed
    while True:
        sent = changed.join(step, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("step"))).alias("_path"))
        met = sent.join(state, ["root", "node"], "left").where(F.col("path").isNull() | (F.col("_path") < F.col("path")))
        changed = written(met.select("root", "node", F.col("_path").alias("path")))
        if changed.isEmpty():
            break
        state = written(state.join(changed.select("root", "node"), ["root", "node"], "left_anti").unionByName(changed))
    ends = state.join(step.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    at = written(numbered(ends, ["root", "path"], "n").select("root", F.col("node").alias("target"), "n"))
    first = at.groupBy(F.col("root").alias("_root")).agg(F.min("n").alias("_first"))
    return at.join(first, F.col("root") == F.col("_root")).select("root", "target", (F.col("n") - F.col("_first")).alias("place"))
