"""Documents as trees of rows that carry their intervals: descent by ranges, runs of repeated siblings.

An element's interval reaches from its own number to that of the last element inside it, so that descent is a comparison
of numbers and needs no walk. One document's elements are the most that any task must hold together.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens import rules
from bundlelens.operators.generate import generate
from bundlelens.operators.html import VOID, _Nodes

NODE = "node int, parent int, place int, depth int, last int, loose boolean, closed boolean, tag string, opening string, shape string, text string"


class _Tree(_Nodes):
    """`_Nodes` that also notes, for each element, its start tag, depth, whether something stands right before it, and
    whether it has an end tag."""

    def __init__(self):
        super().__init__()
        self.depth: list[int] = []
        self.loose: list[bool] = []
        self.closed: list[bool] = []
        self.opening: list[str] = []
        self.said: dict[int | None, bool] = {}  # of a parent: text or a comment since its last child began or ended

    def handle_starttag(self, tag: str, attrs: list) -> None:
        parent = self.open[-1] if self.open else None
        self.depth.append(len(self.open))
        self.loose.append(self.said.get(parent, False))
        self.closed.append(tag in VOID)
        self.opening.append(self.get_starttag_text() or "")
        self.said[parent] = False
        super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        before = next((i for i in range(len(self.open) - 1, -1, -1) if self.rows[self.open[i]][2] == tag), None)
        if before is not None:
            self.closed[self.open[before]] = True
        super().handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        super().handle_data(data)
        if data.strip():
            self.said[self.open[-1] if self.open else None] = True

    def handle_comment(self, data: str) -> None:
        self.said[self.open[-1] if self.open else None] = True


def parse(html: str | None) -> list[tuple]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    rows = tree.rows
    last, inside, places, place = list(range(len(rows))), [[] for _ in rows], {}, []
    for _, parent, *_ in rows:
        place.append(places.get(parent, 0))
        places[parent] = place[-1] + 1
    shape = [""] * len(rows)
    for node, parent, tag, attrs, _ in reversed(rows):  # children come before their parents
        shape[node] = md5("\0".join([tag, *sorted(attrs), "", *reversed(inside[node])]).encode("utf-8", "surrogatepass")).hexdigest()
        inside[node].clear()
        if parent is not None:
            last[parent] = max(last[parent], last[node])
            inside[parent].append(shape[node])
    return [(n, parent, place[n], tree.depth[n], last[n], tree.loose[n], tree.closed[n], tag, tree.opening[n], shape[n], "".join(text)) for n, parent, tag, _, text in rows]


def numbered(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """One row per element: the kept columns, `node` (its number in document order), `parent` (null at the top), `place`
    among its siblings, `depth`, `last` (the last element inside it, or itself), `loose` (text or a comment stands
    between it and what is before it in its parent), `closed` (it has an end tag or needs none), `tag`, `opening` (the
    start tag as written), `shape` (equal for elements whose tags, attributes' names and children agree all the way
    down), `text` (its own). Null and empty documents have no rows."""
    return generate(pages, keep, [html], parse, NODE)


def within(outer: DataFrame, nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Each of `nodes` with every element of `outer` that it is inside: (key, outer, outer_tag) and the columns of `nodes`.
    Both have key, node, last and tag. A document joins with itself only, and gives at most its depth of rows for each
    element. Rows whose key is null are left out."""
    ranges = outer.select(key, F.col("node").alias("outer"), F.col("last").alias("_last"), F.col("tag").alias("outer_tag"))
    return nodes.join(ranges, key).where((F.col("node") > F.col("outer")) & (F.col("node") <= F.col("_last"))).drop("_last")


def runs(nodes: DataFrame, same: Column, value: Column, key: str = "page_id", least: int = 3, distinct: int = 1) -> DataFrame:
    """(key, first, last, same, n, distinct, values): runs of `least` or more siblings next to each other that agree in
    `same` (where it is null there is no run), with nothing but space between them, and with `distinct` or more different
    values. `last` ends the run's interval; values are in order, nulls as empty ones.

    A run begins where an element differs from the sibling before it; the sum of the beginnings so far numbers the runs.
    The window is over one parent's children, at most one document. Keys must differ.
    """
    siblings = Window.partitionBy(key, "parent").orderBy("place")
    rows = nodes.select(key, "parent", "place", "node", "last", "loose", same.alias("same"), F.coalesce(value, F.lit("")).alias("value"))
    begins = F.col("loose") | F.col("same").isNull() | F.lag("same").over(siblings).isNull() | (F.lag("same").over(siblings) != F.col("same"))
    islands = rows.withColumn("_run", F.sum(begins.cast("int")).over(siblings)).where("same IS NOT NULL")
    found = islands.groupBy(key, "parent", "_run").agg(
        F.min("node").alias("first"), F.max("last").alias("last"), F.first("same").alias("same"), F.count("*").alias("n"),
        F.count_distinct("value").alias("distinct"), F.array_sort(F.collect_list(F.struct("node", "value"))).alias("_values"),
    )
    return found.where((F.col("n") >= least) & (F.col("distinct") >= distinct)).select(key, "first", "last", "same", "n", "distinct", F.col("_values.value").alias("values"))


def repeated_leaves(pages: DataFrame) -> DataFrame:
    """(page_id, first, last, opening, n, distinct, values): three or more elements in a row with one and the same start
    tag, that hold text alone, not always the same: what a list of values and a loop would write."""
    nodes = numbered(pages.where(F.col("html").contains("</")), ["page_id"])
    leaf = (F.col("last") == F.col("node")) & F.col("closed") & ~F.col("tag").isin(*rules.NEVER_REPEATED)
    return runs(nodes, F.when(leaf, F.col("opening")), F.regexp_replace("text", r"^\s+|\s+$", ""), distinct=2).withColumnRenamed("same", "opening")


def repeated_shapes(pages: DataFrame) -> DataFrame:
    """(page_id, first, last, tag, n, shape): three or more elements with children in a row whose subtrees agree in tags and
    attributes' names."""
    nodes = numbered(pages.where(F.col("html").contains("</")), ["page_id"]).where("NOT (tag = 'html' OR tag = 'head' OR tag = 'body')")
    found = runs(nodes, F.when(F.col("last") > F.col("node"), F.concat_ws(" ", "tag", "shape")), F.lit(""))
    return found.select("page_id", "first", "last", F.substring_index("same", " ", 1).alias("tag"), "n", F.substring_index("same", " ", -1).alias("shape"))
