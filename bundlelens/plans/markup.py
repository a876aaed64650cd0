"""Queries on trees of markup, clusters with leaders, shared ends of layouts, and ordered expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.operators import alignment, closure, leaders, reports, trees
from bundlelens.plans.tables import table


def repeated_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal elements with texts of their own, in each page's order."""
    found = trees.repeated_leaves(table(spark, sf_dir, "pages"))
    return found.select("page_id", "opening", "n", "distinct", F.concat_ws("\n", "values").alias("texts"))


REPEATED_MARKUP = r"""
WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?:<p>[^<]*</p>\s*){3,}')) AS run FROM pages),
v AS (SELECT page_id, list_transform(regexp_extract_all(run, '<p>([^<]*)</p>', 1), lambda x: replace(replace(replace(replace(trim(x), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS t FROM r)
SELECT page_id, '<p>' AS opening, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS "distinct", array_to_string(t, chr(10)) AS texts FROM v WHERE len(list_distinct(t)) > 1
"""


def repeated_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of subtrees of one shape."""
    return trees.repeated_shapes(table(spark, sf_dir, "pages")).select("page_id", "tag", "n")


REPEATED_SHAPES = """
SELECT page_id, 'li' AS tag, len(regexp_extract_all(run, '<li>'))::BIGINT AS n
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:<li><a href="[^"]*">[^<]*</a></li>){3,}')) AS run FROM pages)
"""


def elements_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each kind lie inside pages' navigation, lists and articles, however deep."""
    nodes = trees.numbered(table(spark, sf_dir, "pages"), ["page_id"]).select("page_id", "node", "last", "tag")
    return trees.within(nodes.where("tag IN ('nav', 'ul', 'article')"), nodes).groupBy("page_id", "outer_tag", "tag").agg(F.count("*").alias("n"))


ELEMENTS_INSIDE = r"""
WITH o AS (SELECT page_id, t AS outer_tag, regexp_extract(html, '(?s)<' || t || r'\b[^>]*>(.*?)(?:</' || t || r'>|\z)', 1) AS part FROM pages, (VALUES ('nav'), ('ul'), ('article')) v(t))
SELECT page_id, outer_tag, tag, count(*) AS n FROM (SELECT page_id, outer_tag, unnest(regexp_extract_all(part, '<([a-z][a-z0-9]*)', 1)) AS tag FROM o) GROUP BY ALL
""".replace("r'", "'")


def link_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the order of their ids, by what they link: each joins the first family that it shares half of its links
    with (of the smaller set), or begins one."""
    links = F.expr("regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)")
    pages = table(spark, sf_dir, "pages").where("page_id IS NOT NULL").select(F.col("page_id").alias("key"), F.col("page_id").alias("ord"), links.alias("features"))
    return leaders.clusters(pages).select(F.col("key").alias("page_id"), F.col("leader").alias("family"))


#: The scan itself: the leaders so far are carried from page to page.
LINK_FAMILIES = """
WITH RECURSIVE p AS MATERIALIZED (SELECT page_id, list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS f, row_number() OVER (ORDER BY page_id) AS i FROM pages),
g AS (SELECT 0::BIGINT AS i, []::STRUCT(k BIGINT, f VARCHAR[])[] AS heads, NULL::BIGINT AS page_id, NULL::BIGINT AS family
UNION ALL SELECT i, CASE WHEN home IS NULL THEN list_append(heads, {'k': page_id, 'f': f}) ELSE heads END, page_id, coalesce(home, page_id)
FROM (SELECT p.i, heads, p.page_id, p.f, list_filter(heads, lambda x: (len(x.f) = 0 AND len(p.f) = 0) OR (least(len(x.f), len(p.f)) > 0 AND 2 * len(list_intersect(x.f, p.f)) >= least(len(x.f), len(p.f))))[1].k AS home FROM g JOIN p ON p.i = g.i + 1))
SELECT page_id, family FROM g WHERE i > 0
"""


def page_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sites' pages with equal first and last elements have in common at either end: hosts and their elements in
    order. Groups go by their figures, since signatures are hashes."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.array(F.regexp_extract("url", "^https?://([^/?#]*)", 1)).alias("wrappers"), F.expr(r"regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)").alias("items"))
    return reports.layout_groups(pages).groupBy("pages", "prefix", "suffix").agg(F.count("*").alias("groups"))


#: Place by place: all pages of the group reach it, and have one and the same item there.
PAGE_LAYOUTS = """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1) AS items FROM pages),
k AS (SELECT page_id, items, dense_rank() OVER (ORDER BY host, coalesce(items[1], ''), coalesce(items[-1], '')) AS s FROM p),
g AS (SELECT s, count(*) AS pages, min(len(items)) AS least FROM k GROUP BY s),
i AS (SELECT s, unnest(items) AS item, generate_subscripts(items, 1) AS pos, len(items) AS n FROM k),
f AS (SELECT s, pos FROM i GROUP BY s, pos HAVING count(DISTINCT item) > 1), b AS (SELECT s, n + 1 - pos AS pos FROM i GROUP BY s, n + 1 - pos HAVING count(DISTINCT item) > 1),
e AS (SELECT s, pages, least, least(least, coalesce((SELECT min(pos) - 1 FROM f WHERE f.s = g.s), least)) AS prefix, least(least, coalesce((SELECT min(pos) - 1 FROM b WHERE b.s = g.s), least)) AS suffix FROM g)
SELECT pages, CASE WHEN pages > 1 THEN prefix ELSE 0 END::INT AS prefix, CASE WHEN pages > 1 THEN least(suffix, least - prefix) ELSE 0 END::INT AS suffix, count(*) AS groups FROM e GROUP BY ALL
"""


def stub_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What small parts stand for: the parts that follow them in large deals, which may be small ones again."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    small = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("node"))
    follow = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    pairs = lines.where("l_quantity >= 48").join(follow, ["l_orderkey", "l_linenumber"])
    edges = pairs.select(F.col("l_partkey").alias("src"), "dst", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord")).where("src <> dst")
    return closure.expanded(small, edges.join(small.select(F.col("node").alias("src")), "src", "left_semi"))


#: All paths without a repeated part are listed; a target's place is that of the first path to it.
STUB_TARGETS = """
WITH RECURSIVE e AS MATERIALIZED (SELECT a.l_partkey AS src, b.l_partkey AS dst, min(a.l_orderkey * 8 + a.l_linenumber) AS ord FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part ON p_partkey = a.l_partkey WHERE a.l_quantity >= 48 AND p_size <= 25 AND a.l_partkey <> b.l_partkey GROUP BY ALL),
w AS (SELECT p_partkey AS root, p_partkey AS node, [p_partkey] AS met, []::BIGINT[] AS path FROM part WHERE p_size <= 25
UNION ALL SELECT root, dst, list_append(met, dst), list_concat(path, [ord, dst]) FROM w JOIN e ON src = node WHERE NOT list_contains(met, dst)),
f AS (SELECT root, node, min(path) AS path FROM w WHERE node NOT IN (SELECT src FROM e) GROUP BY ALL)
SELECT root, node AS target, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS place FROM f
"""

def page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes from one page of a site to the next one, in the order of their ids, down to what articles and
    navigation consist of: elements that are matched, went or came."""
    pages = table(spark, sf_dir, "pages").where("page_id IS NOT NULL").select("page_id", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), "html")
    # numbers dealt out by ranges: a window over a large site would be one task's
    ids = closure.numbered(pages.select("page_id", "host"), ["host", "page_id"], "n").select("page_id", "host", "n")
    after = ids.select(F.col("page_id").alias("next_id"), F.col("host").alias("_host"), (F.col("n") - 1).alias("n"))
    ids = ids.join(after, "n").where("host = _host").select("page_id", "next_id")
    later = pages.select(F.col("page_id").alias("next_id"), F.col("html").alias("after"))
    pairs = ids.join(pages.select("page_id", F.col("html").alias("before")), "page_id").join(later, "next_id")
    found = alignment.changes(pairs, ["page_id", "next_id"]).where("depth <= 3 AND tag IN ('nav', 'ul', 'div', 'article', 'h1', 'p', 'footer')")
    has = lambda c: F.col(c).isNotNull()
    return found.groupBy("page_id", "next_id").agg(F.count_if(has("before") & has("after")).alias("matched"), F.count_if(~has("after")).alias("gone"), F.count_if(~has("before")).alias("new"))


#: The children of bodies and articles as strings of letters; the common part's length row by row.
PAGE_CHANGES = r"""
WITH RECURSIVE p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(html, '(?s)<article\b[^>]*>(.*?)(?:</article>|\z)', 1) AS article, html FROM pages),
q AS (SELECT page_id, host, contains(html, '</article>') AS whole, regexp_extract_all(split_part(article, '<p><b>', 1), '<(h1|p)>', 1) || CASE WHEN contains(article, '<p><b>') THEN ['p'] ELSE [] END AS x, 3 + contains(html, '<ul>')::INT + contains(html, '<footer>')::INT AS rest FROM p),
n AS MATERIALIZED (SELECT page_id, lead(page_id) OVER w AS next_id, x, lead(x) OVER w AS y, rest, lead(rest) OVER w AS next_rest FROM q WINDOW w AS (PARTITION BY host ORDER BY page_id)),
l AS (SELECT page_id, 0 AS i, list_transform(range(len(y) + 1), lambda j: 0) AS v FROM n WHERE next_id IS NOT NULL
UNION ALL SELECT page_id, i + 1, list_transform(range(1, len(t) + 1), lambda j: list_max(t[1:j])) FROM (
  SELECT l.page_id, l.i, list_transform(range(1, len(v) + 1), lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest(v[j], v[j - 1] + (x[l.i + 1] = y[j - 1])::INT) END) AS t FROM l JOIN n USING (page_id) WHERE l.i < len(x)))
SELECT page_id, next_id, (v[-1] + least(rest, next_rest))::BIGINT AS matched, (len(x) - v[-1] + rest - least(rest, next_rest))::BIGINT AS gone, (len(y) - v[-1] + next_rest - least(rest, next_rest))::BIGINT AS new
FROM l JOIN n USING (page_id) WHERE i = len(x)
"""

QUERIES = {
    "repeated_markup": (repeated_markup, REPEATED_MARKUP), "repeated_shapes": (repeated_shapes, REPEATED_SHAPES), "elements_inside": (elements_inside, ELEMENTS_INSIDE),
    "link_families": (link_families, LINK_FAMILIES), "page_layouts": (page_layouts, PAGE_LAYOUTS), "stub_targets": (stub_targets, STUB_TARGETS),
    "page_changes": (page_changes, PAGE_CHANGES),
}
