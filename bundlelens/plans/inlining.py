"""Queries on inlined variants and on sketches of what can be reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.functions import urls
from bundlelens.operators import html, variants
from bundlelens.plans import documents, pages
from bundlelens.plans.documents import _sql_features
from bundlelens.plans.pages import LINKS, ORIGIN, PATH

HOPS, LONG = 3, 1000


def inlined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as functions: each calls the next one in its language and the next but one of its source, long ones are
    exported. What the long ones are with those that they alone call: members, different words and calls."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    after = lambda column, n: docs.select(F.col("doc_id").alias("function"), column, (F.col("doc_id") + n).alias("callee")).join(docs.select(F.col("doc_id").alias("callee"), column), ["callee", column])
    calls = after("lang", 1).select("function", "callee").unionByName(after("source", 2).select("function", "callee"))
    one = lambda df: df.withColumn("module", F.lit("documents"))
    words = documents.features(spark, sf_dir, "documents", "doc_id", "function")
    exported = docs.where(F.col("n_chars") >= LONG).select(F.col("doc_id").alias("function"))
    sets, links, held = variants.inlined(one(words), one(calls), one(exported), HOPS)
    count = lambda df, name: df.groupBy("function").agg(F.count("*").alias(name))
    sizes = count(held, "members").join(count(sets, "words"), "function", "left").join(count(links, "calls"), "function", "left")
    return sizes.select(F.col("function").alias("doc_id"), "members", F.coalesce("words", F.lit(0)).cast("long").alias("words"), F.coalesce("calls", F.lit(0)).cast("long").alias("calls"))


INLINED_DOCUMENTS = f"""
WITH RECURSIVE w AS ({_sql_features('documents', 'doc_id', 'doc_id')}),
c AS (SELECT a.doc_id AS f, b.doc_id AS c FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND a.lang = b.lang UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 2 AND a.source = b.source),
x AS (SELECT doc_id FROM documents WHERE n_chars >= {LONG}), n AS (SELECT c FROM c GROUP BY c HAVING count(*) = 1),
s AS MATERIALIZED (SELECT * FROM c WHERE c IN (SELECT c FROM n) AND c IN (SELECT doc_id FROM w) AND c NOT IN (SELECT doc_id FROM x)),
h AS (SELECT doc_id AS root, doc_id AS m, 0 AS depth FROM x UNION ALL SELECT root, s.c, depth + 1 FROM h JOIN s ON s.f = h.m WHERE depth < {HOPS}),
r AS (SELECT root, count(*) - 1 AS members FROM h GROUP BY root HAVING count(*) > 1),
v AS (SELECT root, count(DISTINCT feature) AS words FROM h JOIN w ON w.doc_id = h.m GROUP BY root),
k AS (SELECT root, count(DISTINCT c) AS calls FROM h JOIN c ON c.f = h.m WHERE NOT EXISTS (FROM h g WHERE g.root = h.root AND g.m = c.c) GROUP BY root)
SELECT root AS doc_id, members, coalesce(words, 0) AS words, coalesce(calls, 0) AS calls FROM r LEFT JOIN v USING (root) LEFT JOIN k USING (root)
"""

CLICKS, MOST, BITS = 4, 64, 60


def _hashed(name: Column) -> Column:
    """60 bits that SQL engines agree on."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def reachable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many addresses, its own included, each page reaches within four clicks: counted up to 63, reckoned beyond."""
    captured = pages.read(spark, sf_dir)
    keyed = captured.select("page_id", urls.page_key(F.col("url")).alias("src"))
    edges = html.page_links(captured).join(keyed, "page_id").select("src", urls.page_key(F.col("link")).alias("dst"))
    nodes = keyed.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    sketch = variants.sketches(nodes.withColumn("feature", F.col("node")), edges, MOST, CLICKS, _hashed)
    return variants.set_sizes(sketch, MOST, BITS, 0)


_KEY = f"{ORIGIN} || coalesce(nullif(regexp_replace({PATH}, '/+$', ''), ''), '/')"
REACHABLE_PAGES = f"""
WITH RECURSIVE {LINKS}, p AS (SELECT page_id, {_KEY} AS key FROM pages),
e AS MATERIALIZED (SELECT DISTINCT key AS a, regexp_extract(link, '^([^:]+://[^/]*)', 1) || coalesce(nullif(regexp_replace(regexp_extract(link, '^[^:]+://[^/]*([^?#]*)', 1), '/+$', ''), ''), '/') AS b FROM links JOIN p USING (page_id)),
n AS (SELECT key AS node FROM p UNION SELECT b FROM e), r AS (SELECT node, node AS other, 0 AS clicks FROM n UNION SELECT r.node, e.b, clicks + 1 FROM r JOIN e ON r.other = e.a WHERE clicks < {CLICKS}),
d AS (SELECT node, ('0x' || md5(other)[1:15])::BIGINT AS h FROM (SELECT DISTINCT node, other FROM r)),
s AS (SELECT node, count(*) AS n, list_sort(list(h))[{MOST}] AS top FROM d GROUP BY node)
SELECT node, CASE WHEN n < {MOST} THEN n ELSE round({MOST - 1} / (top::DOUBLE / {float(1 << BITS)}))::BIGINT END AS size, n < {MOST} AS exact FROM s
"""

QUERIES = {"inlined_documents": (inlined_documents, INLINED_DOCUMENTS), "reachable_pages": (reachable_pages, REACHABLE_PAGES)}
