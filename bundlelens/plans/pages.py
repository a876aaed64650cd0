"""Queries over captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens import rules
from bundlelens.functions import numbers, text, urls
from bundlelens.operators import detect, graphs, html, votes

#: Pages that show bundlers, in the form of `pages`; their ids are negative.
SAMPLES = [
    (-1, "https://n.test/a", '<script src="/_next/static/chunks/main.js"></script><div id="__next"></div><script>self.__next_f=[]</script>'),
    (-2, "https://u.test/", '<div id="__nuxt"></div><script src="/_nuxt/entry.abc.js"></script><script>window.__NUXT__={}</script>'),
    (-3, "https://s.test/", "<script>__sveltekit_1a={}</script><link href='/_app/immutable/x.js'>"),
    (-4, "https://w.test/", '<script src="/static/js/main.12ab.js"></script><script>webpackChunk=[]</script>'),
    (-5, "https://a.test/", '<astro-island component-url="/x"></astro-island><link href="/_astro/a.css"><meta name="generator" content="Astro v4">'),
    (-6, "https://r.test/", "<script>window.__reactRouterContext = {}; __reactRouterManifest</script>"),
    (-7, "https://g.test/", '<app-root ng-version="17"></app-root><style>[_nghost-x]{}</style>'),
    (-8, "https://v.test/", '<script type="module" crossorigin src="/assets/index-Ab12Cd34.js"></script><link rel="modulepreload" href="/assets/b.js">'),
]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(rows: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in rows) + f" ELSE {other} END"


def rlike(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


def with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir).unionByName(spark.createDataFrame(SAMPLES, "page_id long, url string, html string"))


SQL_SAMPLES = f"""all_pages AS (SELECT page_id, url, html FROM pages UNION ALL
    SELECT * FROM (VALUES {', '.join(f'({i}, {quoted(u)}, {quoted(h)})' for i, u, h in SAMPLES)}) v(page_id, url, html))"""
# DuckDB macros are not at hand in one statement, so the parts are written out.
SCHEME, AUTHORITY = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))", "lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1))"
PATH = "coalesce(nullif(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), ''), '/')"
QUERY = "regexp_extract(url, '^[^?#]*([?][^#]*)', 1)"
ORIGIN = f"({SCHEME} || '://' || {AUTHORITY})"
LINKS = f"""links AS (SELECT page_id, url, {SCHEME} || '://' || {AUTHORITY} || array_to_string(list_transform(string_split(href, ''),
    lambda c: CASE WHEN regexp_matches(c, '[^\\x21-\\x7e]|["<>`{{}}]') THEN url_encode(c) ELSE c END), '') AS link
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"#]*)', 1)) AS href FROM pages))"""


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir).select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.site(u).alias("site"), urls.page_key(u).alias("page_key"), urls.crawl_scope(u).alias("scope"), urls.guess_type(u).alias("type"))


URL_PARTS = f"""
SELECT page_id, {SCHEME} AS scheme, {AUTHORITY} AS host, {PATH} AS path, {QUERY} AS query,
       {SCHEME} || '://' || array_to_string(string_split({AUTHORITY}, '.')[-2:], '.') AS site,
       {ORIGIN} || coalesce(nullif(regexp_replace({PATH}, '/+$', ''), ''), '/') AS page_key,
       coalesce(nullif(CASE WHEN {PATH} LIKE '%/' THEN regexp_replace({PATH}, '/+$', '') ELSE regexp_replace({PATH}, '/[^/]*$', '') END, ''), '/') AS scope,
       'other' AS type FROM pages
"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_links(read(spark, sf_dir)).select("page_id", "link").groupBy("page_id", "link").agg(F.count("*").alias("n"))


PAGE_LINKS = f"WITH {LINKS} SELECT page_id, link, count(*) AS n FROM links GROUP BY ALL"


def links_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir)
    found = html.page_links(pages).join(pages.select("page_id", "url"), "page_id")
    inside = urls.in_scope(F.col("link"), F.col("url"), urls.crawl_scope(F.col("url")))
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if(inside).alias("n_inside"), F.count_if(F.col("link").rlike(rules.NON_PAGE)).alias("n_assets"))


LINKS_IN_SCOPE = f"""
WITH {LINKS}, scoped AS (SELECT *, coalesce(nullif(CASE WHEN {PATH} LIKE '%/' THEN regexp_replace({PATH}, '/+$', '') ELSE regexp_replace({PATH}, '/[^/]*$', '') END, ''), '/') AS scope,
    regexp_extract(link, '^[^:]+://[^/]*([^?]*)', 1) AS p FROM links)
SELECT page_id, count(*) AS n_links, count(*) FILTER (scope = '/' OR p = scope OR starts_with(p, scope || '/')) AS n_inside,
       count(*) FILTER ({rlike('link', rules.NON_PAGE)}) AS n_assets FROM scoped GROUP BY page_id
"""


def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.dom(read(spark, sf_dir), ["page_id"]).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


ELEMENT_COUNTS = """
SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag
"""


def inline_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = html.inline_scripts(read(spark, sf_dir))
    return own.select("page_id", "code", "module", detect.is_framework_script(F.col("code")).alias("framework"), *detect.boilerplate_counts(F.col("code")))


INLINE_SCRIPTS = f"""
SELECT page_id, code, false AS module, {' OR '.join(rlike('code', p) for p in rules.FRAMEWORK_SCRIPTS)} AS framework,
       {', '.join(f'len(regexp_extract_all(code, {quoted(p)}))::BIGINT AS {name}' for name, p in rules.BOILERPLATE)}
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<script>(.*?)</script>', 1, 's')) AS code FROM pages) WHERE trim(code) <> ''
"""


def adapter_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.page_detections(with_samples(spark, sf_dir)).select("page_id", "adapter", F.round("score", 3).alias("score"), F.array_join("evidence", "; ").alias("evidence"))


_SIGNALS = " UNION ALL ".join(f"SELECT page_id, {i} AS i, {quoted(a)} AS adapter, {w} AS weight, {quoted(label)} AS label FROM all_pages WHERE {' AND '.join(rlike('html', p) for p in ps)}" for i, (a, place, ps, w, label) in enumerate(rules.PAGE_SIGNALS) if place == "html")
ADAPTER_SIGNALS = f"""
WITH {SQL_SAMPLES}, hits AS ({_SIGNALS})
SELECT page_id, adapter, round(least(1.0, sum(weight::DOUBLE)), 3) AS score, string_agg(label, '; ' ORDER BY i) AS evidence FROM hits GROUP BY page_id, adapter
"""


def adapter_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.rank_adapters(with_samples(spark, sf_dir)).select("page_id", "adapter", F.round("score", 3).alias("score"))


ADAPTER_RANKS = f"""
WITH {SQL_SAMPLES}, hits AS ({_SIGNALS}),
scores AS (SELECT page_id, adapter, round(least(1.0, sum(weight::DOUBLE)), 3) AS score FROM hits GROUP BY page_id, adapter),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, adapter) AS r FROM scores)
SELECT p.page_id, CASE WHEN coalesce(score, 0) >= {rules.MIN_ADAPTER_SCORE} THEN adapter ELSE 'generic' END AS adapter, coalesce(score, 0.0) AS score
FROM all_pages p LEFT JOIN best b ON p.page_id = b.page_id AND b.r = 1
"""


def request_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page requested from the first page of its site."""
    pages = read(spark, sf_dir).withColumn("site", urls.site(F.col("url")))
    first = pages.groupBy("site").agg(F.min_by("url", "page_id").alias("referrer")).withColumnRenamed("site", "of")
    joined = pages.join(first, F.col("site") == F.col("of"))
    return joined.select("page_id", "referrer", urls.fetch_site(F.col("url"), F.col("referrer")).alias("fetch_site"), urls.referer(F.col("url"), F.col("referrer")).alias("referer"))


REQUEST_POLICY = f"""
WITH p AS (SELECT page_id, url, {ORIGIN} AS origin, {SCHEME} AS scheme, {SCHEME} || '://' || array_to_string(string_split({AUTHORITY}, '.')[-2:], '.') AS site FROM pages),
f AS (SELECT site, arg_min(url, page_id) AS referrer, arg_min(origin, page_id) AS r_origin, arg_min(scheme, page_id) AS r_scheme FROM p GROUP BY site)
SELECT page_id, referrer, CASE WHEN r_origin = origin THEN 'same-origin' ELSE 'same-site' END AS fetch_site,
       CASE WHEN r_scheme = 'https' AND scheme = 'http' THEN NULL WHEN r_origin = origin THEN regexp_replace(referrer, '#.*$', '') ELSE r_origin || '/' END AS referer
FROM p JOIN f USING (site)
"""


def host_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory that all pages of a host share."""
    pages = read(spark, sf_dir).select(urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    # the extremes share what all share
    return pages.groupBy("host").agg(F.count("*").alias("pages"), urls.common_directory(F.array(F.min("path"), F.max("path"))).alias("directory"))


HOST_DIRECTORIES = f"""
WITH p AS (SELECT {AUTHORITY} AS host, {PATH} AS path FROM pages),
d AS (SELECT host, list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[:n], '/') || '/') AS dirs FROM p),
x AS (SELECT host, unnest(dirs) AS dir FROM d),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
shared AS (SELECT host, dir FROM (SELECT host, dir, count(*) AS c FROM x GROUP BY host, dir) JOIN n USING (host) WHERE c = pages)
SELECT host, pages, arg_max(dir, length(dir)) AS directory FROM shared JOIN n USING (host) GROUP BY host, pages
"""


def site_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir).select(F.explode(urls.site_words(F.col("url"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("pages"))


SITE_WORDS = f"""
SELECT word, count(*) AS pages FROM (SELECT unnest(string_split({AUTHORITY}, '.')[:-2]) AS word FROM pages)
WHERE length(word) >= 4 AND NOT {rlike('word', rules.GENERIC_LABEL)} GROUP BY word
"""


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the pages' files go: a path without slashes at its end and `.html`, unique within the host."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(urls.path(F.col("url")), r"/+$", ""), r"(?i)\.html?$", ""), r"/index$", "")
    file = F.concat(F.lit("html/"), urls.host_dir(F.col("url")), F.lit("/"), urls.safe_path(F.when(bare == "", "index").otherwise(bare)))
    return votes.unique_names(read(spark, sf_dir).select("page_id", file.alias("file")), "file", "page_id").select("page_id", F.concat("unique_name", F.lit(".html")).alias("file"))


OUTPUT_PATHS = f"""
WITH p AS (SELECT page_id, 'html/' || {AUTHORITY} || '/' || ltrim(coalesce(nullif(regexp_replace(regexp_replace({PATH}, '/+$', ''), '(?i)[.]html?$', ''), ''), 'index'), '/') AS file FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(file) ORDER BY page_id) AS n FROM p)
SELECT page_id, CASE WHEN n = 1 THEN file ELSE file || '-' || n END || '.html' AS file FROM n
"""


def link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected parts of the graph of pages and what they link to."""
    pages = read(spark, sf_dir)
    edges = html.page_links(pages).join(pages.select("page_id", "url"), "page_id").select(urls.page_key(F.col("url")).alias("src"), urls.page_key(F.col("link")).alias("dst"))
    return graphs.components(edges)


LINK_COMPONENTS = f"""
WITH RECURSIVE {LINKS}, e AS (SELECT DISTINCT {ORIGIN} || coalesce(nullif(regexp_replace({PATH}, '/+$', ''), ''), '/') AS a,
    regexp_extract(link, '^([^:]+://[^/]*)', 1) || coalesce(nullif(regexp_replace(regexp_extract(link, '^[^:]+://[^/]*([^?#]*)', 1), '/+$', ''), ''), '/') AS b FROM links),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.other = u.a)
SELECT node, min(other) AS component FROM r GROUP BY node
"""


def missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of links that were never captured, and how many pages point there."""
    pages = read(spark, sf_dir)
    edges = html.page_links(pages).select(F.col("page_id").alias("src"), urls.page_key(F.col("link")).alias("dst"))
    return graphs.missing(edges, pages.select(urls.page_key(F.col("url")).alias("node")))


MISSING_LINKS = f"""
WITH {LINKS} SELECT dst, count(DISTINCT page_id) AS importers FROM (SELECT page_id,
    regexp_extract(link, '^([^:]+://[^/]*)', 1) || coalesce(nullif(regexp_replace(regexp_extract(link, '^[^:]+://[^/]*([^?#]*)', 1), '/+$', ''), ''), '/') AS dst FROM links)
WHERE dst NOT IN (SELECT {ORIGIN} || coalesce(nullif(regexp_replace({PATH}, '/+$', ''), ''), '/') FROM pages) GROUP BY dst
"""


def crawl_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first distances from every host's first page to what it reaches."""
    pages = read(spark, sf_dir)
    keyed = pages.select("page_id", urls.page_key(F.col("url")).alias("key"), urls.host(F.col("url")).alias("host"))
    edges = html.page_links(pages).join(keyed, "page_id").select(F.col("key").alias("src"), urls.page_key(F.col("link")).alias("dst"))
    seeds = keyed.groupBy("host").agg(F.min_by("key", "page_id").alias("node")).select("node")
    return graphs.reach(edges, seeds).withColumn("depth", F.col("depth").cast("long"))


CRAWL_DEPTHS = f"""
WITH RECURSIVE {LINKS}, k AS (SELECT page_id, {ORIGIN} || coalesce(nullif(regexp_replace({PATH}, '/+$', ''), ''), '/') AS key, {AUTHORITY} AS host FROM pages),
e AS (SELECT DISTINCT key AS a, regexp_extract(link, '^([^:]+://[^/]*)', 1) || coalesce(nullif(regexp_replace(regexp_extract(link, '^[^:]+://[^/]*([^?#]*)', 1), '/+$', ''), ''), '/') AS b FROM links JOIN k USING (page_id)),
r AS (SELECT node, 0 AS depth FROM (SELECT arg_min(key, page_id) AS node FROM k GROUP BY host) UNION SELECT e.b, depth + 1 FROM r JOIN e ON r.node = e.a WHERE depth < 20)
SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY node
"""


def page_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = spark.createDataFrame([(-1, "x\nwindow.Telegram.WebApp.ready()\ngrecaptcha.execute()"), (-2, 'fetch("/api/auth/session")')], "page_id long, html string")
    return detect.services(read(spark, sf_dir).select("page_id", "html").unionByName(samples), "page_id", "html").select("page_id", "kind", "name", F.col("line").cast("long").alias("line"))


PAGE_SERVICES = "WITH f AS (SELECT page_id, html FROM pages UNION ALL SELECT * FROM (VALUES (-1, 'x' || chr(10) || 'window.Telegram.WebApp.ready()' || chr(10) || 'grecaptcha.execute()'), (-2, 'fetch(\"/api/auth/session\")')) v(page_id, html)) " + " UNION ALL ".join(
    f"SELECT page_id, {quoted(kind)} AS kind, {quoted(name)} AS name, list_position(list_transform(string_split(html, chr(10)), lambda l: {rlike('l', p)}), true)::BIGINT AS line FROM f WHERE {rlike('html', p)}" for kind, name, p, _ in rules.SERVICES
)


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("html").cast("long")
    return read(spark, sf_dir).select("page_id", n.alias("octets"), numbers.ratio(F.length("html").cast("double"), n.cast("double")).alias("characters_per_octet"), text.snippet(F.col("html"), 80).alias("snippet"))


PAGE_SIZES = r"""
SELECT page_id, strlen(html)::BIGINT AS octets, round(length(html)::DOUBLE / strlen(html), 3) AS characters_per_octet,
       CASE WHEN length(s) > 80 THEN left(s, 77) || '...' ELSE s END AS snippet
FROM (SELECT page_id, html, trim(regexp_replace(html, '\s+', ' ', 'g')) AS s FROM pages)
"""

QUERIES = {
    "url_parts": (url_parts, URL_PARTS), "page_links": (page_links, PAGE_LINKS), "links_in_scope": (links_in_scope, LINKS_IN_SCOPE), "element_counts": (element_counts, ELEMENT_COUNTS),
    "inline_scripts": (inline_scripts, INLINE_SCRIPTS), "adapter_signals": (adapter_signals, ADAPTER_SIGNALS), "adapter_ranks": (adapter_ranks, ADAPTER_RANKS), "request_policy": (request_policy, REQUEST_POLICY),
    "host_directories": (host_directories, HOST_DIRECTORIES), "site_words": (site_words, SITE_WORDS), "output_paths": (output_paths, OUTPUT_PATHS), "link_components": (link_components, LINK_COMPONENTS),
    "missing_links": (missing_links, MISSING_LINKS), "crawl_depths": (crawl_depths, CRAWL_DEPTHS), "page_services": (page_services, PAGE_SERVICES), "page_sizes": (page_sizes, PAGE_SIZES),
}
