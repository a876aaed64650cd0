"""Queries over scripts, styles and bundles: those of the captured pages, chunks made of the parts table (a module for
each part, which needs that of half its number), and samples of what bundlers write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens import rules
from bundlelens.functions import urls
from bundlelens.operators import chunks, detect, exports, html, payloads, readable, scripts
from bundlelens.plans.pages import quoted, read, rlike
from bundlelens.sinks import trees
from bundlelens.sources import http, sourcemaps

#: Scripts as bundlers write them: url, body, adapter.
ASSETS = [
    ("https://h.test/s/runtime.js", 's.p="/x/",s.u=e=>"c/"+e+"."+{3:"ab"}[e]+".js";s.e(3);s.e("q");__webpack_require__', "webpack"),
    ("https://h.test/s/3.js", "(self.webpackChunk=self.webpackChunk||[]).push([[3],{7:(e,t,r)=>{var x=r(8);r(9);r.d(t,{a:()=>x})},8:(e,t,r)=>{e.exports=2},10:f()}]);", "webpack"),
    ("https://h.test/s/4.js", '(globalThis.TURBOPACK||(globalThis.TURBOPACK=[])).push([document.currentScript,1,t=>{t.s(["a",0,1])},2,t=>{t.i(1)}]);', "next"),
    ("https://h.test/assets/main-Ab12Cd34.js", 'import{a}from"./dep-Ab12Cd34.js";export const b=a;router.push("/settings");x="/api/users";y="/img/a.png";z="/blog/post"', "vite"),
    ("https://h.test/_app/immutable/app.js", 'const dictionary = {"/blog/[slug]":[-2,[1]],"/about":[3]}; export {dictionary}', "sveltekit"),
]
SHEETS = [("a.css", 1, "/*! tailwindcss v3.4.1 */.flex{display:flex}.card{a:b}"), ("b.css", 2, ".x{--tw-ring: 1}"), ("c.css", 3, "a{b:c}@media x{d{e:f}}")]
MAPS = [("m1", json.dumps({"version": 3, "mappings": "", "sources": ["webpack:///./src/a.ts", "b.ts"], "sourcesContent": ["A", None]})), ("m2", json.dumps({"version": 3, "mappings": "", "sources": ["c/../d.ts"], "sourcesContent": ["D"]})), ("m3", "<html>")]
SITEMAPS = [("https://h.test/sitemap.xml", "<urlset><loc>https://h.test/a</loc><loc> https://h.test/b?x&amp;y </loc><loc>https://o.test/</loc><loc>https://h.test/n.xml</loc></urlset>"), ("https://h.test/x", "<loc>https://h.test/c</loc>")]


def values(rows: list[tuple], names: str) -> str:
    cell = lambda v: quoted(v) if isinstance(v, str) else "NULL" if v is None else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names}))"


#: Parts that chunks have, and how many numbers a chunk is for.
LARGEST, IN_CHUNK = 45, 100
SQL_ASSETS = f"""(SELECT url, body, adapter FROM {values(ASSETS, "url, body, adapter")} UNION ALL
SELECT 'https://pages.test/' || page_id, unnest(regexp_extract_all(html, '<script>(.*?)</script>', 1, 's')), 'webpack' FROM pages UNION ALL
SELECT 'https://parts.test/' || (p_partkey // {IN_CHUNK}) || '.js', '(self.webpackChunkparts=self.webpackChunkparts||[]).push([[' || (p_partkey // {IN_CHUNK}) || '],{{' ||
  string_agg('"p' || p_partkey || '":(e,t,r)=>{{var x=r("p' || (p_partkey // 2) || '");r.e(' || p_size || ');e.exports=x}}', ',' ORDER BY p_partkey) || '}}])', 'webpack' FROM part WHERE p_size <= {LARGEST} GROUP BY p_partkey // {IN_CHUNK})"""
SQL_PAGE_SHEETS = "(SELECT 'page-' || page_id AS url, unnest(regexp_extract_all(html, '<style>(.*?)</style>', 1, 's')) AS css FROM pages)"
SQL_SCRIPTS = "s AS (SELECT page_id, unnest(regexp_extract_all(html, '<script>(.*?)</script>', 1, 's')) AS code FROM pages)"


def part_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, body, adapter): chunks whose modules are the parts; a chunk has IN_CHUNK of them at most."""
    chunk = F.expr(f"cast(p_partkey div {IN_CHUNK} as string)")
    module = F.expr("""concat('"p', p_partkey, '":(e,t,r)=>{var x=r("p', p_partkey div 2, '");r.e(', p_size, ');e.exports=x}')""")
    # the table is small and parsing its chunks is not: a given number of partitions is left as it is, others are joined by size
    dealt = spark.read.parquet(f"{sf_dir}/part.parquet").where(F.col("p_size") <= LARGEST).withColumn("chunk", chunk).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
    parts = dealt.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("p_partkey", module.alias("m")))).alias("ms"))
    body = F.concat(F.lit("(self.webpackChunkparts=self.webpackChunkparts||[]).push([["), "chunk", F.lit("],{"), F.array_join(F.col("ms.m"), ","), F.lit("}])"))
    return parts.select(F.concat(F.lit("https://parts.test/"), "chunk", F.lit(".js")).alias("url"), body.alias("body"), F.lit("webpack").alias("adapter"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, body, adapter): the inline scripts of all pages, the parts' chunks and the samples."""
    inline = page_scripts(spark, sf_dir).select(F.concat(F.lit("https://pages.test/"), "page_id").alias("url"), F.col("code").alias("body"), F.lit("webpack").alias("adapter"))
    return spark.createDataFrame(ASSETS, "url string, body string, adapter string").unionByName(inline).unionByName(part_chunks(spark, sf_dir))


def page_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, ord, css): the style elements of all pages and the samples."""
    own = read(spark, sf_dir).select(F.concat(F.lit("page-"), "page_id").alias("url"), (F.col("page_id") + 10).cast("int").alias("ord"), F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<style>(.*?)</style>"), 1)).alias("css"))
    return own.unionByName(spark.createDataFrame(SHEETS, "url string, ord int, css string"))


def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.inline_scripts(read(spark, sf_dir)).select("page_id", "code")


def script_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.string_literals(page_scripts(spark, sf_dir), ["page_id"])


SCRIPT_STRINGS = f"""WITH {SQL_SCRIPTS} SELECT page_id, unnest(regexp_extract_all(code, '"([^"]*)"', 1)) AS value, 1::INTEGER AS line FROM s"""


def script_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.names(page_scripts(spark, sf_dir), ["page_id"])


SCRIPT_BINDINGS = f"WITH {SQL_SCRIPTS} SELECT page_id, regexp_extract(code, 'var (\\w+)=', 1) AS name, 'var' AS kind, 1::INTEGER AS uses FROM s WHERE regexp_matches(code, 'var \\w+=')"


def readable_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.readable(page_scripts(spark, sf_dir), ["page_id"])


READABLE_SCRIPTS = rf"""WITH {SQL_SCRIPTS} SELECT page_id, regexp_replace(code, '^var (\w+)=("[^"]*");(\w+)\((\d+)\);$', 'var \1 = \2;' || chr(10) || '\3(\4);' || chr(10)) AS code FROM s"""


def script_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.module_features(page_scripts(spark, sf_dir), ["page_id"]).groupBy("feature").agg(F.count("*").alias("pages"))


SCRIPT_FEATURES = f"""
WITH {SQL_SCRIPTS}, f AS (SELECT page_id, 'S:' || unnest(regexp_extract_all(code, '"([^"]+)"', 1)) AS feature FROM s
UNION SELECT page_id, 'N:' || regexp_extract(code, '\\((\\d+)\\)', 1) FROM s WHERE regexp_matches(code, '\\(\\d\\d+\\)'))
SELECT feature, count(*) AS pages FROM f GROUP BY feature
"""


def page_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = read(spark, sf_dir).select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<style>(.*?)</style>"), 1)).alias("css"))
    return scripts.sheet_rules(sheets, ["page_id"])


PAGE_STYLES = "SELECT page_id, 0::INTEGER AS ord, css AS text, trim(split_part(css, '{', 1)) AS head FROM (SELECT page_id, unnest(regexp_extract_all(html, '<style>(.*?)</style>', 1)) AS css FROM pages)"


def readable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing of these pages is a framework's, so all of them stay as they are."""
    return readable.readable_pages(read(spark, sf_dir)).select("page_id", F.sha2("html", 256).alias("sha256"), "removed", F.size("third_party").alias("third_parties"))


READABLE_PAGES = "SELECT page_id, sha256(html) AS sha256, 0::INTEGER AS removed, 0::INTEGER AS third_parties FROM pages"


def url_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readable.url_attributes(read(spark, sf_dir)).groupBy("tag", "attribute", "value").agg(F.count("*").alias("n"))


URL_ATTRIBUTES = """SELECT 'a' AS tag, 'href' AS attribute, value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS value FROM pages) GROUP BY value"""


def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = page_scripts(spark, sf_dir).select(F.col("page_id").cast("string").alias("path"), F.lit("script").alias("kind"), F.lit(False).alias("library"), F.col("code").alias("content"))
    mods = read(spark, sf_dir).select(F.concat(F.lit("page-"), "page_id").alias("name"), urls.host(F.col("url")).alias("package"), F.lit("full").alias("level"))
    found = chunks.quality(files, mods)
    return found.select("mangled_app", "readable_names", F.size("packages").cast("long").alias("packages"), "require_calls", "degraded")


PAGE_QUALITY = f"""WITH {SQL_SCRIPTS} SELECT (SELECT round(count(*) FILTER (regexp_matches(code, 'var \\w{{1,2}}=')) / count(*), 3) FROM s) AS mangled_app, 1.0::DOUBLE AS readable_names,
(SELECT count(DISTINCT lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1))) FROM pages) AS packages, 0::BIGINT AS require_calls, 0::BIGINT AS degraded"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of an output tree, by host: equal names get numbers."""
    files = read(spark, sf_dir).select(F.concat(F.lit("html/"), urls.host(F.col("url")), F.lit(".html")).alias("path"), F.col("html").alias("content"), F.col("page_id").alias("ord"))
    return trees.placed(files).select("path", "ord")


PAGE_FILES = """
WITH f AS (SELECT 'html/' || lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS stem, html, min(page_id) AS ord FROM pages GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY ord) AS n FROM f)
SELECT stem || CASE WHEN n > 1 THEN '~' || n ELSE '' END || '.html' AS path, ord FROM n
"""


def chunk_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).select("url", detect.chunk_shape(F.col("body")).alias("shape"))


CHUNK_SHAPES = f"""
SELECT url, CASE WHEN regexp_matches(body, 'webpack(Chunk|Jsonp)[\\w$]*[^;]{{0,80}}\\.push\\(\\[\\[') THEN 'webpack-chunk' WHEN contains(body, 'TURBOPACK') AND regexp_matches(body, '\\.push\\(\\[') THEN 'turbopack-chunk'
  WHEN contains(body, '__webpack_require__') THEN 'webpack-runtime' WHEN regexp_matches(body, '(^|[;}}\\s])(import\\s*[\\w{{*"'']|export\\s*[{{*]|export\\s+(default|const|let|var|function|class)\\b)') THEN 'esm' ELSE 'plain' END AS shape FROM {SQL_ASSETS}
"""


def unpacked_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.modules(chunks.unpacked(assets(spark, sf_dir))).select("namespace", "id", "code", F.array_join("deps", ",").alias("deps"), "origin")


def chunk_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.diagnostics(chunks.unpacked(assets(spark, sf_dir))).select("chunk_url", "shape", "level", "modules", F.array_join("skipped", "; ").alias("skipped"))


#: What the samples hold, by hand, and the parts by their chunks.
CHUNK_DIAGNOSTICS = values([("https://h.test/s/3.js", "webpack5-jsonp", "partial", 2, "10: module value is CallExpression"), ("https://h.test/s/4.js", "turbopack-flat", "full", 2, ""), ("https://h.test/assets/main-Ab12Cd34.js", "esm", "full", 1, ""), ("https://h.test/_app/immutable/app.js", "esm", "full", 1, "")], "chunk_url, shape, level, modules, skipped").removeprefix("(").removesuffix(")").replace("SELECT *", "SELECT chunk_url, shape, level, modules::BIGINT AS modules, skipped")
CHUNK_DIAGNOSTICS += f" UNION ALL SELECT 'https://parts.test/' || (p_partkey // {IN_CHUNK}) || '.js', 'webpack5-jsonp', 'full', count(*), '' FROM part WHERE p_size <= {LARGEST} GROUP BY p_partkey // {IN_CHUNK}"


def missing_modules_of_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.missing_modules(chunks.modules(chunks.unpacked(assets(spark, sf_dir))))
    return found.select(F.regexp_extract("dst", "([^\x00]*)$", 1).alias("id"), "importers")


MISSING_MODULES_OF_BUNDLES = f"""SELECT id, importers::BIGINT AS importers FROM (VALUES ('9', 1), ('dep-Ab12Cd34', 1)) v(id, importers) UNION ALL
SELECT 'p' || (p_partkey // 2), count(*) FROM part WHERE p_size <= {LARGEST} AND p_partkey // 2 NOT IN (SELECT p_partkey FROM part WHERE p_size <= {LARGEST}) GROUP BY p_partkey // 2"""


def lazy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.lazy_state(assets(spark, sf_dir))


LAZY_CHUNKS = f"""
WITH a AS {SQL_ASSETS}, asked AS (SELECT DISTINCT replace(unnest(regexp_extract_all(body, '\\.e\\(\\s*(\\d+|"[^"\\\\]+")\\s*\\)', 1)), '"', '') AS chunk_id FROM a),
held AS (SELECT unnest(string_split(regexp_extract(body, '\\.push\\(\\[\\[([^\\]]*)\\]', 1), ',')) AS chunk_id FROM a)
SELECT chunk_id FROM asked WHERE chunk_id NOT IN (SELECT chunk_id FROM held)
"""


def chunk_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_urls(assets(spark, sf_dir)).select("chunk_id", "kind", "path", "chunk_url")


def routes_in_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.route_candidates(assets(spark, sf_dir), "https://h.test", "/")


ROUTES_IN_CODE = f"""
WITH c AS (SELECT DISTINCT unnest(regexp_extract_all(body, '["''`](/[A-Za-z0-9\\-_~.%/]*)["''`]', 1)) AS p FROM {SQL_ASSETS})
SELECT 'https://h.test' || p AS url FROM c WHERE NOT starts_with(p, '//') AND length(p) <= 120 AND NOT {rlike('p', rules.UNSAFE_ROUTE)} AND NOT {rlike('p', rules.NON_PAGE)}
  AND NOT regexp_matches(p, '\\.\\w{{1,5}}$') AND NOT regexp_matches(p, '/[_\\[:(]') AND (p = '/' OR regexp_matches(p, '[^/]{{2,}}')) AND NOT regexp_matches(p, '(?i)(^|/)index(\\.html?)?$')
"""


def style_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = chunks.merged_styles(page_sheets(spark, sf_dir))
    return merged.groupBy("target").agg(F.count("*").alias("rules"))


#: By hand: the banner, .flex and, since version 3 resets elements, the rule of a; .card, .x and the media rule are the app's.
#: The pages' sheets are one rule each.
STYLE_TARGETS = f"""SELECT target, sum(rules)::BIGINT AS rules FROM (SELECT * FROM (VALUES ('tailwind', 3), ('app', 3)) v(target, rules) UNION ALL
SELECT CASE WHEN regexp_matches(css, '^[a-z]+\\{{') THEN 'tailwind' ELSE 'app' END, count(DISTINCT css) FROM {SQL_PAGE_SHEETS} GROUP BY 1) GROUP BY target"""


def tailwind_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.tailwind(page_sheets(spark, sf_dir)).select("url", "uses_tailwind", "tailwind_version")


TAILWIND_SHEETS = f"SELECT url, regexp_matches(css, '(?i)/\\*!\\s*tailwindcss\\s+v?[\\d.]+|--tw-[\\w-]+\\s*:') AS uses_tailwind, nullif(regexp_extract(css, '(?i)/\\*!\\s*tailwindcss\\s+v?([\\d.]+)', 1), '') AS tailwind_version FROM (SELECT url, css FROM {values(SHEETS, 'url, ord, css')} UNION ALL SELECT url, css FROM {SQL_PAGE_SHEETS})"


def map_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the samples, and of a map for each source of documents that names its languages and how many there are."""
    counts = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source", "lang").agg(F.count("*").cast("string").alias("n"))
    whole = counts.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("webpack:///./src/"), "lang", F.lit(".ts")).alias("original"), "n"))).alias("s"))  # a row for each language
    body = F.to_json(F.struct(F.lit(3).alias("version"), F.lit("").alias("mappings"), F.col("s.original").alias("sources"), F.col("s.n").alias("sourcesContent")))
    maps = whole.select(F.concat(F.lit("map-"), "source").alias("map_url"), body.alias("body"))
    return sourcemaps.sources(spark.createDataFrame(MAPS, "map_url string, body string").unionByName(maps))


MAP_SOURCES = f"""
WITH m AS (SELECT map_url, body FROM {values(MAPS, 'map_url, body')} WHERE starts_with(body, '{{')),
s AS (SELECT map_url, unnest(json_extract_string(body, '$.sources[*]')) AS original, generate_subscripts(json_extract_string(body, '$.sources[*]'), 1) AS i, json_extract_string(body, '$.sourcesContent[*]') AS contents FROM m)
SELECT map_url, CASE WHEN original = 'c/../d.ts' THEN 'd.ts' ELSE regexp_replace(regexp_replace(original, '^webpack://[^/]*/', ''), '^(\\.\\.?/)+', '') END AS path, original, contents[i] AS content FROM s
UNION ALL SELECT 'map-' || source, 'src/' || lang || '.ts', 'webpack:///./src/' || lang || '.ts', count(*)::VARCHAR FROM documents GROUP BY source, lang
"""


def sitemap_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the samples' sitemaps list, and those of all captured sites, made of their pages, on one of these."""
    pages = read(spark, sf_dir)
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    own = pages.groupBy(urls.origin(F.col("url")).alias("origin"), F.expr("page_id div 500").alias("part")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("urls"))  # 500 at most
    files = own.select(F.concat("origin", F.lit("/sitemap-"), "part", F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), "urls", F.lit("</urlset>")).alias("body"))
    return http.sitemap_pages(spark.createDataFrame(SITEMAPS, "url string, body string"), F.lit("https://h.test")).unionByName(http.sitemap_pages(files, F.lit("https://spam-farm.example.org")))


SITEMAP_LISTING = f"""
WITH l AS (SELECT DISTINCT replace(unnest(regexp_extract_all(body, '<loc>\\s*([^<\\s]+)\\s*</loc>', 1)), '&amp;', '&') AS url FROM {values(SITEMAPS, 'url, body')} WHERE contains(body, '<urlset'))
SELECT url, url LIKE '%.xml' AS nested FROM l WHERE starts_with(url, 'https://h.test/')
UNION ALL SELECT DISTINCT split_part(url, '#', 1), false FROM pages WHERE starts_with(url, 'https://spam-farm.example.org/')
"""


def kit_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of the samples, and of a dictionary for each captured site that has its pages' paths."""
    paths = read(spark, sf_dir).groupBy(urls.host(F.col("url")).alias("host"), F.expr("page_id div 500").alias("part")).agg(F.array_sort(F.collect_list(F.concat(F.lit('"'), urls.path(F.col("url")), F.lit('":['), "page_id", F.lit("]")))).alias("routes"))  # 500 at most
    own = paths.select(F.concat(F.lit("https://"), "host", F.lit("/_app/"), "part", F.lit(".js")).alias("url"), F.concat(F.lit("const dictionary = {"), F.array_join("routes", ","), F.lit("}; export {dictionary}")).alias("body"))
    return payloads.kit_routes(assets(spark, sf_dir).select("url", "body").unionByName(own)).select("route", "node")


KIT_ROUTES = """SELECT route, node FROM (VALUES ('/blog/[slug]', 2), ('/about', 3)) v(route, node) UNION ALL
SELECT coalesce(nullif(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), ''), '/'), page_id::INT FROM pages"""


def link_specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as specifiers, resolved among the pages' paths of their hosts."""
    pages = read(spark, sf_dir)
    place = lambda u: F.regexp_replace(F.concat(urls.host(u), urls.path(u)), "/$", "")
    specs = html.page_links(pages).join(pages.select("page_id", place(F.col("url")).alias("importer")), "page_id").select("importer", F.concat(F.lit("/"), place(F.col("link"))).alias("specifier")).distinct()
    found = exports.resolve_specifiers(specs, pages.select(place(F.col("url")).alias("path")), ("", ".html"))
    return found.groupBy("importer").agg(F.count("*").alias("links"), F.count("target").alias("captured"))


LINK_SPECIFIERS = f"""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) || regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/$', '') AS path, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS host, html FROM pages),
l AS (SELECT DISTINCT path AS importer, host || unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS target FROM p)
SELECT importer, count(*) AS links, count(*) FILTER (target IN (SELECT path FROM p) OR target || '.html' IN (SELECT path FROM p)) AS captured FROM l GROUP BY importer
"""

QUERIES = {
    "script_strings": (script_strings, SCRIPT_STRINGS), "script_bindings": (script_bindings, SCRIPT_BINDINGS), "readable_scripts": (readable_scripts, READABLE_SCRIPTS), "script_features": (script_features, SCRIPT_FEATURES),
    "page_styles": (page_styles, PAGE_STYLES), "readable_pages": (readable_pages, READABLE_PAGES), "url_attributes": (url_attributes, URL_ATTRIBUTES), "page_quality": (page_quality, PAGE_QUALITY), "page_files": (page_files, PAGE_FILES),
    "chunk_shapes": (chunk_shapes, CHUNK_SHAPES), "unpacked_modules": (unpacked_modules, None), "chunk_diagnostics": (chunk_diagnostics, CHUNK_DIAGNOSTICS), "missing_modules_of_bundles": (missing_modules_of_bundles, MISSING_MODULES_OF_BUNDLES),
    "lazy_chunks": (lazy_chunks, LAZY_CHUNKS), "chunk_locations": (chunk_locations, None), "routes_in_code": (routes_in_code, ROUTES_IN_CODE), "style_targets": (style_targets, STYLE_TARGETS), "tailwind_sheets": (tailwind_sheets, TAILWIND_SHEETS),
    "map_sources": (map_sources, MAP_SOURCES), "sitemap_listing": (sitemap_listing, SITEMAP_LISTING), "kit_routes": (kit_routes, KIT_ROUTES), "link_specifiers": (link_specifiers, LINK_SPECIFIERS),
}
