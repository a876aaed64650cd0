"""Queries of reports: coverage, language versions, runs, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.functions import urls
from bundlelens.operators import graphs, html, reports
from bundlelens.plans.pages import AUTHORITY, LINKS, MISSING_LINKS, PATH, read
from bundlelens.streaming import requests


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir)
    edges = html.page_links(pages).select(F.col("page_id").alias("src"), urls.page_key(F.col("link")).alias("dst"))
    missing = graphs.missing(edges, pages.select(urls.page_key(F.col("url")).alias("node")))
    return reports.coverage(pages=pages.where("html IS NULL"), links=missing, redirects=html.meta_refresh(pages))


COVERAGE = f"SELECT (SELECT count(*) FROM pages WHERE html IS NULL) AS pages, (SELECT count(*) FROM ({MISSING_LINKS})) AS links, 0::BIGINT AS redirects, CASE WHEN (SELECT count(*) FROM ({MISSING_LINKS})) > 0 THEN 'incomplete' ELSE 'complete' END AS status"


def language_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.localised(read(spark, sf_dir))
    return found.groupBy("host").agg(F.sum("pages").alias("pages"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("languages")))), ",").alias("languages"))


LANGUAGE_VERSIONS = f"""
WITH p AS (SELECT {AUTHORITY} AS host, regexp_extract({PATH}, '^/([a-z]{{2}}(?:-[A-Za-z]{{2}})?)(?:/|$)', 1) AS lang FROM pages)
SELECT host, count(*)::BIGINT AS pages, coalesce(string_agg(DISTINCT nullif(lang, ''), ',' ORDER BY nullif(lang, '')), '') AS languages FROM p GROUP BY host
"""


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with no gap longer than half an hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    numbered = reports.runs(events, ["user_id"], "at", F.col("at") - F.col("_before") > 30 * 60 * 1_000_000)
    return numbered.groupBy("user_id", "run").agg(F.count("*").alias("events"), F.min("at").alias("begin"), F.max("at").alias("end"))


USER_SESSIONS = """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR t - before > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING)::BIGINT AS run FROM e)
SELECT user_id, run, count(*) AS events, min(t) AS "begin", max(t) AS "end" FROM r GROUP BY user_id, run
"""


def hourly_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the windows over a stream."""
    found = requests.by_window(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour")
    return found.select(F.unix_micros("begin").alias("begin"), "event_type", "requests")


HOURLY_REQUESTS = """SELECT epoch_us(date_trunc('hour', ts)) AS "begin", event_type, count(*) AS requests FROM events GROUP BY ALL"""


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys for the links' texts of pages, by host."""
    rows = read(spark, sf_dir).select(urls.host(F.col("url")).alias("namespace"), F.explode(F.regexp_extract_all("html", F.lit(r"<a href=\"[^\"]*\">([^<]*)</a>"), 1)).alias("signature"))
    return reports.dictionary(rows)


TEXT_KEYS = rf"""
WITH t AS (SELECT DISTINCT {AUTHORITY} AS namespace, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS signature FROM pages),
w AS (SELECT namespace, signature, array_to_string(string_split_regex(trim(regexp_replace(signature, '[^A-Za-z0-9 ]+', ' ', 'g')), '\s+')[:4], ' ') AS s FROM t),
p AS (SELECT namespace, signature, list_filter(string_split_regex(regexp_replace(s, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> '') AS ws FROM w),
c AS (SELECT namespace, signature, coalesce(array_to_string(list_transform(ws, lambda x, i: CASE WHEN i = 1 THEN lower(x) ELSE upper(left(x, 1)) || lower(substr(x, 2)) END), ''), '') AS k FROM p),
b AS (SELECT namespace, signature, CASE WHEN k = '' THEN 'text' WHEN regexp_matches(k, '^[0-9]') THEN '_' || k ELSE k END AS base FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY namespace, base ORDER BY signature) AS n FROM b)
SELECT namespace, CASE WHEN n = 1 THEN base ELSE base || n END AS key, signature FROM n
"""


def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages share a set of links: pages by the targets they have."""
    found = html.page_links(read(spark, sf_dir)).groupBy("page_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("link")), "\n"), 256).alias("links"), F.count("*").alias("n"))
    return found.groupBy("links").agg(F.count("*").alias("pages"), F.max("n").alias("n"))


LINK_COUNTS = f"WITH {LINKS}, p AS (SELECT page_id, sha256(string_agg(DISTINCT link, chr(10) ORDER BY link)) AS links, count(*) AS n FROM links GROUP BY page_id) SELECT links, count(*) AS pages, max(n) AS n FROM p GROUP BY links"

QUERIES = {
    "coverage": (coverage, COVERAGE), "language_versions": (language_versions, LANGUAGE_VERSIONS), "user_sessions": (user_sessions, USER_SESSIONS), "hourly_requests": (hourly_requests, HOURLY_REQUESTS),
    "text_keys": (text_keys, TEXT_KEYS), "link_counts": (link_counts, LINK_COUNTS),
}
