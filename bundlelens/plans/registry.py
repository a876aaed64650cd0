"""Named queries of the engine and the SQL that must agree with each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.plans import bundles, documents, inlining, libraries, markup, pages, summaries, tables

MODULES = (pages, documents, tables, bundles, summaries, libraries, markup, inlining)
Query = Callable[[SparkSession, str], DataFrame]


def host_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors per page host, and how many of them are root-relative (hence in scope)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html")
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1))
    links = pages.select(host.alias("host"), F.explode(F.expr("regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)")).alias("href"))
    return links.groupBy("host").agg(F.count("*").alias("n_links"), F.count_if(F.col("href").startswith("/")).alias("n_in_scope"))


HOST_LINK_COUNTS = """
SELECT host, count(*) AS n_links, count(*) FILTER (starts_with(href, '/')) AS n_in_scope
FROM (SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host,
             unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
GROUP BY host
"""


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {"host_link_counts": (host_link_counts, HOST_LINK_COUNTS)}
    for module in MODULES:
        if twice := found.keys() & module.QUERIES.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        found |= module.QUERIES
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
