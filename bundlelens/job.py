"""Command line: captured pages and scripts, or URLs to capture, in; tables out.

With --scope-url only pages that links lead to from there count: within its scope (or anywhere, with --include-external),
--depth hops away at most, the first --max-pages in the order of their discovery. Pages and scripts that are left out
because of their size or because they are empty are listed in the table of issues.

    python -m bundlelens.job PAGES [--assets ASSETS] --out FOLDER [--adapter NAME] [--max-pages N] [--depth N] ..

Exit code 0: done, 1: the run failed, 2: the arguments are wrong.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens import adapters
from bundlelens.functions import urls
from bundlelens.operators import chunks, detect, graphs, html
from bundlelens.operators.graphs import cut
from bundlelens.sources import fetch


@dataclass(frozen=True)
class Options:
    """What to read, where to write, and the limits of a run."""

    pages: str
    out: str
    assets: str | None = None
    adapter: str | None = None
    scope_url: str | None = None
    include_external: bool = False
    concurrency: int = 6
    retries: int = 2
    timeout_ms: int = 30_000
    max_bytes: int = 50 << 20
    max_pages: int = 20
    depth: int = 2


def scope_url(text: str) -> str:
    """A URL with its scheme, https where it has none; ValueError for other schemes than http(s)."""
    full = text if "://" in text else f"https://{text}"
    parts = urlparse(full)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError(f"no http(s) URL: {text}")
    return full


def parse_options(argv: list[str]) -> Options:
    parser = argparse.ArgumentParser(prog="bundlelens", description=__doc__.split("\n")[0])
    parser.add_argument("pages", help="parquet of (page_id, url, html), or http(s) URLs to capture, with commas between")
    parser.add_argument("--out", required=True)
    parser.add_argument("--assets", help="parquet of (url, body)")
    parser.add_argument("--adapter", choices=adapters.standard().names())
    parser.add_argument("--scope-url", type=scope_url)
    parser.add_argument("--include-external", action="store_true")
    for name, default in (("concurrency", 6), ("retries", 2), ("timeout-ms", 30_000), ("max-bytes", 50 << 20), ("max-pages", 20), ("depth", 2)):
        parser.add_argument(f"--{name}", type=int, default=default)
    found = parser.parse_args(argv)
    if found.concurrency < 1 or min(found.retries, found.timeout_ms, found.max_bytes, found.max_pages, found.depth) < 0:
        parser.error("limits can't be negative")
    return Options(**vars(found))


def captured(spark: SparkSession, options: Options) -> DataFrame:
    """(page_id, url, html, error) of the pages asked for: read, or fetched with the options' limits."""
    if not options.pages.startswith(("http://", "https://")):
        return spark.read.parquet(options.pages).withColumn("error", F.lit(None).cast("string"))
    spark.dataSource.register(fetch.Capture)
    limits = {"concurrency": options.concurrency, "retries": options.retries, "timeout_ms": options.timeout_ms, "max_bytes": options.max_bytes}
    log = spark.read.format("capture").options(urls=options.pages.replace(",", " "), **{k: str(v) for k, v in limits.items()}).load()
    # fetched once: every table of the run reads what was written
    return cut(log.where("redirect_to IS NULL").select(F.xxhash64("url").alias("page_id"), "url", F.col("body").alias("html"), "error"))


def visited(pages: DataFrame, options: Options) -> DataFrame:
    """The pages that a crawl from the options' scope URL reaches."""
    if options.scope_url is None:
        return pages
    key = lambda c: urls.page_key(F.col(c))
    start = F.lit(options.scope_url)
    links = html.page_links(pages).select(F.col("page_id"), "link").join(pages.select("page_id", key("url").alias("src")), "page_id").select("src", key("link").alias("dst")).distinct()
    own = pages if options.include_external else pages.where(urls.in_scope(F.col("url"), start, urls.crawl_scope(start)))
    seeds = pages.select(urls.page_key(start).alias("node")).distinct()
    depths = graphs.reach(links, seeds, options.depth)
    found = own.join(depths.withColumnRenamed("depth", "_depth"), key("url") == F.col("node"))
    first = found.select("page_id", "_depth").orderBy("_depth", "page_id").limit(options.max_pages).select("page_id")
    return pages.join(first, "page_id", "left_semi")


def run(spark: SparkSession, options: Options) -> dict[str, DataFrame]:
    """The tables of a run, not yet computed."""
    fit = lambda df, c: F.coalesce(F.octet_length(c) <= options.max_bytes, F.lit(False))
    told = lambda df, c, error: df.where(~fit(df, c)).select("url", F.when(F.col(c).isNull(), F.coalesce(error, F.lit("empty"))).otherwise("too large").alias("issue"))
    every = captured(spark, options)
    pages = visited(every.where(fit(every, "html")).drop("error"), options)
    found = {"links": html.page_links(pages), "resources": html.resources(pages), "adapters": detect.rank_adapters(pages), "inline_scripts": html.inline_scripts(pages)}
    issues = told(every, "html", F.col("error"))
    if options.assets:
        assets = spark.read.parquet(options.assets)
        issues = issues.unionByName(told(assets, "body", F.lit(None).cast("string")))
        unpacked = chunks.unpacked(assets.where(fit(assets, "body")).withColumn("adapter", F.lit(options.adapter).cast("string")))
        found |= {"modules": chunks.modules(unpacked), "diagnostics": chunks.diagnostics(unpacked), "missing": chunks.missing_modules(chunks.modules(unpacked))}
    return found | {"issues": issues}


def main(argv: list[str]) -> int:
    try:
        options = parse_options(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = SparkSession.builder.appName("bundlelens").getOrCreate()
    try:
        for name, df in run(spark, options).items():
            df.write.mode("errorifexists").parquet(f"{options.out}/{name}")
            print(f"{name}: {spark.read.parquet(f'{options.out}/{name}').count()} rows")
    except Exception as e:  # what went wrong is told, and the exit code says that something did
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
