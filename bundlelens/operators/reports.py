"""Reports over what was captured: coverage, runs of related rows, language versions, dictionaries of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.functions import text, urls


def coverage(**lists: DataFrame) -> DataFrame:
    """One row: the number of rows of each list of gaps (failed, unresolved, missing..) and whether there are any."""
    found = None
    for name, df in lists.items():
        one = df.agg(F.count("*").alias(name))
        found = one if found is None else found.join(F.broadcast(one))  # single rows
    if found is None:
        raise ValueError("coverage of nothing")
    any_ = F.lit(False)
    for name in lists:
        any_ = any_ | (F.col(name) > 0)
    return found.withColumn("status", F.when(any_, "incomplete").otherwise("complete"))


def library_loaders(loaders: DataFrame, library: DataFrame, least: int = 2) -> DataFrame:
    """Adds from_library to loader findings (finding, strings): whether a library's code is around them, by at least so
    many of its strings (value)."""
    rows = loaders.select("finding", F.explode(F.array_distinct("strings")).alias("value")).join(library.select("value").distinct(), "value", "left_semi")
    hits = rows.groupBy("finding").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("finding", F.lit(True).alias("_l"))
    return loaders.join(hits, "finding", "left").withColumn("from_library", F.coalesce("_l", F.lit(False))).drop("_l")


def relocate(paths: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """Paths in a column replaced where files moved (from, to)."""
    to = moves.select(F.col("from").alias("_from"), F.col("to").alias("_to"))
    return paths.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def runs(rows: DataFrame, by: list[str], position: str, gap: Column) -> DataFrame:
    """Adds run: numbers of runs of a group's rows in order of position, a new one wherever `gap` holds (it may use
    `_before`, the position before)."""
    w = Window.partitionBy(*by).orderBy(position)
    marked = rows.withColumn("_before", F.lag(position).over(w)).withColumn("_new", F.when(F.col("_before").isNull() | gap, 1).otherwise(0))
    return marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_before", "_new")


def clusters(statements: DataFrame, least: int = 8, span: int = 6000) -> DataFrame:
    """(bundle, run, family, begin, end, votes): stretches of a bundle (bundle, at, family or null) where at least so many
    statements with a family stand no farther apart than the span, and the family most of them have."""
    known = statements.where("family IS NOT NULL")
    dense = runs(known, ["bundle"], "at", F.col("at") - F.col("_before") > span)
    counts = dense.groupBy("bundle", "run", "family").agg(F.count("*").alias("votes"), F.min("at").alias("begin"), F.max("at").alias("end"))
    totals = counts.groupBy("bundle", "run").agg(F.sum("votes").alias("n"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.max_by(F.struct("family", "votes"), F.struct("votes", F.col("family"))).alias("b")).where(F.col("n") >= least)
    return totals.select("bundle", "run", "b.family", "begin", "end", "b.votes")


def banner_regions(statements: DataFrame) -> DataFrame:
    """Adds region to statements (bundle, at, banner or null): the last banner at or before each."""
    w = Window.partitionBy("bundle").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return statements.withColumn("region", F.last("banner", ignorenulls=True).over(w))


LANGUAGE = r"^/([a-z]{2}(?:-[A-Za-z]{2})?)(?:/|$)"


def localised(pages: DataFrame) -> DataFrame:
    """(host, route, languages, pages): pages (url) by their route without the language that it begins with."""
    p = urls.path(F.col("url"))
    lang = F.regexp_extract(p, LANGUAGE, 1)
    route = F.when(lang != "", F.concat(F.lit("/"), F.regexp_replace(p, r"^/[^/]*/?", ""))).otherwise(p)
    rows = pages.select(urls.host(F.col("url")).alias("host"), F.regexp_replace(route, r"(.)/+$", "$1").alias("route"), F.nullif(lang, F.lit("")).alias("lang"))
    return rows.groupBy("host", "route").agg(F.array_sort(F.collect_set("lang")).alias("languages"), F.count("*").alias("pages"))


def with_prefix(url: Column, lang: str) -> Column:
    """The URL of the same page in another language."""
    p = urls.path(url)
    bare = F.regexp_replace(p, LANGUAGE, "/")
    return F.concat(urls.origin(url), F.lit(f"/{lang}"), bare, urls.query(url))


def dictionary(texts: DataFrame, words: int = 4) -> DataFrame:
    """(namespace, key, signature): keys for texts (namespace, signature): camel case of their first words, numbered where
    texts of a namespace begin alike."""
    base = text.camel(F.array_join(F.slice(F.split(F.trim(F.regexp_replace("signature", r"[^A-Za-z0-9 ]+", " ")), r"\s+"), 1, words), " "))
    rows = texts.select("namespace", "signature").distinct().withColumn("base", F.when(base == "", "text").otherwise(base))
    n = F.row_number().over(Window.partitionBy("namespace", "base").orderBy("signature"))
    return rows.withColumn("n", n).select("namespace", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.col("n").cast("string"))).alias("key"), "signature")


def layout_groups(pages: DataFrame) -> DataFrame:
    """(signature, pages, prefix, suffix): pages (page_id, wrappers, items: arrays) with equal wrappers and equal first
    and last items, and how many items all of a group share at either end; an item counts at one end only, and a page
    alone shares none. Repeated page_ids count as pages, null items as empty ones.

    What all lists of a group begin with is what the smallest and the largest of them do, and so it is for the lists
    turned round: sums of four lists that each task makes for itself, whatever the size of the group.
    """
    items = F.coalesce("items", F.array().cast(pages.schema["items"].dataType))
    signature = F.xxhash64(F.to_json(F.struct("wrappers", F.get("items", F.lit(0)).alias("a"), F.try_element_at("items", F.lit(-1)).alias("b"))))
    rows = pages.withColumn("items", items).select(signature.alias("signature"), "items", F.reverse("items").alias("turned"))
    groups = rows.groupBy("signature").agg(
        F.count("*").alias("pages"), F.min(F.size("items")).alias("least"), F.min("items").alias("low"), F.max("items").alias("high"),
        F.min("turned").alias("turned_low"), F.max("turned").alias("turned_high"),
    )

    def shared(low: str, high: str) -> Column:
        differ = F.array_position(F.zip_with(low, high, lambda x, y: x.eqNullSafe(y)), False)
        return F.when(differ == 0, F.col("least")).otherwise(F.least((differ - 1).cast("int"), "least"))

    alone = F.col("pages") < 2
    found = groups.withColumn("prefix", F.when(alone, 0).otherwise(shared("low", "high")))
    return found.select("signature", "pages", "prefix", F.when(alone, 0).otherwise(F.least(shared("turned_low", "turned_high"), F.col("least") - F.col("prefix"))).alias("suffix"))


def summary(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    return coverage(**tables).drop("status")


def issues(failed: DataFrame) -> DataFrame:
    """(stage, url, severity, message) from failed requests (url, type, error, optional): optional ones are warnings."""
    return failed.where("error IS NOT NULL").select(F.lit("load").alias("stage"), "url", F.when(F.col("optional"), "warning").otherwise("error").alias("severity"), F.col("error").alias("message"))
