"""Line deduplication by site-relative frequency, in DataFrame expressions only.

For each host, a line's ratio is the share of the host's pages that contain it. Lines whose ratio exceeds RATIO, on
MIN_PAGES pages or more, are boilerplate and are dropped from every page of the host. A host with L lines to a page has
fewer than L / RATIO such lines, however large it is; no host's pages are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.shared import BROADCAST_BYTES, free_names, stash

#: On sites of some hundred pages, footers and notices are on more than a twentieth of them, sentences that merely recur on less.
RATIO, MIN_PAGES = 0.05, 5
#: Where boilerplate is too much to broadcast, the pages of a host are dealt to so many tasks at least.
SALTS = 16
BLANKS = " \t\r\x0b\f"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(df: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, lines array<bigint>): the hashes (XXH64) of each host's boilerplate lines. Lines of white space only don't
    count; a line counts once for a page. Pages with null or empty text count as pages."""
    pages = df.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).cast("string").alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "of")
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x, F.lit(BLANKS)) != ""), lambda x: F.xxhash64(x)))
    counts = pages.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    counts = stash(counts, "lines-counts")
    frequent = counts.join(totals, counts.host == totals.of).where(F.col("n") > ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def _left(df: DataFrame, ratio: float, min_pages: int, text_col: str, host_col: str) -> tuple[DataFrame, str]:
    """`df` with one more column, and that column's name: the lines of each text that stay (null for null texts)."""
    host, gone, left, salt, own = free_names(df, "_host", "_lines", "_left", "_salt", "_own")
    found = stash(boilerplate(df, ratio, min_pages, text_col, host_col), "lines-boilerplate")
    size = found.agg(F.coalesce(F.sum(F.size("lines") * 8 + 100), F.lit(0))).first()[0]
    found = found.select(F.col("host").alias(host), F.col("lines").alias(gone))
    on = F.coalesce(F.col(host_col).cast("string"), F.lit("")) == F.col(host)
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    else:
        found = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on &= F.col(own) == F.col(salt)
    hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if "map" not in kind and "variant" not in kind]
    joined = df.withColumn(own, F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")).join(found, on, "left")
    stay = F.filter(_lines(F.col(text_col)), lambda x: F.col(gone).isNull() | ~F.array_contains(F.col(gone), F.xxhash64(x)))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array(stay)).alias(left)), left


def drop_boilerplate(df: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """`df` with its boilerplate lines taken out of the text column, all rows and columns kept.

    Null text stays null, a text all of whose lines go becomes empty, and null hosts are the host "". Rows that repeat
    are pages each. An empty table stays empty.
    """
    found, left = _left(df, ratio, min_pages, text_col, host_col)
    return found.withColumn(text_col, F.array_join(left, "\n")).drop(left)


def clean(df: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`drop_boilerplate` for tables of (text, source, n_chars): n_chars follows the text, and a text that boilerplate
    alone makes up stays whole, since a page without any text of its own is no longer a document."""
    found, left = _left(df, ratio, min_pages, "text", "source")
    own = F.exists(left, lambda x: F.trim(x, F.lit(BLANKS)) != "")
    text = F.when(own, F.array_join(left, "\n")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in df.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    found, left = _left(docs, RATIO, MIN_PAGES, "text", "source")
    n = F.size(_lines(F.coalesce("text", F.lit("")))) - F.size(F.coalesce(left, F.array(F.lit(""))))
    return found.select("doc_id", F.array_join(left, "\n").alias("text"), n.cast("long").alias("n_dropped"))


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
t AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
c AS (SELECT host, line, count(DISTINCT k) AS n FROM (SELECT k, host, unnest(lines) AS line FROM d) WHERE regexp_matches(line, '[^ \\t\\r\\x0B\\f]') GROUP BY host, line),
b AS (SELECT host, list(line) AS gone FROM c JOIN t USING (host) WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages GROUP BY host),
x AS (SELECT doc_id, text, lines, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda l: NOT list_contains(gone, l)) END AS stay FROM d LEFT JOIN b USING (host))
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(stay, chr(10)), '') END AS text, (len(lines) - len(stay))::BIGINT AS n_dropped
FROM x
"""
