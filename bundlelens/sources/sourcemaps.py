"""Source maps of captured scripts and sheets: where they are, and what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.functions import urls


def candidates(assets: DataFrame) -> DataFrame:
    """(asset_id, ord, map_url, explicit): places where the map of an asset (asset_id, url, body, sourcemap: the header)
    may be, the best first."""
    tail = F.regexp_extract(F.rtrim(F.right("body", F.lit(4096))), r"([^\n]*)$", 1)
    script = F.regexp_extract(tail, r"""//[#@]\s*sourceMappingURL=([^\s'"]+)\s*$""", 1)
    sheet = F.regexp_extract(tail, r"/\*[#@]\s*sourceMappingURL=([^\s*]+)\s*\*/\s*$", 1)
    all_ = F.regexp_extract_all(F.right("body", F.lit(4096)), F.lit(r"""[#@]\s*sourceMappingURL=([^\s'"*]+)"""), 1)
    loose = F.when(~F.col("body").contains("sourceMappingURL=data:"), F.try_element_at(all_, F.lit(-1)))
    comment = F.when(script != "", script).when(sheet != "", sheet).otherwise(loose)
    fallback = F.concat(F.regexp_extract(urls.path(F.col("url")), r"([^/]*)$", 1), F.lit(".map"))
    one = lambda c, explicit: F.struct(c.alias("c"), F.lit(explicit).alias("explicit"))
    rows = assets.select("asset_id", "url", F.posexplode(F.array(one(F.col("sourcemap"), True), one(comment, True), one(fallback, False))).alias("ord", "x")).where("x.c IS NOT NULL")
    resolved = F.when(F.col("x.c").startswith("data:"), F.col("x.c")).otherwise(urls.resolve(F.col("x.c"), F.col("url")))
    found = rows.select("asset_id", "ord", resolved.alias("map_url"), "x.explicit").where("map_url IS NOT NULL")
    first = found.groupBy("asset_id", "map_url").agg(F.min("ord").alias("ord"), F.max("explicit").alias("explicit"))
    return first.select("asset_id", F.row_number().over(Window.partitionBy("asset_id").orderBy("ord")).alias("ord"), "map_url", "explicit")


def data_url(url: Column) -> Column:
    """The text of a data: URL; null if it is malformed."""
    data = F.regexp_extract(url, r"^data:[^,]*,(.*)$", 1)
    base64 = F.regexp_extract(url, r"^data:([^,]*),", 1).endswith(";base64")
    return F.when(url.rlike("^data:[^,]*,"), F.when(base64, F.try_validate_utf8(F.try_to_binary(data, F.lit("base64")).cast("string"))).otherwise(F.try_url_decode(F.replace(data, F.lit("+"), F.lit("%2B")))))


def looks_like_map(text: Column) -> Column:
    bare = F.regexp_replace(F.ltrim(text), r"^\)\]\}'?\n", "")
    return bare.startswith("{") & bare.rlike(r'"(mappings|sections)"\s*:')


def sources(maps: DataFrame) -> DataFrame:
    """(map_url, path, original, content): the sources of maps (map_url, body), flat or sectioned; content is null for
    those that a map only names. The first source of a path counts."""
    one = "sources array<string>, sourcesContent array<string>"
    bare = F.regexp_replace(F.ltrim("body"), r"^\)\]\}'?\n", "")
    parsed = maps.where(looks_like_map(F.col("body"))).select("map_url", F.from_json(bare, f"{one}, sections array<struct<map:struct<{one.replace(' ', ':', 1).replace(', sourcesContent ', ', sourcesContent:')}>>>").alias("m"))
    flat = parsed.select("map_url", F.posexplode(F.concat(F.array(F.struct("m.sources", "m.sourcesContent")), F.transform(F.coalesce("m.sections", F.array().cast("array<struct<map:struct<sources:array<string>,sourcesContent:array<string>>>>")), lambda s: F.struct(s["map"]["sources"].alias("sources"), s["map"]["sourcesContent"].alias("sourcesContent"))))).alias("section", "s"))
    rows = flat.select("map_url", "section", F.posexplode("s.sources").alias("i", "original"), "s.sourcesContent").withColumn("content", F.get("sourcesContent", F.col("i")))
    named = rows.withColumn("original", F.coalesce("original", F.concat(F.lit("source-"), F.col("i").cast("string")))).withColumn("path", urls.source_path(F.col("original")))
    first = named.groupBy("map_url", "path").agg(F.min_by(F.struct("original", "content"), F.struct(F.col("content").isNull(), "section", "i")).alias("s"))
    return first.select("map_url", "path", "s.*")
