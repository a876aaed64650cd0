"""Pages: the document as rows, and what it links, loads and contains."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.functions import urls
from bundlelens.operators import scripts
from bundlelens.operators.generate import generate

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NODE = "node int, parent int, tag string, attrs map<string,string>, text string"


class _Nodes(HTMLParser):
    """Rows of a document: (node, parent, tag, attributes, own text). Comments are dropped; scripts keep raw text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")  # of repeated attributes the first counts
        self.rows.append([len(self.rows), self.open[-1] if self.open else None, tag, found, []])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]][2] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.rows[self.open[-1]][4].append(data)


def parse(html: str | None) -> list[tuple]:
    nodes = _Nodes()
    nodes.feed(html or "")
    nodes.close()
    return [(node, parent, tag, list(attrs.items()), "".join(text)) for node, parent, tag, attrs, text in nodes.rows]


def dom(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """One row per element: the kept columns, its number in document order, its parent's, tag, attributes, own text."""
    return generate(pages, keep, [html], parse, NODE)


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def with_base(pages: DataFrame) -> DataFrame:
    """`base_url`: what the page's relative references stand against: its first <base href>, else its own URL."""
    base = F.regexp_extract("html", r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    return pages.withColumn("base_url", F.when(base != "", F.coalesce(urls.resolve(base, F.col("url")), F.col("url"))).otherwise(F.col("url")))


def meta_refresh(pages: DataFrame) -> DataFrame:
    """(page_id, target): where pages send their visitors at once."""
    tag = F.regexp_extract("html", r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*>""", 0)
    target = F.regexp_extract(tag, r"""(?i)content\s*=\s*["']?\s*\d+\s*;\s*url\s*=\s*['"]?([^'">]+)""", 1)
    return pages.where(target != "").select("page_id", urls.resolve(target, F.col("url")).alias("target"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, link): anchors in document order, then alternate languages."""
    nodes = dom(with_base(pages.where(F.lower("html").contains("href"))), ["page_id", "base_url"])
    anchor = (F.col("tag") == "a") & attr("href").isNotNull()
    alternate = (F.col("tag") == "link") & (attr("rel") == "alternate") & attr("hreflang").isNotNull() & attr("href").isNotNull()
    found = nodes.where(anchor | alternate).select("page_id", F.struct((F.col("tag") == "link").cast("int").alias("kind"), "node").alias("at"), urls.resolve(attr("href"), F.col("base_url")).alias("link")).where("link IS NOT NULL")
    return found.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("at")).alias("ord"), "link")


def inline_scripts(pages: DataFrame) -> DataFrame:
    """(page_id, node, code, module) of scripts without src that hold JavaScript."""
    nodes = dom(pages.where(F.lower("html").contains("<script")), ["page_id"])
    own = nodes.where((F.col("tag") == "script") & attr("src").isNull() & urls.is_javascript(attr("type")) & (F.trim("text") != ""))
    return own.select("page_id", "node", F.col("text").alias("code"), (F.trim(F.coalesce(attr("type"), F.lit(""))) == "module").alias("module"))


def import_maps(pages: DataFrame) -> DataFrame:
    """(page_id, specifier, target) of the pages' import maps; what is no URL is left out."""
    nodes = dom(with_base(pages.where(F.lower("html").contains("importmap"))), ["page_id", "base_url"])
    maps = nodes.where((F.col("tag") == "script") & (F.lower(F.trim(F.coalesce(attr("type"), F.lit("")))) == "importmap"))
    entries = maps.select("page_id", "base_url", F.explode(F.from_json("text", "imports map<string,string>").imports).alias("specifier", "value"))
    return entries.select("page_id", "specifier", urls.resolve(F.col("value"), F.col("base_url")).alias("target")).where("target IS NOT NULL")


RESOURCE = "type string, initiator string, optional boolean"


def _resource(kind: str, initiator: str, optional: bool = False) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(initiator).alias("initiator"), F.lit(optional).alias("optional"))


def resources(pages: DataFrame) -> DataFrame:
    """(page_id, url, type, initiator, optional, ord): all that a browser's parser and preload scanner would fetch, each
    URL of a page once, by its first reason. `pages` has page_id, url, html and, if there is one, link (the header)."""
    based = with_base(pages)
    nodes = dom(based, ["page_id", "base_url"])
    rel = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(attr("rel"), F.lit(""))), r"\s+", " "), F.lit(" "))
    has = lambda word: rel.contains(f" {word} ")
    as_ = F.lower(F.coalesce(attr("as"), F.lit("")))
    of_script = F.when(F.lower(F.trim(F.coalesce(attr("type"), F.lit("")))) == "module", _resource("module", "parser")).otherwise(_resource("script", "parser"))
    of_link = (
        F.when(has("stylesheet"), _resource("style", "parser"))
        .when(has("modulepreload"), _resource("module", "preload"))
        .when(has("manifest"), _resource("manifest", "parser", True))
        .when((has("preload") | has("prefetch")) & (as_ == "script"), F.when(has("prefetch"), F.when(has("preload"), _resource("script", "preload", True)).otherwise(_resource("script", "prefetch", True))).otherwise(_resource("script", "preload")))
        .when((has("preload") | has("prefetch")) & (as_ == "style"), _resource("style", "preload"))
        .when((has("preload") | has("prefetch")) & (as_ == "fetch") & attr("href").rlike(r"\.m?js(\?|$)"), _resource("fetch", "preload", True))
    )
    tagged = nodes.select(
        "page_id", F.struct(F.when(F.col("tag") == "script", 0).otherwise(1).alias("kind"), "node", F.lit(0).alias("i")).alias("at"), "base_url",
        F.when(F.col("tag") == "script", attr("src")).when(F.col("tag") == "link", attr("href")).alias("href"),
        F.when((F.col("tag") == "script") & urls.is_javascript(attr("type")), of_script).when(F.col("tag") == "link", of_link).alias("r"),
    ).where("href IS NOT NULL AND r IS NOT NULL")
    inline = scripts.imports(inline_scripts(based).join(based.select("page_id", "base_url"), "page_id"), ["page_id", "node", "base_url"], module="module")
    imported = inline.where(urls.is_relative(F.col("specifier"))).select("page_id", F.struct(F.lit(2).alias("kind"), "node", F.col("ord").alias("i")).alias("at"), "base_url", F.col("specifier").alias("href"), _resource("module", "inline-script").alias("r"))
    found = tagged.unionByName(imported)
    if "link" in pages.columns:
        found = found.unionByName(link_headers(based))
    resolved = found.select("page_id", "at", urls.resolve(F.col("href"), F.col("base_url")).alias("url"), "r.*").where("url IS NOT NULL")
    first = resolved.groupBy("page_id", "url").agg(F.min_by(F.struct("type", "initiator", "optional", "at"), "at").alias("r"))
    return first.select("page_id", "url", "r.type", "r.initiator", "r.optional", F.row_number().over(Window.partitionBy("page_id").orderBy("r.at")).alias("ord"))


def link_headers(pages: DataFrame) -> DataFrame:
    """Rows of `resources` from Link headers (column link)."""
    parts = pages.where("link IS NOT NULL").select("page_id", "base_url", F.posexplode(F.split("link", r",(?=\s*<)")).alias("i", "part"))
    href, params = F.regexp_extract("part", r"<([^>]+)>", 1), F.lower(F.regexp_extract("part", r"<[^>]+>(.*)", 1))
    rel, as_ = F.regexp_extract(params, r'rel="?([^";]+)"?', 1), F.regexp_extract(params, r'as="?([^";]+)"?', 1)
    r = (
        F.when(rel.contains("modulepreload"), _resource("module", "link-header"))
        .when(rel.contains("preload") & (as_ == "script"), _resource("script", "link-header"))
        .when(rel.contains("preload") & (as_ == "style"), _resource("style", "link-header"))
        .when(rel.contains("stylesheet"), _resource("style", "link-header"))
    )
    return parts.select("page_id", F.struct(F.lit(3).alias("kind"), F.lit(0).alias("node"), "i").alias("at"), "base_url", href.alias("href"), r.alias("r")).where("r IS NOT NULL AND href <> ''")


def islands(pages: DataFrame) -> DataFrame:
    """(page_id, node, component, component_url, renderer_url, framework, client, props): hydrated components."""
    nodes = dom(with_base(pages.where(F.col("html").contains("<astro-island"))), ["page_id", "base_url"]).where("tag = 'astro-island'")
    renderer = attr("renderer-url")
    framework = F.when(F.lower(renderer).contains("svelte"), "svelte").when(F.lower(renderer).contains("solid"), "solid").when(F.lower(renderer).contains("preact"), "preact")
    return nodes.select(
        "page_id", "node", F.from_json(attr("opts"), "name string").getField("name").alias("component"), urls.resolve(attr("component-url"), F.col("base_url")).alias("component_url"),
        urls.resolve(renderer, F.col("base_url")).alias("renderer_url"), framework.alias("framework"), attr("client").alias("client"), attr("props").alias("props"),
    )
