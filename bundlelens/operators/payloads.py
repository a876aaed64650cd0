"""Data that frameworks put into pages and scripts: decoded to JSON, and read as references, routes and hints."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.functions import text, urls
from bundlelens.operators import html
from bundlelens.operators.generate import generate

DEPTH = 200


def compact(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)


# Indexed payloads: an array whose first element is the root; inside objects, arrays and tagged arrays, numbers name other
# elements.

# Negative numbers stand for values that JSON doesn't have; all read as null but for the zero.
SPECIAL = {-1: None, -2: None, -3: None, -4: None, -5: None, -6: 0}
# Tags of arrays, by what follows them: a text as it is, a pattern and its flags, elements, pairs of two
# elements, pairs of a name and an element. Any other tag wraps one element.
TAGGED = {"Date": "text", "BigInt": "text", "URL": "text", "RegExp": "pattern", "Set": "elements", "Map": "pairs", "null": "named"}
#: Values that a payload may have when its shared elements are written out each time.
MOST_VALUES = 1 << 18


class _Elements:
    """The elements of an indexed payload, each resolved once; `sizes` has how many values each is written out."""

    def __init__(self, source: list):
        self.source, self.found, self.sizes, self.open = source, {}, {}, set()

    def element(self, at: Any, depth: int) -> tuple[Any, int]:
        """(value, its size). A number that names no element is null, and so is one whose element holds this place."""
        if type(at) is not int:
            return at, 1
        if at < 0 or at >= len(self.source) or at in self.open or depth > DEPTH:
            return SPECIAL.get(at), 1
        if at not in self.found:
            self.open.add(at)
            self.found[at], self.sizes[at] = self.resolved(self.source[at], depth + 1)
            self.open.discard(at)
            if self.sizes[at] > MOST_VALUES:
                raise ValueError("the payload is too large when its shared values are written out")
        return self.found[at], self.sizes[at]

    def resolved(self, own: Any, depth: int) -> tuple[Any, int]:
        if isinstance(own, dict):
            names, held = list(own), [self.element(x, depth) for x in own.values()]
            return dict(zip(names, (v for v, _ in held), strict=True)), 1 + sum(n for _, n in held)
        if not isinstance(own, list):
            return own, 1
        kind, rest = (TAGGED.get(own[0], "wrapped"), own[1:]) if own and isinstance(own[0], str) else ("elements", own)
        if kind == "text":
            return (rest[0] if rest else None), 1
        if kind == "pattern":
            return "/{}/{}".format(*[*rest, "", ""][:2]), 1
        if kind == "wrapped":
            return self.element(rest[0], depth) if rest else (None, 1)
        held = [self.element(x, depth) if kind != "named" or i % 2 else (x, 1) for i, x in enumerate(rest)]
        size = 1 + sum(n for _, n in held)
        values = [v for v, _ in held]
        return (values if kind == "elements" else {str(k): v for k, v in zip(values[::2], values[1::2], strict=False)}), size


def hydrate(values: Any) -> Any:
    """The value that an indexed payload stands for. Cycles end in null; dates, big integers and URLs are their texts.
    ValueError for a payload that shares so much that it has more than MOST_VALUES values when written out."""
    return _Elements(values).element(0, 0)[0] if isinstance(values, list) and values else values


def hydrate_json(payload: str | None) -> str | None:
    try:
        return compact(hydrate(json.loads(payload or "")))
    except (ValueError, RecursionError):
        return None


def nuxt_data(pages: DataFrame) -> DataFrame:
    """(page_id, data): the pages' payloads as JSON."""
    own = pages.select("page_id", F.regexp_extract("html", r"""(?s)<script[^>]+id=["']__NUXT_DATA__["'][^>]*>(.*?)</script>""", 1).alias("payload")).where("payload <> ''")
    return generate(own, ["page_id"], ["payload"], lambda p: [(hydrate_json(p),)], "data string").where("data IS NOT NULL")


# Tagged pairs: [kind, value], as islands write their properties. 0 plain, 1 object, 2 date or array, 3
# pattern, 4 map, 5 set, 6 big integer or URL.


def untag(value: Any, depth: int = 0) -> Any:
    if depth > 50:
        return value
    if isinstance(value, list) and len(value) == 2 and isinstance(value[0], int) and not isinstance(value[0], bool):
        kind, inner = value
        if kind == 1 and isinstance(inner, list) or kind in (2, 5, 6) and isinstance(inner, list):
            return [untag(x, depth + 1) for x in inner]
        if kind == 3:
            return str(inner)
        return untag(inner, depth + 1) if kind in (0, 1) else inner
    if isinstance(value, dict):
        return {k: untag(x, depth + 1) for k, x in value.items()}
    return value


def island_props(islands: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and data: the properties (props) of islands as JSON; null where they are malformed."""

    def one(props: str | None) -> list[tuple]:
        try:
            return [(compact(untag(json.loads(props or "{}"))),)]
        except ValueError:
            return [(None,)]

    return generate(islands, keep, ["props"], one, "data string")


# Server component payloads.

PUSH = r'self\.__next_f\.push\(\[\s*1\s*,\s*("(?:[^"\\]|\\.)*")\s*\]\)'


def flight_text(pages: DataFrame) -> DataFrame:
    """(page_id, flight): the text that a page's scripts push, in their order."""
    pushed = F.regexp_extract_all("html", F.lit(PUSH), 1)
    joined = F.array_join(F.transform(pushed, lambda s: F.coalesce(F.from_json(F.concat(F.lit('{"v":'), s, F.lit("}")), "v string")["v"], F.lit(""))), "")
    return pages.where(F.col("html").contains("__next_f")).select("page_id", joined.alias("flight")).where("flight <> ''")


def flight_rows(flight: str | None) -> list[tuple[str, str, str | None]]:
    """(id, tag, value): rows of a payload. Values are JSON; rows of text are as long as they say, in bytes."""
    data, at, found = (flight or "").encode(), 0, []
    while at < len(data):
        colon = data.find(b":", at)
        if colon < 0:
            break
        name, at = data[at:colon].decode("utf-8", "replace"), colon + 1
        m = re.compile(rb"[A-Z]*").match(data, at)
        tag, at = m[0].decode(), m.end()
        if tag == "T":
            comma = data.find(b",", at)
            try:
                length = int(data[at:comma], 16)
            except ValueError:
                break
            found.append((name, tag, compact(data[comma + 1 : comma + 1 + length].decode("utf-8", "replace"))))
            at = comma + 1 + length
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        try:
            value = compact(json.loads(data[at:end])) if end > at else None
        except ValueError:
            value = None
        found.append((name, tag, value))
        at = end + 1
    return found


def flight(pages: DataFrame) -> DataFrame:
    """(page_id, id, tag, value) of all rows that pages push."""
    return generate(flight_text(pages), ["page_id"], ["flight"], flight_rows, "id string, tag string, value string")


def client_references(rows: DataFrame) -> DataFrame:
    """(page_id, module_id, export_name, chunk_paths, chunk_ids) of the rows that name client modules."""
    own = rows.where("tag = 'I'").select("page_id", F.from_json("value", "array<string>").alias("v")).where(F.size("v") >= 2)
    chunks = F.from_json(F.get("v", F.lit(1)), "array<string>")
    is_path = lambda c: c.contains("/") | c.rlike(r"\.(m?js|css)$")
    bare = lambda c: F.regexp_replace(c, r'^"|"$', "")
    return own.select("page_id", bare(F.get("v", F.lit(0))).alias("module_id"), F.coalesce(bare(F.get("v", F.lit(2))), F.lit("")).alias("export_name"), F.filter(chunks, is_path).alias("chunk_paths"), F.filter(chunks, lambda c: ~is_path(c)).alias("chunk_ids"))


def build_id(flight_: Column) -> Column:
    return F.nullif(F.regexp_extract(flight_, r'"b":"([^"]+)"', 1), F.lit(""))


def next_data(pages: DataFrame) -> DataFrame:
    """(page_id, build_id, page, asset_prefix) of pages with a data script."""
    own = F.regexp_extract("html", r"""(?is)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>""", 1)
    parsed = pages.select("page_id", F.from_json(own, "buildId string, page string, assetPrefix string").alias("d"), own.alias("raw")).where("raw <> ''")
    return parsed.select("page_id", F.col("d.buildId").alias("build_id"), "d.page", F.col("d.assetPrefix").alias("asset_prefix"))


CHUNK_PATH = r"(?:/[\w\-.~%@]+)*/_next/static/[\w\-./~%@\[\]()]+?\.(?:m?js|css)|(?<![\w/])static/(?:chunks|css|[\w-]{8,})/[\w\-./~%@\[\]()]+?\.(?:m?js|css)"


def chunk_paths(column: str) -> Column:
    """Distinct chunk paths that a text mentions, in their order."""
    return F.array_distinct(F.regexp_extract_all(column, F.lit(CHUNK_PATH), 0))


def asset_base(pages: DataFrame, mark: str = "/_next/") -> DataFrame:
    """(page_id, base): where a page's assets lie: the base that most of its URLs have, the first one of equals."""
    based = html.with_base(pages)
    found = based.select("page_id", "base_url", F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?i)(?:src|href)\s*=\s*["']([^"']*""" + re.escape(mark) + r"""[^"']*)["']"""), 1)).alias("ord", "href"))
    bases = found.select("page_id", "ord", urls.resolve(F.col("href"), F.col("base_url")).alias("u")).where(F.col("u").contains(mark)).withColumn("base", F.concat(F.substring_index("u", mark, 1), F.lit(mark)))
    counts = bases.groupBy("page_id", "base").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = counts.groupBy("page_id").agg(F.max_by("base", F.struct(F.col("n"), -F.col("first"))).alias("_base")).withColumnRenamed("page_id", "_of")
    joined = pages.join(best, F.col("page_id") == F.col("_of"), "left")
    return joined.select("page_id", F.coalesce("_base", F.concat(urls.origin(F.col("url")), F.lit(mark))).alias("base"))


def reconcile(page: str | None) -> str | None:
    """A streamed page with its late segments in place: what `$RC("B:0","S:0")` calls would move, moved."""
    if page is None:
        return None
    for boundary, segment in re.findall(r'\$RC\("([^"]+)","([^"]+)"\)', page):
        m = re.search(rf'<div hidden id="{re.escape(segment)}">', page)
        end = _closing(page, m.end()) if m else -1
        hole = re.search(rf'<template id="{re.escape(boundary)}"></template>(.*?)<!--/\$-->', page, re.S)
        if m is None or end < 0 or hole is None:
            continue
        inner = page[m.end() : end]
        whole = page[: m.start()] + page[end + len("</div>") :]
        page = whole.replace(hole[0], f"{inner}<!--/$-->", 1)
    return page


def _closing(page: str, at: int) -> int:
    """Where the `</div>` of a division stands whose inside begins at `at`."""
    depth = 1
    for m in re.compile(r"<(/?)div\b[^>]*>").finditer(page, at):
        depth += -1 if m[1] else 1
        if depth == 0:
            return m.start()
    return -1


# Compiled messages. Kinds of nodes: 0 root, 1 plural, 2 sequence, 3 and 9 text, 4 named, 5 listed, 6
# linked, 7 link key, 8 modifier.


def message_source(node: Any) -> str | None:
    """The source of a compiled message; null for nodes that aren't known."""
    if not isinstance(node, dict):
        return None
    kind = node.get("t", node.get("type"))
    quoted = lambda s: re.sub(r"[{}@|]", lambda m: f"{{'{m[0]}'}}", s)
    every = lambda xs, sep: None if any(x is None for x in xs) else sep.join(xs)
    if kind == 0:
        return message_source(node.get("b"))
    if kind == 1:
        return every([message_source(c) for c in node.get("c") or []], " | ")
    if kind == 2:
        return quoted(node["s"]) if isinstance(node.get("s"), str) else every([message_source(i) for i in node.get("i") or []], "")
    if kind in (3, 9):
        return quoted(node["v"]) if isinstance(node.get("v"), str) else quoted(node["s"]) if isinstance(node.get("s"), str) else ""
    if kind == 4:
        return f"{{{node['k']}}}" if isinstance(node.get("k"), str) else None
    if kind == 5:
        return f"{{{node['i']}}}" if isinstance(node.get("i"), int) else None
    if kind == 6:
        key = message_source(node.get("k"))
        modifier = node["m"].get("v") if isinstance(node.get("m"), dict) else None
        return None if key is None else f"@{f'.{modifier}' if modifier else ''}:{key}"
    if kind in (7, 8):
        return node["v"] if isinstance(node.get("v"), str) else None
    return None


# Routes and hints.


def kit_routes(scripts: DataFrame) -> DataFrame:
    """(url, route, node): the route dictionaries of scripts (url, body)."""
    pattern = r'(?:^|[,;{\s])[\w$]+\s*=\s*(\{(?:"[^"]*"\s*:\s*\[[^\]]*(?:\[[^\]]*\])?[^\]]*\]\s*,?\s*)+\})'
    found = scripts.where(F.col("body").contains("dictionary")).select("url", F.explode(F.regexp_extract_all("body", F.lit(pattern), 1)).alias("d"))
    return found.select("url", F.explode(F.from_json("d", "map<string,array<string>>")).alias("route", "v")).select("url", "route", F.abs(F.get("v", F.lit(0)).cast("int")).alias("node")).where("node IS NOT NULL")


def kit_hints(scripts: DataFrame) -> DataFrame:
    """(id, name, weight, reason): names of modules by the routes whose nodes they are."""
    number = F.regexp_extract(urls.path(F.col("url")), r"/nodes/(\d+)\.[\w-]+\.js$", 1)
    nodes = scripts.where(number != "").select(number.cast("int").alias("node"), urls.chunk_stem(F.col("url")).alias("id"))
    fixed = scripts.sparkSession.createDataFrame([(0, "Layout", "root layout"), (1, "Error", "root error")], "node int, name string, reason string")
    named = kit_routes(scripts).select("node", F.concat(F.coalesce(F.nullif(text.pascal(F.regexp_replace("route", r"[\[\]()/]", " ")), F.lit("")), F.lit("Index")), F.lit("Page")).alias("name"), F.concat(F.lit("route "), F.col("route")).alias("reason"))
    return nodes.join(fixed.unionByName(named), "node").select("id", "name", F.lit(7.0).alias("weight"), "reason")


def file_name_hints(scripts: DataFrame) -> DataFrame:
    """(id, name, weight, reason): names before the hash in chunk names."""
    stem = urls.chunk_stem(F.col("url"))
    name = F.regexp_extract(stem, r"^(.+?)-[\w-]{8}$", 1)
    return scripts.select(stem.alias("id"), name.alias("name")).where(~F.col("name").isin("", "index", "chunk")).select("id", "name", F.lit(4.0).alias("weight"), F.lit("chunk file name").alias("reason"))


def angular_hints(scripts: DataFrame) -> DataFrame:
    """(id, name, weight, reason): components of scripts that define just one selector."""
    found = F.regexp_extract_all("body", F.lit(r'selectors\s*:\s*\[\s*\[\s*"([a-z][\w-]*)"'), 1)
    return scripts.select(urls.chunk_stem(F.col("url")).alias("id"), found.alias("s")).where(F.size("s") == 1).select("id", text.component_name(F.get("s", F.lit(0))).alias("name"), F.lit(7.0).alias("weight"), F.concat(F.lit("component <"), F.get("s", F.lit(0)), F.lit(">")).alias("reason"))


def island_hints(pages: DataFrame) -> DataFrame:
    found = html.islands(pages)
    own = found.where("component_url IS NOT NULL AND component IS NOT NULL").select(urls.chunk_stem(F.col("component_url")).alias("id"), F.col("component").alias("name"), F.lit(9.0).alias("weight"), F.concat(F.lit("island "), F.col("component")).alias("reason"))
    renderers = found.where("renderer_url IS NOT NULL AND framework IS NOT NULL").select(urls.chunk_stem(F.col("renderer_url")).alias("id"), F.concat("framework", F.lit("-renderer")).alias("name"), F.lit(6.0).alias("weight"), F.lit("island renderer").alias("reason"))
    return own.unionByName(renderers).distinct()


def module_names(hints: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, name): each module's best hint, made unique but for case; modules without any are called by their ids."""
    best = hints.groupBy("id", "name").agg(F.max("weight").alias("w")).groupBy("id").agg(F.max_by("name", F.struct("w", F.col("name"))).alias("hint")).withColumnRenamed("id", "_of")
    base = ids.join(best, F.col("id") == F.col("_of"), "left").withColumn("base", F.regexp_replace(F.coalesce("hint", F.concat(F.lit("module-"), F.col("id"))), r"[^\w-]", "_"))
    n = F.row_number().over(Window.partitionBy(F.lower("base")).orderBy("id"))
    return base.withColumn("n", n).select("id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))).alias("name"))


def shared_chunks(references: DataFrame, share: float = 0.5) -> DataFrame:
    """(chunk): chunks that at least that share of all references (module_id, chunk_paths) has: the app's baseline."""
    own = references.select("module_id", F.explode("chunk_paths").alias("chunk")).distinct()
    total = references.agg(F.count_distinct("module_id")).first()[0]
    return own.groupBy("chunk").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(share * total)).select("chunk")


def references_on_every_page(references: DataFrame) -> DataFrame:
    total = references.agg(F.count_distinct("page_id")).first()[0]
    return references.groupBy("module_id").agg(F.count_distinct("page_id").alias("n")).where(F.col("n") == total).select("module_id")
