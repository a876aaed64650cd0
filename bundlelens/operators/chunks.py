"""Bundles as tables: modules, diagnostics, dependencies, outlines and readable code of captured scripts.

A script is parsed where its row is; rows that can't hold what is asked for are filtered by native guards before they
reach Python. Dependencies between modules are equi-joins on (namespace, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlelens.functions import numbers, urls
from bundlelens.js import facts, refine
from bundlelens.js import unpack as bundles
from bundlelens.operators import graphs, scripts
from bundlelens.operators.detect import boilerplate_counts
from bundlelens.operators.generate import generate
from bundlelens.operators.votes import first_of_equal

#: What a script must have to be worth unpacking.
GUARD = r"""webpack(?:Chunk|Jsonp)|TURBOPACK|\bexports\b|\bimport\s*[\w{*"'(]|\bexport\s*[{*\w]"""
MODULE = "level string, shape string, id string, code string, deps array<string>, exports array<string>, origin string, skipped array<string>, notes array<string>"


def _rows(body: str | None, url: str | None, adapter: str | None) -> list[tuple]:
    chunk = bundles.unpack(body, url, adapter)
    if chunk is None:
        return []
    about = ([f"{i}: {why}" for i, why in chunk.skipped], chunk.notes)
    return [(chunk.level, chunk.shape, m.id, m.code, m.deps, m.exports, m.origin, *about) for m in chunk.modules] or [(chunk.level, chunk.shape, None, None, [], [], None, *about)]


def unpacked(assets: DataFrame) -> DataFrame:
    """One row per module of every script (url, body, adapter), and one without module for chunks of none."""
    return generate(assets.where(F.col("body").rlike(GUARD)).withColumn("chunk_url", F.col("url")), ["chunk_url"], ["body", "url", "adapter"], _rows, MODULE)


def modules(found: DataFrame) -> DataFrame:
    """(namespace, id, code, deps, exports, origin): every module once, in the first chunk by url that has it."""
    rows = found.where("id IS NOT NULL").withColumn("namespace", F.regexp_extract("chunk_url", r"^([a-z]+://[^/]*)", 1))
    first = rows.groupBy("namespace", "id").agg(F.min_by(F.struct("chunk_url", "code", "deps", "exports", "origin"), "chunk_url").alias("m"), F.count_distinct(F.sha2(F.regexp_replace("code", r"\s+", ""), 256)).alias("shapes"))
    return first.select("namespace", "id", "m.*", (F.col("shapes") > 1).alias("differs"))


def diagnostics(found: DataFrame) -> DataFrame:
    """(chunk_url, shape, level, modules, skipped, notes) of every chunk; ten of the skipped."""
    return found.groupBy("chunk_url", "shape", "level").agg(F.count("id").alias("modules"), F.any_value(F.slice("skipped", 1, 10)).alias("skipped"), F.any_value("notes").alias("notes"))


def dependencies(mods: DataFrame) -> DataFrame:
    """(src, dst) edges between modules, named namespace and id."""
    name = lambda i: F.concat_ws("\x00", "namespace", i)
    return mods.select(name("id").alias("src"), F.explode("deps").alias("_d"), "namespace").select("src", name("_d").alias("dst"))


def missing_modules(mods: DataFrame) -> DataFrame:
    """(dst, importers) of modules that are needed and weren't captured."""
    return graphs.missing(dependencies(mods), mods.select(F.concat_ws("\x00", "namespace", "id").alias("node")))


def aliases(mods: DataFrame) -> DataFrame:
    """(namespace, id, target): modules that are other names of a module, followed to it through ten of them at most."""
    schema = "kind string, sources array<string>"
    small = mods.where((F.length("code") < 2000) & F.col("code").rlike(r"^\s*(export|import)\b"))
    trivial = generate(small, ["namespace", "id"], ["code"], lambda c: [t] if (t := facts.trivial(c)) else [], schema).where("kind = 'alias'")
    edges = trivial.select(F.concat_ws("\x00", "namespace", "id").alias("src"), F.concat_ws("\x00", "namespace", urls.module_id(F.get("sources", F.lit(0)))).alias("dst"))
    ends = graphs.aliases(edges)
    part = lambda c, i: F.split(c, "\x00")[i]
    return ends.select(part("src", 0).alias("namespace"), part("src", 1).alias("id"), part("dst", 1).alias("target"))


def outlines(mods: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    """Imports and exports of modules, a row each."""
    guard = F.col(code).rlike(r"\b(import|export)\b")
    return generate(mods.where(guard), keep, [code], facts.outline, "kind string, name string, other string, source string")


def names(mods: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    return generate(mods, keep, [code], facts.bindings, "name string, kind string, uses int")


def mangled_ratio(mods: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    """(keep.., total, mangled, ratio): how many bindings have names only a minifier gives."""
    found = generate(mods, keep, [code], lambda c: [facts.mangled(c)], "total int, mangled int")
    return found.withColumn("ratio", numbers.ratio(F.col("mangled").cast("double"), F.col("total").cast("double")))


def readable(mods: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    """(keep.., code): deminified and renamed; null where the code can't be parsed."""

    def one(text: str | None) -> list[tuple]:
        plain = refine.deminify(text)
        return [(refine.rename(plain) if plain is not None else None,)]

    return generate(mods, keep, [code], one, "code string" if code not in keep else "readable string")


def name_votes(mods: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    """Evidence for names, a row each, for `votes.argmax`."""
    return generate(mods, keep, [code], refine.vote_rows, "binding string, at int, name string, weight int")


def chunk_urls(runtimes: DataFrame) -> DataFrame:
    """(url, chunk_id, kind, path): paths of all chunks that runtime scripts (url, body) know, computed without running
    them, and the URL each has."""
    guarded = runtimes.where(F.col("body").rlike(r"\.(u|miniCssF)\s*=|\.p\s*\+|jsonpScriptSrc"))
    found = generate(guarded, ["url"], ["body"], bundles.chunk_urls, "chunk_id string, kind string, path string")
    base = guarded.select("url", public_path(F.col("body")).alias("public_path"))
    return found.join(base, "url").select("url", "chunk_id", "kind", "path", urls.resolve(F.concat(F.coalesce("public_path", F.lit("")), F.col("path")), F.col("url")).alias("chunk_url"))


def public_path(body: Column) -> Column:
    """The prefix that a runtime puts before chunk paths; null for none or `auto`."""
    found = F.regexp_extract(body, r"""\.p\s*=\s*["']([^"']*)["']""", 1)
    return F.when(~found.isin("", "auto"), found)


def lazy_state(scripts_: DataFrame) -> DataFrame:
    """(chunk_id): chunks that scripts ask for and none of the captured chunks is."""
    asked = scripts_.select(F.explode(F.regexp_extract_all("body", F.lit(r'\.e\(\s*(\d+|"[^"\\]+")\s*\)'), 1)).alias("chunk_id")).select(F.regexp_replace("chunk_id", '"', "").alias("chunk_id")).distinct()
    held = scripts_.select(F.regexp_extract("body", r"\.push\(\[\[([^\]]*)\]", 1).alias("ids")).select(F.explode(F.split("ids", r"\s*,\s*")).alias("chunk_id")).select(F.regexp_replace("chunk_id", "[\"']", "").alias("chunk_id"))
    return asked.join(held.distinct(), "chunk_id", "left_anti")


def unfetched(scripts_: DataFrame, known: DataFrame) -> DataFrame:
    """(value, file, line): constant script and style URLs in scripts (file, code) that aren't among the known (url)."""
    seen = generate(scripts_.where(F.col("code").rlike(r"\.(m?js|css)\b")), ["file"], ["code"], scripts.seen_urls, "value string, line int")
    return seen.join(known.select(F.col("url").alias("value")).distinct(), "value", "left_anti").dropDuplicates(["value"])


def loader_findings(scripts_: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    guard = r"\b(import|require|__webpack_require__|importScripts|eval|Function|ensure|Worker|SharedWorker|System)\b|import\.meta"
    return generate(scripts_.where(F.col(code).rlike(guard)), keep, [code], scripts.loaders, "kind string, line int")


def string_literals(scripts_: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    return generate(scripts_.where(F.col(code).rlike("[\"'`]")), keep, [code], scripts.string_literals, "value string, line int")


def route_tables(scripts_: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    guarded = scripts_.where(F.col(code).rlike(r"\bpath\s*:"))
    return generate(guarded, keep, [code], facts.routes, "path string, name string, file string")


def route_candidates(scripts_: DataFrame, origin: str, scope: str) -> DataFrame:
    """(url): pages of the scope that strings in scripts (body) name; neither assets nor dynamic or risky routes."""
    from bundlelens import rules

    p = F.col("p")
    found = scripts_.select(F.explode(F.regexp_extract_all("body", F.lit(r"""["'`](/[A-Za-z0-9\-_~.%/]*)["'`]"""), 1)).alias("p"))
    segments = F.array_remove(F.split(p, "/"), "")
    plain = ~p.startswith("//") & (F.length(p) <= 120) & ~p.rlike(rules.UNSAFE_ROUTE) & ~p.rlike(rules.NON_PAGE) & ~F.regexp_replace(p, r"\.html?$", "").rlike(r"\.\w{1,5}$")
    good = plain & ~F.exists(segments, lambda s: s.rlike(r"^[_\[:(]") | s.contains("..")) & ((F.size(segments) == 0) | F.exists(segments, lambda s: F.length(s) >= 2)) & ~F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit("")).rlike(r"(?i)^index(\.html?)?$")
    full = F.when((F.lit(scope) != "/") & ~((p == scope) | p.startswith(f"{scope}/")), F.concat(F.lit(scope), F.when(p == "/", "").otherwise(p))).otherwise(p)
    return found.where(good).select(F.concat(F.lit(origin), full).alias("url")).where(urls.in_scope(F.col("url"), F.lit(origin), F.lit(scope))).withColumn("_k", F.regexp_replace("url", "/+$", "")).groupBy("_k").agg(F.min("url").alias("url")).select("url")


def merged_styles(sheets: DataFrame) -> DataFrame:
    """(target, ord, text): the rules of all distinct sheets (url, ord, css), dealt to tailwind or the app's own."""
    from bundlelens.operators.detect import tailwind

    distinct = first_of_equal(sheets, F.col("css"), "url", "ord").where("duplicate_of IS NULL").drop("duplicate_of")
    marked = tailwind(distinct)
    uses = F.broadcast(marked.agg(F.max("uses_tailwind").alias("uses"), F.min_by("tailwind_version", F.struct(F.col("tailwind_version").isNull(), "ord")).alias("version")))
    # one row of two values for all sheets; it is as small as that
    rules_ = scripts.sheet_rules(distinct.withColumnRenamed("ord", "sheet"), ["url", "sheet"], "css").join(uses)
    return rules_.where(~F.col("text").rlike(r"^/\*#\s*sourceMappingURL=")).select(F.when(F.col("uses") & is_tailwind(F.col("text"), F.col("head"), F.col("version")), "tailwind").otherwise("app").alias("target"), "sheet", "ord", "text")


# Beginnings of class names that utility frameworks generate.
UTILITY = r"^-?(flex|grid|block|inline|hidden|contents|table|relative|absolute|fixed|sticky|static|container|sr-only|not-sr-only|truncate|underline|italic|antialiased|uppercase|lowercase|capitalize|rounded|border|shadow|transition|transform|filter|(m|p|w|h|gap|top|left|right|bottom|inset|z|order|col|row|text|font|leading|tracking|bg|from|to|via|fill|stroke|opacity|ring|space|divide|min|max|mx|my|mt|mb|ml|mr|px|py|pt|pb|pl|pr|size|basis|grow|shrink|justify|items|self|place|object|overflow|cursor|select|rotate|scale|translate|duration|ease|delay|animate)-\S+)$"


def is_tailwind(text: Column, head: Column, version: Column) -> Column:
    """Whether a rule is one that the utility framework generates: its layers, keyframes and properties, and selectors
    all of whose classes are utilities."""
    from bundlelens.operators.detect import TAILWIND_BANNER

    legacy = F.coalesce(version.rlike(r"^[0-3]\."), F.lit(False))
    classes = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\.((?:\\.|[\w-])+)"), 1), lambda c: F.regexp_replace(c, r"\\(.)", "$1"))
    utility = lambda s: F.when(F.size(classes(s)) == 0, legacy).otherwise(F.forall(classes(s), lambda c: c.rlike(r"[:\[\]/]") | c.rlike(UTILITY)))
    return (
        F.when(text.startswith("/*"), text.rlike(TAILWIND_BANNER))
        .when(head.rlike(r"^@layer\s+(properties|theme|base|components|utilities)\b|^@keyframes\s+(spin|ping|pulse|bounce)\b|^@property\s+--tw-"), F.lit(True))
        .when(head.startswith("@"), F.lit(False))
        .otherwise(F.forall(F.split(head, ","), utility))
    )


def quality(files: DataFrame, mods: DataFrame) -> DataFrame:
    """One row: shares of readable names and mangled identifiers, counters of generated code, degraded chunks.

    files: (path, kind, library, content); mods: (name, package, level)."""
    own = files.where(F.col("kind").isin("module", "script") & ~F.col("path").contains("/_missing/"))
    counted = mangled_ratio(own.withColumn("code", F.col("content")), ["path", "library"])
    by = lambda c, lib: F.sum(F.when(F.col("library") == lib, F.col(c)).otherwise(0)).cast("double")
    identifiers = counted.agg(numbers.ratio(by("mangled", False), by("total", False)).alias("mangled_app"), numbers.ratio(by("mangled", True), by("total", True)).alias("mangled_library"))
    generated = own.select(*boilerplate_counts(F.col("content"))).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("define_exports", "exports_assignments", "require_calls", "indirect_calls")])
    named = mods.agg(numbers.ratio(F.count_if(~F.col("name").startswith("module-")).cast("double"), F.count("*").cast("double")).alias("readable_names"), F.array_sort(F.collect_set("package")).alias("packages"), F.count_if(F.col("level").isin("partial", "raw")).alias("degraded"))
    return identifiers.join(F.broadcast(generated)).join(F.broadcast(named))


def markup(mods: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    """(keep.., jsx, template): modules with element calls as JSX, and the template of their first render function; null
    where there is none."""
    from bundlelens.js import templates

    guarded = mods.where(F.col(code).rlike(r"\b_?jsxs?\b|createElement(VNode|Block)|createVNode"))
    return generate(guarded, keep, [code], lambda c: [(templates.jsx(c), templates.vue_template(c))], "jsx string, template string")
