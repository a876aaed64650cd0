"""URLs, paths and resource types as column expressions; nothing here needs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bundlelens import rules


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it; expressions stay as small as they are written."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def scheme(url: Column) -> Column:
    return F.lower(part(url, r"^([A-Za-z][A-Za-z0-9+.-]*):"))


def authority(url: Column) -> Column:
    return F.lower(part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"))


def host(url: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def path(url: Column) -> Column:
    found = part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    """The query with its question mark, or the empty string."""
    return part(url, r"^[^?#]*(\?[^#]*)")


def fold_dots(p: Column) -> Column:
    """An absolute path without `.` and `..` segments."""

    def step(kept: Column, segment: Column) -> Column:
        # segments are stacked unless they are a dot; two dots take the last one off, but never the root
        low = F.lower(segment)
        return F.when(low.isin("..", "%2e%2e"), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(low.isin(".", "%2e"), kept).otherwise(F.array_append(kept, segment))

    def folded(segments: Column) -> Column:
        stack = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array(F.lit("")), step)
        open_end = F.lower(F.element_at(segments, -1)).isin(".", "..", "%2e", "%2e%2e")
        return let(F.concat(F.array_join(stack, "/"), F.when(open_end, "/").otherwise("")), lambda x: F.when(x == "", "/").otherwise(x))

    return F.when(p.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), let(F.split(p, "/", -1), folded)).otherwise(p)


def encode_others(text: Column) -> Column:
    """Percent-encode blanks, quotes, angle brackets and what isn't ASCII."""
    escaped = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c == " ", "%20").when(c.rlike(r"""[^\x21-\x7e]|["<>`{}]"""), F.url_encode(c)).otherwise(c)), "")
    return F.when(text.rlike(r"""[^\x21-\x7e]|["<>`{}]"""), escaped).otherwise(text)


def resolve(href: Column, base: Column) -> Column:
    """`href` against `base` as an absolute http(s) URL without fragment; null for anything else."""

    def slashes(h: Column) -> Column:
        # like browsers, take backslashes in the path for slashes
        own = F.regexp_extract(h, r"^[^?]*", 0)
        return F.when(h.contains("\\"), F.concat(F.regexp_replace(own, r"\\", "/"), F.regexp_extract(h, r"\?.*$", 0))).otherwise(h)

    def absolute(h: Column) -> Column:
        return (
            F.when(h.rlike(r"(?i)^https?://"), h)
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin(base), h))
            .when(h.startswith("?"), F.concat(origin(base), path(base), h))
            .when(h == "", F.concat(origin(base), path(base), query(base)))
            .otherwise(F.concat(origin(base), F.regexp_replace(path(base), r"[^/]*$", ""), h))
        )

    def rebuilt(x: Column) -> Column:
        port = F.when(scheme(x) == "http", r":80").otherwise(r":443")
        where = let(authority(x), lambda a: F.when(F.endswith(a, port), F.regexp_replace(a, r":\d+$", "")).otherwise(F.regexp_replace(a, r":$", "")))
        found = let(where, lambda w: F.when(w != "", F.concat(scheme(x), F.lit("://"), w, let(let(path(x), fold_dots), encode_others), let(query(x), encode_others))))
        return F.when(scheme(x).isin("http", "https"), found)

    bare = F.regexp_replace(F.trim(F.regexp_replace(href, r"[\t\n\r]", "")), r"#.*$", "")
    return let(let(let(bare, slashes), absolute), rebuilt)


def guess_type(url: Column) -> Column:
    p = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(p.rlike(r"(?i)\.m?js$"), "script").when(p.rlike(r"(?i)\.css$"), "style").when(p.rlike(r"(?i)\.map$"), "sourcemap").when(p.rlike(r"(?i)\.(webmanifest|json)$"), "manifest").otherwise("other")


def is_javascript(mime: Column) -> Column:
    return mime.isNull() | (mime == "") | F.trim(mime).rlike(r"(?i)^(module|text/javascript|application/javascript)$")


def is_relative(specifier: Column) -> Column:
    return specifier.rlike(r"(?i)^(\.{1,2}/|/|https?://)")


def crawl_scope(url: Column) -> Column:
    """The directory that a crawl from `url` stays in."""
    p = path(url)
    found = F.when(p.endswith("/"), F.regexp_replace(p, r"/+$", "")).otherwise(F.regexp_replace(p, r"/[^/]*$", ""))
    return F.when(found == "", "/").otherwise(found)


def in_scope(url: Column, of: Column, scope: Column) -> Column:
    return (origin(url) == origin(of)) & ((scope == "/") | (path(url) == scope) | path(url).startswith(F.concat(scope, F.lit("/"))))


def page_key(url: Column) -> Column:
    """What tells pages apart: origin and path without slashes at its end."""
    p = F.regexp_replace(path(url), r"/+$", "")
    return F.concat(origin(url), F.when(p == "", "/").otherwise(p))


def site(url: Column) -> Column:
    """Scheme and the last two labels of the host; addresses and short hosts as they are."""
    labels = F.split(host(url), r"\.")
    whole = host(url).rlike(r"^[\d.]+$") | (F.size(labels) <= 2)
    return F.concat(scheme(url), F.lit("://"), F.when(whole, host(url)).otherwise(F.array_join(F.slice(labels, -2, 2), ".")))


def fetch_site(target: Column, referrer: Column) -> Column:
    return F.when(referrer.isNull(), "none").when(origin(referrer) == origin(target), "same-origin").when(site(referrer) == site(target), "same-site").otherwise("cross-site")


def referer(target: Column, referrer: Column) -> Column:
    """The referer header: nothing from https to http, the whole URL within an origin, the origin across them."""
    return (
        F.when(referrer.isNull() | ((scheme(referrer) == "https") & (scheme(target) == "http")), F.lit(None).cast("string"))
        .when(origin(referrer) == origin(target), F.regexp_replace(referrer, r"#.*$", ""))
        .otherwise(F.concat(origin(referrer), F.lit("/")))
    )


def short_hash(text: Column) -> Column:
    """Eight characters that identify a text; equal texts have equal ones, nothing more is promised."""
    return F.left(F.lower(F.hex(F.xxhash64(text))), F.lit(8))


def safe_segment(segment: Column) -> Column:
    """A file name: unsafe characters become `_`, long names end in a hash."""
    clean = F.regexp_replace(F.regexp_replace(segment, r'[<>:"|?*\\/\x00-\x1f]', "_"), r"[. ]+$", "_")
    clean = F.when(clean.isin("", ".", ".."), "_").otherwise(clean)
    return F.when(F.length(clean) > 120, F.concat(F.left(clean, F.lit(111)), F.lit("~"), short_hash(clean))).otherwise(clean)


def safe_path(text: Column) -> Column:
    """A relative path of safe segments; dots are folded and never lead above the root."""
    parts = F.split(F.regexp_replace(text, r"\\", "/"), "/", -1)
    # plus signs are no blanks in paths
    decoded = lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)).otherwise(F.array_append(a, safe_segment(decoded(s)))),
    )
    return F.when(F.size(kept) == 0, "_").otherwise(F.array_join(kept, "/"))


def host_dir(url: Column) -> Column:
    port = part(authority(url), r":(\d+)$")
    return safe_segment(F.when(port != "", F.concat(host(url), F.lit("_"), port)).otherwise(host(url)))


def source_path(source: Column) -> Column:
    """The path of an original source: without the bundler's prefix, query and leading dots."""
    found = source
    for pattern in reversed(rules.SOURCE_PREFIXES):
        found = F.when(source.rlike(pattern), F.regexp_replace(source, pattern, "")).otherwise(found)
    return safe_path(F.regexp_replace(F.regexp_replace(found, r"[?#].*$", ""), r"^(\.\.?/)+", ""))


def chunk_stem(url: Column) -> Column:
    """The file name without extension of a script."""
    return F.regexp_replace(part(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$"), r"\.[mc]?js$", "")


def package_of(specifier: Column) -> Column:
    """The package that an import names, scoped or not; null for paths, URLs and built-in modules."""
    name = F.when(specifier.startswith("@"), F.regexp_extract(specifier, r"^[^/]*/?[^/]*", 0)).otherwise(F.regexp_extract(specifier, r"^[^/]*", 0))
    ours = specifier.rlike(r"^(\.|/|#|node:|virtual:|~|@/|data:|https?:)")
    return F.when(~ours & name.rlike(r"(?i)^(@[a-z0-9._-]+/)?[a-z0-9._-]+$"), name)


def module_id(specifier: Column) -> Column:
    found = part(specifier, r"^\./(.+)\.js$")
    return F.when(found != "", found)


def site_words(url: Column) -> Column:
    """Labels of the host that name the site."""
    labels = F.split(host(url), r"\.")
    return F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: (F.length(x) >= 4) & ~x.rlike(rules.GENERIC_LABEL))


def is_hash_name(name: Column) -> Column:
    """Whether a name of 8 to 12 characters looks like a content hash."""
    mixed = name.rlike("[A-Z]") & name.rlike("[a-z]")
    word = name.rlike(r"^[A-Z]?[a-z]+(?:[A-Z][a-z]+)*$")
    return name.rlike(r"^[A-Za-z0-9_-]{8,12}$") & F.when(F.length(name) == 8, name.rlike(r"[\d_-]") | mixed).otherwise(~word & (name.rlike(r"\d") | mixed))


def common_directory(paths: Column) -> Column:
    """The longest directory that all paths of an array share."""
    split = F.transform(paths, lambda p: F.slice(F.split(p, "/", -1), 1, F.size(F.split(p, "/", -1)) - 1))
    shared = F.aggregate(
        split, F.get(split, F.lit(0)),
        lambda a, b: F.slice(a, 1, F.coalesce(F.array_min(F.filter(F.transform(a, lambda x, i: F.when(F.coalesce(F.get(b, i), F.lit("\x00")) == x, F.lit(None)).otherwise(i)), lambda i: i.isNotNull())), F.size(a))),
    )
    return F.when(F.size(paths) == 0, "/").otherwise(F.concat(F.array_join(shared, "/"), F.lit("/")))


def relative_import(from_file: Column, to_file: Column) -> Column:
    """How a file imports another: a path that begins with a dot."""
    a, b = F.split(from_file, "/", -1), F.split(to_file, "/", -1)
    n = F.least(F.size(a), F.size(b)) - 1
    shared = F.coalesce(F.array_min(F.filter(F.transform(F.slice(a, 1, n), lambda x, i: F.when(F.get(b, i) == x, F.lit(None)).otherwise(i)), lambda i: i.isNotNull())), n)
    up = F.array_join(F.array_repeat(F.lit(".."), F.size(a) - 1 - shared), "/")
    down = F.array_join(F.slice(b, shared + 1, F.size(b) - shared), "/")
    return F.when(up == "", F.concat(F.lit("./"), down)).otherwise(F.concat_ws("/", up, down))


def absolutise_srcset(value: Column, base: Column) -> Column:
    """Every URL of a srcset made absolute, descriptors kept."""
    return F.array_join(F.transform(F.split(value, r"\s*,\s+"), lambda x: F.concat_ws(" ", F.coalesce(resolve(F.regexp_extract(F.trim(x), r"^\S+", 0), base), F.regexp_extract(F.trim(x), r"^\S+", 0)), F.nullif(F.regexp_extract(F.trim(x), r"\s(.*)$", 1), F.lit("")))), ", ")
