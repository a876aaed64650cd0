import pytest
from pyspark.sql import functions as F

from bundlelens.functions import numbers, sets, text, urls


def values(spark, f, rows, schema):
    """The results of a column function over rows of arguments, in their order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    args = [F.col(c) for c in df.columns[1:]]
    return [r[1] for r in df.select("_i", f(*args).alias("x")).orderBy("_i").collect()]


def test_resolve(spark):
    base = "https://h.test/t/app?q=1#x"
    cases = {"./m.js": "https://h.test/t/m.js", "/c.js": "https://h.test/c.js", "x/p.js": "https://h.test/t/x/p.js", "../../up": "https://h.test/up", "//cdn.test:443/a?b#c": "https://cdn.test/a?b", "?z": "https://h.test/t/app?z", "": "https://h.test/t/app?q=1", "#f": "https://h.test/t/app?q=1", "mailto:a@b": None, "javascript:0": None, "HTTP://H.Test:80/A/../B/.": "http://h.test/B/", "/é a": "https://h.test/%C3%A9%20a", " /x\n": "https://h.test/x", "/a\\b": "https://h.test/a/b", "/a/%2e%2E/b": "https://h.test/b", "http://": None, "/../..": "https://h.test/", "a/./b/..": "https://h.test/t/a/"}
    assert dict(zip(cases, values(spark, urls.resolve, [(h, base) for h in cases], "h string, b string"))) == cases


def test_paths(spark):
    cases = {"../../etc/passwd": "etc/passwd", "/a/./b/../c": "a/c", "": "_", "a/..": "_", "a b%20c": "a b c", "a\\b": "a/b", "x:y?.": "x_y__", "..%2F..%2Fx": ".._.._x", "a+b": "a+b"}
    assert dict(zip(cases, values(spark, urls.safe_path, [(c,) for c in cases], "p string"))) == cases
    long = values(spark, urls.safe_segment, [("x" * 300,)], "p string")[0]
    assert len(long) == 120 and long.startswith("x" * 111 + "~")
    cases = {"webpack://_N_E/./components/Counter.jsx": "components/Counter.jsx", "turbopack:///[project]/lib/math.js": "[project]/lib/math.js", "../../src/a.ts?x#y": "src/a.ts", "foo://host/a/b": "a/b"}
    assert dict(zip(cases, values(spark, urls.source_path, [(c,) for c in cases], "p string"))) == cases


def test_scope(spark):
    cases = {"https://h.test/t/tttt/about": True, "https://h.test/t/tttttt": False, "https://h.test/other": False, "https://evil.test/t/tttt/x": False, "https://h.test/t/tttt": True}
    assert dict(zip(cases, values(spark, urls.in_scope, [(c, "https://h.test/t/tttt", "/t/tttt") for c in cases], "u string, o string, s string"))) == cases
    assert values(spark, urls.crawl_scope, [("https://h.test/a/b",), ("https://h.test/a/b/",), ("https://h.test",)], "u string") == ["/a", "/a/b", "/"]
    assert values(spark, urls.page_key, [("https://h.test/a//?q",), ("https://h.test",)], "u string") == ["https://h.test/a", "https://h.test/"]


def test_sites_and_referrers(spark):
    rows = [("https://a.h.test/x", None), ("https://h.test/x", "https://h.test/y#z"), ("https://a.h.test/x", "https://b.h.test/y"), ("https://h.test/", "https://g.test/"), ("http://h.test/", "https://h.test/")]
    assert values(spark, urls.fetch_site, rows, "t string, r string") == ["none", "same-origin", "same-site", "cross-site", "cross-site"]
    assert values(spark, urls.referer, rows, "t string, r string") == [None, "https://h.test/y", "https://b.h.test/", "https://g.test/", None]


def test_small_url_functions(spark):
    assert values(spark, urls.guess_type, [("https://h/a.mjs?x",), ("/b.css",), ("c.js.map",), ("site.webmanifest",), ("d",)], "u string") == ["script", "style", "sourcemap", "manifest", "other"]
    assert values(spark, urls.package_of, [("react/jsx",), ("@a/b/c",), ("./x",), ("node:fs",), ("https://x",), ("@a",)], "s string") == ["react", "@a/b", None, None, None, None]
    assert values(spark, urls.chunk_stem, [("https://h/a/b-1.mjs?x",)], "u string") == ["b-1"]
    assert values(spark, urls.site_words, [("https://www.example-shop.co.test",)], "u string") == [["example-shop"]]
    assert values(spark, urls.is_hash_name, [("a1b2c3d4",), ("AbcdEfgh",), ("abcdefgh",), ("HelloWorld",), ("He110World",), ("short",)], "n string") == [True, True, False, False, True, False]
    assert values(spark, urls.common_directory, [(["/a/b/c", "/a/b/d/e"],), (["/x"],), ([],), (["/a/x", "/b/x"],)], "p array<string>") == ["/a/b/", "/", "/", "/"]
    assert values(spark, urls.relative_import, [("a/b/c.js", "a/d.js"), ("a/b.js", "a/c.js"), ("a.js", "x/y.js"), ("x/y/z.js", "w.js")], "f string, t string") == ["../d.js", "./c.js", "./x/y.js", "../../w.js"]
    assert values(spark, urls.absolutise_srcset, [("a.png 1x, /b.png 2x", "https://h.test/d/")], "s string, b string") == ["https://h.test/d/a.png 1x, https://h.test/b.png 2x"]
    assert values(spark, urls.host_dir, [("https://h.test:81/x",), ("https://h.test/x",)], "u string") == ["h.test_81", "h.test"]


@pytest.mark.parametrize(("f", "cases"), [
    (text.camel, {"hello world": "helloWorld", "fooBar-baz": "fooBarBaz", "1st": "_1st", "--": ""}),
    (text.singular, {"entries": "entry", "class": None, "boxes": "box", "users": "user", "userList": "user", "bus": None, "as": None, "List": None}),
    (text.strip_verb, {"getUser": "user", "get": "get", "fetchAll": "all", "geti": "geti"}),
    (text.upper_snake, {"fooBar baz": "FOO_BAR_BAZ"}),
    (text.kebab, {"fooBarBaz": "foo-bar-baz"}),
    (text.key_subject, {"app:userToken": "token", "my_cart_v2": "cart", "app": "app", "": ""}),
    (text.icon_name, {"arrow-left_up": "ArrowLeftUp"}),
    (text.component_name, {"app-user-list": "UserListComponent", "x-y": "YComponent", "widget": "WidgetComponent"}),
    (text.string_kind, {"/api/users": "endpoint", "https://x.test/a": "url", "/about": "path", "hello": "text", "a@b.co": "email", "//cdn.x": "url"}),
    (text.protected_email, {"7b1a3b1955181416": "a@b.com", "00": None, "zz": None, "0041": None}),
    (text.third_party, {"js.stripe.com/v3": "Stripe.js", "x.test/": None}),
    (text.decode_entities, {"a &lt;b&gt; &amp;lt;": "a <b> &lt;"}),
    (numbers.duration_name, {"86400": "ONE_DAY", "5": None}),
])
def test_names(spark, f, cases):
    assert dict(zip(cases, values(spark, f, [(c,) for c in cases], "s string"))) == cases


def test_route_name(spark):
    cases = [(["users", ":id"], False, "User"), (["users"], True, "UsersIndex"), ([], True, "Home"), ([], False, "Home"), (["*"], False, "NotFound"), (["docs", "*"], False, "DocsNotFound"), (["1x"], False, None), (["user-posts", ":id", "edit"], False, "UserPostEdit")]
    assert values(spark, text.route_name, [c[:2] for c in cases], "s array<string>, i boolean") == [c[2] for c in cases]


def test_sets_and_numbers(spark):
    assert values(spark, sets.jaccard, [(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>") == [1 / 3, 0.0]
    assert values(spark, sets.containment, [(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>") == [0.5, 0.0]
    assert values(spark, sets.distinctive, [(["A:2", "P:length", "P:foo"],)], "a array<string>") == [["P:foo"]]
    assert values(spark, numbers.ratio, [(1, 3), (1, 0)], "a int, b int") == [0.333, 0.0]
    assert values(spark, numbers.uint32, [(-1,), (1 << 33,)], "a long") == [4294967295, 0]
    assert values(spark, numbers.backoff_ms, [(0,), (3,), (9,)], "a int") == [250, 2000, 4000]
    assert values(spark, numbers.size_text, [(5,), (2048,), (3 << 20,)], "a long") == ["5 B", "2.0 KiB", "3.0 MiB"]
