import random

import random

import pytest
from pyspark.sql import functions as F

from bundlelens.operators import detect, graphs, identify, votes
from bundlelens.plans import documents
from bundlelens.sources import http


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


GRAPH = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "d"), ("e", "f"), ("f", "f"), ("x", "y")]


def test_reach(spark):
    assert {tuple(r) for r in graphs.reach(edges(spark, GRAPH), nodes(spark, ["a"])).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.node for r in graphs.reach(edges(spark, GRAPH), nodes(spark, ["a"]), 1).collect()} == {"a", "b"}
    assert graphs.reach(edges(spark, []), nodes(spark, [])).count() == 0


def test_long_paths(spark):
    """More rounds than are kept apart."""
    chain = edges(spark, [(str(i), str(i + 1)) for i in range(20)])
    assert graphs.reach(chain, nodes(spark, ["0"])).count() == 21


def test_aliases(spark):
    found = graphs.aliases(edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "p")]), 3)
    assert {tuple(r) for r in found.collect()} == {("a", "d", 3), ("b", "d", 2), ("c", "d", 1), ("p", "q", 3), ("q", "p", 3)}


def test_all_importers(spark):
    # d has a second importer that is not in; g waits for two rounds
    e = edges(spark, [("s", "b"), ("b", "c"), ("s", "c"), ("c", "d"), ("z", "d"), ("c", "g"), ("b", "g"), ("l", "l")])
    assert {r.node for r in graphs.all_importers(e, nodes(spark, ["s"])).collect()} == {"s", "b", "c", "g"}


def test_prune(spark):
    e = edges(spark, [("app", "a"), ("x", "y"), ("y", "z"), ("z", "a"), ("w", "w"), ("p", "q"), ("q", "p")])
    assert {r.node for r in graphs.prune(e, nodes(spark, ["x", "y", "z", "a", "w", "p", "q"])).collect()} == {"x", "y", "z", "w"}
    assert graphs.prune(e, nodes(spark, ["a"])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    parent = list(range(150))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {r.node: r.component for r in graphs.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert found == {x: root(x) for p in pairs for x in p}


def test_levels_and_missing(spark):
    found = graphs.levels(edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("p", "q"), ("q", "p"), ("r", "p")]))
    assert {tuple(r) for r in found.collect()} == {("c", 0), ("b", 1), ("a", 2)}
    assert {tuple(r) for r in graphs.missing(edges(spark, [("a", "b"), ("c", "b"), ("a", "d")]), nodes(spark, ["d"])).collect()} == {("b", 2)}


def test_votes(spark):
    rows = spark.createDataFrame([("b", "x", 2, 1), ("b", "y", 1, 2), ("b", "y", 1, 3), ("c", "z", 1, 4)], "binding string, name string, weight int, ord int")
    assert {tuple(r) for r in votes.argmax(rows, ["binding"], "name", "weight", "ord").collect()} == {("b", "x", 2), ("c", "z", 1)}
    assert {(r.binding, r.name, r.n, r.total) for r in votes.consensus(rows, ["binding"], "name").collect()} == {("b", "y", 2, 3)}
    assert {(r.binding, r.name) for r in votes.unanimous(rows, ["binding"], "name").collect()} == {("c", "z")}
    row = votes.with_margin(spark.createDataFrame([("m", "p", 0.9), ("m", "q", 0.7)], "m string, p string, s double"), ["m"], "p", "s").first()
    assert (row.p, row.runner_up) == ("p", "q") and row.margin == pytest.approx(0.2)


def test_equal_content_and_unique_names(spark):
    rows = spark.createDataFrame([("u1", "x", 2), ("u2", "x", 1), ("u3", "y", 3), ("u4", None, 4)], "url string, body string, ord int")
    assert {r.url: r.duplicate_of for r in votes.first_of_equal(rows, F.col("body"), "url", "ord").collect()} == {"u1": "u2", "u2": None, "u3": None, "u4": None}
    names = spark.createDataFrame([(1, "Foo"), (2, "foo"), (3, "bar"), (4, "foo-2"), (5, "FOO")], "id int, name string")
    assert {r.id: r.unique_name for r in votes.unique_names(names, "name", "id").collect()} == {1: "Foo", 2: "foo-2-2", 3: "bar", 4: "foo-2", 5: "FOO-3"}


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_are_unique(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "A", "b"]) + rng.choice(["", "-2", "-2-2", "-3"])) for i in range(40)] + [(99, None)]
    found = votes.unique_names(spark.createDataFrame(rows, "id int, name string"), "name", "id").collect()
    names = [r.unique_name.lower() for r in found if r.name]
    assert len(found) == len(rows) and len(set(names)) == len(names)
    first = {}
    for i, n in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        first.setdefault(n.lower(), i)
    assert all(r.unique_name == r.name for r in found if r.name and first[r.name.lower()] == r.id)


def test_detection(spark):
    pages = spark.createDataFrame([(1, "/_next/static/x", {"X-Powered-By": "Next.js", "x-nextjs-cache": "1"}), (2, "plain", {}), (3, None, None)], "page_id long, html string, headers map<string,string>")
    row = detect.page_detections(pages).collect()
    assert [(r.page_id, r.adapter, r.score) for r in row] == [(1, "next", 1.0)] and len(row[0].evidence) == 3
    assert {(r.page_id, r.adapter) for r in detect.rank_adapters(pages).collect()} == {(1, "next"), (2, "generic"), (3, "generic")}
    assets = spark.createDataFrame([("s", "/a.js", "(self.webpackChunk_x=self.webpackChunk_x||[]).push([["), ("s", "/b.js", "__webpack_require__"), ("s", "/c.js", "__webpack_require__")], "site string, url string, body string")
    assert [(r.adapter, r.score) for r in detect.asset_detections(assets, ["site"]).collect()] == [("webpack", 0.9)]
    modules = spark.createDataFrame([("s", "useState(1)"), ("s", "openBlock()"), ("s", "defineStore("), ("t", "x")], "site string, code string")
    assert {tuple(r) for r in detect.framework_votes(modules, ["site"]).collect()} == {("s", "vue"), ("t", "vanilla")}


def test_services_and_third_parties(spark):
    files = spark.createDataFrame([("f", "a\nTelegram.WebApp.x\nTelegram.WebApp.y"), ("g", "")], "file string, code string")
    assert [(r.file, r.name, r.line) for r in detect.services(files).collect()] == [("f", "Telegram Mini App", 2)]
    urls = spark.createDataFrame([("https://js.stripe.com/v3/",), ("https://x.test/a",)], "url string")
    assert [r.service for r in detect.third_parties(urls).collect()] == ["js.stripe.com (Stripe.js)", "x.test"]


def test_crypto(spark):
    files = spark.createDataFrame([("sha", "[0x6a09e667,0xbb67ae85,1116352408]"), ("md5", "a(0xd76aa478);b(-389564586);c(0x5a827999,0x6ed9eba1)"), ("b64", '"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"'), ("no", "12345678;0xedb8")], "file string, code string")
    found = {(r.file, r.algorithm, r.role) for r in detect.crypto(files).collect()}
    assert ("sha", "sha256", "function") in found and ("b64", "base64", "function") in found and not any(f == "no" for f, *_ in found)


def test_string_index(spark):
    rows = [("a/b", f"f{i % 25:02}", i) for i in range(60)] + [("x", "f", 1), ("  ", "f", 1), ("/api/u", "g", 0)]
    found = {r.value: r for r in detect.string_index(spark.createDataFrame(rows, "value string, location string, ord int")).collect()}
    assert set(found) == {"a/b", "/api/u"} and found["a/b"]["count"] == 60 and found["a/b"].locations == [f"f{i:02}" for i in range(20)] and found["/api/u"].kind == "endpoint"


def test_tailwind_and_shapes(spark):
    sheets = detect.tailwind(spark.createDataFrame([("/*! tailwindcss v3.4.1 */",), ("a{--tw-x: 1}",), ("a{}",)], "css string")).collect()
    assert [(r.uses_tailwind, r.tailwind_version) for r in sheets] == [(True, "3.4.1"), (True, None), (False, None)]
    bodies = ["(self.webpackChunk=self.webpackChunk||[]).push([[1],{}])", "(globalThis.TURBOPACK=[]).push(['a'])", "var a;import{b}from'./c'", "x()"]
    assert [r[0] for r in spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").orderBy("i").select(detect.chunk_shape(F.col("b"))).collect()] == ["webpack-chunk", "turbopack-chunk", "esm", "plain"]


def feature_rows(spark, sets, key):
    return spark.createDataFrame([(k, f) for k, fs in sets.items() for f in fs], f"{key} string, feature string")


def test_identification(spark):
    lib = {"react": [f"P:r{i}" for i in range(12)], "vue": [f"P:v{i}" for i in range(12)], "tiny": ["P:t1", "P:t2"]}
    modules = {"m1": [*lib["react"], "S:x"], "m2": [*lib["react"][:6], *lib["vue"][:2]], "m3": [*lib["react"], *lib["vue"]], "m4": ["P:t1", "P:t2"]}
    found = identify.identify(feature_rows(spark, modules, "module"), feature_rows(spark, lib, "file"))
    assert {(r.module, r.file) for r in found.collect()} == {("m1", "react"), ("m3", "react")}
    whole = identify.identify_concatenated(feature_rows(spark, modules, "module"), feature_rows(spark, lib, "file"))
    assert [(r.module, r.files, r.coverage) for r in whole.collect()] == [("m3", 2, 1.0)]
    small = {"s1": ["a", "b", "c", "d"], "s2": ["a", "b"]}
    assert [(r.module, r.file) for r in identify.identify_small(feature_rows(spark, small, "module"), feature_rows(spark, {"f": ["a", "b", "c", "d", "e"]}, "file")).collect()] == [("s1", "f")]
    names = spark.createDataFrame([("m", "x"), ("m", "y"), ("n", "x")], "module string, name string")
    files = spark.createDataFrame([("f", "x"), ("f", "y"), ("g", "x")], "file string, name string")
    assert [tuple(r) for r in identify.identify_by_names(names, files).collect()] == [("m", "f")]


@pytest.mark.parametrize("share", [0.0, 0.3, 0.6, 1.0])
def test_overlaps_against_all_pairs(spark, share):
    rng = random.Random(4)
    files = {f"f{i}": set(rng.sample(range(40), rng.randint(1, 9))) for i in range(20)}
    modules = {f"m{i}": set(rng.sample(range(40), rng.randint(1, 25))) for i in range(30)}
    as_rows = lambda d, key: feature_rows(spark, {k: map(str, v) for k, v in d.items()}, key)
    found = {(r.module, r.file): (r.shared, r.of_module, r.of_file) for r in identify.overlaps(as_rows(modules, "module"), as_rows(files, "file"), share).collect()}
    assert found == {(m, f): (len(a & b), len(a), len(b)) for m, a in modules.items() for f, b in files.items() if a & b and len(a & b) >= share * len(b)}


def test_same_results_on_any_partitions(spark):
    """Whatever the number of shuffle partitions."""
    rows = [(f"u{i % 7}", "xyz"[i % 3], i % 5, i) for i in range(200)]
    got, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = spark.createDataFrame(rows, "binding string, name string, weight int, ord int")
        e = spark.createDataFrame([(i, i * 7 % 50) for i in range(50)], "src long, dst long")
        got.append((sorted(map(tuple, votes.argmax(df, ["binding"], "name", "weight", "ord").collect())), sorted(map(tuple, graphs.components(e).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


def test_rare_matches_against_all_pairs(spark):
    rng = random.Random(3)
    lib = {f"l{i}": set(rng.sample(range(60), 8)) for i in range(40)}
    own = {f"f{i}": set(list(lib[f"l{i}"])[:7]) | {100 + i} for i in range(15)}
    as_rows = lambda d: feature_rows(spark, {k: map(str, v) for k, v in d.items()}, "function")
    found = {r.function: (r.match, r.score) for r in identify.rare_matches(as_rows(own), as_rows(lib), threshold=0.6).collect()}
    want = {}
    for f, a in own.items():
        ranked = sorted(((-len(a & b) / len(a | b), k) for k, b in lib.items()))
        if -ranked[0][0] >= 0.6 and ranked[1][0] - ranked[0][0] >= 0.1:
            want[f] = (ranked[0][1], round(-ranked[0][0], 3))
    assert found == want and want


def test_cookies(spark):
    lines = ["sid=1; Path=/; HttpOnly", "lax=2; Path=/t", "none=3; SameSite=None; Secure", "old=4; Max-Age=0", "evil=5; Domain=other.test", "=6", "sid=7; Path=/", "gone=1; Expires=Wed, 21 Oct 2015 07:28:00 GMT", "wide=8; Domain=.test; Path=/"]
    headers = spark.createDataFrame([("https://h.test/t/app", line, i) for i, line in enumerate(lines)], "url string, set_cookie string, ord int")
    jar = http.store_cookies(headers, F.col("ord"), F.timestamp_seconds(F.lit(1_700_000_000)))
    asked = spark.createDataFrame([(1, "https://h.test/t/x.js", False), (2, "https://h.test/other.js", False), (3, "https://h.test/t/x.js", True), (4, "https://other.test/", False), (5, "http://h.test/t/x", False)], "request_id int, url string, cross_site boolean")
    assert {r.request_id: r.cookie for r in http.cookie_headers(asked, jar).collect()} == {1: "lax=2; none=3; sid=7; wide=8", 2: "sid=7; wide=8", 3: "none=3", 4: "wide=8", 5: "lax=2; sid=7; wide=8"}


def test_headers(spark):
    row = spark.createDataFrame([("https://h.test/a.js", "module", "https://g.test/p", None, None), ("https://h.test/", "document", None, "a=1", None)], "u string, t string, r string, c string, i boolean")
    found = [{h["name"]: h["value"] for h in r[0]} for r in row.select(http.request_headers(F.col("u"), F.col("t"), F.col("r"), F.col("c"), F.col("i"))).collect()]
    assert found[0]["origin"] == "https://g.test" and found[0]["sec-fetch-mode"] == "cors" and found[0]["referer"] == "https://g.test/" and "sec-fetch-user" not in found[0]
    assert found[1]["sec-fetch-user"] == "?1" and found[1]["cookie"] == "a=1" and found[1]["priority"] == "u=0, i" and list(found[1])[0] == "sec-ch-ua"


def test_redirects_retries_sitemaps(spark):
    ends = http.follow_redirects(edges(spark, [(f"u{i}", f"u{i + 1}") for i in range(12)]))
    assert {r.url: (r.final_url, r.failed) for r in ends.collect()}["u0"] == ("u10", True) and {r.url: r.failed for r in ends.collect()}["u5"] is False
    plan = http.retry_plan(spark.createDataFrame([(503,), (404,), (None,)], "status int")).collect()
    assert [(r.retryable, r.waits_ms) for r in plan] == [(True, [250, 500]), (False, []), (True, [250, 500])]
    maps = spark.createDataFrame([("https://h.test/sitemap.xml", "<urlset><loc> https://h.test/a?x&amp;y </loc><loc>https://o.test/</loc><loc>/n.xml</loc></urlset>"), ("https://h.test/x", "<loc>/b</loc>")], "url string, body string")
    assert {tuple(r) for r in http.sitemap_pages(maps, F.lit("https://h.test")).collect()} == {("https://h.test/a?x&y", False), ("https://h.test/n.xml", True)}
    assert [r.url for r in http.robots_sitemaps(spark.createDataFrame([("User-agent: *\nSitemap: /s.xml",)], "body string")).collect()] == ["/s.xml"]


def test_frontier(spark):
    pages = spark.createDataFrame([("https://h.test/",)], "url string")
    links = spark.createDataFrame([(1, 1, 1, "https://h.test/"), (1, 1, 2, "https://h.test/b/"), (1, 1, 3, "https://h.test/b"), (1, 2, 1, "https://h.test/c.png"), (1, 2, 2, "https://h.test/d")], "depth int, page_ord int, link_ord int, link string")
    assert [r.link for r in http.frontier(pages, links, 5).orderBy("link_ord").collect()] == ["https://h.test/b/", "https://h.test/d"]


def test_har(spark):
    log = spark.createDataFrame([(1, "https://h.test/a?x=1&y=a%20b", "parser:https://h.test/", "GET", 200, "OK", None, 12, 5)], "entry_id int, url string, initiator string, type string, status int, status_text string, error string, size int, time_ms int")
    log = log.withColumn("started_at", F.timestamp_seconds(F.lit(0))).withColumn("mime_type", F.lit("text/html")).withColumn("redirect_to", F.lit(None).cast("string"))
    log = log.withColumns({c: F.array().cast("array<struct<name:string,value:string>>") for c in ("request_headers", "response_headers")})
    pages = spark.createDataFrame([(1, "https://h.test/z"), (2, "https://h.test/")], "ord int, url string")
    entry = http.har_entries(http.page_of_entry(log, pages)).first().entry
    assert '"pageref":"page_2"' in entry and '{"name":"y","value":"a b"}' in entry and '"startedDateTime":"1970-01-01T00:00:00.000Z"' in entry


@pytest.mark.parametrize("share", [0.0, 0.3, 0.8])
def test_overlaps_where_the_rows_are(spark, share):
    """Known sizes: the same pairs, and of the modules' rows only sums by pairs are shuffled."""
    rng = random.Random(5)
    rows = lambda n, most: sorted({(i, f"w{rng.randrange(60)}") for i in range(n) for _ in range(rng.randrange(1, most))})
    modules, files = spark.createDataFrame(rows(60, 40), "module long, feature string"), spark.createDataFrame(rows(15, 12), "file long, feature string")
    sizes = modules.groupBy("module").agg(F.count("*").alias("of_module"))
    found = identify.overlaps(modules, files, share, sizes)
    columns = ["module", "file", "shared", "of_module", "of_file"]
    assert {tuple(r) for r in found.select(columns).collect()} == {tuple(r) for r in identify.overlaps(modules, files, share).select(columns).collect()}
    assert "hashpartitioning(feature" not in found._jdf.queryExecution().executedPlan().toString()


def test_first_words_without_a_shuffle(spark):
    """Where each word of a text is first, and the same index as from all places."""
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("ab bc cd de é ef ".split(" ")) for _ in range(rng.randrange(30)))) for i in range(60)] + [(60, None), (61, ""), (62, " ab  ab\tcd ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    firsts = documents.first_words(docs, "doc_id")
    want = {}
    for i, t in texts:
        for pos, w in enumerate((t or "").split()):
            want.setdefault((i, w), pos)
    assert {(r.doc_id, r.word): r.pos for r in firsts.collect()} == want and "Exchange" not in firsts._jdf.queryExecution().executedPlan().toString()
    as_rows = lambda df, name: df.select(F.col("word").alias("value"), F.col("doc_id").cast("string").alias("location"), F.struct("doc_id", "pos").alias(name))
    found = as_rows(documents.words(docs, "doc_id"), "ord")
    index = lambda df: sorted((r.value, r.kind, r["count"], tuple(r.locations)) for r in df.collect())
    assert index(detect.string_index(found, 5, as_rows(firsts, "first"))) == index(detect.string_index(found, 5))


def test_large_rounds_of_levels_stay_off_the_driver(spark):
    few, many = (graphs._dealt(spark.range(3), n) for n in (graphs.FEW, graphs.FEW + 1))
    plan = lambda df: spark.range(9).join(df, "id", "left_anti")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" in plan(many)
