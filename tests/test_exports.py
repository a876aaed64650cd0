import pytest

from bundlelens.operators import exports, readable


def imports(spark, rows):
    return spark.createDataFrame(rows, "importer string, source string, imported string, local string")


def exported(spark, rows):
    return spark.createDataFrame(rows, "module string, exported string, local string, source string")


def test_resolution(spark):
    files = spark.createDataFrame([("a/b.js",), ("a/c/index.js",), ("d.ts",)], "path string")
    specs = spark.createDataFrame([("a/x.js", "./b"), ("a/x.js", "./c"), ("a/q/y.js", "../../d"), ("a/x.js", "./none"), ("a/x.js", "./b.js")], "importer string, specifier string")
    assert {(r.specifier, r.target) for r in exports.resolve_specifiers(specs, files).collect()} == {("./b", "a/b.js"), ("./c", "a/c/index.js"), ("../../d", "d.ts"), ("./none", None), ("./b.js", "a/b.js")}


def test_forward_and_collapse(spark):
    i = imports(spark, [("app", "shim", "A", "a"), ("app", "real", "B", "b")])
    e = exported(spark, [("shim", "A", "X", "shim2"), ("shim2", "X", "Y", "real"), ("real", "Y", "y", None), ("real", "B", "b", None)])
    assert {(r.local, r.source, r.imported) for r in exports.forward(i, e).collect()} == {("a", "shim2", "X"), ("b", "real", "B")}
    own = spark.createDataFrame([("real",)], "module string")
    assert {r.module for r in exports.shims(e, own).collect()} == {"shim", "shim2"}
    assert {(r.local, r.source, r.imported) for r in exports.collapse(i, e, own).collect()} == {("a", "real", "Y"), ("b", "real", "B")}


def test_unused_merged_unified(spark):
    i = imports(spark, [("f", "m", "A", "a"), ("f", "m", "A", "z"), ("g", "n", "*", "ns")])
    e = exported(spark, [("m", "A", "a", None), ("m", "B", "b", None), ("n", "C", "c", None)])
    assert {(r.module, r.exported) for r in exports.unused(e, i).collect()} == {("m", "B")}
    assert {(r.importer, len(r.names)) for r in exports.merged(i).collect()} == {("f", 2), ("g", 1)}
    assert [tuple(r) for r in exports.unified_locals(i).collect()] == [("f", "z", "a")]


def test_consensus(spark):
    i = imports(spark, [("f", "m", "a", "useUser"), ("g", "m", "a", "useUser2"), ("h", "m", "a", "other"), ("f", "m", "b", "x1"), ("f", "m", "longName", "foo"), ("g", "m", "longName", "foo")])
    assert [tuple(r) for r in exports.consensus_names(i).collect()] == [("m", "a", "useUser")]


def test_folders(spark):
    edges = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("q", "d"), ("p", "e"), ("q", "e")], "src string, dst string")
    assert {tuple(r) for r in exports.exclusive_folders(edges).collect()} == {("a", "p"), ("b", "p"), ("c", "p")}
    units = spark.createDataFrame([("useX", "function", [], False, False, False), ("Card", "function", ["jsx"], True, False, False), ("cart", "const", ["defineStore"], False, False, False), ("MAX", "const", [], False, False, False), ("card", "function", [], True, False, False)], "name string, kind string, calls array<string>, returns_markup boolean, is_page boolean, is_icon boolean")
    assert {r.name: r.path for r in exports.destinations(exports.classify(units)).collect()} == {"useX": "src/hooks/useX.js", "Card": "src/components/Card.jsx", "card": "src/components/card-2.jsx", "cart": "src/stores/cart.js", "MAX": "src/constants/MAX.js"}
    edges = spark.createDataFrame([("src/a/x.js", "src/b/y.js"), ("src/a/x.js", "src/a/z.js")], "importer string, target string")
    assert [r.alias for r in exports.aliased(edges).orderBy("target").collect()] == [None, "@/b/y"]
    moves = spark.createDataFrame([("src/b/y.js", "lib/y.js")], "from string, to string")
    assert {r.target for r in exports.repointed(edges, moves).collect()} == {"lib/y.js", "src/a/z.js"}


def test_sole_targets(spark):
    i = imports(spark, [("p", "c1", "x", "x"), ("p", "c2", "y", "y")])
    mods = spark.createDataFrame([("c1", "m1"), ("c2", "m2"), ("c2", "m3")], "chunk string, module string")
    assert [tuple(r) for r in exports.sole_targets(i, mods).collect()] == [("p", "c1", "m1")]


PAGE = (
    '<!DOCTYPE html><html><head><link rel="preload" href="/x.js"><link rel="stylesheet" href="/s.css"><link rel="icon" href="/f.ico"/></head><body><!--$--><p>a &amp; b<br/></p><!--/$--><!-- kept -->'
    '<script src="/app.js"></script><script src="https://js.stripe.com/v3"></script><script>self.__next_f.push([])</script><script type="application/ld+json">{"a":1}</script><script>own()</script>'
    '<div hidden></div><template id="B:0"><b>x</b></template><a href="/cdn-cgi/l/email-protection" class="__cf_email__" data-cfemail="7b1a3b1955181416">[x]</a></body></html>'
)


def test_readable_page(spark):
    row = readable.readable_pages(spark.createDataFrame([(1, "https://h.test/a", PAGE)], "page_id int, url string, html string")).first()
    assert row.removed == 2 and row.third_party == ["https://js.stripe.com/v3"]
    assert row.html == (
        '<!DOCTYPE html><html><head><link rel="stylesheet" href="/s.css"><link rel="icon" href="/f.ico"/></head><body><p>a &amp; b<br/></p><!-- kept -->'
        '<!-- third-party script: js.stripe.com (Stripe.js) --><script src="https://js.stripe.com/v3"></script><script type="application/ld+json">{"a":1}</script><script>own()</script>'
        '<a href="mailto:a@b.com">a@b.com</a></body></html>'
    )


@pytest.mark.parametrize("page", [None, "", "<", "<script>", "</div>", "plain"])
def test_readable_broken(page):
    assert isinstance(readable.clean(page, None), tuple)


def test_url_attributes():
    assert readable.attribute_urls('<a href="/x"><img srcset="a 1x" alt=""><p title=q>') == [("a", "href", "/x"), ("img", "srcset", "a 1x")]


@pytest.mark.parametrize("page", ["<p>a&amp b&#65 c&x</p>", "<P >a</P >", "<?xml a?><p>b</p>", "a<!-- x --!>b", "<script>var a=1", "<title>R&a</title>\n<p>&lt</p>"])
def test_readable_as_written(page):
    """What stays is copied as it stands, references without a semicolon and odd end tags too."""
    assert readable.clean(page, None) == (page, 0, [])


def test_readable_null():
    assert readable.clean(None, None) == (None, 0, [])
