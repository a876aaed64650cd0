from bundlelens.operators import html, scripts


def page(spark, body, url="https://h.test/t/app", link=None):
    return spark.createDataFrame([(1, url, body, link)], "page_id long, url string, html string, link string")


def test_resources(spark):
    """Every way in which a page names what it needs, in the order of the page; each URL once, those named twice as needed."""
    body = (
        '<link rel="stylesheet" href="theme/dark.css"><script src="//cdn.test/lib.js"></script><script type="module" src="main.mjs"></script>'
        '<link rel="prefetch" as="script" href="next-page.js"><link rel="preload" as="script" href="main-legacy.js"><script src="main-legacy.js" nomodule defer></script>'
        '<link rel="modulepreload" href="/shared/util.mjs"><link rel="apple-touch-icon" href="/touch.png"><link rel="manifest" href="app.webmanifest">'
        '<script type="text/template"><script src="no.js"></script><script type="module">export * from "../widgets/index.js"; const n = 1;</script>'
    )
    rows = html.resources(page(spark, body, "https://shop.test/de/cart", "</early.js>; rel=preload; as=script, </face.woff2>; rel=preload; as=font")).collect()
    found = {r.url: (r.type, r.optional) for r in rows}
    assert found == {
        "https://shop.test/de/theme/dark.css": ("style", False), "https://cdn.test/lib.js": ("script", False), "https://shop.test/de/main.mjs": ("module", False),
        "https://shop.test/de/next-page.js": ("script", True), "https://shop.test/de/main-legacy.js": ("script", False), "https://shop.test/shared/util.mjs": ("module", False),
        "https://shop.test/de/app.webmanifest": ("manifest", True), "https://shop.test/widgets/index.js": ("module", False), "https://shop.test/early.js": ("script", False),
    }
    order = [r.url.rsplit("/", 1)[1] for r in sorted(rows, key=lambda r: r.ord)]
    assert order.index("lib.js") < order.index("main.mjs")


def test_links_base_and_refresh(spark):
    body = '<base href="/b/"><a href="x">1</a><A HREF=\'y#z\'>2</A><a>3</a><link rel=alternate hreflang=de href="/de"><a href="mailto:q@r">4</a><p title="<a href=no>">'
    assert [r.link for r in html.page_links(page(spark, body)).orderBy("ord").collect()] == ["https://h.test/b/x", "https://h.test/b/y", "https://h.test/de"]
    assert [r.target for r in html.meta_refresh(page(spark, '<meta http-equiv="refresh" content="0; url=/next">')).collect()] == ["https://h.test/next"]


def test_inline_scripts_and_maps(spark):
    body = '<script>var a="</p>"</script><script type=module>b</script><script src=x>c</script><script type="text/plain">d</script><script> </script><script type="importmap">{"imports":{"#entry":"/e.js","bad":"mailto:x"}}</script>'
    assert [(r.code, r.module) for r in html.inline_scripts(page(spark, body)).orderBy("node").collect()] == [('var a="</p>"', False), ("b", True)]
    assert [tuple(r) for r in html.import_maps(page(spark, body)).collect()] == [(1, "#entry", "https://h.test/e.js")]


def test_islands(spark):
    row = html.islands(page(spark, '<astro-island component-url="/c.js" renderer-url="/client.svelte.js" opts="{&quot;name&quot;:&quot;Card&quot;}" client="load" props="{}"></astro-island>')).first()
    assert (row.component, row.component_url, row.framework, row.client) == ("Card", "https://h.test/c.js", "svelte", "load")


def test_null_and_broken_pages(spark):
    for body in (None, "", "<", "<a href", "<script>import('", "</p></p><b"):
        assert html.resources(page(spark, body)).count() == html.page_links(page(spark, body)).count() == 0


def test_script_resources(spark):
    """Imports and re-exports, static or not, and workers; bare package names and computed ones name no file."""
    code = "import{tax}from'../lib/tax.mjs';export{sum}from'./sum.mjs';const page=n=>import(`./p/${n}.js`),help=()=>import('/help.mjs');import'lodash';new SharedWorker(new URL('jobs/sync.js',import.meta.url));navigator.serviceWorker.register('../sw.mjs')"
    df = spark.createDataFrame([(1, "https://shop.test/js/app/start.mjs", code)], "asset_id long, url string, body string")
    found = {(r.type, r.url.removeprefix("https://shop.test")) for r in scripts.script_resources(df).collect()}
    assert found == {("module", "/js/lib/tax.mjs"), ("module", "/js/app/sum.mjs"), ("module", "/help.mjs"), ("worker", "/js/app/jobs/sync.js"), ("worker", "/js/sw.mjs")}
    sheet = spark.createDataFrame([(1, "https://shop.test/css/all.css", "@import 'fonts/a.css';\n@import url(/print.css) print;b{c:url(d.png)}")], "asset_id long, url string, body string")
    assert {r.url for r in scripts.style_resources(sheet).collect()} == {"https://shop.test/css/fonts/a.css", "https://shop.test/print.css"}


def test_tokens():
    code = r'''a = b / c / d; x = /re[/]"/g.test(y) ? `t${u + `in${v}`}e\n` : 'it\'s \u{1F600}\x41'; // "no"
/* 'no' */ return /x/; z?.5:1; 0x1F.p'''
    kinds = [(t.kind, t.value) for t in scripts.tokens(code)]
    assert [v for k, v in kinds if k == "regex"] == ['/re[/]"/g', "/x/"]
    assert [v for k, v in kinds if k == "template"] == ["t", "in", "", "e\n"]
    assert [v for k, v in kinds if k == "string"] == ["it's \U0001f600A"]
    assert [v for k, v in kinds if k == "number"] == [".5", "1", "0x1F"]
    assert [t.line for t in scripts.tokens("a\n`x\ny`\nb")] == [1, 2, 4]
    for broken in ('"open', "`open ${", "/open", "\\", "}}}", "'a\nb'"):
        list(scripts.tokens(broken))


def test_literals_loaders_features():
    assert scripts.string_literals('f("a",\n`b${c}d`)') == [("a", 1), ("b", 2), ("d", 2)]
    assert [k for k, _ in scripts.loaders('import(x);import("y");require(z);require("q");eval(s);new Worker(w);new Worker("k");new Worker(new URL("./a.js",import.meta.url));System.import(m);importScripts(u);new Function("a",b);require.ensure([]);new URL(p,import.meta.url);o.eval(x)')] == ["dynamic-import", "dynamic-require", "eval", "worker", "system-import", "import-scripts", "eval", "require-ensure", "url-import-meta"]
    assert {f for (f,) in scripts.features('x.foo({bar:1,"baz":"text"},12,JSON.parse(q))')} == {"P:foo", "K:bar", "K:baz", "S:text", "N:12", "G:JSON", "P:parse"}
    assert scripts.numeric_literals("0xffffffff,1.5,10,1e3") == [(4294967295, 1), (10, 1), (1000, 1)]
    assert scripts.seen_urls('a("/x/y.js","z.js","https://h/c.css?v")') == [("/x/y.js", 1), ("https://h/c.css?v", 1)]


def test_css_rules():
    css = '@charset "x;y";/* {note} */a{b:"}"}@media x{c{d:e}}f{g:h'
    assert [r[2] for r in scripts.css_rules(css)] == ['@charset "x;y";', "/*", "a", "@media x", "f"]
    assert [r[1] for r in scripts.css_rules(css)][1:3] == ["/* {note} */", 'a{b:"}"}']
    assert scripts.css_rules(None) == []
