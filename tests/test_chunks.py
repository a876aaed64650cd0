import json

import pytest
from pyspark.sql import functions as F

from bundlelens.operators import chunks
from bundlelens.sinks import trees
from bundlelens.sources import sourcemaps

ASSETS = [
    ("https://h.test/a.js", "(self.webpackChunk=self.webpackChunk||[]).push([[1],{7:(e,t,r)=>{var x=r(8);r(9);r.d(t,{a:()=>x})},8:(e,t,r)=>{e.exports=2},10:f()}]);", "webpack"),
    ("https://h.test/b.js", "(self.webpackChunk=self.webpackChunk||[]).push([[2],{8:(e,t,r)=>{e.exports = 2}}]);", "webpack"),
    ("https://h.test/main-1.js", 'import{a}from"./dep-1.js";export const b=a;', "vite"),
    ("https://h.test/none.js", "var a=1", "webpack"),
]


@pytest.fixture(scope="module")
def unpacked(spark):
    return chunks.unpacked(spark.createDataFrame(ASSETS, "url string, body string, adapter string")).cache()


def test_modules(spark, unpacked):
    mods = chunks.modules(unpacked)
    rows = {r.id: r for r in mods.collect()}
    assert set(rows) == {"7", "8", "main-1"} and rows["8"].chunk_url.endswith("a.js") and not rows["8"].differs and rows["7"].deps == ["8", "9"]
    found = {r.chunk_url[-4:]: (r.level, r.modules, r.skipped) for r in chunks.diagnostics(unpacked).collect()}
    assert found["a.js"[-4:]] == ("partial", 2, ["10: module value is CallExpression"])
    assert {r.dst.split("\x00")[1]: r.importers for r in chunks.missing_modules(mods).collect()} == {"9": 1, "dep-1": 1}
    assert {(r.kind, r.name) for r in chunks.outlines(mods, ["id"]).where("id = 'main-1'").collect()} == {("import", "a"), ("export", "b")}


def test_aliases(spark):
    mods = spark.createDataFrame([("n", "1", 'export * from "./2.js";\n'), ("n", "2", 'export * from "./3.js";\n'), ("n", "3", "export const a = 1;")], "namespace string, id string, code string")
    assert {(r.id, r.target) for r in chunks.aliases(mods).collect()} == {("1", "3"), ("2", "3")}


def test_readable_and_names(spark):
    mods = spark.createDataFrame([("m", "try{a&&b()}catch(e){c(e)}"), ("bad", "((")], "id string, code string")
    rows = {r.id: r.code for r in chunks.readable(mods, ["id"]).collect()}
    assert "catch (error)" in rows["m"] and rows["bad"] is None
    assert {r.id: (r.total, r.mangled) for r in chunks.mangled_ratio(mods, ["id"]).collect()} == {"m": (1, 1), "bad": (0, 0)}
    assert [(r.name, r.weight) for r in chunks.name_votes(mods, ["id"]).collect()] == [("error", 5)]


def test_urls_and_lazy(spark):
    runtime = spark.createDataFrame([("https://h.test/s/rt.js", 's.p="/x/",s.u=e=>"c/"+e+"."+{3:"ab"}[e]+".js";s.e(3);s.e("q")'), ("https://h.test/s/c.js", "(self.webpackChunk=[]).push([[3],{}])")], "url string, body string")
    assert [r.chunk_url for r in chunks.chunk_urls(runtime).where("chunk_id = '3'").collect()] == ["https://h.test/x/c/3.ab.js"]
    assert [r.chunk_id for r in chunks.lazy_state(runtime).collect()] == ["q"]


def test_routes(spark):
    code = 'router.push("/settings");l("/about/");q="/index";r="/a/b";x="/api/users";y="/logout";z="/img/a.png";w="/blog/[slug]";v="/_app";u="//cdn.x/a";t="/t/tttt/docs"'
    df = spark.createDataFrame([(code,)], "body string")
    assert sorted(r.url for r in chunks.route_candidates(df, "https://h.test", "/t/tttt").collect()) == ["https://h.test/t/tttt/about/", "https://h.test/t/tttt/docs", "https://h.test/t/tttt/settings"]
    assert [r.path for r in chunks.route_tables(spark.createDataFrame([('x={path:"/a",component:b}',)], "code string"), []).collect()] == ["/a"]


def test_styles(spark):
    v3 = "/*! tailwindcss v3.4.1 */*{margin:0}.flex{display:flex}.md\\:p-4{padding:1px}.card .mt-2{a:b}@keyframes spin{a{}}"
    sheets = spark.createDataFrame([("a", 1, v3), ("b", 2, v3), ("c", 3, ".own{x:y}/*# sourceMappingURL=c.map */")], "url string, ord int, css string")
    found = {}
    for r in chunks.merged_styles(sheets).orderBy("sheet", "ord").collect():
        found.setdefault(r.target, []).append(r.text)
    assert found["app"] == [".card .mt-2{a:b}", ".own{x:y}"] and len(found["tailwind"]) == 5


def test_loaders_and_strings(spark):
    df = spark.createDataFrame([("f", 'import(x);a("/x.js","/y.css")')], "file string, code string")
    assert [(r.kind, r.line) for r in chunks.loader_findings(df, ["file"]).collect()] == [("dynamic-import", 1)]
    assert [r.value for r in chunks.unfetched(df, spark.createDataFrame([("/x.js",)], "url string")).collect()] == ["/y.css"]
    assert chunks.string_literals(df, ["file"]).count() == 2


def test_quality(spark):
    files = spark.createDataFrame([("a.js", "module", False, "var aa,longName;exports.x=1"), ("lib.js", "module", True, "var b"), ("c.css", "style", False, "")], "path string, kind string, library boolean, content string")
    mods = spark.createDataFrame([("home", None, "full"), ("module-1", "react", "partial")], "name string, package string, level string")
    row = chunks.quality(files, mods).first()
    assert (row.mangled_app, row.mangled_library, row.readable_names, row.degraded, row.exports_assignments, row.packages) == (0.5, 1.0, 0.5, 1, 1, ["react"])


def test_source_maps(spark):
    body = {"version": 3, "sources": ["webpack:///./src/a.ts", "b.ts", None], "sourcesContent": ["A", None, "C"], "mappings": ""}
    maps = spark.createDataFrame([("m", ")]}'\n" + json.dumps(body)), ("s", json.dumps({"sections": [{"map": body}], "version": 3})), ("x", "<html>")], "map_url string, body string")
    found = {(r.map_url, r.path): r.content for r in sourcemaps.sources(maps).collect()}
    assert found == {(m, p): c for m in "ms" for p, c in [("src/a.ts", "A"), ("b.ts", None), ("source-2", "C")]}
    assets = spark.createDataFrame([(1, "https://h.test/a/b.js", "x\n//# sourceMappingURL=b.js.map", None), (2, "https://h.test/c.css", "y/*# sourceMappingURL=data:a,b */", "/h.map"), (3, "https://h.test/d.js", "z", None)], "asset_id int, url string, body string, sourcemap string")
    rows = sourcemaps.candidates(assets).orderBy("asset_id", "ord").collect()
    assert [(r.asset_id, r.map_url, r.explicit) for r in rows] == [(1, "https://h.test/a/b.js.map", True), (2, "https://h.test/h.map", True), (2, "data:a,b", True), (2, "https://h.test/c.css.map", False), (3, "https://h.test/d.js.map", False)]
    urls = ["data:application/json;base64,eyJhIjoxfQ==", "data:,a%20b+c", "data:x", "data:;base64,!!"]
    assert [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(sourcemaps.data_url(F.col("u"))).collect()] == ['{"a":1}', "a b+c", None, None]


def test_tree(spark, tmp_path):
    files = spark.createDataFrame([("a", "1", 1), ("a/b.js", "2", 2), ("c.js", "3", 3), ("c.js", "4", 4), ("c.js", "3", 5), ("../../d", "5", 6)], "path string, content string, ord int")
    placed = {r.path: r.content for r in trees.placed(files).collect()}
    assert placed == {"a~dir": "1", "a/b.js": "2", "c.js": "3", "c~2.js": "4", "d": "5"}
    trees.write_tree(trees.placed(files), str(tmp_path / "out"))
    assert (tmp_path / "out/a/b.js").read_text() == "2" and (tmp_path / "out/d").read_text() == "5"
    trees.write_tree(trees.placed(files), str(tmp_path / "out"))
    (tmp_path / "other").mkdir()
    (tmp_path / "other/x").write_text("")
    with pytest.raises(FileExistsError):
        trees.write_tree(files, str(tmp_path / "other"))
    with pytest.raises(ValueError):
        trees.resolve_inside("/tmp/out", "../escape")


def test_no_file_is_lost(spark, tmp_path):
    paths = ["x.js", "x.js", "x~2.js", "x~2.js/y", "d", "d/e", "d/e/f", "d~dir", "x.js"]
    files = spark.createDataFrame([(p, f"text {i}", i) for i, p in enumerate(paths)], "path string, content string, ord int")
    placed = trees.placed(files)
    found = [r.path for r in placed.collect()]
    assert len(found) == len(set(found)) == len(paths) and not any(b.startswith(a + "/") for a in found for b in found)
    trees.write_tree(placed, str(tmp_path / "out"))
    written = sorted(p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file() and p.name != "manifest.json")
    assert written == [f"text {i}" for i in range(len(paths))]


def test_reports(spark):
    one = spark.createDataFrame([(1, "x")], "n int, s string")
    assert json.loads(trees.manifest({"summary": one, "more": one}).first()[0]) == {"tool": "bundlelens", "summary": {"n": 1, "s": "x"}, "more": {"n": 1, "s": "x"}}
    imports = spark.createDataFrame([("react/jsx",), ("./x",), ("@a/b",)], "specifier string")
    assert json.loads(trees.package_json(imports, spark.createDataFrame([("react", "18.0.0")], "package string, version string")).first()[0])["dependencies"] == {"@a/b": "*", "react": "18.0.0"}
    assert trees.missing_stubs(spark.createDataFrame([("n\x009", 2)], "dst string, importers long")).first().path == "js/_missing/module-9.js"


def test_chunks_of_parts_are_dealt(spark, tmp_path):
    """Parts are a small table, whose chunks are costly to parse: they aren't joined to one task."""
    from bundlelens.plans import bundles

    spark.range(40_000).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = bundles.part_chunks(spark, str(tmp_path))
    assert found.count() == 400
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 200
