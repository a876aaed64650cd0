import pytest
from pyspark.sql import functions as F

from bundlelens import adapters, job
from bundlelens.operators import naming


def test_options():
    o = job.parse_options(["in", "--out", "x", "--scope-url", "h.test/a"])
    assert (o.concurrency, o.retries, o.timeout_ms, o.max_bytes, o.max_pages, o.depth, o.scope_url) == (6, 2, 30_000, 50 << 20, 20, 2, "https://h.test/a")
    for bad in (["in"], ["in", "--out", "x", "--adapter", "none"], ["in", "--out", "x", "--scope-url", "ftp://x"], ["in", "--out", "x", "--depth", "-1"]):
        assert job.main(bad) == 2
    with pytest.raises(ValueError):
        job.scope_url("javascript://x")


def test_run(spark, tmp_path):
    spark.createDataFrame([(1, "https://h.test/", '<a href="/x">')], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([("https://h.test/m.js", 'import"./n.js";export const a=1')], "url string, body string").write.parquet(f"{tmp_path}/assets")
    args = [f"{tmp_path}/pages", "--assets", f"{tmp_path}/assets", "--out", f"{tmp_path}/out"]
    tables = job.run(spark, job.parse_options(args))
    assert {k: v.count() for k, v in tables.items()} == {"links": 1, "resources": 0, "adapters": 1, "inline_scripts": 0, "modules": 1, "diagnostics": 1, "missing": 1, "issues": 0}


def test_limits_and_issues(spark, tmp_path):
    links = lambda *to: " ".join(f'<a href="{t}">' for t in to)
    pages = [(1, "https://h.test/a/", links("b", "c", "https://other.test/")), (2, "https://h.test/a/b", links("d")), (3, "https://h.test/a/c", links("/out")), (4, "https://h.test/a/d", "<p>"), (5, "https://h.test/out", "<p>"), (6, "https://other.test/", "<p>"), (7, "https://h.test/a/unlinked", "<p>"), (8, "https://h.test/large", "x" * 2000), (9, "https://h.test/none", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([("https://h.test/m.js", None), ("https://h.test/n.js", "y" * 2000)], "url string, body string").write.parquet(f"{tmp_path}/assets")
    adapters_of = lambda *more: {r.page_id for r in job.run(spark, job.parse_options([f"{tmp_path}/pages", "--out", "x", "--max-bytes", "1000", *more]))["adapters"].collect()}
    assert adapters_of() == {1, 2, 3, 4, 5, 6, 7}
    assert adapters_of("--scope-url", "https://h.test/a/") == {1, 2, 3, 4}
    assert adapters_of("--scope-url", "https://h.test/a/", "--include-external") == {1, 2, 3, 4, 5, 6}
    assert adapters_of("--scope-url", "https://h.test/a/", "--depth", "1") == {1, 2, 3}
    assert adapters_of("--scope-url", "https://h.test/a/", "--max-pages", "2") == {1, 2}
    tables = job.run(spark, job.parse_options([f"{tmp_path}/pages", "--assets", f"{tmp_path}/assets", "--out", "x", "--max-bytes", "1000"]))
    assert {(r.url, r.issue) for r in tables["issues"].collect()} == {("https://h.test/large", "too large"), ("https://h.test/none", "empty"), ("https://h.test/m.js", "empty"), ("https://h.test/n.js", "too large")}


def test_registry(spark):
    registry = adapters.standard()
    assert "generic" in registry.names() and registry.get(None).name == "generic" and len(registry.page_signals()) == 31
    with pytest.raises(ValueError):
        registry.register(adapters.Adapter("vite"))
    with pytest.raises(ValueError):
        registry.get("nothing")
    scripts = spark.createDataFrame([("https://h.test/assets/Home-Ab12Cd34.js", "")], "url string, body string")
    assert [r.name for r in registry.hints("vite", scripts).collect()] == ["Home"] and registry.hints("webpack", scripts).count() == 0


def test_semantic_names(spark):
    code = """
    function a(x){localStorage.setItem("app:cart",x)} function b(){return fetch("/api/v1/users/"+1)} const c=e=>navigator.clipboard.writeText(e)
    function d(x){return JSON.parse(JSON.stringify(x))} function e(x,l,h){return Math.min(Math.max(x,l),h)} function f(){return 1} function g(u){return fetch("/api/orders",{method:"POST"})}
    """
    found = naming.named(naming.facts(spark.createDataFrame([("m", code)], "id string, code string"), ["id"]))
    assert {r.name: r.semantic_name for r in found.collect()} == {"a": "storeCart", "b": "fetchUsers", "c": "copyToClipboard", "d": "deepClone", "e": "clamp", "f": None, "g": "createOrders"}


def test_constants_usage_and_classes(spark):
    df = spark.createDataFrame([("86400", None, None), ("5", "itemCount", ">"), ("5", "name", "<"), ("0", "x", ">"), ("7", None, None)], "v string, s string, o string")
    assert [r[0] for r in df.select(naming.constant_name(F.col("v"), F.col("s"), F.col("o"))).collect()] == ["ONE_DAY", "MIN_ITEM_COUNT", "MAX_NAME", None, None]
    calls = spark.createDataFrame([("q", "a", ["queryKey", "queryFn"]), ("q", "a", ["queryFn"]), ("q", "b", ["mutationFn"]), ("q", "c", ["x"])], "package string, export string, keys array<string>")
    assert {tuple(r) for r in naming.usage_votes(calls).collect()} == {("q", "a", "useQuery", 2), ("q", "b", "useMutation", 1)}
    classes = spark.createDataFrame([("A", "Error", [], []), ("B", None, ["get", "post"], []), ("C", None, ["list"], ["/api/x"]), ("D", None, [], []), ("E", None, ["run"], [])], "name string, extends string, methods array<string>, strings array<string>")
    assert {r.name: r.role for r in naming.class_roles(classes).collect()} == {"A": "error", "B": "client", "C": "api", "D": "model", "E": "other"}
