import pytest
from pyspark.sql import functions as F

from bundlelens.operators import reports


def test_coverage(spark):
    none, some = spark.createDataFrame([], "x int"), spark.createDataFrame([(1,), (2,)], "x int")
    assert tuple(reports.coverage(failed=none, missing=some).first()) == (0, 2, "incomplete") and reports.coverage(failed=none).first().status == "complete"
    assert tuple(reports.summary(a=some, b=none).first()) == (2, 0)
    with pytest.raises(ValueError):
        reports.coverage()


def test_loaders_and_moves(spark):
    loaders = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "a"]), (3, [])], "finding int, strings array<string>")
    library = spark.createDataFrame([("a",), ("b",)], "value string")
    assert {r.finding: r.from_library for r in reports.library_loaders(loaders, library).collect()} == {1: True, 2: False, 3: False}
    moved = reports.relocate(spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a", "c")], "from string, to string"), "path")
    assert {r.path for r in moved.collect()} == {"c", "b"}
    failed = spark.createDataFrame([("u", "script", "HTTP 404", True), ("v", "script", "x", False), ("w", "script", None, False)], "url string, type string, error string, optional boolean")
    assert {(r.url, r.severity) for r in reports.issues(failed).collect()} == {("u", "warning"), ("v", "error")}


def test_clusters(spark):
    rows = [("b", i * 100, "react" if i % 3 else "scheduler") for i in range(9)] + [("b", 50_000 + i, "vue") for i in range(3)] + [("b", 450, None), ("c", 1, "x")]
    found = reports.clusters(spark.createDataFrame(rows, "bundle string, at int, family string"))
    assert [tuple(r) for r in found.collect()] == [("b", 1, "react", 0, 800, 6)]
    statements = spark.createDataFrame([("b", 1, None), ("b", 2, "x"), ("b", 3, None), ("b", 4, "y"), ("c", 9, None)], "bundle string, at int, banner string")
    assert {(r.bundle, r.at): r.region for r in reports.banner_regions(statements).collect()} == {("b", 1): None, ("b", 2): "x", ("b", 3): "x", ("b", 4): "y", ("c", 9): None}


def test_languages(spark):
    pages = spark.createDataFrame([("https://h.test/en/a/",), ("https://h.test/fr/a",), ("https://h.test/about",), ("https://h.test/de",)], "url string")
    assert {(r.route, tuple(r.languages), r.pages) for r in reports.localised(pages).collect()} == {("/a", ("en", "fr"), 2), ("/about", (), 1), ("/", ("de",), 1)}
    assert [r[0] for r in pages.select(reports.with_prefix(F.col("url"), "es")).collect()] == ["https://h.test/es/a/", "https://h.test/es/a", "https://h.test/es/about", "https://h.test/es/"]


def test_dictionary(spark):
    texts = spark.createDataFrame([("home", "Hello big wide world now"), ("home", "Hello big wide world"), ("home", "!!"), ("shop", "Hello"), ("shop", "Hello")], "namespace string, signature string")
    assert {(r.namespace, r.key) for r in reports.dictionary(texts).collect()} == {("home", "helloBigWideWorld"), ("home", "helloBigWideWorld2"), ("home", "text"), ("shop", "hello")}


def test_layout_groups(spark):
    rows = [(1, ["main"], ["nav", "a", "foot"]), (2, ["main"], ["nav", "b", "c", "foot"]), (3, ["x"], ["nav", "foot"])]
    found = reports.layout_groups(spark.createDataFrame(rows, "page_id int, wrappers array<string>, items array<string>"))
    assert sorted((r.pages, r.prefix, r.suffix) for r in found.collect()) == [(1, 0, 0), (2, 1, 1)]
