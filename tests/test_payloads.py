import pytest
import json

from pyspark.sql import functions as F

from bundlelens.operators import payloads


def pages(spark, *bodies):
    return spark.createDataFrame([(i, "https://h.test/t/app", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")


def test_hydrate():
    assert payloads.hydrate([{"a": 1, "b": 2, "c": -1}, "x", [3, 4], 5, ["Date", "2020-01-01"]]) == {"a": "x", "b": [5, "2020-01-01"], "c": None}
    assert payloads.hydrate([["Map", 1, 2], "k", ["Set", 1]]) == {"k": ["k"]}
    assert payloads.hydrate([["RegExp", "a", "g"]]) == "/a/g" and payloads.hydrate([["null", "x", 1], 7]) == {"x": 7} and payloads.hydrate([["Ref", 1], 3]) == 3
    assert payloads.hydrate([{"self": 0}]) == {"self": None} and payloads.hydrate([[5]]) == [None] and payloads.hydrate("x") == "x"


def test_shared_elements_are_resolved_once():
    assert payloads.hydrate([{"a": 1, "b": 1}, {"x": 2}, 9]) == {"a": {"x": 9}, "b": {"x": 9}}
    # each element holds the next one twice: written out, 2 ** 60 values
    doubling = [[i + 1, i + 1] for i in range(60)] + ["end"]
    with pytest.raises(ValueError):
        payloads.hydrate(doubling)
    assert payloads.hydrate_json(json.dumps(doubling)) is None


def test_nuxt_and_islands(spark):
    rows = payloads.nuxt_data(pages(spark, '<script type="application/json" id="__NUXT_DATA__">[{"a":1},"é"]</script>', "<script id='__NUXT_DATA__'>bad</script>", None)).collect()
    assert [(r.page_id, r.data) for r in rows] == [(0, '{"a":"é"}')]
    props = spark.createDataFrame([(1, '{"a":[0,"x"],"b":[1,{"c":[0,1]}],"d":[2,[[0,1]]],"e":[3,"re"]}'), (2, "{"), (3, None)], "id int, props string")
    assert {r.id: r.data for r in payloads.island_props(props, ["id"]).collect()} == {1: '{"a":"x","b":{"c":1},"d":[1],"e":"re"}', 2: None, 3: "{}"}


def test_flight(spark):
    text = '1:I["42",["7","static/chunks/a.js"],"Card"]\n2:HL["/s.css","style"]\n3:T5,é:\nab0:{"b":"build1"}\n4:bad'
    body = "".join(f"<script>self.__next_f.push([1,{json.dumps(part)}])</script>" for part in (text[:30], text[30:]))
    df = pages(spark, body, "none")
    assert payloads.flight_text(df).first().flight == text
    rows = payloads.flight(df)
    assert {(r.id, r.tag): r.value for r in rows.collect()} == {("1", "I"): '["42",["7","static/chunks/a.js"],"Card"]', ("2", "HL"): '["/s.css","style"]', ("3", "T"): '"é:\\na"', ("b0", ""): '{"b":"build1"}', ("4", ""): None}
    assert [tuple(r) for r in payloads.client_references(rows).collect()] == [(0, "42", "Card", ["static/chunks/a.js"], ["7"])]
    assert payloads.flight_text(df).select(payloads.build_id(F.col("flight"))).first()[0] == "build1"


def test_next_pages(spark):
    df = pages(spark, '<script id="__NEXT_DATA__" type="application/json">{"buildId":"b1","page":"/x"}</script><script src="/p/_next/static/chunks/m.js"></script><link href="/p/_next/static/css/s.css"><script src="/q/_next/x.js"></script>', "none")
    assert [tuple(r) for r in payloads.next_data(df).collect()] == [(0, "b1", "/x", None)]
    assert {r.page_id: r.base for r in payloads.asset_base(df).collect()} == {0: "https://h.test/p/_next/", 1: "https://h.test/_next/"}
    assert df.where("page_id = 0").select(payloads.chunk_paths("html")).first()[0] == ["/p/_next/static/chunks/m.js", "/p/_next/static/css/s.css"]


def test_reconcile():
    page = '<main><!--$?--><template id="B:0"></template><p>wait</p><!--/$--></main><div hidden id="S:0"><div>late</div></div><script>$RC("B:0","S:0")</script>'
    assert payloads.reconcile(page) == '<main><!--$?--><div>late</div><!--/$--></main><script>$RC("B:0","S:0")</script>'
    assert payloads.reconcile("plain") == "plain" and payloads.reconcile(None) is None


def test_messages():
    ast = {"t": 0, "b": {"t": 1, "c": [{"t": 2, "i": [{"t": 3, "v": "a@"}, {"t": 4, "k": "n"}]}, {"t": 2, "s": "b"}, {"t": 2, "i": [{"t": 5, "i": 0}, {"t": 6, "k": {"t": 7, "v": "key"}, "m": {"t": 8, "v": "lower"}}]}]}}
    assert payloads.message_source(ast) == "a{'@'}{n} | b | {0}@.lower:key"
    assert payloads.message_source({"t": 99}) is None and payloads.message_source(None) is None


def test_hints(spark):
    scripts = spark.createDataFrame([
        ("https://h.test/_app/immutable/nodes/0.aa.js", ""), ("https://h.test/_app/immutable/nodes/2.bb.js", ""), ("https://h.test/_app/immutable/entry/app.cc.js", 'const dictionary = {"/blog/[slug]":[-2,[1]]}; export {dictionary}'),
        ("https://h.test/assets/UserCard-Ab12Cd34.js", 'selectors:[["app-user-card"]]'),
    ], "url string, body string")
    assert [(r.route, r.node) for r in payloads.kit_routes(scripts).collect()] == [("/blog/[slug]", 2)]
    hints = payloads.kit_hints(scripts).unionByName(payloads.file_name_hints(scripts)).unionByName(payloads.angular_hints(scripts))
    assert {(r.id, r.name, r.weight) for r in hints.collect()} == {("0.aa", "Layout", 7.0), ("2.bb", "BlogSlugPage", 7.0), ("UserCard-Ab12Cd34", "UserCard", 4.0), ("UserCard-Ab12Cd34", "UserCardComponent", 7.0)}
    ids = spark.createDataFrame([("0.aa",), ("UserCard-Ab12Cd34",), ("9",)], "id string")
    assert {r.id: r.name for r in payloads.module_names(hints, ids).collect()} == {"0.aa": "Layout", "UserCard-Ab12Cd34": "UserCardComponent", "9": "module-9"}


def test_shared_references(spark):
    refs = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "a", ["x"]), (1, "b", ["x"]), (1, "c", ["z"])], "page_id int, module_id string, chunk_paths array<string>")
    assert [r.chunk for r in payloads.shared_chunks(refs).collect()] == ["x"]
    assert [r.module_id for r in payloads.references_on_every_page(refs).collect()] == ["a"]
