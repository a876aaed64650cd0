import random

import pytest

from bundlelens.js import unpack as u
from bundlelens.js.parser import parse
from bundlelens.js.scopes import Analysis, edited, rename_edits


def module_graph(rng, ids):
    """{id: (ids it needs, names it exports)}"""
    ids = list(ids)
    return {i: (sorted(rng.sample([x for x in ids if x != i], rng.randint(0, min(3, len(ids) - 1)))), [f"v{rng.randrange(1000)}" for _ in range(rng.randint(0, 3))]) for i in ids}


def factory(rng, needs, names, style):
    """Source of a webpack factory, in one of the ways that minifiers write them."""
    m, x, q = rng.sample("abcdefghijk", 3)
    names = list(dict.fromkeys(names))
    body = (f"{q}.d({x},{{{','.join(f'{n}:()=>own{n}' for n in names)}}});" if names else "") + "".join(f"const need{i}={q}({i});" for i in needs) + "".join(f"const own{n}={rng.randrange(99)};" for n in names)
    return f"({m},{x},{q})=>{{{body}}}" if style == "arrow" else f"function({m},{x},{q}){{{body}}}"


def webpack_chunk(rng, graph, shape, style, broken=None):
    """The whole chunk; the factory of the module `broken` is the result of a call."""
    made = {i: "make(7)" if i == broken else factory(rng, *own, style) for i, own in graph.items()}
    before = ""
    if shape == "named":
        before = "".join(f"var made{i}={f};" for i, f in made.items() if i != broken)
        made = {i: f if i == broken else f"made{i}" for i, f in made.items()}
    held = "[" + ",".join(made.get(i, "") for i in range(max(made) + 1)) + "]" if shape == "array" else "{" + ",".join(f"{i}:{f}" for i, f in made.items()) + "}"
    queue = f"webpackChunk{rng.choice(['', 'shop', '_app'])}"
    return f"{before}(self.{queue}=self.{queue}||[]).push([[{rng.randrange(500)}],{held}])"


def came_back(found, graph):
    return {m.id: sorted(m.deps) for m in found.modules} == {str(i): sorted(map(str, needs)) for i, (needs, _) in graph.items()}


@pytest.mark.parametrize("style", ["arrow", "function"])
@pytest.mark.parametrize("shape", ["object", "array", "named"])
def test_webpack_graphs_come_back(shape, style):
    for seed in range(8):
        rng = random.Random(seed)
        graph = module_graph(rng, range(rng.randint(1, 9)) if shape == "array" else rng.sample(range(900), rng.randint(1, 9)))
        found = u.webpack(webpack_chunk(rng, graph, shape, style))
        assert found.level == "full" and not found.skipped and came_back(found, graph)
        assert {m.id: sorted(m.exports) for m in found.modules} == {str(i): sorted(set(names)) for i, (_, names) in graph.items()}
        for m in found.modules:
            parse(m.code)
        # a module that no factory makes is left out and told, the others stay
        broken = rng.choice(list(graph))
        found = u.webpack(webpack_chunk(random.Random(seed), graph, shape, style, broken))
        rest = {i: own for i, own in graph.items() if i != broken}
        assert came_back(found, rest) and [i for i, _ in found.skipped] == [str(broken)]
        assert found.level == ("partial" if rest else found.level)


def turbopack_chunk(rng, graph, shape, broken=None):
    def made(needs, names):
        m = rng.choice("pqrs")
        return f"{m}=>{{" + (f"{m}.s([{','.join(f'{chr(34)}{n}{chr(34)},0,own{n}' for n in names)}]);" if names else "") + "".join(f"let need{i}={m}.i({i});" for i in needs) + "".join(f"let own{n}=1;" for n in dict.fromkeys(names)) + "}"

    of = {i: "make(7)" if i == broken else made(*own) for i, own in graph.items()}
    rows = "document.currentScript," + ",".join(f"{i},{f}" for i, f in of.items()) if shape == "flat" else f'"chunks/{rng.randrange(99)}.js",{{' + ",".join(f'"{i}":{f}' for i, f in of.items()) + "}"
    return f"(globalThis.TURBOPACK||(globalThis.TURBOPACK=[])).push([{rows}])"


@pytest.mark.parametrize("shape", ["flat", "object"])
def test_turbopack_graphs_come_back(shape):
    for seed in range(8):
        rng = random.Random(seed)
        graph = module_graph(rng, rng.sample(range(900), rng.randint(2, 9)))
        found = u.turbopack(turbopack_chunk(rng, graph, shape))
        assert (found.level, found.shape) == ("full", f"turbopack-{shape}") and came_back(found, graph)
        broken = rng.choice(list(graph))
        found = u.turbopack(turbopack_chunk(random.Random(seed), graph, shape, broken))
        assert came_back(found, {i: own for i, own in graph.items() if i != broken}) and [i for i, _ in found.skipped] == [str(broken)]


def test_damaged_chunks_give_no_wrong_modules():
    """Cut or disturbed anywhere, a chunk gives modules of the graph or none, and never an error."""
    rng = random.Random(11)
    graph = module_graph(rng, rng.sample(range(900), 5))
    for whole in (webpack_chunk(rng, graph, "object", "arrow"), turbopack_chunk(rng, graph, "flat")):
        for _ in range(60):
            at = rng.randrange(len(whole))
            for damaged in (whole[:at], whole[:at] + rng.choice("{}()[],;") + whole[at:], whole[:at] + whole[at + rng.randint(1, 9) :]):
                for found in (u.webpack(damaged), u.turbopack(damaged)):
                    assert found is None or found.level in ("full", "partial", "raw")


def test_module_code():
    code = '(self.webpackChunk=[]).push([[1],{1:(e,t,n)=>{"use strict";n.r(t),n.d(t,{A:()=>r,default:()=>s});var a=n(4),r=a.x+n(5).y;const s=()=>n.e(462).then(n.bind(n,462));t.z={n}}}]);'
    m = u.webpack(code).modules[0]
    assert m.deps == ["4", "462", "5"] or sorted(m.deps) == ["4", "462", "5"]
    assert 'import * as a from "./4.js";' in m.code and 'require("./5.js").y' in m.code and 'import("./462.js")' in m.code and "export { r as A, s as default };" in m.code
    assert "exports.z={n: __webpack_require__}" in m.code and "use strict" not in m.code and m.exports == ["A", "default"]
    parse(m.code)


def test_wrapped_graphs_come_back():
    """Modules that a bundle wraps become files of their own, which the rest imports."""
    for seed in range(6):
        rng = random.Random(seed)
        names = rng.sample(["dates", "money", "tax", "cart", "route", "store"], rng.randint(2, 6))
        needs = {n: sorted(rng.sample(names[:k], rng.randint(0, min(2, k)))) for k, n in enumerate(names)}
        chunk = lambda n: f"var {n}=wrap((given,held)=>{{" + "".join(f"const need{d}={d}();" for d in needs[n]) + f"given.value{n}={rng.randrange(9)};}});"
        code = 'import{w as wrap}from"./helpers-HJKLZXCV.js";' + "".join(map(chunk, names)) + "show(" + ",".join(f"{n}().value{n}" for n in names) + ");"
        found = u.wrapped(code, "https://h.test/out/page-QAZWSXED.js")
        own = {m.id: m for m in found.modules}
        file = lambda n: f"page-QAZWSXED~{n}"
        assert (found.level, found.containers) == ("full", len(names)) and set(own) == {"page-QAZWSXED", *map(file, names)}
        assert sorted(own["page-QAZWSXED"].deps) == sorted(["helpers-HJKLZXCV", *map(file, names)])
        for n in names:
            assert f"value{n}" in own[file(n)].code and all(f'"./{file(d)}.js"' in own[file(n)].code for d in needs[n])
            parse(own[file(n)].code)


def test_esm():
    r = u.unpack('import{a}from"./vendor-ABCDEFGH.js";export const b=a+1;import("./lazy-12345678.js");import"react"', "http://h/assets/index-XXXXXXXX.js", "vite")
    assert (r.modules[0].id, sorted(r.modules[0].deps), r.modules[0].exports) == ("index-XXXXXXXX", ["lazy-12345678", "vendor-ABCDEFGH"], ["b"])
    assert u.unpack("var a=1", "x.js", "vite") is None and u.unpack(None, None, None) is None and u.unpack("(((", "x", "webpack") is None


def test_chunk_urls():
    """File names are read from the runtime's templates: lookups by id, with the id itself where a table has none."""
    code = '(()=>{var need={};need.u=k=>"js/"+({5:"basket"}[k]||k)+"-"+{5:"f00d",6:"beef"}[k]+".min.js",need.miniCssF=k=>"styles/"+{6:"cafe"}[k]+".css";need.e(6).then(go)})()'
    assert set(u.chunk_urls(code)) == {("5", "script", "js/basket-f00d.min.js"), ("6", "script", "js/6-beef.min.js"), ("6", "style", "styles/cafe.css")}
    assert u.ensured(code) == ["6"]
    older = '!function(list){function file(k){return root.p+"bundles/"+({}[k]||k)+"_"+{14:"0b5e"}[k]+".js"}var root={};root.p="/shop/"}([])'
    assert u.chunk_url(u.templates(older)["script"], "14") == "bundles/14_0b5e.js"


@pytest.mark.parametrize("body", ["(steal(document.cookie),'a.js')", "new Function(k)()", "k.split('').reverse()+'.js'", "import(k)", "top[k]=k+'.js'"])
def test_templates_are_not_run(body):
    assert u.chunk_urls(f"need.u=k=>{body};need.e(3)") == []


def test_scopes():
    code = "var a=1;function f(a,{b,c:d=a}){let e=a+b;{let a=e;g(a)}try{}catch(x){x}return{a,d}}for(let i of a)h(i)"
    analysis = Analysis(parse(code))
    assert set(analysis.free) == {"g", "h"} and set(analysis.root.bindings) == {"a", "f"}
    inner = next(s for s in analysis.scopes if s.node.type == "FunctionDeclaration")
    assert set(inner.bindings) == {"a", "b", "d", "e"}
    assert edited(code, rename_edits(inner.bindings["a"], "first")) == "var a=1;function f(first,{b,c:d=first}){let e=first+b;{let a=e;g(a)}try{}catch(x){x}return{a: first,d}}for(let i of a)h(i)"
