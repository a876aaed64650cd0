import random

import pytest

from bundlelens.operators import closure, leaders, reports, trees


def walk(edges, root):
    """Depth first, what a node stands for in its place."""
    after = {}
    for s, d, o in edges:
        if s is not None and d is not None:
            after.setdefault(s, {})
            after[s][d] = min(o, after[s].get(d, o))
    met, found, todo = set(), [], [root]
    while todo:
        node = todo.pop()
        if node not in after:
            found += [node] * (node not in found)
        elif node not in met:
            met.add(node)
            todo += [d for d, _ in sorted(after[node].items(), key=lambda e: (e[1], e[0]), reverse=True)]
    return found


@pytest.mark.parametrize("seed", range(4))
def test_expanded_is_the_walk(spark, seed):
    rng = random.Random(seed)
    n = 12 + 10 * seed
    edges = [(rng.randrange(n * 2 // 3), rng.randrange(n), rng.randrange(9)) for _ in range(2 * n)]
    edges += edges[:5] + [(None, 1, 1), (1, None, 1), (2, 2, 0)]
    df = spark.createDataFrame(edges, "src int, dst int, ord int").repartition(5)
    roots = [*range(0, n, 3), n + 1, None, 0]
    found = closure.expanded(spark.createDataFrame([(r,) for r in roots], "node int"), df).collect()
    want = {(r, t, i) for r in roots if r is not None for i, t in enumerate(walk(edges, r))}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_expanded_alone(spark):
    none = spark.createDataFrame([], "src string, dst string, ord long")
    roots = spark.createDataFrame([("a",), ("b",)], "node string")
    assert {tuple(r) for r in closure.expanded(roots, none).collect()} == {("a", "a", 0), ("b", "b", 0)}
    assert closure.expanded(roots.limit(0), none).count() == 0
    ring = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, ord long")
    assert closure.expanded(roots, ring).count() == 0
    # 2 ** 40 paths, each node kept once
    ladder = spark.createDataFrame([e for i in range(40) for e in ((f"{i}", f"{i}l", 0), (f"{i}", f"{i}r", 1), (f"{i}l", f"{i + 1}", 0), (f"{i}r", f"{i + 1}", 0))][:48], "src string, dst string, ord long")
    assert [tuple(r) for r in closure.expanded(spark.createDataFrame([("0",)], "node string"), ladder).collect()] == [("0", "12", 0)]


def scan(items, share):
    heads, found = [], {}
    for key, features in items:
        mine = {f for f in features or [] if f is not None}
        for name, theirs in heads:
            least = min(len(mine), len(theirs))
            if (not mine and not theirs) or (least and len(mine & theirs) / least >= share - 1e-9):
                found[key] = name
                break
        else:
            heads.append((key, mine))
            found[key] = key
    return found


@pytest.mark.parametrize(("share", "words", "first"), [(0.5, 25, 4), (0.5, 60, 16), (0.3, 40, 256), (1.0, 12, 1), (0.75, 20, 7)])
def test_clusters_are_the_scan(spark, monkeypatch, share, words, first):
    monkeypatch.setattr(leaders, "FIRST_BATCH", first)
    rng = random.Random(words)
    items = [(f"k{i}", rng.choice([None, [], [None]]) if rng.random() < 0.05 else [f"w{min(rng.randrange(words), rng.randrange(words))}" for _ in range(rng.randint(1, 9))]) for i in range(300)]
    items += [(f"c{i}", [*(items[i][1] or []), "new"]) for i in range(30)]
    rng.shuffle(items)
    rows = [(k, i // 2, f, "x") for i, (k, f) in enumerate(items)]  # ties in ord go by key
    df = spark.createDataFrame(rows, "key string, ord int, features array<string>, leader string").repartition(6)
    found = leaders.clusters(df, share).collect()
    assert {r.key: r.leader for r in found} == scan([(k, f) for k, _, f, _ in sorted(rows, key=lambda r: (r[1], r[0]))], share)
    assert len(found) == len(rows)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([], "key string, ord int, features array<string>")
    assert leaders.clusters(df).count() == 0
    chain = spark.createDataFrame([(i, i, [i, i + 1]) for i in range(40)], "key int, ord int, features array<int>")
    assert {tuple(r) for r in leaders.clusters(chain).collect()} == {(i, i - i % 2) for i in range(40)}


MARKUP = """<body><ul class=m> <li>one</li>
<li>two</li><li>two</li></ul><ul><li>a</li><li>a</li><li>a</li></ul><p>x</p>and<p>y</p><p>z</p><!-- c --><p>w</p>
<div><i>1</i><i class="k">2</i><i>3</i></div><section><b>1</b></section><section><b>2</b></section><section><b>3</b></section><section><b id=q>3</b></section><td>1<td>2<td>3"""


def test_tree(spark):
    pages = spark.createDataFrame([(1, MARKUP), (2, None), (3, ""), (4, "no element")], "page_id int, html string")
    nodes = {r.node: r for r in trees.numbered(pages, ["page_id"]).collect()}
    for r in nodes.values():
        above, at = [], r.parent
        while at is not None:
            above.append(at)
            at = nodes[at].parent
        assert r.depth == len(above) and [n for n in nodes if n < r.node <= nodes[n].last] == sorted(above)
    assert len({r.shape for r in nodes.values() if r.tag == "section"}) == 2
    df = trees.numbered(pages, ["page_id"])
    assert {(r.outer_tag, r.tag) for r in trees.within(df.where("tag = 'div'"), df).collect()} == {("div", "i")}
    assert trees.within(df, df).count() == sum(r.depth for r in nodes.values())


def test_repeats(spark):
    pages = spark.createDataFrame([(1, MARKUP, "x"), (2, None, "x"), (3, "<b>", "x")], "page_id int, html string, node string")
    found = [(r.page_id, r.opening, r.n, r.distinct, r["values"]) for r in trees.repeated_leaves(pages).collect()]
    assert found == [(1, "<li>", 3, 2, ["one", "two", "two"])]
    assert [(r.tag, r.n) for r in trees.repeated_shapes(pages).collect()] == [("section", 3)]
    assert trees.repeated_leaves(pages.limit(0)).count() == 0


def test_deep_and_wide(spark):
    deep, wide = "<i>" * 2000 + "</i>" * 2000, "<ul>" + "".join(f"<li>{i}</li>" for i in range(20_000)) + "</ul>"
    pages = spark.createDataFrame([(1, deep), (2, wide)], "page_id int, html string")
    assert [(r.page_id, r.n, r.distinct) for r in trees.repeated_leaves(pages).collect()] == [(2, 20_000, 20_000)]
    assert trees.numbered(pages, ["page_id"]).where("page_id = 1 AND last = 1999").count() == 2000


def test_layouts_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice("xy")], rng.choice([None, [], [rng.choice("ab"), *(rng.choice("ccd") for _ in range(rng.randint(0, 4))), rng.choice(["e", None])]])) for i in range(120)]
    rows += [(i, ["z"], ["n", "n", "n"][: 1 + i % 3]) for i in range(200, 206)]
    groups = {}
    for _, wrappers, items in rows:
        items = items or []
        groups.setdefault((*wrappers, items[0] if items else None, items[-1] if items else None), []).append(items)
    want = []
    for lists in groups.values():
        least, prefix, suffix = min(map(len, lists)), 0, 0
        while len(lists) > 1 and prefix < least and len({x[prefix] for x in lists}) == 1:
            prefix += 1
        while len(lists) > 1 and suffix < least - prefix and len({x[-1 - suffix] for x in lists}) == 1:
            suffix += 1
        want.append((len(lists), prefix, suffix))
    df = spark.createDataFrame(rows, "page_id int, wrappers array<string>, items array<string>")
    for parts in (1, 7):
        found = reports.layout_groups(df.repartition(parts))
        assert sorted((r.pages, r.prefix, r.suffix) for r in found.collect()) == sorted(want)
