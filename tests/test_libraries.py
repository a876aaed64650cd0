import random

import duckdb
import pytest
from pyspark.sql import functions as F

from bundlelens.operators import closure, graphs, matching, signatures
from bundlelens.plans import libraries


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def scan(edges, taken=()):
    """The greedy assignment, one edge after the other."""
    lefts, rights, found = set(), set(taken), set()
    best = {}
    for a, b, s in edges:
        if None not in (a, b, s):
            best[a, b] = max(s, best.get((a, b), s))
    for (a, b), s in sorted(best.items(), key=lambda e: (-e[1], e[0])):
        if a not in lefts and b not in rights:
            lefts.add(a)
            rights.add(b)
            found.add((a, b, s))
    return found


def test_greedy_is_the_scan(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(25) if rng.random() > 0.03 else None, rng.choice("abcdefghijklmnop"), rng.choice([rng.randrange(6), rng.randrange(1000), None])) for _ in range(90)]
    edges += [(7, b, 5) for b in "abcdefghijklmnop"] + edges[:20]  # an end of very many edges, and edges that repeat
    df = spark.createDataFrame(edges, "left int, right string, score int").repartition(5)
    taken = spark.createDataFrame([("c",), ("d",)], "right string")
    assert rows(matching.greedy(df), "left", "right", "score") == scan(edges)
    assert rows(matching.greedy(df, taken), "left", "right", "score") == scan(edges, "cd")


def test_greedy_takes_independent_edges_at_once(spark):
    found = matching.greedy(spark.range(1000).selectExpr("id AS left", "id AS right", "id AS score"))
    assert rows(found.groupBy("round").count(), "round", "count") == {(1, 1000)}
    chain = matching.greedy(spark.createDataFrame([(0, 0, 5), (0, 1, 4), (1, 1, 3), (1, 2, 2)], "left int, right int, score int"))
    assert rows(chain, "left", "right", "round") == {(0, 0, 1), (1, 1, 2)}
    assert matching.greedy(spark.createDataFrame([], "left int, right int, score int")).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b)


def sets(rng, names, n):
    return {k: {f"{rng.choice('KSPN')}:{rng.randrange(n)}" for _ in range(rng.randint(1, 9))} for k in names}


def test_match_members_against_all_pairs(spark):
    rng = random.Random(4)
    groups = {g: (sets(rng, [f"m{i}" for i in range(25)], 12), sets(rng, [f"{i}" for i in range(25)], 12)) for g in "xy"}
    for mine, theirs in groups.values():
        mine |= {f"copy{k}": v for k, v in list(theirs.items())[:12] if len(v) > 3}
        theirs |= {f"again{k}": set(v) for k, v in list(theirs.items())[:6]}  # ties, but for what the member says itself
        mine["call"] = {"A:call", "K:zz"}
        theirs["invoke"] = {"A:call", "K:zz"}
    want = set()
    for g, (mine, theirs) in groups.items():
        for m, f in mine.items():
            if len(f) < 4 and "A:call" not in f:
                continue
            scores = {n: jaccard(f, t) for n, t in theirs.items() if n != m}
            top = max(scores.values())
            tied = [n for n, s in scores.items() if s == top]
            named = [n for n in tied if f"S:{n}" in f]
            name = tied[0] if len(tied) == 1 else named[0] if len(named) == 1 else None
            if name and top >= 0.6 and top - max((s for s in scores.values() if s < top), default=0) >= 0.1:
                want.add((g, m, name, round(top, 6)))
    mine = spark.createDataFrame([(g, m, f) for g, (x, _) in groups.items() for m, fs in x.items() for f in fs], "group string, member string, feature string")
    theirs = spark.createDataFrame([(g, n, n, f) for g, (_, y) in groups.items() for n, fs in y.items() for f in fs], "group string, candidate string, name string, feature string")
    found = {(*r[:3], round(r[3], 6)) for r in matching.match_members(mine, theirs, 0.6, 0.1).select("group", "member", "name", "score").collect()}
    assert found == want and len(want) > 10


def in_rounds(functions, calls, library, library_calls, rounds, threshold, margin):
    """Every round over every function."""
    theirs = {n: f | {f"C:{c}" for x, c in library_calls if x == n} for n, f in library.items()}
    named = {}
    for n in range(1, rounds + 1):
        wanted = {}
        for (module, fn), own in functions.items():
            if (module, fn) in named:
                continue
            own = own | {f"C:{named[module, c][0]}" for m, f, c in calls if (m, f) == (module, fn) and (module, c) in named}
            scores = {x: jaccard(own, t) for x, t in theirs.items()}
            top = max(scores.values())
            tied = [x for x, s in scores.items() if s == top]
            if len(tied) == 1 and top >= threshold and top - max(s for s in scores.values() if s < top) >= margin:
                wanted.setdefault((module, tied[0]), []).append((-top, fn))
        fresh = {(module, min(fns)[1]): (name, -min(fns)[0], n) for (module, name), fns in wanted.items() if name not in {v[0] for k, v in named.items() if k[0] == module}}
        if not fresh:
            break
        named |= fresh
    return {(*k, v[0], round(v[1], 6), v[2]) for k, v in named.items()}


def test_rounds_learn_from_what_they_named(spark):
    rng = random.Random(1)
    library = sets(rng, [f"lib{i}" for i in range(30)], 14)
    library_calls = [(f"lib{i}", f"lib{rng.randrange(30)}") for i in range(30) for _ in range(2)]
    functions, calls = {}, []
    for module in "ab":
        of = {f"{module}{i}": f"lib{i}" for i in range(30)}
        for fn, name in of.items():
            functions[module, fn] = {f for f in library[name] if rng.random() > 0.25} | {f"K:{module}{rng.randrange(9)}"}
        calls += [(module, fn, f"{module}{c[3:]}") for fn, name in of.items() for x, c in library_calls if x == name]
    want = in_rounds(functions, calls, library, library_calls, 4, 0.6, 0.1)
    assert len({w[4] for w in want}) > 1, "nothing is learned from names"
    df = lambda data, names: spark.createDataFrame(data, names)
    found, work = matching.identify_in_rounds(
        df([(*k, f) for k, fs in functions.items() for f in fs], "module string, function string, feature string"), df(calls, "module string, function string, callee string"),
        df([(n, f) for n, fs in library.items() for f in fs], "name string, feature string"), df(library_calls, "name string, callee string"), 4, 0.6, 0.1,
    )
    assert {(*r[:3], round(r[3], 6), r[4]) for r in found.select("module", "function", "name", "score", "round").collect()} == want
    assert work[0] == 60 and all(n < 60 for n in work[1:])  # callers of what was named, no others


def test_nothing_to_identify(spark):
    none = lambda names: spark.createDataFrame([], names)
    found, work = matching.identify_in_rounds(none("module string, function string, feature string"), none("module string, function string, callee string"), none("name string, feature string"), none("name string, callee string"))
    assert found.count() == 0 and work == []


def test_signatures_grow_by_increments(spark, tmp_path):
    rng = random.Random(5)
    postings = [(f"f{rng.randrange(12)}", f"x{rng.randrange(40)}") for _ in range(300)] + [(None, "x1"), ("f1", None)]
    df = spark.createDataFrame(postings, "file string, feature string")
    once, grown = (signatures.SignatureBase(spark, f"{tmp_path}/{n}", f"base_{n}", 4) for n in ("once", "grown"))
    once.add(df)
    grown.add(df.where("feature < 'x2'"))
    grown.add(df)
    grown.add(df.limit(50))
    want = {(f, x) for f, x in postings if f and x}
    for base in (once, grown):
        found = [tuple(r) for r in base.postings().select("file", "feature").collect()]
        assert len(found) == len(want) and set(found) == want
        assert rows(base.frequencies(), "feature", "files") == {(x, len({f for f, y in want if y == x})) for _, x in want}
    asked = [(m, f"x{rng.randrange(45)}") for m in range(6) for _ in range(10)]
    shared = {}
    for m, x in set(asked):
        for f in {f for f, y in want if y == x}:
            shared.setdefault((m, f), []).append(len({g for g, y in want if y == x}) <= 5)
    found = grown.lookup(spark.createDataFrame(asked, "module int, feature string"), rare=5)
    assert rows(found, "module", "file", "shared", "rare") == {(*k, len(v), sum(v)) for k, v in shared.items()}
    again = signatures.SignatureBase(spark, f"{tmp_path}/grown", "base_again", 4)  # what another session would see
    assert again.postings().count() == len(want)


def test_the_index_is_never_shuffled(spark, tmp_path):
    base = signatures.SignatureBase(spark, str(tmp_path), "base_plan", 4)
    base.add(spark.createDataFrame([("f", f"x{i}") for i in range(50)], "file string, feature string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = base.postings().join(spark.createDataFrame([("x1",)], "feature string"), "feature")._jdf.queryExecution().executedPlan().toString()
        counts = base.frequencies()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert "Exchange" not in counts


def graph(rng, n, m):
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_owners_against_fixpoints(spark, seed):
    rng = random.Random(seed)
    edges = graph(rng, 30, 34)
    seeds = [(f"n{rng.randrange(30)}", rng.choice("xyz")) for _ in range(6)] + [("alone", "x")]
    values = {}
    for node, owner in seeds:
        values.setdefault(node, set()).add(owner)
    for _ in range(60):
        for a, b in edges:
            if a in values:
                values.setdefault(b, set()).update(values[a])
    df, of = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "node string, owner string")
    assert rows(graphs.spread(df, of), "node", "owner", "conflict") == {(n, min(v) if len(v) == 1 else None, len(v) > 1) for n, v in values.items()}

    first = dict(sorted(seeds, key=lambda s: (s[0], s[1]), reverse=True))  # of a node's owners the smallest
    owners, closed = dict(first), {"n3", "n4"}
    importers = {}
    for a, b in edges:
        importers.setdefault(b, set()).add(a)
    grew = True
    while grew:
        grew = False
        for node, froms in importers.items():
            if node not in owners and node not in closed and len({owners.get(f) for f in froms}) == 1 and all(f in owners for f in froms):
                owners[node], grew = owners[next(iter(froms))], True
    assert rows(graphs.owned_by_importers(df, of, spark.createDataFrame([(c,) for c in closed], "node string")), "node", "owner") == set(owners.items())


def test_first_owners_are_those_of_walks(spark):
    rng = random.Random(2)
    edges, roots = graph(rng, 40, 60), rng.sample([f"n{i}" for i in range(40)], 6)
    owner, shared = {}, set()
    for ord_, root in enumerate(roots):
        queue = [root]
        while queue:
            node = queue.pop(0)
            if node in owner:
                if owner[node] != ord_:
                    shared.add(node)
                continue
            owner[node] = ord_
            queue += [b for a, b in edges if a == node]
    found = graphs.first_owners(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(r, i) for i, r in enumerate(roots)], "node string, ord int"))
    assert rows(found, "node", "owner", "shared") == {(n, o, n in shared) for n, o in owner.items()}


def united(edges):
    """Components, by the smallest member."""
    label = {n: n for e in edges for n in e[:2]}
    for _ in label:
        for a, b, *_ in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_hubs_and_bounds(spark):
    rng = random.Random(3)
    edges = [(*e, i) for i, e in enumerate(graph(rng, 40, 28))]
    rng.shuffle(edges)
    sizes = {f"n{i}": rng.randint(1, 9) for i in range(55)}
    df = spark.createDataFrame(edges, "src string, dst string, ord int")
    of = spark.createDataFrame(list(sizes.items()), "node string, size long")
    apart = [e for e in edges if e[0] != e[1]]
    groups = {}
    for node, root in united(apart).items():
        groups.setdefault(root, []).append(node)
    degree = {n: len({x for e in apart for x in e[:2] if n in e[:2]} - {n}) for n in united(apart)}
    want = {(min(g, key=lambda n: (-degree[n], n)), len(g), sum(sizes.get(n, 0) for n in g)) for g in groups.values()}
    assert rows(graphs.groups_with_hub(df, of, 30), "hub", "members", "size") == {w for w in want if w[2] <= 30}

    group = {n: n for n in {*sizes, *(x for e in apart for x in e[:2])}}
    weight = {n: sizes.get(n, 0) for n in group}
    for a, b, _ in sorted(apart, key=lambda e: e[2]):
        x, y = sorted((group[a], group[b]))
        if x != y and weight[x] + weight[y] <= 20:
            weight[x] += weight.pop(y)
            group = {n: x if g == y else g for n, g in group.items()}
    found = rows(graphs.bounded_groups(df, of, 20), "node", "group")
    assert found == set(group.items())


def test_numbers_without_one_task(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 AS a", "id % 3 AS b").repartition(6)
    found = closure.numbered(df, ["b", "a"], "place", 5)
    want = sorted((r.b, r.a) for r in df.collect())
    assert [(r.b, r.a, r.place) for r in found.orderBy("place").collect()] == [(*w, i) for i, w in enumerate(want, 5)]
    assert closure.numbered(df.limit(0), ["a"], "place").count() == 0


def crawl(seeds, have, producers, most):
    """The closure, one reference after the other."""
    queued, found, pending, n = set(), [], [], 0
    for url in seeds:
        if url not in queued:
            queued.add(url)
            pending.append((url, None))
    while True:
        found += [(url, parent, n, len(found) + i, url in have) for i, (url, parent) in enumerate(pending)]
        fresh, pending = [url for url, _ in pending if url in have], []
        for url in fresh:
            for p in producers:
                for ref in p.get(url, []):
                    if ref is not None and ref not in queued:
                        queued.add(ref)
                        pending.append((ref, url))
        if not pending or n == most:
            return set(found), set(pending)
        n += 1


@pytest.mark.parametrize("most", [2, 12])
def test_closure_is_the_crawl(spark, most):
    rng = random.Random(most)
    urls = [f"u{i}" for i in range(40)]
    producers = [{u: rng.sample([*urls, None], rng.randint(0, 3)) for u in urls} for _ in range(2)]
    have, seeds = set(rng.sample(urls, 28)), ["u3", "u1", "u3", "u30"]
    edges = [spark.createDataFrame([(u, r, i) for u, refs in p.items() for i, r in enumerate(refs)], "parent string, url string, ord int") for p in producers]
    of = lambda e: lambda fresh: e.join(fresh.withColumnRenamed("url", "parent").select("parent"), "parent")
    found, left = closure.closure(spark.createDataFrame(list(zip(seeds, range(4), strict=True)), "url string, ord int"), spark.createDataFrame([(h, "body") for h in have], "url string, body string"), [of(e) for e in edges], most)
    want, rest = crawl(seeds, have, producers, most)
    assert rows(found, "url", "parent", "round", "place", "loaded") == want and rows(left, "url", "parent") == rest
    assert (most == 12) == (not rest) and len(want) > 10


def test_bounded_groups_of_equal_orders(spark):
    """Edges of one order are all decided, each by itself."""
    edges = spark.createDataFrame([("a", "b", 1), ("c", "d", 1), ("b", "c", 1), ("d", "e", 2)], "src string, dst string, ord long")
    sizes = spark.createDataFrame([(n, 1) for n in "abcde"], "node string, size long")
    assert {tuple(r) for r in graphs.bounded_groups(edges, sizes, 4).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e")}


def test_clear_candidates_by_classes(spark):
    """The same as by all pairs, with one row for all copies of a set."""
    mine = [(0, f"m{i}", f) for i in range(40) for f in ("abc" if i < 30 else "xyz")] + [(0, "o", "q")]
    theirs = [(0, f"t{i}", f) for i in range(30) for f in "abd"] + [(0, "s", f) for f in "xyzw"] + [(0, "s2", f) for f in "xyzvu"] + [(0, f"n{i}", f) for i in range(5) for f in ("k", f"C:{i}")]
    mine, theirs = spark.createDataFrame(mine, "group int, member string, feature string"), spark.createDataFrame(theirs, "group int, candidate string, feature string")
    found = {tuple(r) for r in matching.clear_candidates(mine, theirs, 0.5, 0.05).collect()}
    pairs = matching.clear_best(matching.likeness(mine, theirs, 0.45), ["member"], "candidate", 0.5, 0.05)
    assert found == {tuple(r) for r in pairs.collect()} and {(m, c) for m, c, *_ in found} == {(f"m{i}", "s") for i in range(30, 40)}
    of, sets = matching.classes(theirs, "candidate", mine)
    assert (of.count(), sets.select("class").distinct().count()) == (32, 3)


def test_a_small_index_goes_to_the_rows(spark, tmp_path):
    base = signatures.SignatureBase(spark, str(tmp_path), "base_small", 4)
    base.add(spark.createDataFrame([(f"f{i % 5}", f"x{i}") for i in range(50)] + [("f0", "y"), ("f1", "y")], "file string, feature string"))
    rows = spark.createDataFrame([(m, f) for m in range(20) for f in {f"x{m}", f"x{m + 5}", "y"}], "module long, feature string")
    found = base.lookup(rows, rare=1, distinct=True)
    want = {(m, f"f{i}"): (2 * (m % 5 == i) + (i < 2), 2 * (m % 5 == i)) for m in range(20) for i in range(5) if m % 5 == i or i < 2}
    assert {(r.module, r.file): (r.shared, r.rare) for r in found.collect()} == want
    assert "hashpartitioning(feature" not in found._jdf.queryExecution().executedPlan().toString()


def test_closure_reads_what_is_captured_once_a_round(spark):
    """Producers get the rows that a round has loaded from a table of their own, not a plan over all that is captured."""
    plans = []

    def half(fresh):
        plans.append(fresh._jdf.queryExecution().optimizedPlan().toString())
        return fresh.select(F.col("url").alias("parent"), F.expr("cast(cast(url as int) div 2 as string)").alias("url"), F.lit(0).alias("ord"))

    captured = spark.range(40).select(F.col("id").cast("string").alias("url"))
    found, left = closure.closure(spark.createDataFrame([("39", 0), ("50", 1)], "url string, ord int"), captured, [half])
    assert [(r.url, r.loaded) for r in found.orderBy("place").collect()] == [("39", True), ("50", False), ("19", True), ("9", True), ("4", True), ("2", True), ("1", True), ("0", True)]
    assert left.isEmpty() and not any("Join" in p or "Range" in p for p in plans)


def test_sets_go_to_their_pairs_as_rows(spark, monkeypatch):
    """A set is one row of what members and candidates are written to, and features without a value count as before."""
    mine = [(0, f"m{i}", f) for i in range(20) for f in ["a", "b", "c", "d", f"S:t{i}", f"S:t{i}"]] + [(0, "hole", f) for f in ["a", "b", "c", None]]
    theirs = [(0, f"c{i}", f"t{i}", f) for i in range(20) for f in ["a", "b", "c", "d"]] + [(0, "again", "t3", "a")]
    mine, theirs = spark.createDataFrame(mine, "group int, member string, feature string"), spark.createDataFrame(theirs, "group int, candidate string, name string, feature string")
    counts, write = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df: counts.append(df.count()) or write(df))
    found = {tuple(r) for r in matching.match_members(mine, theirs, 0.6, 0.1).collect()}
    assert found == {(0, f"m{i}", f"t{i}", 0.8, 0.8) for i in range(20)}
    assert counts == [20, 21]
    holes = {(r.member, r.score) for r in matching.likeness(mine, theirs.where("candidate = 'c1'"), 0.5).where("member = 'hole'").collect()}
    assert holes == {("hole", 0.6)}  # 3 of the 5 of both


def bounded(edges, sizes, most):
    """The scan of bounded_groups, one edge after the other; edges of equal orders by their ends."""
    group = {n: n for n in {*sizes, *(x for a, b, _ in edges if a != b for x in (a, b))}}
    weight = {n: sizes.get(n) or 0 for n in group}
    for a, b, _ in sorted((e for e in edges if e[0] != e[1]), key=lambda e: (e[2], e[0], e[1])):
        x, y = sorted((group[a], group[b]))
        if x != y and weight[x] + weight[y] <= most:
            weight[x] += weight.pop(y)
            group = {n: x if g == y else g for n, g in group.items()}
    return set(group.items())


def test_trade_groups_reads_deals_of_all_lines(spark, tmp_path):
    """A large deal counts on whatever line of its order it is; smaller ones don't."""
    lines = [(1, 1, 1, 1, 50.0), (1, 2, 1, 2, 50.0), (2, 3, 2, 7, 50.0), (2, 2, 2, 6, 50.0), (3, 4, 3, 4, 50.0), (3, 5, 3, 5, 49.0), (4, 1, 3, 3, 50.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 40), (2, 40), (3, 1), (4, 45), (5, 1)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = [tuple(r) for r in libraries.trade_groups(spark, str(tmp_path)).collect()]
    want = {("s1", "p1"), ("p1", "p1"), ("p2", "p1"), ("s2", "p1"), ("p3", "p3"), ("s3", "p4"), ("p4", "p4")}
    assert len(found) == len(want) and set(found) == want
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.sql(libraries.TRADE_GROUPS).fetchall()) == sorted(found)


def test_edges_that_are_too_large_wait_for_none(spark, monkeypatch):
    """They are struck out in the round in which they are, not one by one in their order."""
    edges, sizes = [("a", f"z{i:02}", i) for i in range(40)], {"a": 1, "z00": 3} | {f"z{i:02}": 9 for i in range(1, 40)}
    df, of = spark.createDataFrame(edges, "src string, dst string, ord long"), spark.createDataFrame(list(sizes.items()), "node string, size long")
    tables, write = [], graphs.written
    monkeypatch.setattr(graphs, "written", lambda df: tables.append(df) or write(df))
    assert rows(graphs.bounded_groups(df, of, 4), "node", "group") == bounded(edges, sizes, 4)
    assert len(tables) < 10


@pytest.mark.parametrize("least", [0, -6])
def test_bounded_groups_are_the_scan(spark, least):
    """Sizes may be below 0, when a group that is too large may become small again."""
    rng = random.Random(least)
    edges = [(*e, rng.randrange(60)) for e in graph(rng, 40, 90)]
    sizes = {f"n{i}": rng.choice([None, *range(least, 9)]) for i in range(45) if i % 7}
    df = spark.createDataFrame(edges, "src string, dst string, ord int").repartition(3)
    found = graphs.bounded_groups(df, spark.createDataFrame(list(sizes.items()), "node string, size int"), 15)
    assert rows(found, "node", "group") == bounded(edges, sizes, 15)
