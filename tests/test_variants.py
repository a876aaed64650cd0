"""Inlined variants and sketches of reachable sets, against plain loops over random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from bundlelens.operators import variants

SCHEMAS = {"features": "module string, function string, feature string, depth int", "calls": "module string, function string, callee string, member int", "exported": "module string, function string, feature int"}


def frames(spark, features, calls, exported):
    """The inputs as DataFrames, with another column each whose name clashes with one of the operator's own."""
    given = {"features": features, "calls": calls, "exported": exported}
    return [spark.createDataFrame([(*r, 7) for r in rows], SCHEMAS[name]) for name, rows in given.items()]


def by_hand(features, calls, exported, hops):
    calls, exported = {c for c in calls if None not in c}, {e for e in exported if None not in e}
    own = {}
    for m, f, x in features:
        if None not in (m, f, x):
            own.setdefault((m, f), set()).add(x)
    callers = {}
    for m, f, c in calls:
        callers.setdefault((m, c), set()).add(f)
    held = {}
    for root in exported:
        level = [root]
        for _ in range(hops):
            level = [(m, c) for m, f in level for m2, f2, c in calls if (m2, f2) == (m, f) and len(callers[m, c]) == 1 and c != f and (m, c) not in exported and (m, c) in own]
            held.setdefault(root, set()).update(level)
    sets, links = set(), set()
    for (m, f), inside in held.items():
        if inside:
            sets |= {(m, f, x) for x in own.get((m, f), ())} | {(m, f, x) for i in inside for x in own[i] if not x.startswith("A:")}
            all_links = {c for m2, f2, c in calls if (m2, f2) == (m, f)} | {c for m2, f2, c in calls if (m2, f2) in inside and c != f}
            links |= {(m, f, c) for c in all_links if (m, c) not in inside}
    return sets, links


@pytest.mark.parametrize("seed,hops", [(1, 1), (2, 2), (3, 5)])
def test_inlined(spark, seed, hops):
    rng = random.Random(seed)
    name = lambda: f"f{rng.randrange(25)}"
    calls = [(rng.choice("mn"), name(), name()) for _ in range(45)] + [(None, "f1", "f2"), ("m", None, "f3"), ("m", "f1", None)]
    features = [(rng.choice("mn"), name(), rng.choice(["A:call", "S:x", "S:y", "K:1", "K:2"])) for _ in range(90)] + [("m", "f1", None), (None, "f1", "S:x")]
    exported = [(m, f"f{i}") for m in "mn" for i in range(0, 25, 3)] + [("m", None)]
    sets, links, _ = variants.inlined(*frames(spark, features * 2, calls * 2, exported), hops)
    want_sets, want_links = by_hand(features, calls, exported, hops)
    assert sorted(map(tuple, sets.collect())) == sorted(want_sets) and want_sets
    assert sorted(map(tuple, links.collect())) == sorted(want_links)


def test_cycles_and_own_calls(spark):
    """A function that calls itself, one that is called by itself alone, and a cycle without a way in are no members."""
    features = [("m", f, "S:" + f) for f in "abcd"]
    calls = [("m", "a", "a"), ("m", "b", "c"), ("m", "c", "b"), ("m", "d", "d")]
    sets, links, _ = variants.inlined(*frames(spark, features, calls, [("m", "a")]), 3)
    assert sets.count() == links.count() == 0


def test_empty(spark):
    sets, links, _ = variants.inlined(*frames(spark, [], [], []))
    assert sets.count() == links.count() == 0


def test_variant_matches(spark):
    """`whole` was published as one function; a bundle has it in two, and `plain` as it is."""
    library = [("whole", f"S:{i}") for i in range(8)] + [("plain", f"K:{i}") for i in range(8)]
    features = [("m", "p", f"S:{i}") for i in range(5)] + [("m", "q", f"S:{i}") for i in range(5, 8)] + [("m", "r", f"K:{i}") for i in range(8)] + [("m", "s", "S:99")]
    calls = [("m", "p", "q"), ("m", "r", "s")]
    found = variants.variant_matches(*frames(spark, features, calls, [("m", "p"), ("m", "r")]), spark.createDataFrame(library, "function string, feature string"))
    assert [tuple(r) for r in found.collect()] == [("m", "p", "whole", 1.0, 1.0)]


def reach_sets(features, edges, hops):
    sets = {}
    for node, x in features:
        if node is not None and x is not None:
            sets.setdefault(node, set()).add(x)
    for _ in range(hops):
        before = {n: set(s) for n, s in sets.items()}
        for a, b in edges:
            if a is not None and b is not None:
                sets.setdefault(a, set()).update(before.get(b, ()))
        sets = {n: s for n, s in sets.items() if s}
        if sets == before:
            break
    return sets


@pytest.mark.parametrize("seed,most,hops", [(1, 4, 50), (2, 1000, 50), (3, 6, 2), (4, 1, 50)])
def test_sketches(spark, seed, most, hops):
    """A sketch is the smallest hashes of the whole set, cycles included."""
    rng = random.Random(seed)
    node = lambda: f"n{rng.randrange(30)}"
    edges = [(node(), node()) for _ in range(40)] + [(None, "n1"), ("n1", None)]
    features = [(node(), f"x{rng.randrange(60)}") for _ in range(70)] + [("n1", None), (None, "x1")]
    frame = spark.createDataFrame([(*r, 1) for r in features * 2], "node string, feature string, hash int")
    got = variants.sketches(frame, spark.createDataFrame(edges * 2, "src string, dst string"), most, hops)
    sets = reach_sets(features, edges, hops)
    hashes = {r.x: r.h for r in spark.createDataFrame([(f"x{i}",) for i in range(60)], "x string").select("x", F.xxhash64("x").alias("h")).collect()}
    assert sorted(map(tuple, got.collect())) == sorted((n, h) for n, s in sets.items() for h in sorted(hashes[x] for x in s)[:most])
    sizes = {r.node: (r.size, r.exact) for r in variants.set_sizes(got, most).collect()}
    assert sizes.keys() == sets.keys() and all(sizes[n] == (len(s), True) for n, s in sets.items() if len(s) < most)


def test_reckoned_size(spark):
    """Of 20 000 features 1024 hashes tell the number within a tenth."""
    features = spark.range(20_000).select(F.lit("a").alias("node"), F.col("id").cast("string").alias("feature"))
    got = variants.set_sizes(variants.sketches(features, spark.createDataFrame([], "src string, dst string"), 1024), 1024).collect()
    assert len(got) == 1 and not got[0].exact and abs(got[0].size - 20_000) < 2_000
