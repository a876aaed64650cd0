import random

import numpy as np
import pytest
import xxhash

from bundlelens.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    """fps: list of (doc_id, fp); component of each row by following links of all pairs."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fps))]


def planted(rng, groups, size, steps):
    """Chains and clouds of fingerprints around random centres."""
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(size):
            y = x
            for _ in range(rng.randint(0, steps)):
                y ^= 1 << rng.randrange(64)
            yield y
            if rng.random() < 0.3:
                x = y


def test_fingerprint():
    rng = random.Random(1)
    vocabulary = ["a", "B", "é", "ÀB", "long-word", "x　y", "\x1c"]
    for n in [0, 1, 2, 3, 4, 5, 50, 700]:
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "\t\x0b ", "\r\n"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_keys_miss_no_pair(blocks):
    rng = random.Random(2)
    masks = simhash.masks(blocks, 4)
    for _ in range(500):
        x = y = rng.getrandbits(64)
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_forest_spans_the_pairs():
    rng = random.Random(3)
    fps = list(dict.fromkeys(planted(rng, 12, 40, 5)))
    group = np.array([rng.randrange(3) for _ in fps])
    a, b = simhash.forest(group, np.array(fps, dtype=np.uint64))
    assert all((fps[i] ^ fps[j]).bit_count() <= 4 and group[i] == group[j] for i, j in zip(a, b))
    for g in range(3):
        own = [i for i in range(len(fps)) if group[i] == g]
        want = brute_components([(i, fps[i]) for i in own])
        parent = {i: i for i in own}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in zip(a, b):
            if group[i] == g:
                parent[max(root(i), root(j))] = min(root(i), root(j))
        assert [root(i) for i in own] == want


@pytest.mark.parametrize("tile", [3, 2048])
def test_links_and_components(spark, tile):
    rng = random.Random(4)
    fps = sorted(set(planted(rng, 15, 20, 4)))
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, tile=tile)).collect()}
    want = brute_components([(simhash._signed(x), x) for x in fps])
    assert [roots.get(simhash._signed(x), simhash._signed(x)) for x in fps] == want


def test_query(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 60, 400]))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [None, "", " \n ", "same", "SAME", "same", "w " * 30_000]
    rng.shuffle(rows)
    table = [(i if i % 11 else None, t, "x") for i, t in enumerate(rows)] + [(5, rows[5], "again")]
    spark.createDataFrame(table, "doc_id long, text string, fingerprint string").write.parquet(f"{tmp_path}/documents.parquet")
    fps = [(d, brute_fingerprint(t)) for d, t, _ in table]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps))), key=str)
    assert sorted((tuple(r) for r in simhash.op1_simhash(spark, str(tmp_path)).collect()), key=str) == want


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def brute_similar(rows, similarity=0.8):
    """Component of each (doc_id, text) by links of all pairs of similar shingle sets; equal sets are one."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a and b and min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(rows))]


def near_texts(rng, groups):
    """Groups of copies with 0 to 3 of a hundred words changed, at any place."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([40, 120, 400]))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, len(own) * 3 // 100)):
                own[rng.randrange(len(own))] = word()
            yield " ".join(own)


def test_similar_texts(spark):
    rng = random.Random(6)
    texts = [*near_texts(rng, 160), None, "", "same", "SAME", "a b", "w " * 20_000]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(9, texts[9])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(3)
    found = {}
    for r in simhash.similar(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.component_id)
    want = {}
    for (d, _), c in zip(rows, brute_similar(rows)):
        want.setdefault(d, set()).add(c)
    assert found == want and sum(want[d] != {d} for d in want) > 60
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, c in found.items() if d in c or d is None}


def test_large_groups_of_similar_texts(spark, monkeypatch):
    """A group of texts of one template, each a link to the others."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(own)))
    found = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in found.collect()} == {0}


def test_similar_texts_whose_first_ones_are_not(spark, monkeypatch):
    """In every group the first text is unlike the others, which are all similar: links grow with the texts, not with the
    pairs, and none is lost."""
    monkeypatch.setattr(simhash.common_shingles, "__defaults__", (0,))
    rng = random.Random(11)
    base, hashed, no = [f"w{i}" for i in range(104)], simhash.Shingles(5), np.zeros(0, dtype=np.uint64)
    texts = []
    for i in range(200):
        own = list(base)
        own[rng.randrange(104)] = f"x{i}"
        texts.append(own)
    keys = lambda own: set(simhash.prefix(hashed(" ".join(own)), no, no, 0.8).tolist())
    least, shared = min(simhash.set_name(hashed(" ".join(t))) for t in texts), set().union(*(keys(t) for t in texts[:100])) & set().union(*(keys(t) for t in texts[100:]))
    others = []
    for i in range(100):
        window = base[i : i + 5]
        for n in range(20_000 if set(hashed(" ".join(window)).tolist()) & shared else 0):
            own = window + [f"y{i}-{n}-{k}" for k in range(12)]
            if simhash.set_name(hashed(" ".join(own))) < least and keys(own) & shared:
                others.append(own)
                break
    assert len(others) > 15
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + others)]
    seen, grow = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: seen.append(edges.count()) or grow(edges))
    found = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict(enumerate(brute_similar(rows))) and sum(c == 0 for c in found.values()) == 200
    assert sum(seen) < 10 * len(rows)  # all pairs are 100 * 199


@pytest.mark.parametrize(("outside", "most"), [(1, 1), (3000, 2)])
def test_large_groups_stay_linear(spark, outside, most):
    """Of 200 000 members few are outside the major component: they meet all, and the others meet only them."""
    n, tile = 200_000, 2048
    member = spark.range(n).selectExpr("1L AS key", "id AS node", f"if(id < {outside}, id, {n}) AS root").unionByName(spark.createDataFrame([(2, 1, 5), (2, 2, 6), (3, 1, 5), (3, 2, 5)], "key long, node long, root long"))
    parted = simhash.contested(member, tile)
    assert {(r._key, r.tiles, r.major, r.outer) for r in parted.collect()} == {(1, -(-n // tile), n, most), (2, 1, None, None)}
    units = simhash.meetings(member.join(parted, parted._key == member.key), ["node", "root"])
    assert units.where("key = 1").count() == n * most + outside * -(-n // tile)
    # each member outside meets every other one in some unit
    x, y = (units.where(f"key = 1 AND side = {s}") for s in (1, 0))
    one = x.where("node = 0").select("i", "j").join(y, ["i", "j"]).select("node").distinct()
    assert one.count() == n


def test_no_pair_is_lost(spark):
    """Texts of one template agree on many bits, and most are not similar to each other nor to any hub: all pairs are found."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    template, rows = [word() for _ in range(190)], []
    for _ in range(250):
        base = template + [word() for _ in range(50)]
        # k other words at the end: n - k shingles of n + k are shared, a coefficient of 0.8 and little more
        k = (len(base) - 4) // 9
        rows += [" ".join(base), " ".join(base[:-k] + [word() for _ in range(k)])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = dict(enumerate(brute_similar(list(enumerate(rows)))))
    assert sum(d != c for d, c in want.items()) == 250
    assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == want


@pytest.mark.parametrize(("compared", "tile", "listed"), [(2, 3, 1), (256, 2048, 50), (5, 64, 1 << 20)])
def test_small_bounds_lose_nothing(spark, monkeypatch, compared, tile, listed):
    """Comparisons cut into small parts and orders that know hardly a frequent shingle give the same result."""
    monkeypatch.setattr(simhash, "COMPARED", compared)
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(simhash.common_shingles, "__defaults__", (listed,))
    monkeypatch.setattr(simhash.other_pairs, "__defaults__", (tile,))
    rng = random.Random(9)
    shared = [f"shared{i}" for i in range(60)]
    texts = [" ".join(t.split() + shared) if i % 3 else t for i, t in enumerate(near_texts(rng, 60))]
    rows = [*enumerate(texts), (1, texts[5])]
    found, want = {}, {}
    for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        found.setdefault(r.doc_id, set()).add(r.component_id)
    for (d, _), c in zip(rows, brute_similar(rows), strict=True):
        want.setdefault(d, set()).add(c)
    assert found == want


def test_given_documents(spark):
    """All documents of a given table, against all pairs that share a shingle."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(zip([d for d, _ in rows], brute_similar(rows), strict=True))
    assert found == want and sum(d != c for d, c in want.items()) > 50


def test_wide_fingerprints():
    """Parities and pivots bound the difference of two sets from below, so that they never discard a similar pair."""
    rng = np.random.default_rng(1)
    for n in (1, 40, 3000):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: n - n // 9], rng.integers(0, 2**63, n // 9, dtype=np.uint64)])
        a, b = simhash.parities(x), simhash.parities(y)
        apart = int(np.bitwise_count(a ^ b).sum())
        assert apart <= len(set(x.tolist()) ^ set(y.tolist()))
        assert all(abs(int(np.bitwise_count(a ^ p).sum()) - int(np.bitwise_count(b ^ p).sum())) <= apart for p in simhash.wide_pivots())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.similar(none).count() == 0
