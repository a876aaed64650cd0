import hashlib
import random

import pytest

from bundlelens.llm import mixing


def brute_rake(cells, targets, fraction=mixing.FRACTION, rounds=mixing.ROUNDS, tolerance=0.0):
    """Probabilities of cells {(source, lang, topic): tokens}; goals by trying every number of values that are taken whole."""
    total = sum(cells.values())
    share = {k: v / total if total else 0.0 for k, v in cells.items()}
    goal, fraction = [], min([fraction, *(sum(v for k, v in share.items() if own.get(k[mixing.ATTRIBUTES.index(a)], 0) > 0) for a, own in targets.items())])
    for i, a in enumerate(mixing.ATTRIBUTES):
        own = {}
        for k, v in share.items():
            own[k[i]] = own.get(k[i], 0) + v
        weight = {k: float(targets[a].get(k, 0)) if a in targets else v**mixing.TEMPERATURE if v else 0.0 for k, v in own.items()}
        whole = sum(weight.values()) or 1.0
        order = sorted((k for k in own if weight[k]), key=lambda k: own[k] / weight[k])
        goal.append(dict.fromkeys(own, 0.0) | {k: own[k] for k in order})
        for n in range(len(order)):
            multiple = (fraction - sum(own[k] for k in order[:n])) / sum(weight[k] / whole for k in order[n:])
            if own[order[n]] >= multiple * weight[order[n]] / whole:
                goal[-1] |= {k: multiple * weight[k] / whole for k in order[n:]}
                break
    w = {k: fraction * v for k, v in share.items()}
    reach = lambda i, value: sum(min(share[k], w[k]) for k in w if k[i] == value)
    for _ in range(rounds):
        if all(abs(reach(i, value) / aim - 1) <= tolerance for i in range(3) for value, aim in goal[i].items() if aim):
            break
        for i in range(3):
            for value, aim in goal[i].items():
                mine = [k for k in w if k[i] == value and w[k] > 0]
                reached = lambda m: sum(min(share[k], m * w[k]) for k in mine)  # noqa: B023, E731
                low, high = 0.0, max((share[k] / w[k] for k in mine), default=0.0)
                for _ in range(80):
                    half = (low + high) / 2
                    low, high = (half, high) if reached(half) < aim else (low, half)
                w |= {k: high * w[k] if aim else 0.0 for k in mine}
    return {k: min(1.0, w[k] / share[k]) if share[k] else mixing.FRACTION for k in cells}


CELLS = {(s, lang, t): (hash_ % 97) * 10 for hash_, (s, lang, t) in enumerate(((s, lang, t) for s in "abcde" for lang in ("en", "fr", "") for t in ("prose", "table")), 3)}


@pytest.mark.parametrize("limit", [10_000, 0])
@pytest.mark.parametrize("targets", [{}, {"lang": {"en": 3, "fr": 1, "xx": 1}}, {"source": dict.fromkeys("abcde", 1.0), "topic": {"prose": 1, "table": 5}}])
def test_rake(spark, monkeypatch, limit, targets):
    monkeypatch.setattr(mixing, "ONE_PARTITION", limit)
    monkeypatch.setattr(mixing, "TOLERANCE", 0.0)
    rounds = 2 if not limit else 12
    cells = spark.createDataFrame([(*k, v) for k, v in CELLS.items()], "source string, lang string, topic string, tokens long")
    found = mixing.rake(cells, targets, rounds=rounds)
    want = brute_rake(CELLS, targets, rounds=rounds)
    assert {(r.source, r.lang, r.topic): r.probability for r in found.collect()} == pytest.approx(want, abs=1e-6)
    if limit and "lang" not in targets:  # that one asks more of some sources than they have in its languages
        for r in mixing.marginals(found).collect():
            assert r.reached == pytest.approx(r.goal, rel=0.02) and r.reached <= r.available + 1e-12
            assert r.goal == pytest.approx(r.available) or r.goal >= r.asked - 1e-12


def test_marginals_of_given_documents(spark):
    """Every value reaches its goal within a hundredth, and the fraction asked for is taken; values that fall short are
    taken whole."""
    docs = mixing.described(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    raked = mixing.rake(docs.groupBy(*mixing.ATTRIBUTES).agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "tokens"))
    found = mixing.marginals(raked).collect()
    assert all(r.reached == pytest.approx(r.goal, rel=0.01) for r in found)
    for a in mixing.ATTRIBUTES:
        assert sum(r.reached for r in found if r.attribute == a) == pytest.approx(mixing.FRACTION, rel=0.001)
    short = [r for r in found if r.asked > r.available]
    assert short and all(r.reached == pytest.approx(r.available, rel=0.01) for r in short)


def test_very_long_text_and_given_topics(spark):
    rows = [(1, "word " * 300_000, "en", "a", "x"), (2, "few words", "en", "b", "y"), (3, "few words", "en", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string")
    found = mixing.mix(docs, fraction=1.0, topic=docs.kind).collect()
    assert sorted((r.doc_id, r.topic, r.n_tokens) for r in found) == [(1, "x", 300_000), (2, "y", 2), (3, "", 2)]
    with pytest.raises(ValueError):
        mixing.mix(docs, fraction=1.5)


def test_sample_follows_probabilities(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i if i else None, rng.choice(["plain words here", "a | b | c", "x *** y", "MIT License", "", None]) , rng.choice(["en", "fr", None]), "s" if rng.random() < 0.5 else rng.choice(["t", "u", None])) for i in range(3000)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, topic string").write.parquet(f"{tmp_path}/documents.parquet")
    kind = lambda t: "table" if " | " in t else "markup" if "***" in t or "###" in t else "legal" if "licen" in t.lower() else "prose"
    cells = {}
    for _, t, lang, s in rows:
        k = (s or "", lang or "", kind(t or ""))
        cells[k] = cells.get(k, 0) + len((t or "").split())
    probability = brute_rake(cells, {}, tolerance=mixing.TOLERANCE)
    want = set()
    for i, t, lang, s in rows:
        k = (s or "", lang or "", kind(t or ""))
        p = probability[k]
        if int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52 < p:
            want.add((i, *k, len((t or "").split()), round(p, 6)))
    assert {tuple(r) for r in mixing.op3_mixing(spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want}


def test_empty(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "", "en", "s"), (2, None, None, None)], schema)).count() <= 2
