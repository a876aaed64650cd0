import random
import re
from itertools import permutations

import pytest

from bundlelens.llm import audit

SCHEMA = "doc_id long, text string, lang string, mask string, part long, first string, w string"
NAMES = ["part", "filter_order", "step", *audit.OUTCOMES]


def failures(rows):
    """For each (doc_id, text, lang), the letters it fails."""
    for doc_id, text, _ in rows:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        yield "".join(
            letter
            for letter, fails in {
                "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
            }.items()
            if fails
        )


def replayed(rows, labels):
    """Every order applied to the documents, one filter after the other."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in range(2))
    found = {}
    fails = list(failures(rows))
    for part in {r[2] or "" for r in rows}:
        own = [(i, f) for (i, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                before, left = left, [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                redundant = sum(letter in f for _, f in own) - sum(letter in f for _, f in before)
                found[part, "".join(order), step] = [len(left), len(gone), redundant, sum(f == letter for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), counts in found.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in found.items()}


def documents():
    rng = random.Random(3)
    vocabulary = ["word", "Wörter", "UPPER CASE", "x" * 50, "a|b", "#tag", "日本", *[f"w{i}" for i in range(300)]]
    texts = [rng.choice([" ", "\t", "\n", "\x0b", "  "]).join(rng.choices(rng.choice([vocabulary, vocabulary[:2], vocabulary[7:]]), k=rng.choice([0, 1, 199, 200, 201, 400]))) for _ in range(60)]
    rows = [(rng.choice([i, i, None]) if i % 9 else 5, rng.choice([*texts, None, "", " "]), rng.choice(["en", "en", "de", None, "", "rare"])) for i in range(250)]
    labels = [(rng.choice([*range(250), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)]
    return rows, labels


def run(spark, rows, labels, n=4):
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(n)
    said = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, of string")
    return audit.audit(audit.labelled(audit.masks(docs), said))


@pytest.mark.parametrize("n", [1, 7])
def test_against_replay(spark, n):
    rows, labels = documents()
    found = [tuple(r) for r in run(spark, rows, labels, n).select(NAMES).collect()]
    assert len(found) == len(set(found)) == 600 * 4 and set(found) == replayed(rows, labels)


def test_masks(spark):
    rows, _ = documents()
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    found = sorted(("ABCDE"[i] for i in range(5) if r.mask >> i & 1) and "".join(x for i, x in enumerate("ABCDE") if r.mask >> i & 1) for r in audit.masks(docs).collect())
    assert found == sorted(failures(rows)) and len(set(found)) > 8


def test_many_parts(spark):
    """More parts than are multiplied at once."""
    rows = spark.range(500).selectExpr("concat('p', id % 150) AS part", "cast(id % 32 as int) AS mask", "id % 2 = 0 AS good", "false AS toxic")
    found = audit.audit(rows).collect()
    assert len(found) == 150 * 600 and sum(r.removed for r in found if r.filter_order == "ABCDE" and r.step == 1) == rows.where("mask & 1 = 1").count()


def test_every_order_adds_up():
    orders, of = audit.matrices(5)
    assert of["kept"].shape == (32, 600) and len(orders) == 120
    by_order = of["removed"].reshape(32, 120, 5)
    assert (by_order.sum(axis=2)[1:] == 1).all() and (by_order[0] == 0).all()
    # the shares of the filters that a mask fails are equal
    assert all(set(of["shapley"][m]) == ({0, 120 // bin(m).count("1")} if m != 31 else {24}) for m in range(1, 32))


def test_empty(spark):
    assert run(spark, [], []).count() == 0
    one = run(spark, [(1, None, None)], []).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}


def test_given_documents(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    want = con.sql(f"SELECT {', '.join(NAMES)} FROM ({audit.OP13_SQL})").fetchall()
    found = [tuple(r) for r in audit.op13_filter_audit(spark, "/root/testdata/sf0.01").select(NAMES).collect()]
    assert sorted(found) == sorted(want) and len(want) == 600 * 4
