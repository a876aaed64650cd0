import random

import pytest

from bundlelens.llm import lines


def brute(rows, ratio=lines.RATIO, least=lines.MIN_PAGES):
    """rows: (doc_id, text, source); the lines of each text that stay, None for null."""
    gone = set()
    for host in {s or "" for _, _, s in rows}:
        own = [set((t or "").split("\n")) for _, t, s in rows if (s or "") == host]
        for line in set().union(*own):
            n = sum(line in x for x in own)
            if line.strip(" \t\r\x0b\f") and n >= least and n > ratio * len(own):
                gone.add((host, line))
    return [None if t is None else [x for x in t.split("\n") if ((s or ""), x) not in gone] for _, t, s in rows]


def table():
    rng = random.Random(1)
    for i in range(200):
        host = rng.choice(["a", "a", "b", None, f"rare{i}"])
        own = [f"line {rng.randrange(3000)}" for _ in range(rng.randint(0, 6))] + rng.choice([["menu", "menu"], ["é|footer "], [""], ["  "], ["x" * 5000]])
        rng.shuffle(own)
        yield (i if i % 17 else None, "\n".join(own) if i % 13 else None, host)
    yield from [(500, "menu", "a")] * 2
    yield from [(600 + i, "only boilerplate", "small") for i in range(5)]


@pytest.mark.parametrize("limit", [lines.BROADCAST_BYTES, -1])
def test_against_brute_force(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", limit)
    rows = list(table())
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lines string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(((i, None if x is None else "\n".join(x), 0 if x is None else t.count("\n") + 1 - len(x)) for (i, t, _), x in zip(rows, brute(rows))), key=str)
    found = lines.op9_line_dedup(spark, str(tmp_path))
    assert sorted(map(tuple, found.select("doc_id", "text", "n_dropped").collect()), key=str) == want
    assert sum(w[2] for w in want) > 50
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cleaned = lines.drop_boilerplate(docs)
    assert cleaned.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=str) == sorted(((w[0], w[1]) for w in want), key=str)


def test_clean_against_brute_force(spark):
    rows = [(i, t, h, -1, "x") for i, t, h in table()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, _lines string")
    own = lambda x: x is not None and any(line.strip(" \t\r\x0b\f") for line in x)
    want = [(i, "\n".join(x) if own(x) else t, h) for (i, t, h, *_), x in zip(rows, brute([r[:3] for r in rows]), strict=True)]
    found = lines.clean(docs)
    assert found.dtypes == docs.dtypes
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(((i, t, h, None if t is None else len(t), "x") for i, t, h in want), key=str)


def test_given_documents(spark):
    """On a given table, sites lose the line that a twelfth of their pages have, and lines of a few pages stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text")
    gone = lines.boilerplate(docs).selectExpr("host", "size(lines) AS n").collect()
    assert len(gone) == 20 and all(r.n == 1 for r in gone)
    changed = lines.drop_boilerplate(docs).toDF("doc_id", "source", "after").join(docs, "doc_id").where("text <> after").select("text", "after").collect()
    dropped = {line for text, after in changed for line in set(text.split("\n")) - set(after.split("\n"))}
    assert len(dropped) == 1 and len(changed) > 900
    # each occurrence goes, and every other line stays in its place
    assert all([line for line in text.split("\n") if line not in dropped] == (after.split("\n") if after else []) for text, after in changed)
    assert sum(text.split("\n").count(line) == 2 for text, _ in changed for line in dropped) > 100


def test_empty(spark):
    assert lines.drop_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
