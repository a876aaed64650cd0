import random
import re
from collections import Counter

import pytest

from bundlelens.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, f long, of string, n string"


def brute(rows, max_words=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    found = {}
    for (lang, p), a in candidates.items():
        longer = [b for (x, q), b in candidates.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= share * a for b in longer):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, own in found.items() for rank, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def documents(seed=1, n=300):
    rng = random.Random(seed)
    letters = ["a", "B", "of", "the", "New", "york", "city", "é", "ñu", " x", "日本", "x" * 300]
    fixed = ["New York City", "in the  end", "out\tof the", "à la carte"]
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(letters) for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"]) for p in parts)
        yield (i if i % 7 else None, None if i % 23 == 0 else text, rng.choice(["en", "en", "fr", None, "und", ""]), 1, "x", "y")
    yield from [(500, "same row again and again", "en", 1, "x", "y")] * 12


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("limits", "options"), [({}, {}), ({"MOST_BITS": 4, "BROADCAST_BYTES": -1, "RANKED": 7}, {"chunk": 64}), ({}, {"max_words": 5, "share": 80}), ({}, {"max_words": 2, "least": 3, "top": 5})])
def test_against_brute_force(spark, monkeypatch, limits, options):
    """Whatever the buffers, the bitmap's size and the joins."""
    for name, value in limits.items():
        monkeypatch.setattr(co, name, value)
    rows = list(documents())
    found = collected(co.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), **options))
    want = brute([(r[1], r[2]) for r in rows], **{k: v for k, v in options.items() if k != "chunk"})
    assert found == want and len(want) > 10


def test_small_chunks_cut_between_pieces():
    texts = [b"a b c. d e f, " * 50, b"", b"no break at all " * 40, b"x"]
    cut = list(co.chunks(texts, 64))
    for row, text in enumerate(texts):
        parts = [t for own in cut for r, t in own if r == row]
        assert b"".join(parts) == text and all(co.BREAK.match(p[-1:]) for p in parts[:-1])


def test_products_pass_64_bits(spark):
    parts = spark.createDataFrame([("en", "a", 4_000_000_000_000), ("en", "b", 3_000_000_000_007)], "lang string, phrase string, f long")
    cuts = spark.createDataFrame([("en", "a b", 2_999_999_999_999, 1, "a", "b")], "lang string, phrase string, a long, k int, left string, right string")
    a, x, y = 2_999_999_999_999, 4_000_000_000_000, 3_000_000_000_007
    assert co.scored(cuts, parts).first().score == 1_000_000 * a * a // (x * y)


def test_empty_and_columns(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " \t\n", "en")], "doc_id long, text string, lang string")
    assert co.collocations(nothing).count() == 0
    assert dict(co.op11_collocations(spark, "/root/testdata/sf0.001").dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"}


def test_given_documents(spark):
    """A whole given table against the SQL, which takes phrases as lists of words."""
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({co.OP11_SQL})").fetchall()
    assert collected(co.op11_collocations(spark, "/root/testdata/sf0.01")) == sorted(want) and len(want) > 1000
