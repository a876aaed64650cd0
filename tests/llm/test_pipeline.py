import hashlib
import random

from tokenizers import Tokenizer

import corpus_pipeline
from bundlelens.llm import bpe, mixing
from tests.llm import test_lines, test_mixing, test_quality, test_simhash


def documents():
    rng = random.Random(3)
    for i in range(260):
        kind = rng.choice(["plain", "plain", "copy", "near", "short", "repeats", "table"])
        words = [f"word{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        if kind == "copy":
            words = [f"copied{j}" for j in range(100)]
        elif kind == "near":
            words = [f"nearly{j}" for j in range(400)]
            words[rng.randrange(400)] = f"other{i}"
        elif kind == "short":
            words = words[:20]
        elif kind == "repeats":
            words = words[:5] * 30
        elif kind == "table":
            words[5] = "|"
        text = " ".join(words) + "\nshared footer" * (rng.random() < 0.5)
        yield i, text, rng.choice(["en", "fr"]), rng.choice(["a", "a", "b", "c"]), len(text)
    yield 900, None, None, None, None
    yield 901, "", "en", "a", 0


def brute(rows):
    kept = set(test_quality.brute_kept([(r[0], r[1], r[3]) for r in rows]))
    rows = [r for r in rows if r[0] in kept]
    stay = test_lines.brute([(r[0], r[1], r[3]) for r in rows])
    texts = [(r[0], "\n".join(s) if any(x.strip(" \t\r\x0b\f") for x in s) else r[1], *r[2:4]) for r, s in zip(rows, stay)]
    components = test_simhash.brute_similar([(r[0], r[1]) for r in texts])
    texts = [r for r, c in zip(texts, components) if r[0] == c]
    cells = {}
    kind = lambda t: "table" if " | " in t else "prose"
    for _, t, lang, s in texts:
        cells[s, lang, kind(t)] = cells.get((s, lang, kind(t)), 0) + len(t.split())
    probability = test_mixing.brute_rake(cells, {}, tolerance=mixing.TOLERANCE)
    library = Tokenizer.from_file(bpe.public_vocabulary())
    for i, t, lang, s in texts:
        if int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52 < probability[s, lang, kind(t)]:
            ids = library.encode(t, add_special_tokens=False).ids
            yield i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()


def test_run(spark, tmp_path):
    rows = list(documents())
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert 0 < kept.count() <= docs.count()
        docs = kept
    found = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == set(brute(rows)) and len(found) > 50


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Further columns, named as the operators name their own, come through; so does a table without rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _gone string, _host long, _lines string, _left int, _p double, _source string, component_id long, node string, w string, host string"
    rows = [(*r, "g", 1, "l", 2, 0.5, "s", 3, "n", "w", "h") for r in documents()]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.dtypes == docs.dtypes
        docs = after
        assert docs.limit(1).count() == 1
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
