import hashlib
import random

from tokenizers import Tokenizer

from bundlelens.llm import bpe

PIECES = ["a", "e", "aa", "aaa", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "é", "中", "😀", "'s", "'ll", "'", "1", "23", "²", "<|endoftext|>", "<|endof", "###", "\u0301", "\x00", "\ufeff", "İ", "_"]


def strings():
    rng = random.Random(5)
    for _ in range(3000):
        yield "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        yield "".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.choice([2, 3, 6, 26])]) for _ in range(rng.randint(0, 24)))


def test_agrees_with_the_library():
    own, library = bpe.load(bpe.public_vocabulary()), Tokenizer.from_file(bpe.public_vocabulary())
    for text in strings():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    assert own.decode([120, 200, 173]) == library.decode([120, 200, 173], skip_special_tokens=False)  # no valid UTF-8


def test_gadgets_of_a_small_vocabulary():
    """Against merging by rank, over every string of up to 7 letters: repeated letters and merges that never happen."""
    merges = [(b"a", b"a"), (b"b", b"a"), (b"aa", b"b"), (b"a", b"b"), (b"ba", b"ba"), (b"aa", b"aa"), (b"b", b"aa")]
    vocab = {b"a": 0, b"b": 1}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    own = bpe.Automaton(vocab, merges, {})

    def by_rank(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while pairs := [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(vocab[p] for p in parts)

    for n in range(1, 8):
        for x in range(2**n):
            word = bytes(b"ab"[x >> i & 1] for i in range(n))
            assert own.encode_word(word) == by_rank(word), word


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 50)
    own, library = bpe.load(bpe.public_vocabulary()), Tokenizer.from_file(bpe.public_vocabulary())
    text = " ".join(map(str, range(1000)))
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(own.memo) <= 100


def test_query(spark, tmp_path):
    texts = [None, "", "a b", "a b", "x<|endoftext|>y", "word " * 40_000, *list(strings())[:50]]
    spark.createDataFrame([(i if i else None, t, "ids") for i, t in enumerate(texts)], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(bpe.public_vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i or None, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in bpe.op4_bpe(spark, str(tmp_path)).collect()} == want


def test_operator(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    ids = bpe.encode(df, bpe.public_vocabulary())
    assert {tuple(r) for r in bpe.decode(ids, bpe.public_vocabulary()).collect()} == {(1, "hello world"), (2, "")}
    assert bpe.encode(df.limit(0), bpe.public_vocabulary()).count() == 0
