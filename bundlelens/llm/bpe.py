"""Byte-level BPE as a tokenization automaton.

The merges are compiled, one gadget after the other, into a deterministic automaton whose arcs are labelled with
tokens and which accepts exactly the token sequences that BPE produces:

* it begins with one state that has an arc back to itself for every byte;
* the gadget of a merge (u, v) sends the arcs labelled u to a copy of their target that lacks the arc v, and gives
  every state that has an arc u an arc labelled uv to where v led.

All arcs with one label lead to one state, so states are named by labels. A gadget stores what it changed: the lost
arc and its time. A state that a gadget made is a copy, so it lacks what its ancestors lost before; an arc uv exists
where the arc u did at that time. Looking an arc up follows these two chains; found arcs stay in a transition table.

A pre-split word is encoded by following the one path whose labels spell it: at each state the longest label that fits
and has an arc, and back from where none does. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How byte-level vocabularies write bytes as printable characters.
PRINTABLE_BYTES = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
# The split pattern of byte-level BPE, white space as Unicode's White_Space property has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Words kept in memory by each Python worker, in either of two generations.
MEMO_WORDS = 250_000
#: Rows of the transition table that each Python worker keeps.
MEMO_ARCS = 300_000


def byte_characters() -> dict[str, int]:
    printable = set(PRINTABLE_BYTES)
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


START = -1


class Automaton:
    """The tokenization automaton of one vocabulary, and the encoder and decoder that read it."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], added: dict[str, int]):
        """vocab: label -> id; merges: pairs of labels by rank; added: strings that are tokens of their own."""
        self.added = added
        self.labels = [b""] * (1 + max([*vocab.values(), *added.values()], default=0))
        for label, token in vocab.items():
            self.labels[token] = label
        for text, token in added.items():
            self.labels[token] = text.encode()
        n = len(self.labels)
        self.left, self.right, self.born = [-1] * n, [-1] * n, [0] * n
        self.lost: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        #: Tokens that some arc carries; a merge that can never take place makes none.
        self.match = {bytes([b]): vocab[bytes([b])] for b in range(256) if bytes([b]) in vocab}
        for time, (a, b) in enumerate(merges, 1):
            self.merge_gadget(time, vocab[a], vocab[b], vocab[a + b])
        self.compile_patterns()

    def merge_gadget(self, time: int, u: int, v: int, merged: int) -> None:
        labels = self.labels
        if labels[u] in self.match and labels[v] in self.match and self.has_arc(u, v):
            self.left[merged], self.right[merged], self.born[merged] = u, v, time
            self.lost[u << 20 | v] = time
            self.match[labels[merged]] = merged
            self.arcs.pop(u << 20 | v, None)

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state that `state`'s arcs lead to has an arc labelled `token`."""
        if state == START:
            return True
        key = state << 20 | token
        found = self.arcs.get(key)
        if found is None:
            found = self.arcs[key] = self.look_up(state, token)
        return found

    def look_up(self, state: int, token: int) -> bool:
        lost, born, copied = self.lost, self.born, 1 << 60
        while state >= 0:
            t, came = token, 1 << 60
            while t >= 0:
                when = lost.get(state << 20 | t, came + 1)
                if when < copied and when <= came:
                    return False
                came, t = born[t], self.left[t]
            copied, state = born[state], self.right[state]
        return True

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The one path through the automaton that spells the word: the longest label first, back where none goes on.

        A position has one path from the start, so a position without a way on is never tried again.
        """
        n, has_arc, labels = len(word), self.has_arc, self.labels
        ids: list[int] = []
        back: list[tuple[int, list[int]]] = []
        dead: set[int] = set()
        at, fits = 0, self.fitting(word, 0)
        while at < n:
            before = ids[-1] if ids else START
            while fits:
                token = fits.pop()
                end = at + len(labels[token])
                if end not in dead and has_arc(before, token):
                    back.append((at, fits))
                    ids.append(token)
                    at, fits = end, self.fitting(word, end) if end < n else []
                    break
            else:
                dead.add(at)
                at, fits = back.pop()
                ids.pop()
        return tuple(ids)

    def fitting(self, word: bytes, at: int) -> list[int]:
        """Tokens whose labels begin at a position of the word, the longest last."""
        get, found = self.pieces.get, []
        for end in range(at + 1, len(word) + 1):
            token = get(word[at:end])
            if token is None:
                break
            if token >= 0:
                found.append(token)
        return found

    def compile_patterns(self) -> None:
        import regex

        #: Every beginning of a label, with the token that it is or -1.
        self.pieces = dict.fromkeys((label[:i] for label in self.match for i in range(1, len(label))), -1) | self.match
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(SPLIT)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "specials", "pieces", "memo", "older", "arcs")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.arcs = {}
        self.compile_patterns()

    def remember(self, words: list[str]) -> None:
        """Encode the words that the memo lacks. It has two generations; the older is dropped when the newer is full."""
        if len(self.memo) > MEMO_WORDS:
            self.older, self.memo = self.memo, {}
        if len(self.arcs) > MEMO_ARCS:
            self.arcs = {}
        memo, older = self.memo, self.older
        for word in set(words).difference(memo):
            memo[word] = older.get(word) or self.encode_word(word.encode())

    def encode(self, text: str | None) -> list[int]:
        """Token ids of the whole text; null is empty. Strings of added tokens become these tokens."""
        ids: list[int] = []
        if not text:
            return ids
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.added:
                ids.append(self.added[part])
                continue
            words, begun = self.split.findall(part), len(ids)
            try:
                ids.extend(chain.from_iterable(map(self.memo.__getitem__, words)))
            except KeyError:
                del ids[begun:]
                for at in range(0, len(words), MEMO_WORDS):  # a very long text has more words than the memo holds
                    some = words[at : at + MEMO_WORDS]
                    self.remember(some)
                    ids.extend(chain.from_iterable(map(self.memo.__getitem__, some)))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The emitted labels' bytes as text, invalid UTF-8 replaced."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def load(path: str) -> Automaton:
    """Compile the vocabulary file of the `tokenizers` library at `path` (byte-level BPE without prefix space)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    characters = byte_characters()
    label = lambda s: bytes(characters[c] for c in s)
    model = spec["model"]
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    vocab = {label(k): v for k, v in model["vocab"].items() if k not in added}
    merges = [(label(a), label(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    return Automaton(vocab, merges, added)


def public_vocabulary() -> str:
    """The installed public vocabulary that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _texts(df: DataFrame, of: str, kind: str, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(of).cast(kind).alias("value"))


def encode(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>) of every row, the whole text encoded.

    Null and empty texts have no ids; a null or repeated doc_id is kept as it is, one row out for each row in. Other
    columns of `df`, whatever their names, are not read.
    """
    import pyarrow as pa

    codec = df.sparkSession.sparkContext.broadcast(load(path))  # its size is the vocabulary's

    def run(batches):
        for batch in batches:
            ids = [codec.value.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    found = _texts(df, text_col, "string", id_col)
    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids are no ids and give the empty text."""
    import pyarrow as pa

    codec = df.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        for batch in batches:
            texts = [codec.value.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    found = _texts(df, ids_col, "array<int>", id_col)
    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, text string")


def digests(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again in one pass, so that the
    ids need not leave the task. Edge cases as in `encode`."""
    import pyarrow as pa

    codec = df.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        own = codec.value
        decimal = [str(i) for i in range(len(own.labels))]
        for batch in batches:
            n, encoded, decoded = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py())
                n.append(len(ids))
                encoded.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    found = _texts(df, text_col, "string", id_col)
    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary())
