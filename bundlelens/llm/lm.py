"""Language-model scoring by a gated recurrent network in numpy.

Words are counted over all training documents. The `head` most frequent ones (and the end of text) have ids; all others
share one output, the tail. The output softmax is factored by classes: the `neural` most frequent words form classes of
`group` words with a softmax of their own, the other words of the head form classes by their last letters, the tail is a
class too; inside these last two kinds a word's share is its smoothed count. So the model gives a probability to every
word, those never seen included, and all of them sum to 1.

Texts become ids once: a table of ids, written to the shared folder, is what training and scoring read, so neither looks
words up again nor needs the vocabulary's words. Training is data-parallel: every partition runs truncated backpropagation over its training documents from the same
start, carrying the state from window to window; every window gives gradients. The replicas' weights are averaged by
their numbers of tokens, chunk by chunk and in two steps, on the executors. Scoring carries the state across windows from a
document's first word to its end, and rare words' shares are joined to the documents by a shuffle of them alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from copy import copy
from itertools import chain, repeat
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.shared import stash


class Sizes(NamedTuple):
    """The model's bounds and how it is trained."""

    head: int = 1 << 18  # words with ids
    neural: int = 2048  # words with input and output weights of their own
    group: int = 64  # words of a class of these
    suffix_classes: int = 24  # classes of the other words with ids
    suffix_inputs: int = 256  # rows of the input table for all words without one of their own
    hidden: int = 16
    lanes: int = 1024  # documents side by side
    window: int = 16  # steps of backpropagation, and of scoring, at least
    positions: int = 1 << 14  # of a window: it has more steps where there are fewer lanes
    rate: float = 0.1
    block: int = 1 << 11  # rows of a softmax at once
    tokens: int = 1 << 21  # that a task takes into memory at once
    replica: int = 4_000_000  # training tokens of a replica
    counted: int = 500_000  # words that a task counts before it passes them on
    written: int = 1 << 18  # tokens that a task encodes before it passes them on


#: Training leaves out the documents whose crc32(doc_id as text) mod 7 is this.
FOLDS, HELD_OUT = 7, 2
END = b""


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def held_out(doc_id: int | None) -> bool:
    """Null ids are the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def suffix(word: bytes, n: int) -> int:
    return (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) % n if word else 0


def count_words(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(word binary, c): counts over the training documents; the empty word is the end of text."""
    import pyarrow as pa

    def run(batches: Iterable) -> Iterator:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not held_out(doc_id):
                    found.update(words(text.as_py()))
                    found[END] += 1
                    if len(found) > sizes.counted:
                        yield rows()
        if found:
            yield rows()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Vocabulary:
    """The head's words by falling counts, their classes and inputs; sums over the rest."""

    def __init__(self, head: list[tuple[bytes, int]], n_tokens: int, n_types: int, sizes: Sizes = Sizes()):
        import numpy as np

        self.sizes = sizes
        head = sorted(head, key=lambda x: (-x[1], x[0]))
        if all(w != END for w, _ in head):
            head.append((END, 0))  # no training documents
        self.n_tokens, self.n_types = n_tokens, n_types
        self.total = n_tokens + n_types + 1.0
        self.ids = {w: i for i, (w, _) in enumerate(head)}
        self.end, self.tail = self.ids[END], len(head)
        self.counts = np.array([c for _, c in head], dtype=np.float64)
        self.neural = m = min(sizes.neural, len(head))
        self.n_neural = -(-m // sizes.group)
        self.classes = self.n_neural + sizes.suffix_classes + 1
        own = [i // sizes.group if i < m else self.n_neural + suffix(w, sizes.suffix_classes) for i, (w, _) in enumerate(head)]
        self.class_of = np.array([*own, self.classes - 1], dtype=np.int16 if self.classes < 1 << 15 else np.int32)
        self.input_of = np.array([i if i < m else m + suffix(w, sizes.suffix_inputs) for i, (w, _) in enumerate(head)] + [m], dtype=np.int32)
        weight = np.append(self.counts + 1, 0.0)
        # what the head's words leave of the smoothed total is the tail's: its words and the one never seen
        self.tail_total = max(1.0, self.total - weight.sum())
        weight[-1] = self.tail_total
        mass = np.bincount(self.class_of, weights=weight, minlength=self.classes)
        self.class_mass = mass / mass.sum()
        #: ln of a word's share of its class, for classes without weights; the tail's words get theirs by a join.
        self.share = np.log(weight / mass[self.class_of])
        self.share[:m], self.share[-1] = 0.0, 0.0
        self.base = np.append(np.log10((self.counts + 1) / self.total), 0.0)
        self.word_bias = np.log(self.counts[:m] + 1).astype(np.float32)

    def without_words(self) -> Vocabulary:
        """All but the words themselves: what training and scoring need, and small."""
        lean = copy(self)
        lean.ids = {}
        return lean

    def encode(self, text: str | None) -> tuple[Any, Any, list[bytes]]:
        """(output ids, input rows, the words of the tail) of a text and its end."""
        import numpy as np

        own = words(text)
        get = self.ids.get
        ids = np.fromiter(chain(map(get, own, repeat(-1)), (self.end,)), dtype=np.int32, count=len(own) + 1)
        inputs = self.input_of[ids]
        rare = np.nonzero(ids < 0)[0].tolist()
        tail = [own[i] for i in rare]
        if rare:
            inputs[rare] = [self.neural + suffix(w, self.sizes.suffix_inputs) for w in tail]
            ids[rare] = self.tail
        return ids, inputs, tail


class Network:
    """A layer of gated recurrent units between an input table and a class-factored softmax."""

    def __init__(self, vocabulary: Vocabulary, weights: Any = None):
        import numpy as np

        self.v, self.sizes = vocabulary, vocabulary.sizes
        h = self.sizes.hidden
        rng = np.random.default_rng(1)
        shapes = {"table": (vocabulary.neural + self.sizes.suffix_inputs, 3 * h), "recurrent": (h, 3 * h), "class_w": (h, vocabulary.classes), "class_b": (vocabulary.classes,), "word_w": (vocabulary.neural, h), "word_b": (vocabulary.neural,)}
        size = sum(math.prod(s) for s in shapes.values())
        self.flat = np.zeros(size, dtype=np.float32) if weights is None else weights.astype(np.float32)
        self.squares = None
        at = 0
        for name, shape in shapes.items():
            setattr(self, name, self.flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)
        if weights is None:  # the start is the unigram model; the recurrent part is random
            self.table[:] = rng.normal(0, 0.3, self.table.shape)
            self.recurrent[:] = rng.normal(0, 0.25, self.recurrent.shape)
            self.class_b[:] = np.log(vocabulary.class_mass + 1e-30)
            self.word_b[:] = vocabulary.word_bias

    def step(self, x, h):
        """The next state after reading rows of the input table, and what backpropagation needs."""
        import numpy as np

        a = h @ self.recurrent
        n = self.sizes.hidden
        gates = np.tanh((x[:, : 2 * n] + a[:, : 2 * n]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
        return new + z * (h - new), (h, z, r, new, a[:, 2 * n :])

    def shares(self, h, weights, bias, own, learn: bool):
        """(ln shares of the columns `own`, with `learn` the scores' gradients) of a softmax over h @ weights + bias.

        States lie within 1 of 0, so biases and weights bound every score. Where that bound is close to the largest score
        it serves as the shift, else each row's largest score does.
        """
        import numpy as np

        spread = np.abs(weights).sum(axis=0)
        shift = (bias + spread).max()
        e = h @ weights + (bias - shift)
        if spread.max() > 30:
            e -= e.max(axis=1, keepdims=True)
        rows = np.arange(len(own))
        found = e[rows, own]
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], dtype=np.float32)
        found -= np.log(total)
        if learn:
            e *= (1 / total)[:, None]
            e[rows, own] -= 1
        return found, e

    def outputs(self, h, targets, learn: bool = False):
        """ln probabilities of the targets (ids) after states h; with `learn` also the gradients."""
        import numpy as np

        v, group, block = self.v, self.sizes.group, self.sizes.block
        own = v.class_of[targets]
        # sorted by class, so that each class's rows are a slice; the sort of 16-bit numbers is linear
        order = np.argsort(own, kind="stable")
        own, h, targets = own[order], h[order], targets[order]
        found = v.share[targets]
        dh = np.empty_like(h)
        grads = {"class_w": np.zeros_like(self.class_w), "class_b": np.zeros_like(self.class_b), "word_w": np.zeros_like(self.word_w), "word_b": np.zeros_like(self.word_b)}
        for at in range(0, len(h), block):  # of a size that stays in a core's cache
            part = slice(at, at + block)
            ln, e = self.shares(h[part], self.class_w, self.class_b, own[part], learn)
            found[part] += ln
            if learn:
                grads["class_w"] += h[part].T @ e
                grads["class_b"] += e.sum(axis=0)
                dh[part] = e @ self.class_w.T
        ends = np.searchsorted(own, np.arange(v.n_neural + 1))
        for c in range(v.n_neural):
            words = slice(c * group, min((c + 1) * group, v.neural))
            for at in range(ends[c], ends[c + 1], block):
                part = slice(at, min(at + block, ends[c + 1]))
                ln, e = self.shares(h[part], self.word_w[words].T, self.word_b[words], targets[part] - c * group, learn)
                found[part] += ln
                if learn:
                    grads["word_w"][words] += e.T @ h[part]
                    grads["word_b"][words] += e.sum(axis=0)
                    dh[part] += e @ self.word_w[words]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return (found[back], dh[back], grads) if learn else found[back]

    def learn(self, inputs, targets, live, fresh, h):
        """One window of truncated backpropagation; the state after it."""
        import numpy as np

        steps, n, most = len(inputs), self.sizes.hidden, len(h)
        keep = (~fresh).astype(np.float32)[..., None]
        read = self.table[inputs]
        before, z, r, new, an = np.empty((5, steps, most, n), dtype=np.float32)
        for t in range(steps):
            # the state before a token predicts it; then the token is read
            before[t] = h * keep[t]
            h, (_, z[t], r[t], new[t], an[t]) = self.step(read[t], before[t])
        on = np.flatnonzero(live)
        _, dh_on, grads = self.outputs(before.reshape(-1, n)[on], targets.reshape(-1)[on], learn=True)
        dout = np.zeros((steps * most, n), dtype=np.float32)
        dout[on] = dh_on
        dout = dout.reshape(steps, most, n)
        # what each gate's gradient takes from the next state's, for all steps at once
        to_z, to_new, to_r = (before - new) * z * (1 - z), (1 - z) * (1 - new * new), an * r * (1 - r)
        da, dnew = np.empty((steps, most, 3 * n), dtype=np.float32), np.empty((steps, most, n), dtype=np.float32)
        dh, back = np.zeros((most, n), dtype=np.float32), np.ascontiguousarray(self.recurrent.T)
        for t in range(steps - 1, -1, -1):
            np.multiply(dh, to_new[t], out=dnew[t])
            np.multiply(dh, to_z[t], out=da[t, :, :n])
            np.multiply(dnew[t], to_r[t], out=da[t, :, n : 2 * n])
            np.multiply(dnew[t], r[t], out=da[t, :, 2 * n :])
            dh = (dh * z[t] + da[t] @ back + dout[t]) * keep[t]
        grads["recurrent"] = before.reshape(-1, n).T @ da.reshape(-1, 3 * n)
        da[:, :, 2 * n :] = dnew
        self.update(grads, inputs[live], da[live], max(1, len(on)))
        return h

    def update(self, grads: dict[str, Any], rows, row_grads, n: int) -> None:
        """Adagrad on the mean gradient of n tokens; of the input table only the rows that were read."""
        import numpy as np

        if self.squares is None:
            self.squares = {k: np.full_like(getattr(self, k), 1e-6) for k in ("table", "recurrent", "class_w", "class_b", "word_w", "word_b")}
        for k, g in grads.items():
            g = g / np.float32(n)
            self.squares[k] += g * g
            getattr(self, k)[...] -= self.sizes.rate * g / np.sqrt(self.squares[k])
        if len(rows):
            if len(self.table) < 1 << 15:
                rows = rows.astype(np.int16)  # sorted in linear time
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            own = rows[first]
            g = np.add.reduceat(row_grads[order], first, axis=0) / np.float32(n)
            self.squares["table"][own] += g * g
            self.table[own] -= self.sizes.rate * g / np.sqrt(self.squares["table"][own])


def lanes(texts: list[tuple[Any, Any]], most: int):
    """Texts laid end to end in lanes of about equal length: (inputs, targets, text numbers or -1, first of a text) as
    matrices of steps by lanes. The longest text bounds the lanes' number from above, so that none runs alone for long."""
    import heapq

    import numpy as np

    total, longest = sum(len(i) for i, _ in texts), max(len(i) for i, _ in texts)
    n = max(1, min(most, total // max(longest, 1), len(texts)))
    heap = [(0, k) for k in range(n)]
    place = []
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i][0])):
        at, k = heapq.heappop(heap)
        place.append((i, at, k))
        heapq.heappush(heap, (at + len(texts[i][0]), k))
    steps = max(at for at, _ in heap)
    inputs, targets = np.zeros((n, steps), dtype=np.int32), np.zeros((n, steps), dtype=np.int32)
    number, fresh = np.full((n, steps), -1, dtype=np.int32), np.zeros((n, steps), dtype=bool)
    for i, at, k in place:
        ids, rows = texts[i]
        end = at + len(ids)
        inputs[k, at:end], targets[k, at:end], number[k, at:end], fresh[k, at] = rows, ids, i, True
    return tuple(np.ascontiguousarray(x.T) for x in (inputs, targets, number, fresh))


def steps_of(n: int, sizes: Sizes) -> int:
    """The steps of a window of n lanes: few lanes take more, so that each window has work enough."""
    return max(sizes.window, min(8 * sizes.window, sizes.positions // n))


def score_texts(network: Network, texts: list[tuple[Any, Any]]):
    """ln probability of each text's tokens, the tail's words as the tail."""
    import numpy as np

    inputs, targets, number, fresh = lanes(texts, network.sizes.lanes)
    found = np.zeros(len(texts))
    h = np.zeros((inputs.shape[1], network.sizes.hidden), dtype=np.float32)
    size, keep = steps_of(inputs.shape[1], network.sizes), ~fresh[..., None]
    for begin in range(0, len(inputs), size):
        window = slice(begin, begin + size)
        states = []
        for t in range(begin, min(begin + size, len(inputs))):
            h = h * keep[t]
            states.append(h)
            h, _ = network.step(network.table[inputs[t]], h)
        own = number[window].reshape(-1)
        on = own >= 0
        ln = network.outputs(np.concatenate(states)[on], targets[window].reshape(-1)[on])
        found += np.bincount(own[on], weights=ln, minlength=len(texts))
    return found


def train_texts(network: Network, texts: list[tuple[Any, Any]]) -> None:
    import numpy as np

    inputs, targets, number, fresh = lanes(texts, network.sizes.lanes)
    h = np.zeros((inputs.shape[1], network.sizes.hidden), dtype=np.float32)
    size = steps_of(inputs.shape[1], network.sizes)
    for begin in range(0, len(inputs), size):
        window = slice(begin, begin + size)
        h = network.learn(inputs[window], targets[window], number[window] >= 0, fresh[window], h)


def encoded(docs: DataFrame, shared) -> DataFrame:
    """Each document with a number of its own (row), its output ids and the input rows of its tail words as 32-bit numbers,
    its sums over words of the head, and its tail words with their counts in it."""
    import numpy as np
    import pyarrow as pa

    types = {"row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "n_head": pa.int64(), "base_head": pa.float64(), "ids": pa.binary(), "tail": pa.binary(), "words": pa.list_(pa.binary()), "ns": pa.list_(pa.int64())}

    def run(batches: Iterable) -> Iterator:
        from pyspark import TaskContext

        v, row, columns, n = shared.value, TaskContext.get().partitionId() << 36, {k: [] for k in types}, 0

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], list(types))
            for values in columns.values():
                values.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, inputs, tail = v.encode(text.as_py())
                rare = Counter(tail)
                made = (row, doc_id, len(ids), len(ids) - len(tail), float(v.base[ids].sum()), ids.tobytes(), inputs[ids == v.tail].astype(np.int32).tobytes(), list(rare), list(rare.values()))
                for values, value in zip(columns.values(), made, strict=True):
                    values.append(value)
                row, n = row + 1, n + len(ids)
                if n >= v.sizes.written:
                    yield rows()
                    n = 0
        if columns["row"]:
            yield rows()

    return docs.mapInArrow(run, "row long, doc_id long, n_tokens long, n_head long, base_head double, ids binary, tail binary, words array<binary>, ns array<bigint>")


def _gathered(batches: Iterable, vocabulary: Vocabulary, apart: bool = False) -> Iterator[tuple[list, list]]:
    """Lists of rows, of `tokens` tokens or a little more: (leading columns, (ids, inputs)). A row has its ids and the
    tail's inputs last. apart: rows of one list have the same first column."""
    import numpy as np

    rows, texts, n = [], [], 0
    for batch in batches:
        *first, ids_of, tails = batch.columns
        for row, ids, tail in zip(zip(*(c.to_pylist() for c in first), strict=True), ids_of, tails, strict=True):
            if apart and rows and rows[-1][0] != row[0]:
                yield rows, texts
                rows, texts, n = [], [], 0
            # the buffers are copied, so that no batch stays in memory for a few rows of it
            ids = np.frombuffer(ids.as_py(), dtype=np.int32)
            inputs = vocabulary.input_of[ids]
            inputs[ids == vocabulary.tail] = np.frombuffer(tail.as_py(), dtype=np.int32)
            rows.append(row)
            texts.append((ids, inputs))
            n += len(ids)
            if n >= vocabulary.sizes.tokens:
                yield rows, texts
                rows, texts, n = [], [], 0
    if rows:
        yield rows, texts


CHUNK = 1 << 14


def _held_out() -> Column:
    """Whether a row's labels aren't learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def train(texts: DataFrame, vocabulary: Vocabulary, shared) -> Any:
    """The averaged weights, learnt from `encoded` texts. What is collected is one model's weights, whose size `Sizes` bounds.

    A hash of a text's id and words says which replica learns it, and in which order; sums are made in the order of the
    replicas' numbers. So the weights are the same however the texts are stored and dealt out."""
    import numpy as np
    import pyarrow as pa

    def learned(deal: int, network, n: int):
        parts = [network.flat[i : i + CHUNK] for i in range(0, len(network.flat), CHUNK)]
        columns = [pa.array(range(len(parts)), pa.int32()), pa.array([deal] * len(parts), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "deal", "n", "weights"])

    def replica(batches: Iterable) -> Iterator:
        deal, network, n = None, None, 0
        for rows, own in _gathered(batches, shared.value, apart=True):
            if rows[0][0] != deal:
                if n:
                    yield learned(deal, network, n)
                deal, network, n = rows[0][0], Network(shared.value), 0
            train_texts(network, own)
            n += sum(len(ids) for ids, _ in own)
        if n:
            yield learned(deal, network, n)

    def average(batches: Iterable) -> Iterator:
        """Of the rows of each chunk and deal, which stand together."""
        key, total, tokens = None, 0.0, 0
        mean = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], ["chunk", "deal", "n", "weights"])
        for batch in batches:
            for chunk, deal, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (chunk, deal) != key:
                    if key:
                        yield mean()
                    key, total, tokens = (chunk, deal), 0.0, 0
                total, tokens = total + np.frombuffer(data, dtype=np.float32).astype(np.float64) * n, tokens + n
        if key:
            yield mean()

    schema = "chunk int, deal int, n long, weights binary"
    replicas = max(1, vocabulary.n_tokens // vocabulary.sizes.replica)
    h = F.xxhash64("doc_id", "ids")
    dealt = texts.where(~_held_out()).select(F.pmod(h, F.lit(replicas)).cast("int").alias("deal"), "doc_id", "ids", "tail", h.alias("h")).repartition(replicas, "deal").sortWithinPartitions("deal", "h", "doc_id")
    trained = dealt.select("deal", "doc_id", "ids", "tail").mapInArrow(replica, schema)
    # sums over about the root of the replicas first, so that no task reads the weights of all
    parts = max(1, math.isqrt(replicas))
    grouped = trained.select("chunk", F.pmod("deal", F.lit(parts)).alias("deal"), F.col("deal").alias("of"), "n", "weights").repartition(parts * 8, "chunk", "deal").sortWithinPartitions("chunk", "deal", "of")
    partial = grouped.select("chunk", "deal", "n", "weights").mapInArrow(average, schema)
    whole = partial.repartition("chunk").sortWithinPartitions("chunk", "deal").select("chunk", F.lit(0).alias("deal"), "n", "weights")
    found = whole.mapInArrow(average, schema).orderBy("chunk").collect()
    return np.concatenate([np.frombuffer(r.weights, dtype=np.float32) for r in found]) if found else Network(vocabulary).flat


def vocabulary_of(counts: DataFrame, sizes: Sizes = Sizes()) -> Vocabulary:
    """The `head` most frequent words: those above the lowest step of a logarithmic histogram that leaves no more."""
    step = F.floor(F.log2("c") * 16).cast("int")
    histogram = counts.groupBy(step.alias("step")).agg(F.count("*").alias("types"), F.sum("c").alias("tokens")).orderBy(F.desc("step")).collect()
    n, lowest = 1, 1 << 30
    for row in histogram:  # a thousand rows at most: 64-bit counts have so many steps
        n += row.types
        if n > sizes.head:
            break
        lowest = row.step
    head = counts.where((step >= lowest) | (F.col("word") == F.lit(END))).toArrow()
    rows = list(zip(head.column("word").to_pylist(), head.column("c").to_pylist(), strict=True))
    return Vocabulary(rows, sum(r.tokens for r in histogram), sum(r.types for r in histogram), sizes)


def score_documents(df: DataFrame, sizes: Sizes = Sizes(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null texts are empty: their one token is the end. Null ids count as the empty text when folds are chosen; rows that
    repeat an id are documents each. Without training documents every word is unknown. Other columns aren't read.
    """
    import pyarrow as pa

    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = stash(count_words(docs, sizes), "lm-counts")
    vocabulary = vocabulary_of(counts, sizes)
    shared = spark.sparkContext.broadcast(vocabulary)
    texts = stash(encoded(docs, shared), "lm-encoded")
    shared.unpersist()
    lean = spark.sparkContext.broadcast(vocabulary.without_words())
    weights = spark.sparkContext.broadcast(train(texts, vocabulary, lean))

    def run(batches: Iterable) -> Iterator:
        network = Network(lean.value, weights.value)
        for rows, own in _gathered(batches, lean.value):
            ln = score_texts(network, own)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)), pa.array(ln / math.log(10))], [*leading, "score_head"])

    leading, kinds = ["row", "doc_id", "n_tokens", "n_head", "base_head"], [pa.int64()] * 4 + [pa.float64()]
    scored = stash(texts.select(*leading, "ids", "tail").mapInArrow(run, "row long, doc_id long, n_tokens long, n_head long, base_head double, score_head double"), "lm-scored")
    tail = texts.select("row", F.explode(F.arrays_zip("words", "ns")).alias("x")).select("row", F.col("x.words").alias("rare"), F.col("x.ns").alias("n"))
    known = tail.join(counts, tail.rare == counts.word, "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_tail"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"), F.sum("n").alias("n_rare"))
    joined = scored.join(sums.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    n_rare, logs = F.coalesce("n_rare", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    seen_end = int(vocabulary.counts[vocabulary.end] > 0)
    return joined.select(
        "doc_id", _held_out().alias("held_out"), "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) - (1 - seen_end)).alias("n_known"), F.lit(vocabulary.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base_head") + logs - n_rare * math.log10(vocabulary.total)).alias("base_score"),
        (F.col("score_head") + logs - n_rare * math.log10(vocabulary.tail_total)).alias("score"),
    )


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
