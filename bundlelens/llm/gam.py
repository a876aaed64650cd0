"""Quality classifier: a generalised additive model with pairwise interactions.

A document's features are bins of numbers that its text alone gives. Trees of three leaves on one feature are boosted in
cycles over the features, each adding to that feature's table; then trees on two features (a cut of the first, a cut of
the second on either side) are boosted on the pairs that promise most. A score is the logistic of a sum of table entries,
so that documents are scored by indexing and adding, a batch at a time, and every part of a score can be shown.

Every document is described and scored in tasks. The model is fitted to SAMPLE labelled documents at most: those whose
hashed ids are the smallest, whatever the partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import log1p
from operator import eq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.shared import stash

#: Labelled documents that the model is fitted to, at most.
SAMPLE = 40_000
#: Bins of a feature, and of a feature in a pair.
BINS, COARSE = 64, 16
#: Cycles over the features and over the pairs, the part of a leaf's value that is added, and the weight of a leaf at 0.
CYCLES, PAIR_CYCLES, RATE, RIDGE = 80, 40, 0.15, 2.0
#: Pairs of features that get tables; the least sum of weights in a leaf.
PAIRS, LEAST = 6, 2.0
THRESHOLD = 0.3
FEATURES = (
    "words", "word_bytes", "distinct", "repeats", "top_word", "upper", "symbols", "marks", "digits", "stops", "high_bytes", "dup_lines", "line_words", "plain_words",
)
_UPPER, _SYMBOLS, _MARKS, _DIGITS, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|<>~^_=+@\\/{}[]", b"!?", b"0123456789", b".,;:"
_LOW = bytes(range(128))


def features(text: str | None) -> list[float]:
    """FEATURES of a text; zeros without words. Words are runs of other bytes than space and 9 to 13."""
    raw = text.encode() if text else b""
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    share = lambda which: (size - len(raw.translate(None, which))) / size
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return [
        log1p(n), sum(map(len, words)) / n, len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n, share(_UPPER), share(_SYMBOLS), share(_MARKS), share(_DIGITS),
        share(_STOPS), 1 - share(_LOW), 1 - len(set(lines)) / len(lines), log1p(n / len(lines)), sum(map(bytes.isalpha, words)) / n,
    ]


def described(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, features) of every row, null and repeated ids included; other columns aren't read."""
    import pyarrow as pa

    def run(batches: Iterable) -> Iterator:
        for batch in batches:
            rows = [features(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, features array<double>")


@dataclass
class Model:
    """edges: of each feature the values at which its bins begin, but the first; tables: of each feature a value for each
    bin; pairs: {(a, b): table of coarse bins}."""

    intercept: float
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: dict = field(default_factory=dict)

    def bins(self, x):
        import numpy as np

        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]) if self.edges else np.zeros((0, len(x)), dtype=np.int64)

    def scores(self, x):
        """The probability of label 1 of rows of features."""
        import numpy as np

        own = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[own[f]]
        for (a, b), table in self.pairs.items():
            total += table[coarse(own[a]), coarse(own[b])]
        return 1 / (1 + np.exp(-total))


def coarse(bins):
    return bins * COARSE // BINS


def _gain(g, h):
    """What leaves with these sums of gradients and weights gain; too light ones gain nothing."""
    import numpy as np

    return np.where(h >= LEAST, g * g / (h + RIDGE), -np.inf)


def _cut(g, h):
    """(gain, place) of the best cut of a histogram into two leaves; cut before `place`."""
    import numpy as np

    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return -np.inf, 0
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
    best = int(np.argmax(gains))
    return float(gains[best]) - float(g.sum() ** 2 / (h.sum() + RIDGE)), best + 1


def shallow_tree(g, h, leaves: int = 3):
    """A value for each bin: the best cuts one after the other, until there are `leaves` or none gains."""
    import numpy as np

    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, i = max((*_cut(g[a:b], h[a:b]), i) for i, (a, b) in enumerate(parts))
        if not gain > 1e-9:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, a + at), (a + at, b)]
    values = np.zeros(len(g))
    for a, b in parts:
        values[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return values


def pair_tree(g, h):
    """(gain, table) of the best cut of the rows with the best cut of the columns on either side, or the other way round."""
    import numpy as np

    best, found = 0.0, np.zeros_like(g)
    for turned in (False, True):
        x, w = (g.T, h.T) if turned else (g, h)
        total = x.sum() ** 2 / (w.sum() + RIDGE)
        above, below = np.cumsum(x, axis=0)[:-1], np.cumsum(w, axis=0)[:-1]
        for at in range(1, len(x)):
            halves = [(above[at - 1], below[at - 1]), (x.sum(axis=0) - above[at - 1], w.sum(axis=0) - below[at - 1])]
            if min(half[1].sum() for half in halves) < LEAST:
                continue
            cuts = [_cut(*half) for half in halves]
            gain = sum(max(c[0], 0) + a.sum() ** 2 / (b.sum() + RIDGE) for c, (a, b) in zip(cuts, halves, strict=True)) - total
            if gain > best + 1e-9:
                values = np.zeros_like(x)
                for rows, cut, (a, b) in zip((slice(0, at), slice(at, None)), cuts, halves, strict=True):
                    ends = [0, cut[1], len(a)] if cut[0] > 0 else [0, len(a)]
                    for i, j in zip(ends, ends[1:], strict=False):
                        values[rows, i:j] = a[i:j].sum() / (b[i:j].sum() + RIDGE)
                best, found = gain, values.T if turned else values
    return best, found


def fit(x, y, cycles: int = CYCLES, pair_cycles: int = PAIR_CYCLES, n_pairs: int = PAIRS) -> Model:
    """The model of rows of features and labels (0 or 1). Without rows every score is 0.5, of one label alone nearly it."""
    import numpy as np

    positive = float(y.sum())
    model = Model(float(np.log((positive + 0.5) / (len(y) - positive + 0.5))))
    if not len(y) or positive in (0, len(y)):
        return model
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for f in range(x.shape[1])]
    model.tables = [np.zeros(BINS) for _ in model.edges]
    own, total = model.bins(x), np.full(len(y), model.intercept)

    def gradients(at, size):
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(cycles):
        for f, table in enumerate(model.tables):
            step = RATE * shallow_tree(*gradients(own[f], BINS))
            table += step
            total += step[own[f]]
    rough = coarse(own)
    cell = lambda a, b: rough[a] * COARSE + rough[b]
    square = lambda a, b: [v.reshape(COARSE, COARSE) for v in gradients(cell(a, b), COARSE * COARSE)]
    promise = sorted(((pair_tree(*square(a, b))[0], a, b) for a, b in combinations(range(len(own)), 2)), key=lambda p: (-p[0], p[1:]))
    model.pairs = {(a, b): np.zeros((COARSE, COARSE)) for gain, a, b in promise[:n_pairs] if gain > 0}
    for _ in range(pair_cycles):
        for (a, b), table in model.pairs.items():
            step = RATE * pair_tree(*square(a, b))[1]
            table += step
            total += step[rough[a], rough[b]]
    return model


def sampled(rows: DataFrame, most: int = SAMPLE):
    """(features, labels) of the `most` rows (doc_id, features, label) with the smallest hashed ids, as arrays."""
    import numpy as np

    n = rows.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    if n > most:  # a little more than is needed, so that few rows are sorted and sent
        rows = rows.where(place < int(min(1.0, 1.1 * most / n + 1000 / n) * (1 << 31)))
    table = rows.orderBy(place, "doc_id", "features", "label").limit(most).select("features", "label").toArrow()
    x = table.column("features").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, len(FEATURES)))
    return x, table.column("label").to_numpy().astype(float)


def classify(df: DataFrame, labels: DataFrame, learn: str = "crc32(cast(doc_id AS string)) % 5 <> 0", most: int = SAMPLE, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: held_out says that `learn` is not true of its id.

    Labels are (doc_id, quality); an id with several counts as 1 if half of them or more are, null labels say nothing.
    Null texts are empty, a null id is not held out but has no label to learn. Without any label to learn all scores are
    0.5. Other columns aren't read.
    """
    import pyarrow as pa

    rows = stash(described(df, text_col, id_col).withColumn("held_out", F.coalesce(~F.expr(learn), F.lit(False))), "gam-features")
    said = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("of")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = rows.where("NOT held_out").join(said, F.col("doc_id") == F.col("of")).select("doc_id", "features", "label")
    model = fit(*sampled(stash(known, "gam-known"), most))

    def run(batches: Iterable) -> Iterator:
        import numpy as np

        for batch in batches:
            scores = model.scores(batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "features").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op12_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return classify(read("documents"), read("labels").select("doc_id", "quality"))
