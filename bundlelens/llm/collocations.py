"""Phrase collocation mining.

Every n-gram of 1 to `max_words` words becomes a DataFrame row (lang, phrase, count), which Spark aggregates by language
and phrase. Candidates (2 words or more, `least` occurrences or more) are cut after each word, the cuts are joined with
the counts of their two parts and scored in Decimal; the lowest cut counts. Candidates with an extension by one word that
is nearly as frequent are dropped by an anti-join, and the rest is ranked within each language by windows.

The minimum count is pushed down by levels: an n-gram is no more frequent than the two (n - 1)-grams in it, so only where
both are frequent enough an n-gram becomes a row. A bitmap of the frequent ones' hashes, of a fixed size whatever the
data, says where: hashes that meet let rows through that the count then drops, and none is lost. Words, pieces and hashes
are found for whole buffers of texts at once.

Phrases and parts are compared as text. What a task holds is a buffer of CHUNK bytes and the bitmap.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.llm.shared import BROADCAST_BYTES, stash

MAX_WORDS, LEAST, SHARE, TOP = 3, 10, 50, 2000
UNKNOWN = "und"
#: Bytes of text that are looked at together; longer texts are cut between pieces.
CHUNK = 1 << 19
#: Bits of a bitmap for each frequent n-gram, and at most: 32 MB.
BITS_EACH, MOST_BITS = 16, 28
#: Candidates of one language that a task ranks before the best of all tasks meet.
RANKED = 100_000
BREAK = re.compile(rb"[.,;:!?\x0a-\x0d]")


class Words:
    """Words, pieces and n-grams of buffers of text."""

    def __init__(self):
        import numpy as np
        from xxhash import xxh64_intdigest

        self.lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
        self.kind = np.array([2 if BREAK.match(bytes([c])) else 1 if c in (9, 32) else 0 for c in range(256)], dtype=np.uint8)
        self.values = np.array([xxh64_intdigest(bytes([c]), 42) for c in range(256)], dtype=np.uint64)
        self.factor, self.powers = np.uint64(0x9E3779B97F4A7C15), [np.ones(1, dtype=np.uint64)] * 2

    def read(self, raw: bytes) -> None:
        """Find the words of `raw`: their places in the text (at) and in the buffer (start, end), where one blank parts the
        words of a piece, and the numbers of their pieces."""
        import numpy as np

        found = np.frombuffer(raw.translate(self.lower), dtype=np.uint8)
        kind = self.kind[found]
        word = kind == 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
        self.at, ends = edges[::2], edges[1::2]
        keep = word.copy()
        keep[ends[ends < len(found)]] = True  # what follows a word: a break, or the blank before the next word
        place = np.cumsum(keep, dtype=np.int64)
        self.start, self.end = place[self.at] - 1, place[ends - 1]
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.at]
        self.buffer = np.where(kind == 1, np.uint8(32), found)[keep]

    def starts(self, n: int):
        """The numbers of the words that n-grams begin with."""
        import numpy as np

        last = len(self.at) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :]) if last > 0 else np.zeros(0, dtype=np.int64)

    def hashes(self, salt):
        """The words' hashes, each with the salt of its language."""
        import numpy as np

        n = len(self.buffer)
        if len(self.powers[0]) < n:
            inverse = np.uint64(pow(int(self.factor), -1, 1 << 64))
            self.powers = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, f, dtype=np.uint64)])) for f in (self.factor, inverse)]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.values[self.buffer] * self.powers[0][:n])])
        own = (sums[self.end] - sums[self.start]) * self.powers[1][self.start]
        return mixed(own + salt)

    def phrases(self, first, n: int):
        """An array of the n-grams that begin with the words `first`."""
        import numpy as np
        import pyarrow as pa

        start, end = self.start[first].astype(np.int32), self.end[first + n - 1].astype(np.int32)
        offsets = np.zeros(len(first) + 1, dtype=np.int32)
        np.cumsum(end - start, out=offsets[1:])
        place = np.repeat(start - offsets[:-1], end - start)
        place += np.arange(offsets[-1], dtype=np.int32)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(self.buffer[place]))


def mixed(x):
    """A 64-bit hash of each number."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def gram_hashes(words, n: int):
    """Of each word's n-gram, the hash; words are hashed already. The last n - 1 have none."""
    import numpy as np

    found = words
    for i in range(1, n):
        found = mixed(found[: len(words) - i] * np.uint64(0xD6E8FEB86659FD93) + words[i:])
    return found


def salts(langs: list[str]):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(x.encode(), 7) for x in langs], dtype=np.uint64)


def chunks(texts: Iterable[bytes], size: int) -> Iterator[list[tuple[int, bytes]]]:
    """(row, text) lists of about `size` bytes; a longer text is cut after breaks, where no n-gram goes across."""
    own, held = [], 0
    for row, text in enumerate(texts):
        begin = 0
        while len(text) - begin > size and (cut := BREAK.search(text, begin + size)):
            yield [(row, text[begin : cut.end()])]
            begin = cut.end()
        own.append((row, text[begin:]))
        held += len(text) - begin
        if held >= size:
            yield own
            own, held = [], 0
    if own:
        yield own


def grams(df: DataFrame, n: int, frequent: tuple | None, chunk: int = CHUNK) -> DataFrame:
    """(lang, phrase, n) rows of the n-grams of df (lang, text), equal ones of a buffer together. frequent: a broadcast
    bitmap of the (n - 1)-grams' hashes and its number of bits; only n-grams whose two are in it are given."""
    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches: Iterable) -> Iterator:
        import numpy as np

        words = Words()
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes, names = langs.indices.to_numpy(), langs.dictionary
            salt = salts(names.to_pylist())
            for own in chunks(batch.column(1).cast(pa.binary()).to_pylist(), chunk):
                begins = np.cumsum([0, *(len(t) + 1 for _, t in own[:-1])])
                words.read(b"\n".join(t for _, t in own))
                code = codes[np.array([row for row, _ in own])][np.searchsorted(begins, words.at, "right") - 1]
                first = words.starts(n)
                if frequent and len(first):
                    bits, most = frequent[0].value, np.uint64((1 << frequent[1]) - 1)
                    at = gram_hashes(words.hashes(salt[code]), n - 1) & most
                    known = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    first = first[known[first] & known[first + 1]]
                if len(first):
                    rows = pa.table({"lang": code[first], "phrase": words.phrases(first, n)}).group_by(["lang", "phrase"]).aggregate([([], "count_all")])
                    rows = pa.table([names.take(rows["lang"].combine_chunks()), rows["phrase"], rows["count_all"]], schema=schema)
                    yield from rows.to_batches(max_chunksize=65_536)

    return df.mapInArrow(run, "lang string, phrase string, n long")


def bitmap(frequent: DataFrame, n: int) -> tuple:
    """A broadcast bitmap of the hashes of frequent (lang, phrase) of n words, and the logarithm of its size. Bits are
    brought together by Spark; at most 2 ** MOST_BITS come to the driver, however many phrases there are."""
    import numpy as np
    import pyarrow as pa

    spark = frequent.sparkSession
    log = min(MOST_BITS, max(16, (BITS_EACH * frequent.count()).bit_length()))

    def run(batches: Iterable) -> Iterator:
        words = Words()
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            words.read(b"\n".join(batch.column(1).cast(pa.binary()).to_pylist()))
            salt = salts(langs.dictionary.to_pylist())[np.repeat(langs.indices.to_numpy(), n)]
            found = gram_hashes(words.hashes(salt), n)[::n] & np.uint64((1 << log) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["bit"])

    bits = frequent.select("lang", "phrase").mapInArrow(run, "bit long")
    parts = bits.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits"))
    whole = np.zeros(max(1 << log, 1 << 15) // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        whole[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(row.bits, dtype=np.uint8)
    return spark.sparkContext.broadcast(whole), log


def scored(cuts: DataFrame, parts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): of each phrase's cuts (k, left, right) the one with the lowest score, then the
    smallest k. parts: (lang, phrase, f) of all that a cut can give."""
    size = parts.agg(F.coalesce(F.sum(F.octet_length("phrase") + F.octet_length("lang") + 48), F.lit(0))).first()[0]
    small = F.broadcast if size <= BROADCAST_BYTES else lambda x: x
    of = lambda side, count: small(parts.select(F.col("lang").alias(f"{count}_lang"), F.col("phrase").alias(f"{count}_of"), F.col("f").alias(count)))  # noqa: E731, ARG005
    found = cuts.join(of("left", "l"), (F.col("lang") == F.col("l_lang")) & (F.col("left") == F.col("l_of")))
    found = found.join(of("right", "r"), (F.col("lang") == F.col("r_lang")) & (F.col("right") == F.col("r_of")))
    exact = "(cast(1000000 as decimal(7,0)) * (cast(a as decimal(19,0)) * cast(a as decimal(19,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    least = found.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(df: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, share: int = SHARE, top: int | None = TOP, text_col: str = "text", lang_col: str = "lang", chunk: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` collocations, or all with None.

    Null texts are empty, null languages `und`. Repeated rows count each. Languages without a candidate, and an empty
    table, give no rows. Ties of score and count go by the phrase in byte order; other columns aren't read.
    """
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted, frequent = [], None
    for n in range(1, max_words + 1):
        rows = grams(texts, n, frequent, chunk).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        counted.append(stash(rows if n == 1 else rows.where(F.col("f") >= least), f"collocations-{n}"))
        if n < max_words:
            frequent = bitmap(counted[-1].where(F.col("f") >= least), n)
    totals = counted[0].groupBy(F.col("lang").alias("of")).agg(F.sum("f").alias("n"))
    parts = reduce(DataFrame.unionByName, counted[:-1]).where(F.col("f") >= least)
    cuts = []
    for n, rows in enumerate(counted[1:], 2):
        each = [F.struct(F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("left"), F.substring_index("phrase", " ", k - n).alias("right")) for k in range(1, n)]
        cuts.append(rows.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.array(*each))))
    found = scored(reduce(DataFrame.unionByName, cuts), parts)
    # what lies inside a longer candidate lies inside one of its extensions by one word, which is as frequent or more so
    longer = [rows.select("lang", "f", F.explode(F.array(F.substring_index("phrase", " ", n - 1), F.substring_index("phrase", " ", 1 - n))).alias("inner")) for n, rows in enumerate(counted[2:], 3)]
    if longer:
        extended = reduce(DataFrame.unionByName, longer).groupBy(F.col("lang").alias("of"), "inner").agg(F.max("f").alias("longest"))
        found = found.join(extended, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("inner")) & (100 * F.col("longest") >= share * F.col("a")), "left_anti")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*best)).cast("long")
    if top is not None:
        found = stash(found, "collocations-scored")
        deal = max(1, -(-found.count() // RANKED))
        found = found.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(deal))).withColumn("rank", rank("lang", "deal")).where(F.col("rank") <= top).drop("deal", "rank")
    found = found.withColumn("rank", rank("lang"))
    if top is not None:
        found = found.where(F.col("rank") <= top)
    return found.join(totals, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS size) WHERE len(w) >= size) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= {LEAST}),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS longest
           FROM (SELECT *, unnest(range(1, size - n + 2)) AS i FROM c, (SELECT unnest(range(2, {MAX_WORDS})) AS n) WHERE n < size) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside i ON i.lang = best.lang AND i.phrase = best.phrase WHERE i.longest IS NULL OR 100 * i.longest < {SHARE} * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {TOP}
"""
