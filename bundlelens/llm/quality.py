"""Host-level quality rules, in DataFrame expressions only.

Rules are measured on every document and their failures summed by host. A host's rate for a rule is shrunk towards all
hosts' by a beta prior that is fitted to the hosts' own rates (method of moments, less what chance alone would spread
them), so that a host of few documents is not judged by them alone. The verdicts are joined back to the documents: a
document goes if it fails the base rules, if its host is condemned (shrunk rate of base failures of CONDEMNED or more),
or if it exceeds the bar of one of the other rules that its host has earned: LENIENCE times the rule's own bar at a rate
of 0, the rule's own bar from a rate of NOTORIOUS on, in between by the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.shared import BROADCAST_BYTES, drop_ids, stash

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
CONDEMNED, NOTORIOUS, LENIENCE = 0.9, 0.5, 2.0
#: Bounds of the prior's weight, in documents.
MIN_WEIGHT, MAX_WEIGHT = 1.0, 1e6
#: The rules besides the base rules, with {m} for the multiple of the bar: a document fails where that of 1 is exceeded.
RULES = {
    "symbols": "n_symbols * 10 > {m} * n_words",
    "dup_lines": "n_dup_lines * 10 > {m} * 3 * n_lines",
    "word_length": "abs(2 * word_chars - 13 * n_words) > {m} * 7 * n_words",
}


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _kept(column: Column, name: str) -> Column:
    """A value that later lambdas may use many times: a generator keeps the optimizer from copying its expression there."""
    return F.explode(F.array(column)).alias(name)


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed) of each row.

    Null text: no words. Lines count if they have a word. Windows of three words are compared as words: a sort of
    (hash, position) in one long brings candidates together, and only those are compared in full. Rows are measured
    where they are; nothing is shuffled. Null hosts are the host "". Other columns aren't read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spaced = F.col("text")
    for c in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    counted = docs.select(
        "doc_id", "host",
        F.length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        _kept(F.array_remove(F.split(spaced, " ", -1), ""), "w"),
    )
    packed = "if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), 31) | i))"
    counted = counted.select(
        "doc_id", "host", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "w", _kept(F.sort_array(F.expr(packed)), "s"),
    )
    # neighbours with equal hash parts are candidates
    near = "transform(filter(s, (x, i) -> (i > 0 and shiftright(s[i - 1], 31) = shiftright(x, 31)) or (i < size(s) - 1 and shiftright(s[i + 1], 31) = shiftright(x, 31))), x -> x & 2147483647)"
    counted = counted.select(*[c for c in counted.columns if c != "s"], _kept(F.expr(near), "p"))
    windows = "if(size(p) = 0, array(), sort_array(transform(p, i -> struct(w[cast(i as int)] as a, w[cast(i as int) + 1] as b, w[cast(i as int) + 2] as c, i))))"
    counted = counted.select(*[c for c in counted.columns if c not in ("w", "p")], F.size("w").cast("long").alias("n_words"), _kept(F.expr(windows), "g"))
    equal = "g[j{0}].a = x.a and g[j{0}].b = x.b and g[j{0}].c = x.c"
    found = f"sort_array(transform(filter(g, (x, j) -> (j > 0 and {equal.format(' - 1')}) or (j < size(g) - 1 and {equal.format(' + 1')})), x -> x.i))"
    counted = counted.select(*[c for c in counted.columns if c != "g"], _kept(F.expr(found), "r"))
    # a window at i covers the words i to i + 2; those up to the last window's end are counted already
    covered = F.expr("aggregate(r, named_struct('n', 0L, 'last', -3L), (a, i) -> named_struct('n', a.n + least(3L, i - a.last), 'last', i), a -> a.n)")
    counted = counted.select(*[c for c in counted.columns if c != "r"], covered.alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def shrunk_rates(failures: DataFrame, rules: list[str]) -> DataFrame:
    """(host, n, one shrunk rate per rule) from (host, n, one count of failures per rule).

    The prior's weight is 1 / rho - 1, where rho is the correlation of failures within hosts: by it the hosts' rates
    spread more than samples of their sizes would. Hosts of one document say nothing of it.
    """
    totals = failures.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *[F.struct(F.sum(r).alias("failed"), F.sum(F.col(r) * F.col(r) / F.col("n")).alias("squares")).alias(r) for r in rules]).first()
    rates = []
    for r in rules:
        mean = totals[r].failed / totals.n if totals.n else 0.0
        rho = 0.0
        if 0 < mean < 1 and totals.n > totals.hosts:
            rho = ((totals[r].squares - totals[r].failed * mean) / (mean * (1 - mean)) - totals.hosts) / (totals.n - totals.hosts)
        weight = min(MAX_WEIGHT, max(MIN_WEIGHT, 1 / rho - 1)) if rho > 0 else MAX_WEIGHT
        rates.append(((F.col(r) + F.lit(weight * mean)) / (F.col("n") + F.lit(weight))).alias(r))
    return failures.select("host", "n", *rates)


def judge(df: DataFrame, **columns: str) -> DataFrame:
    """The measures of every row and `kept`. An empty table gives no rows; one host alone is its own prior.

    Verdicts are broadcast while they are few (BROADCAST_BYTES). Many are joined by the host, where adaptive execution
    splits a host of many rows; what is shuffled are the measures, not the texts."""
    measured = stash(measures(df, **columns).withColumns({f"failed_{r}": F.expr(rule.format(m="1")) for r, rule in RULES.items()}), "quality")
    rules = ["base", *RULES]
    failures = stash(measured.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.col(f"{'base_failed' if r == 'base' else f'failed_{r}'}")).alias(r) for r in rules]), "quality-hosts")
    verdicts = shrunk_rates(failures, rules).select(
        F.col("host").alias("of"), (F.col("base") >= CONDEMNED).alias("condemned"),
        *[(LENIENCE - (LENIENCE - 1) * F.least(F.lit(1.0), F.col(r) / NOTORIOUS)).alias(f"bar_{r}") for r in RULES],
    )
    verdicts = F.broadcast(verdicts) if failures.count() * 200 <= BROADCAST_BYTES else verdicts
    bad = F.col("base_failed") | F.col("condemned")
    for r, rule in RULES.items():
        bad = bad | F.expr(rule.format(m=f"bar_{r}"))
    joined = measured.join(verdicts, measured.host == F.col("of"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~bad).alias("kept"))


def drop_rejected(df: DataFrame) -> DataFrame:
    """The rows of `df`, all columns, that `judge` keeps. Rows that share a doc_id go together if one of them is
    rejected; rows without an id stay, since no verdict can name them."""
    return drop_ids(df, judge(df).where("NOT kept").select("doc_id"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT k, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM g) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(3)) AS j) GROUP BY k),
m AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered USING (k)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
             {', '.join(f'({rule.format(m="1")}) AS failed_{r}' for r, rule in RULES.items())} FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS base, {', '.join(f'count(*) FILTER (failed_{r}) AS {r}' for r in RULES)} FROM f GROUP BY host),
p AS (SELECT count(*) AS hosts, sum(n) AS total, {', '.join(f'sum({r}) / sum(n) AS mean_{r}, sum({r} * {r} / n) - sum({r}) * sum({r}) / sum(n) AS spread_{r}' for r in ['base', *RULES])} FROM h),
q AS (SELECT *, {', '.join(f'CASE WHEN mean_{r} > 0 AND mean_{r} < 1 AND total > hosts THEN (spread_{r} / (mean_{r} * (1 - mean_{r})) - hosts) / (total - hosts) ELSE 0 END AS rho_{r}' for r in ['base', *RULES])} FROM p),
v AS (SELECT host, {', '.join(f'({r} + weight_{r} * mean_{r}) / (n + weight_{r}) AS rate_{r}' for r in ['base', *RULES])}
      FROM h, (SELECT *, {', '.join(f'CASE WHEN rho_{r} > 0 THEN least({MAX_WEIGHT}, greatest({MIN_WEIGHT}, 1 / rho_{r} - 1)) ELSE {MAX_WEIGHT} END AS weight_{r}' for r in ['base', *RULES])} FROM q)),
b AS (SELECT host, rate_base, {', '.join(f'{LENIENCE} - ({LENIENCE} - 1) * least(1.0, rate_{r} / {NOTORIOUS})::DOUBLE AS bar_{r}' for r in RULES)} FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate_base < {CONDEMNED} AND NOT ({' OR '.join(f'({rule.format(m=f"bar_{r}")})' for r, rule in RULES.items())}) AS kept
FROM f JOIN b USING (host)
"""
