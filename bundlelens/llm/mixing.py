"""Mixing sources to target weights by iterative proportional fitting, in DataFrame expressions only.

Documents fall into cells of (source, language, topic). The cells' token weights are raked: scaled to the target
marginal of one attribute after the other until all hold. A cell's weight by its tokens is the probability with which
each of its documents is taken; a hash of the id decides, so that the same documents are taken whatever the partitions.

A probability is at most 1, so raking is bounded: each step takes the multiple of a value's weights by which they give
its goal when none counts for more than its cell has. Values that have fewer tokens than their targets ask for are taken
whole, and the rest is shared by the others in proportion to their targets; `marginals` reports what was asked for, what
can be had, and what is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from bundlelens.llm.shared import BROADCAST_BYTES, free_names, stash

#: Targets by default: each marginal's own token shares to this power, so that small sources and languages gain.
TEMPERATURE = 0.7
FRACTION, SEED = 0.8, "mix"
#: Rounds at most; raking ends when no value's share is further from its goal than this part of it.
ROUNDS, TOLERANCE = 20, 0.01
ATTRIBUTES = ("source", "lang", "topic")
#: Up to so many cells are raked in one partition, without a shuffle; more are raked by shuffles, a round at a time.
ONE_PARTITION = 10_000


def topic(text: Column) -> Column:
    """The kind of text that its form shows: documents carry no topics. Other topics are given as a column to `mix`."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("***")) | F.contains(text, F.lit("###")), "markup").when(F.contains(F.lower(text), F.lit("licen")), "legal").otherwise("prose")


def tokens(text: Column) -> Column:
    """Words: runs of other characters than white space (space and 9 to 13)."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(text, " ", -1), "")).cast("long")


def described(df: DataFrame, of: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of each row; null attributes are "", null texts have no tokens."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = topic(text) if of is None else F.coalesce(of.cast("string"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(a).cast("string"), F.lit("")).alias(a) for a in ATTRIBUTES[:2]], kind.alias("topic"), tokens(text).alias("n_tokens"))


def _multiple(goal: Column, bound: str, weight: str, group: WindowSpec, *ties: str) -> Column:
    """The k for which the sum of least(bound, k * weight) over the rows of a group is `goal`, or the least one at which
    all are at their bounds. With rows in the order of bound by weight, those before some place are at their bounds and
    the others share what is left; the right place is that which gives the largest k."""
    order = group.orderBy(F.try_divide(bound, weight).asc_nulls_last(), *ties)
    before = F.coalesce(F.sum(bound).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    return F.when(F.col(weight) > 0, F.try_divide(goal - before, after))


def goals(cells: DataFrame, a: str, fraction: float, targets: dict[str, float] | None, temperature: float) -> DataFrame:
    """(value, available, asked, goal) of each value of attribute `a` of cells (..., share): the share of all tokens that
    it has, that its target asks for, and that it gets."""
    values = cells.groupBy(F.col(a).alias("value")).agg(F.sum("share").alias("available"))
    if targets is None:
        values = values.withColumn("weight", F.when(F.col("available") > 0, F.pow("available", F.lit(temperature))).otherwise(0.0))
    else:
        wanted = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "_value string, weight double")
        # as large as the parameter
        values = values.join(F.broadcast(wanted), F.col("value") == F.col("_value"), "left").select("value", "available", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    everything = Window.partitionBy(F.lit(0))
    values = values.withColumn("part", F.coalesce(F.try_divide("weight", F.sum("weight").over(everything)), F.lit(0.0)))
    values = values.withColumn("k", _multiple(F.lit(fraction), "available", "part", everything, "value"))
    most = F.coalesce(F.max("k").over(everything), F.lit(0.0))
    return values.select("value", "available", (F.lit(fraction) * F.col("part")).alias("asked"), F.least("available", most * F.col("part")).alias("goal"))


def _raked(cells: DataFrame, a: str) -> DataFrame:
    """One step: the weights of each value of `a` are scaled to its goal."""
    own = Window.partitionBy(a)
    found = cells.withColumn("k", _multiple(F.col(f"goal_{a}"), "share", "weight", own, *ATTRIBUTES))
    return found.withColumn("weight", F.coalesce(F.max("k").over(own), F.lit(0.0)) * F.col("weight")).drop("k")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, temperature: float = TEMPERATURE, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, share, asked and goal of each attribute, w, probability): raked cells (source, lang, topic,
    tokens); all but the probability are shares of all tokens.

    targets: for some attributes the wanted weight of each value, in any unit; values that aren't named get none, and no
    more is taken than those that are named have. Other attributes get tempered shares. Cells without tokens have share 0
    and the fraction as probability. Where goals of different attributes contradict each other, the last attribute's hold
    and the rest as nearly as the rounds bring them.
    """
    targets = targets or {}
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    cells = cells.select(*ATTRIBUTES, "tokens")
    named = [F.sum(F.when(F.col(a).isin([k for k, v in own.items() if v > 0]), F.col("tokens")).otherwise(0)) for a, own in targets.items()]
    n, total, *most = cells.agg(F.count("*"), F.sum("tokens"), *named).first()
    small, total = n <= ONE_PARTITION, float(total or 0.0)
    aim = min([fraction, *((m or 0.0) / total for m in most if total)])
    shares = cells = (cells.coalesce(1) if small else cells).withColumn("share", F.col("tokens") / total if total else F.lit(0.0))
    for a in ATTRIBUTES:
        found = goals(shares, a, aim, targets.get(a), temperature).select(F.col("value").alias(f"_{a}"), F.col("asked").alias(f"asked_{a}"), F.col("goal").alias(f"goal_{a}"))
        cells = cells.join(F.broadcast(found) if small else found, F.col(a) == F.col(f"_{a}")).drop(f"_{a}")
    cells = stash(cells.withColumn("weight", F.lit(aim) * F.col("share")), "mix-cells")
    now = F.least("share", "weight")
    for _ in range(rounds):
        cells = cells.coalesce(1) if small else cells
        apart = [F.coalesce(F.abs(F.try_divide(F.sum(now).over(Window.partitionBy(a)), F.col(f"goal_{a}")) - 1), F.lit(0.0)) for a in ATTRIBUTES]
        if (cells.select(F.greatest(*apart).alias("apart")).agg(F.max("apart")).first()[0] or 0.0) <= TOLERANCE:
            break
        for a in ATTRIBUTES:
            cells = _raked(cells, a)
        cells = stash(cells, "mix-round")
    p = F.when(F.col("share") > 0, F.try_divide("w", "share")).otherwise(F.lit(fraction))
    return cells.withColumn("w", now).drop("tokens", "weight").withColumn("probability", p)


def marginals(cells: DataFrame) -> DataFrame:
    """(attribute, value, available, asked, goal, reached) of raked cells, as shares of all tokens: what a value has, what
    its target asks for, what of that can be had, and what is expected to be taken."""
    parts = [F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value"), F.col(f"asked_{a}").alias("asked"), F.col(f"goal_{a}").alias("goal")) for a in ATTRIBUTES]
    each = cells.select("share", "w", F.explode(F.array(*parts)).alias("x"))
    return each.groupBy(F.col("x.attribute").alias("attribute"), F.col("x.value").alias("value")).agg(F.sum("share").alias("available"), F.first("x.asked").alias("asked"), F.first("x.goal").alias("goal"), F.sum("w").alias("reached"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id alone: 52 bits of the MD5 of seed and id. Null ids share one."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def probabilities(docs: DataFrame, fraction: float, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """(_source, _lang, _topic, _p) of each cell of the described documents; broadcast where it is small enough."""
    cells = docs.groupBy(*ATTRIBUTES).agg(F.sum("n_tokens").alias("tokens"))
    raked = stash(rake(stash(cells, "mix-tokens"), targets, fraction), "mix-probabilities")
    found = raked.select(*[F.col(a).alias(f"_{a}") for a in ATTRIBUTES], F.col("probability").alias("_p"))
    return F.broadcast(found) if found.count() * 200 <= BROADCAST_BYTES else found


def mix(df: DataFrame, fraction: float = FRACTION, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability) of the documents taken.

    Null attributes are the value "" and null texts have no tokens; rows that repeat an id are taken together; the one
    hash of all null ids takes or leaves them by their cells. An empty table gives none. Other columns aren't read.
    """
    docs = described(df, topic)
    joined = docs.join(probabilities(docs, fraction, targets), [F.col(a) == F.col(f"_{a}") for a in ATTRIBUTES])
    return joined.where(uniform(F.col("doc_id")) < F.col("_p")).select("doc_id", *ATTRIBUTES, "n_tokens", F.round("_p", 6).alias("probability"))


def sample(df: DataFrame, fraction: float = FRACTION, targets: dict[str, dict[str, float]] | None = None, of: Column | None = None) -> DataFrame:
    """The rows of `df`, all columns, of the documents that `mix` takes. of: their topics, if not by their form."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = topic(text) if of is None else F.coalesce(of.cast("string"), F.lit(""))
    own = {"source": F.coalesce(F.col("source").cast("string"), F.lit("")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "topic": kind}
    names = free_names(df, *[f"_{a}" for a in ATTRIBUTES], "_p")
    cells = probabilities(described(df, of), fraction, targets).toDF(*names)
    joined = df.join(cells, [own[a] == F.col(n) for a, n in zip(ATTRIBUTES, names, strict=False)])
    return joined.where(uniform(F.col("doc_id").cast("long")) < F.col(names[-1])).select(*[F.col(f"`{c}`") for c in df.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    multiple = lambda goal, bound, weight, group, ties: f"""CASE WHEN {weight} > 0 THEN
  ({goal} - coalesce(sum({bound}) OVER ({group} ORDER BY {bound} / nullif({weight}, 0) NULLS LAST, {ties} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum({weight}) OVER ({group} ORDER BY {bound} / nullif({weight}, 0) NULLS LAST, {ties} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS k"""  # noqa: E731
    apart = lambda a: f"coalesce(abs(sum(least(share, weight)) OVER (PARTITION BY {a}) / nullif(goal_{a}, 0) - 1), 0)"
    steps, last = [], "c0"
    for i in range(ROUNDS):
        steps.append(f"""r{i} AS (SELECT *, max(apart) OVER () > {TOLERANCE} AS on_ FROM (SELECT source, lang, topic, share, goal_source, goal_lang, goal_topic, weight,
  greatest({', '.join(apart(a) for a in ATTRIBUTES)}) AS apart FROM {last}))""")
        last = f"r{i}"
        for a in ATTRIBUTES:
            name, group = f"r{i}_{a}", f"PARTITION BY {a}"
            steps.append(f"""{name} AS (SELECT source, lang, topic, share, goal_source, goal_lang, goal_topic, on_, CASE WHEN on_ THEN coalesce(max(k) OVER ({group}), 0) * weight ELSE weight END AS weight
  FROM (SELECT *, {multiple(f'goal_{a}', 'share', 'weight', group, 'source, lang, topic')} FROM {last}))""")
            last = name
    goal = lambda a: f"""v_{a} AS (SELECT {a}, s, pow(s, {TEMPERATURE}) / sum(pow(s, {TEMPERATURE})) OVER () AS part FROM (SELECT {a}, sum(share) AS s FROM shares GROUP BY {a})),
k_{a} AS (SELECT *, {multiple(FRACTION, 's', 'part', '', a)} FROM v_{a}),
g_{a} AS (SELECT {a}, least(s, max(k) OVER () * part) AS goal_{a} FROM k_{a})"""  # noqa: E731
    goals_sql = ",\n".join(goal(a) for a in ATTRIBUTES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
                  CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '***') OR contains(text, '###') THEN 'markup'
                       WHEN contains(lower(text), 'licen') THEN 'legal' ELSE 'prose' END AS topic,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
shares AS MATERIALIZED (SELECT source, lang, topic, tokens / sum(tokens) OVER () AS share FROM cells),
{goals_sql},
c0 AS (SELECT *, {FRACTION} * share AS weight FROM shares JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic)),
{', '.join(steps)},
p AS (SELECT source, lang, topic, CASE WHEN share > 0 THEN least(share, weight) / share ELSE {FRACTION} END AS p FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability FROM d JOIN p USING (source, lang, topic)
WHERE ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {2**52}.0 < p
"""


OP3_SQL = _sql()
