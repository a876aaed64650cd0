"""Queries over texts: strings, features, likeness, votes on words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens import rules
from bundlelens.functions import text, urls
from bundlelens.operators import detect, identify, votes
from bundlelens.plans.pages import case, quoted, rlike

SPACE = r"[ \t\n\x0B\f\r]+"


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep.., pos, word): the words of every text in order."""
    return docs.select(*keep, F.posexplode(F.array_remove(F.split("text", SPACE, -1), "")).alias("pos", "word"))


SQL_WORDS = "w AS (SELECT doc_id, source, lang, pos, word FROM (SELECT doc_id, source, lang, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'), 1) - 1 AS pos FROM documents))"
SQL_KIND = case([(rlike("value", p), quoted(k)) for k, p in rules.STRING_KINDS], "'text'")


def string_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = words(read(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n"))  # each word is classified once
    return detect.classified_strings(counted, "word").groupBy("kind").agg(F.count("*").alias("strings"), F.sum("n").alias("n"))


STRING_KINDS = f"WITH {SQL_WORDS}, c AS (SELECT word AS value, count(*) AS n FROM w GROUP BY word) SELECT {SQL_KIND} AS kind, count(*) AS strings, sum(n)::BIGINT AS n FROM c GROUP BY 1"


def first_words(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep.., pos, word): the different words of every text where they are first. The words are sorted with their
    places, and those that begin a run of equal ones stay: nothing is shuffled."""
    own = F.array_remove(F.split("text", SPACE, -1), "")
    placed = F.array_sort(F.transform(own, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))))
    begins = lambda ws: F.filter(ws, lambda w, i: (i == 0) | (w["word"] != F.get(ws, i - 1)["word"]))
    return docs.select(*keep, F.explode(F.get(F.transform(F.array(placed), begins), F.lit(0))).alias("_w")).select(*keep, "_w.pos", "_w.word")


def string_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, value, location, ord_ = read(spark, sf_dir), F.col("word").alias("value"), F.col("doc_id").cast("string").alias("location"), F.struct("doc_id", "pos")
    # ids of documents are unique, so a text's first words are a location's
    found = detect.string_index(words(docs, "doc_id").select(value, location, ord_.alias("ord")), firsts=first_words(docs, "doc_id").select(value, location, ord_.alias("first")))
    return found.select("value", "kind", "count", F.array_join("locations", ",").alias("locations"))


STRING_INDEX = f"""
WITH {SQL_WORDS}, p AS (SELECT word AS value, doc_id, count(*) AS n FROM w WHERE length(word) >= 2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY doc_id) AS place FROM p)
SELECT value, {SQL_KIND} AS kind, sum(n)::BIGINT AS count, string_agg(doc_id::VARCHAR, ',' ORDER BY place) FILTER (place <= 20) AS locations FROM r GROUP BY value
"""


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([\w.+-]+@[\w-]+\.[\w.-]*\w)"), 1)).alias("email"))
    return found.groupBy("email").agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first"))


EMAILS = r"""
SELECT email, count(DISTINCT doc_id) AS documents, min(doc_id) AS first
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([\w.+-]+@[\w-]+\.[\w.-]*\w)', 1)) AS email FROM documents) GROUP BY email
"""


def equal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.first_of_equal(read(spark, sf_dir), F.col("text"), "doc_id", "doc_id").select("doc_id", "duplicate_of")


EQUAL_TEXTS = "SELECT doc_id, CASE WHEN doc_id <> f THEN f END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)"


def features(spark: SparkSession, sf_dir: str, table: str, key: str, name: str) -> DataFrame:
    """(name, feature): distinct lower-case words of a table's texts."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias(name), F.explode(_different_words()).alias("feature"))
    return rows


def _different_words() -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower("text"), SPACE, -1), ""))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, of_module): how many different words each document has; ids of documents are unique."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("module"), F.size(_different_words()).cast("long").alias("of_module"))


def _sql_features(table: str, key: str, name: str) -> str:
    return f"SELECT {key} AS {name}, unnest(list_distinct(regexp_extract_all(lower(text), '[^ \\t\\n\\x0B\\f\\r]+'))) AS feature FROM {table}"


def contained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that a document holds for the most part, whatever else it holds."""
    pairs = identify.overlaps(features(spark, sf_dir, "documents", "doc_id", "module"), features(spark, sf_dir, "benchmark", "item_id", "file"), 0.8, word_counts(spark, sf_dir))
    return pairs.select(F.col("module").alias("doc_id"), F.col("file").alias("item_id"), "shared", F.round(F.col("shared") / F.col("of_file"), 3).alias("containment"))


_OVERLAPS = f"""d AS ({_sql_features('documents', 'doc_id', 'module')}), b AS ({_sql_features('benchmark', 'item_id', 'file')}),
dn AS (SELECT module, count(*) AS of_module FROM d GROUP BY module), bn AS (SELECT file, count(*) AS of_file FROM b GROUP BY file),
o AS (SELECT module, file, of_module, of_file, shared FROM (SELECT module, file, count(*) AS shared FROM d JOIN b USING (feature) GROUP BY ALL) JOIN dn USING (module) JOIN bn USING (file))"""
CONTAINED_PASSAGES = f"WITH {_OVERLAPS} SELECT module AS doc_id, file AS item_id, shared, round(shared / of_file, 3) AS containment FROM o WHERE shared >= 0.8 * of_file"


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark item that a document is."""
    return identify.identify(features(spark, sf_dir, "documents", "doc_id", "module"), features(spark, sf_dir, "benchmark", "item_id", "file"), threshold=0.3, sizes=word_counts(spark, sf_dir))


IDENTIFIED = f"""
WITH {_OVERLAPS}, s AS (SELECT *, (shared / of_file) * least(1.0::DOUBLE, 2 * shared / of_module) AS score FROM o WHERE of_file >= {rules.MIN_MODULE_FEATURES})
SELECT module, file, round(score, 3) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY score DESC, file) AS r FROM s WHERE score >= 0.3) WHERE r = 1
"""


def rare_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the other-numbered text most like it, candidates by their rarest words."""
    own = features(spark, sf_dir, "documents", "doc_id", "function")
    return identify.rare_matches(features(spark, sf_dir, "benchmark", "item_id", "function"), own, threshold=0.3, margin=0.01).select(F.col("function").alias("item_id"), F.col("match").alias("doc_id"), "score", "margin")


RARE_MATCHES = f"""
WITH f AS ({_sql_features('benchmark', 'item_id', 'function')}), l AS ({_sql_features('documents', 'doc_id', 'match')}),
df AS (SELECT feature, count(*) AS df FROM l GROUP BY feature),
k AS (SELECT function, feature, df, row_number() OVER (PARTITION BY function ORDER BY df, feature) AS place FROM f JOIN df USING (feature)),
c AS (SELECT DISTINCT function, match FROM k JOIN l USING (feature) WHERE df <= 40 OR place <= 2),
s AS (SELECT function, match, count(*) AS shared FROM c JOIN f USING (function) JOIN l USING (match, feature) GROUP BY ALL),
z AS (SELECT function, match, shared / (a + b - shared) AS score FROM s JOIN (SELECT function, count(*) AS a FROM f GROUP BY 1) USING (function) JOIN (SELECT match, count(*) AS b FROM l GROUP BY 1) USING (match)),
r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM z WINDOW w AS (PARTITION BY function ORDER BY score DESC, match))
SELECT function AS item_id, match AS doc_id, round(score, 3) AS score, round(score - coalesce(next, 0.0), 3) AS margin FROM r WHERE rank = 1 AND score >= 0.3 AND score - coalesce(next, 0.0) >= 0.01
"""


def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that at least half of all sources have."""
    return votes.baseline(words(read(spark, sf_dir), "source"), "word", "source", 0.5)


COMMON_WORDS = f"WITH {SQL_WORDS} SELECT word, count(DISTINCT source) AS groups FROM w GROUP BY word HAVING count(DISTINCT source) >= 0.5 * (SELECT count(DISTINCT source) FROM documents)"


def words_of_one_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.sole_owner(words(read(spark, sf_dir), "source"), "word", "source").groupBy("source").agg(F.count("*").alias("words"))


WORDS_OF_ONE_SOURCE = f"WITH {SQL_WORDS}, o AS (SELECT word, min(source) AS source FROM w GROUP BY word HAVING count(DISTINCT source) = 1) SELECT source, count(*) AS words FROM o GROUP BY source"


def label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = spark.read.parquet(f"{sf_dir}/labels.parquet").join(read(spark, sf_dir), "doc_id")
    return votes.shares_of(joined, ["lang", "source"], F.col("quality") == 1)


LABEL_SHARES = "SELECT lang, source, count(*) AS n, count(*) FILTER (quality = 1) AS hits, round(count(*) FILTER (quality = 1) / count(*), 3) AS share FROM labels JOIN documents USING (doc_id) GROUP BY ALL"


def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name for every document from its first word, unique but for case."""
    first = F.coalesce(F.nullif(text.camel(F.regexp_extract("text", r"^\s*(\S+)", 1)), F.lit("")), F.lit("document"))
    return votes.unique_names(read(spark, sf_dir).select("doc_id", first.alias("name")), "name", "doc_id").select("doc_id", "unique_name")


DOCUMENT_NAMES = r"""
WITH f AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(regexp_extract(text, '^\s*(\S+)', 1), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> '') AS parts FROM documents),
j AS (SELECT doc_id, coalesce(array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = 1 THEN lower(x) ELSE upper(left(x, 1)) || lower(substr(x, 2)) END), ''), '') AS name FROM f),
n AS (SELECT doc_id, CASE WHEN name = '' THEN 'document' WHEN regexp_matches(name, '^[0-9]') THEN '_' || name ELSE name END AS name FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY doc_id) AS k FROM n),
s AS (SELECT doc_id, CASE WHEN k = 1 THEN name ELSE name || '-' || k END AS unique_name, k FROM r)
SELECT doc_id, CASE WHEN k > 1 AND lower(unique_name) IN (SELECT lower(name) FROM n) THEN unique_name || '-2' ELSE unique_name END AS unique_name FROM s
"""


def hash_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = words(read(spark, sf_dir)).select("word").distinct()
    return distinct.where(urls.is_hash_name(F.col("word")))


HASH_NAMES = rf"""
WITH {SQL_WORDS}, d AS (SELECT DISTINCT word FROM w WHERE regexp_matches(word, '^[A-Za-z0-9_-]{{8,12}}$'))
SELECT word FROM d WHERE CASE WHEN length(word) = 8 THEN regexp_matches(word, '[\d_-]') OR (regexp_matches(word, '[A-Z]') AND regexp_matches(word, '[a-z]'))
  ELSE NOT regexp_matches(word, '^[A-Z]?[a-z]+(?:[A-Z][a-z]+)*$') AND (regexp_matches(word, '\d') OR (regexp_matches(word, '[A-Z]') AND regexp_matches(word, '[a-z]'))) END
"""


def singulars(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = words(read(spark, sf_dir)).select("word").distinct().withColumn("singular", text.singular(F.col("word")))
    return distinct.where("singular IS NOT NULL").groupBy("singular").agg(F.count("*").alias("forms"))


SINGULARS = f"""
WITH {SQL_WORDS}, d AS (SELECT DISTINCT word FROM w), s AS (SELECT CASE WHEN regexp_matches(word, 'ies$') AND length(word) > 4 THEN left(word, -3) || 'y' WHEN regexp_matches(word, '(ss|us|is)$') THEN NULL
  WHEN regexp_matches(word, '(ch|sh|x|s)es$') AND length(word) > 4 THEN left(word, -2) WHEN regexp_matches(word, 's$') AND length(word) > 3 THEN left(word, -1)
  WHEN regexp_matches(word, '(List|Array)$') THEN nullif(regexp_replace(word, '(List|Array)$', ''), '') END AS singular FROM d)
SELECT singular, count(*) AS forms FROM s WHERE singular IS NOT NULL GROUP BY singular
"""


def source_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word that tells a source best: most documents of the source have it, by the largest lead over the next."""
    pairs = words(read(spark, sf_dir), "doc_id", "source").where(F.length("word") >= 6).select("source", "doc_id", "word").distinct()
    scores = pairs.groupBy("source", "word").agg(F.count("*").cast("double").alias("score"))
    return votes.with_margin(scores, ["source"], "word", "score")


SOURCE_WORDS = f"""
WITH {SQL_WORDS}, s AS (SELECT source, word, count(DISTINCT doc_id)::DOUBLE AS score FROM w WHERE length(word) >= 6 GROUP BY ALL),
r AS (SELECT *, row_number() OVER o AS r, lead(word) OVER o AS runner_up, lead(score) OVER o AS next FROM s WINDOW o AS (PARTITION BY source ORDER BY score DESC, word))
SELECT source, word, score, runner_up, score - coalesce(next, 0.0) AS margin FROM r WHERE r = 1
"""


def conversation_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation joined in order."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    joined = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.listagg("role", F.lit(">")).alias("any_order"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]), ">").alias("roles"))
    return joined.select("conv_id", "turns", "roles")


CONVERSATION_SCRIPTS = "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id"

QUERIES = {
    "string_kinds": (string_kinds, STRING_KINDS), "string_index": (string_index, STRING_INDEX), "emails": (emails, EMAILS), "equal_texts": (equal_texts, EQUAL_TEXTS),
    "contained_passages": (contained_passages, CONTAINED_PASSAGES), "identified": (identified, IDENTIFIED), "rare_matches": (rare_matches, RARE_MATCHES), "common_words": (common_words, COMMON_WORDS),
    "words_of_one_source": (words_of_one_source, WORDS_OF_ONE_SOURCE), "label_shares": (label_shares, LABEL_SHARES), "document_names": (document_names, DOCUMENT_NAMES), "hash_names": (hash_names, HASH_NAMES),
    "singulars": (singulars, SINGULARS), "source_words": (source_words, SOURCE_WORDS), "conversation_scripts": (conversation_scripts, CONVERSATION_SCRIPTS),
}
