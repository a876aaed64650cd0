"""Queries over the order and event tables: votes, ranks, graphs, cookies and logs on edges of other origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.functions import numbers, text, urls
from bundlelens.operators import graphs, votes
from bundlelens.sources import http


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def weighted_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market segment with most money in each nation."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", _cents("c_acctbal").alias("weight"), "c_custkey")
    return votes.argmax(rows, ["c_nationkey"], "c_mktsegment", "weight", "c_custkey")


WEIGHTED_VOTES = """
WITH s AS (SELECT c_nationkey, c_mktsegment, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS weight, min(c_custkey) AS f FROM customer GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, weight FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY weight DESC, f) AS r FROM s) WHERE r = 1
"""


def strongest_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.strongest(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag"], "l_quantity")


STRONGEST_HINTS = "SELECT l_partkey, l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL"


def suppliers_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_suppkey").alias("supplier")).agg(F.sum("l_quantity").alias("score"))
    return votes.with_margin(scores, ["l_partkey"], "supplier", "score")


SUPPLIERS_WITH_MARGIN = """
WITH s AS (SELECT l_partkey, l_suppkey AS supplier, sum(l_quantity) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS r, lead(supplier) OVER w AS runner_up, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY l_partkey ORDER BY score DESC, supplier))
SELECT l_partkey, supplier, score, runner_up, score - coalesce(next, 0.0) AS margin FROM r WHERE r = 1
"""


def consensus_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.consensus(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", least=2, share=0.4)


CONSENSUS_PRIORITIES = """
WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey)::BIGINT AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority DESC) AS r FROM c)
SELECT o_custkey, o_orderpriority, n, total FROM r WHERE r = 1 AND n >= 2 AND n >= 0.4 * total
"""


def unanimous_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.unanimous(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")


UNANIMOUS_STATUSES = "SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1"


def return_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.shares_of(table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_linenumber"], F.col("l_returnflag") == "R")


RETURN_SHARES = "SELECT l_linestatus, l_linenumber, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS hits, round(count(*) FILTER (l_returnflag = 'R') / count(*), 3) AS share FROM lineitem GROUP BY ALL"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from regions down to orders."""
    edge = lambda name, a, b, up, down: table(spark, sf_dir, name).select(F.concat(F.lit(up), F.col(a)).alias("src"), F.concat(F.lit(down), F.col(b)).alias("dst"))
    return edge("nation", "n_regionkey", "n_nationkey", "r", "n").unionByName(edge("customer", "c_nationkey", "c_custkey", "n", "c")).unionByName(edge("orders", "o_custkey", "o_orderkey", "c", "o"))


_TREE = "t AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that hangs below the first region, by depth."""
    found = graphs.reach(_tree(spark, sf_dir), spark.createDataFrame([("r0",)], "node string"))
    return found.select("node", F.col("depth").cast("long").alias("depth"))


REACHABLE = f"WITH RECURSIVE {_TREE}, r AS (SELECT 'r0' AS node, 0 AS depth UNION SELECT t.dst, depth + 1 FROM r JOIN t ON r.node = t.src) SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY node"


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as modules: each is an alias of, and needs, the part of half its number."""
    return table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))


def alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.aliases(_halves(spark, sf_dir)).select("src", "dst", F.col("hops").cast("long").alias("hops"))


ALIAS_CHAINS = """
WITH RECURSIVE a AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1),
c AS (SELECT src, dst, 1 AS hops FROM a UNION ALL SELECT c.src, a.dst, hops + 1 FROM c JOIN a ON c.dst = a.src WHERE hops < 10)
SELECT src, arg_max(dst, hops) AS dst, max(hops)::BIGINT AS hops FROM c GROUP BY src
"""


def exclusive_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders alone lead to parts: a node belongs where all its importers do. Seeds are nations of the
    first two regions."""
    edges = _tree(spark, sf_dir).unionByName(table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")))
    return graphs.all_importers(edges, spark.createDataFrame([("r0",), ("r1",), ("r2",), ("r3",)], "node string"))


EXCLUSIVE_MODULES = """
WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey <= 3), c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT k FROM n)),
o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM c)),
p AS (SELECT l_partkey AS k FROM lineitem GROUP BY l_partkey HAVING bool_and(l_orderkey IN (SELECT k FROM o)))
SELECT 'r' || r_regionkey AS node FROM region WHERE r_regionkey <= 3 UNION ALL SELECT 'n' || k FROM n UNION ALL SELECT 'c' || k FROM c UNION ALL SELECT 'o' || k FROM o UNION ALL SELECT 'p' || k FROM p
"""


def pruned_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts that no part left imports."""
    return graphs.prune(_halves(spark, sf_dir), table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("node")))


PRUNED_MODULES = """
WITH RECURSIVE held AS (SELECT p_partkey AS k FROM part WHERE p_size > 25 UNION SELECT k // 2 FROM held WHERE k > 1)
SELECT p_partkey AS node FROM part WHERE p_size <= 25 AND p_partkey NOT IN (SELECT k FROM held)
"""


def module_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.levels(_halves(spark, sf_dir)).select("node", F.col("level").cast("long").alias("level"))


MODULE_LEVELS = "WITH n AS (SELECT p_partkey AS k FROM part WHERE p_partkey > 1 UNION SELECT p_partkey // 2 FROM part WHERE p_partkey > 1) SELECT k AS node, CASE WHEN k <= 1 THEN 0 ELSE floor(log2(k)) END::BIGINT AS level FROM n"


def missing_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that parts need and that aren't solvent."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graphs.missing(edges, table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node")))


MISSING_MODULES = "SELECT l_suppkey AS dst, count(DISTINCT l_partkey) AS importers FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_suppkey"


def customer_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers that hang together."""
    return graphs.components(_tree(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("nodes"))


CUSTOMER_COMPONENTS = f"""
WITH RECURSIVE {_TREE}, down AS (SELECT DISTINCT src AS root, src AS node FROM t WHERE src LIKE 'r%' UNION SELECT root, dst FROM down JOIN t ON down.node = t.src)
SELECT component, count(*) AS nodes FROM (SELECT root, min(node) OVER (PARTITION BY root) AS component FROM down) GROUP BY component
"""


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.camel(n).alias("camel"), text.pascal(n).alias("pascal"), text.upper_snake(n).alias("upper_snake"), text.kebab(text.camel(n)).alias("kebab"), text.icon_name(F.col("p_type")).alias("icon"))


_PARTS = r"list_filter(string_split_regex(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> '')"
PART_NAMES = rf"""
WITH w AS (SELECT *, {_PARTS} AS ws FROM part),
c AS (SELECT *, array_to_string(list_transform(ws, lambda x, i: CASE WHEN i = 1 THEN lower(x) ELSE upper(left(x, 1)) || lower(substr(x, 2)) END), '') AS camel FROM w)
SELECT p_partkey, camel, upper(left(camel, 1)) || substr(camel, 2) AS pascal, upper(array_to_string(ws, '_')) AS upper_snake, lower(regexp_replace(camel, '([a-z0-9])([A-Z])', '\1-\2', 'g')) AS kebab,
       array_to_string(list_transform(list_filter(string_split_regex(p_type, '[-_\s]+'), lambda x: x <> ''), lambda x: upper(left(x, 1)) || substr(x, 2)), '') AS icon FROM c
"""


def price_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = _cents("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.sum(numbers.uint32(-cents)).alias("unsigned"), numbers.ratio(F.sum("l_linenumber").cast("double"), F.count("*").cast("double")).alias("ratio"), F.max(numbers.backoff_ms(F.col("l_linenumber"))).alias("backoff"), F.min(numbers.iso(F.col("l_shipdate"))).alias("iso"))


PRICE_NUMBERS = """
SELECT l_shipdate, sum(((-round(l_extendedprice * 100)::BIGINT) % 4294967296 + 4294967296) % 4294967296)::BIGINT AS unsigned, round(sum(l_linenumber)::DOUBLE / count(*), 3) AS ratio,
       max(least(250 * pow(2.0, l_linenumber), 4000))::BIGINT AS backoff, min(strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z') AS iso FROM lineitem GROUP BY l_shipdate
"""


def cookie_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as Set-Cookie headers: a user is a path, an event type a cookie; the last one set counts and an expired
    one deletes it."""
    events = table(spark, sf_dir, "events").select(
        F.lit("https://h.test/t/app").alias("url"),
        F.concat(F.col("event_type"), F.lit("="), F.col("event_id").cast("string"), F.lit("; Path=/u/"), F.col("user_id").cast("string"), F.when(F.col("value") < 10, "; Max-Age=0").otherwise("")).alias("set_cookie"),
        "ts", "event_id",
    )
    now = F.timestamp_seconds(F.lit(4102444800))
    return http.store_cookies(events, F.struct("ts", "event_id"), now).select("path", "name", "value")


COOKIE_STORE = """
SELECT '/u/' || user_id AS path, event_type AS name, event_id::VARCHAR AS value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND NOT (value < 10)
"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a network log, summed by hour and type."""
    log = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("hour"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return log.groupBy("hour", "event_type").agg(F.count("*").alias("requests"), F.count_if(F.col("k") % 2 == 0).alias("even"), F.max("k").alias("most"))


REQUEST_LOG = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS requests, count(*) FILTER ((props->>'$.k')::INT % 2 = 0) AS even, max((props->>'$.k')::INT) AS most FROM events GROUP BY ALL"


def redirect_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as redirects to the one of half their number."""
    hops = table(spark, sf_dir, "supplier").where("s_suppkey > 1").select(F.concat(F.lit("http://h.test/"), F.col("s_suppkey")).alias("src"), F.concat(F.lit("http://h.test/"), F.expr("s_suppkey div 2")).alias("dst"))
    return http.follow_redirects(hops).select("url", "final_url", F.col("hops").cast("long").alias("hops"), "failed")


REDIRECT_ENDS = """
WITH RECURSIVE a AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 1),
c AS (SELECT src, dst, 1 AS hops FROM a UNION ALL SELECT c.src, a.dst, hops + 1 FROM c JOIN a ON c.dst = a.src WHERE hops < 10)
SELECT 'http://h.test/' || src AS url, 'http://h.test/' || arg_max(dst, hops) AS final_url, max(hops)::BIGINT AS hops, arg_max(dst, hops) IN (SELECT src FROM a) AS failed FROM c GROUP BY src
"""


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a nation's file would import its region's."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", urls.relative_import(F.concat(F.lit("src/nations/"), F.col("n_name"), F.lit(".js")), F.concat(F.lit("src/"), F.col("r_name"), F.lit(".js"))).alias("specifier"))


RELATIVE_PATHS = "SELECT n_nationkey, '../' || r_name || '.js' AS specifier FROM nation JOIN region ON n_regionkey = r_regionkey"

QUERIES = {
    "weighted_votes": (weighted_votes, WEIGHTED_VOTES), "strongest_hints": (strongest_hints, STRONGEST_HINTS), "suppliers_with_margin": (suppliers_with_margin, SUPPLIERS_WITH_MARGIN),
    "consensus_priorities": (consensus_priorities, CONSENSUS_PRIORITIES), "unanimous_statuses": (unanimous_statuses, UNANIMOUS_STATUSES), "return_shares": (return_shares, RETURN_SHARES),
    "reachable": (reachable, REACHABLE), "alias_chains": (alias_chains, ALIAS_CHAINS), "exclusive_modules": (exclusive_modules, EXCLUSIVE_MODULES), "pruned_modules": (pruned_modules, PRUNED_MODULES),
    "module_levels": (module_levels, MODULE_LEVELS), "missing_modules": (missing_modules, MISSING_MODULES), "customer_components": (customer_components, CUSTOMER_COMPONENTS),
    "part_names": (part_names, PART_NAMES), "price_numbers": (price_numbers, PRICE_NUMBERS), "cookie_store": (cookie_store, COOKIE_STORE), "request_log": (request_log, REQUEST_LOG),
    "redirect_ends": (redirect_ends, REDIRECT_ENDS), "relative_paths": (relative_paths, RELATIVE_PATHS),
}
