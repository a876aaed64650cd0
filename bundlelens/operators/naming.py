"""Names from behaviour: what a function does decides what it is called, by an ordered table of rules.

Facts are read off trees once (`facts`), rules are column expressions over them: the first that holds counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlelens.functions import numbers, text
from bundlelens.js import facts as trees
from bundlelens.operators.generate import generate

FACTS = "name string, params int, calls array<string>, reads array<string>, writes array<string>, strings array<string>"


def facts(modules: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    """Functions of modules with what they call, read, write and say."""
    guard = F.col(code).rlike(r"\bfunction\b|=>")
    return generate(modules.where(guard), keep, [code], trees.function_facts, FACTS)


def calls(pattern: str) -> Column:
    return F.exists("calls", lambda c: c.rlike(pattern))


def touches(pattern: str) -> Column:
    return F.exists(F.concat("reads", "writes", "calls"), lambda c: c.rlike(pattern))


def writes(pattern: str) -> Column:
    return F.exists("writes", lambda c: c.rlike(pattern))


def says(pattern: str) -> Column:
    return F.exists("strings", lambda s: s.rlike(pattern))


def _key() -> Column:
    """The subject of the first string that looks like a key."""
    return text.pascal(text.key_subject(F.coalesce(F.get(F.filter("strings", lambda s: s.rlike(r"^[\w:.-]+$")), F.lit(0)), F.lit("value"))))


def _resource() -> Column:
    """The resource of the first API path: its last segment that is no parameter or version."""
    path = F.get(F.filter("strings", lambda s: s.rlike(r"^(https?://[^/]+)?/(api|v\d+|rest|graphql)(/|$)")), F.lit(0))
    parts = F.filter(F.split(F.regexp_replace(path, r"^https?://[^/]+|[?#].*$", ""), "/"), lambda p: p.rlike(r"^[A-Za-z][\w-]*$") & ~p.rlike(r"^(api|v\d+|rest|graphql)$"))
    return F.when(path.isNotNull(), text.pascal(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("Data"))))


def semantic_name() -> Column:
    """The name that a function's facts give; null where they say nothing."""
    verb = (
        F.when(says(r"^(POST|post)$"), "create").when(says(r"^(PUT|PATCH|put|patch)$"), "update").when(says(r"^(DELETE|delete)$"), "delete").otherwise("fetch")
    )
    return (
        F.when(calls(r"^navigator\.clipboard\.writeText$"), "copyToClipboard")
        .when(calls(r"^navigator\.share$"), "share")
        .when(calls(r"(^|\.)createObjectURL$") & (touches(r"\.download$") | calls(r"\.click$")), "downloadFile")
        .when(calls(r"^(local|session)Storage\.setItem$"), F.concat(F.lit("store"), _key()))
        .when(calls(r"^(local|session)Storage\.getItem$"), F.concat(F.lit("load"), _key()))
        .when(calls(r"^(local|session)Storage\.removeItem$"), F.concat(F.lit("clear"), _key()))
        .when(writes(r"^document\.cookie$"), "setCookie")
        .when(touches(r"^document\.cookie$"), "getCookie")
        .when(calls(r"^JSON\.parse$") & calls(r"^JSON\.stringify$"), "deepClone")
        .when(calls(r"^(window\.)?clearTimeout$") & calls(r"^(window\.)?setTimeout$"), "debounce")
        .when(calls(r"^crypto\.randomUUID$|^Math\.random$") & ~calls(r"^Math\.floor$"), "randomId")
        .when(calls(r"^Math\.random$"), "randomInteger")
        .when(calls(r"^crypto\.subtle\.digest$"), "digest")
        .when(calls(r"^(window\.)?matchMedia$") & says("prefers-color-scheme"), "prefersDark")
        .when(calls(r"^(window\.)?matchMedia$"), "matchesMedia")
        .when(calls(r"(^|\.)scrollIntoView$"), "scrollToElement").when(calls(r"^(window\.)?scrollTo$"), "scrollTo")
        .when(calls(r"^(window\.)?open$"), "openWindow")
        .when(writes(r"^(window\.)?location(\.href)?$"), "redirect")
        .when(writes(r"^document\.title$"), "setTitle")
        .when(calls(r"^(window\.)?(fetch|axios(\.\w+)?)$|(^|\.)(get|post|put|patch|delete)$") & _resource().isNotNull(), F.concat(verb, _resource()))
        .when(calls(r"^Math\.min$") & calls(r"^Math\.max$") & (F.col("params") == 3), "clamp")
        .when(calls(r"^Intl\.NumberFormat|(^|\.)toLocaleString$|(^|\.)toFixed$") & (F.col("params") >= 1), "formatNumber")
        .when(calls(r"^Intl\.DateTimeFormat|(^|\.)toLocale(Date|Time)String$|(^|\.)toISOString$"), "formatDate")
        .when(calls(r"^(console)\.(error|warn)$") & (F.size("calls") == 1), "reportError")
    )


def named(found: DataFrame) -> DataFrame:
    """Adds semantic_name to function facts."""
    return found.withColumn("semantic_name", semantic_name())


def constant_name(literal: Column, subject: Column, operator: Column) -> Column:
    """The name of a constant by its use: a known duration, the limit of what it is compared with; null for others."""
    limit = F.when(subject.isNotNull() & operator.isin(">", ">="), F.concat(F.lit("MIN_"), text.upper_snake(subject))).when(subject.isNotNull() & operator.isin("<", "<="), F.concat(F.lit("MAX_"), text.upper_snake(subject)))
    return F.coalesce(numbers.duration_name(literal), F.when(literal.cast("double") != 0, limit))


# API of query hooks by the shape of the object that they are given.
HOOK_KEYS = [("useInfiniteQuery", "getNextPageParam"), ("useMutation", "mutationFn"), ("useQuery", "queryFn"), ("useForm", "resolver"), ("createBrowserRouter", "element")]


def usage_votes(calls_: DataFrame) -> DataFrame:
    """(package, export, name, votes): names of packages' exports by the keys (array) of the objects that importers pass
    (package, export, keys); the first shape of the table that fits."""
    name = F.lit(None).cast("string")
    for api, key in reversed(HOOK_KEYS):
        name = F.when(F.array_contains("keys", key), api).otherwise(name)
    return calls_.withColumn("name", name).where("name IS NOT NULL").groupBy("package", "export", "name").agg(F.count("*").alias("votes"))


def class_roles(usage: DataFrame) -> DataFrame:
    """Adds role to class usage (name, extends, methods, strings): api, client, error, model or other."""
    api = F.exists("strings", lambda s: s.rlike(r"^/(api|v\d+)(/|$)"))
    verbs = F.size(F.array_intersect("methods", F.array(*map(F.lit, ("get", "post", "put", "patch", "delete", "request")))))
    role = F.when(F.col("extends").rlike("Error$"), "error").when(verbs >= 2, "client").when(api, "api").when((F.size("methods") == 0) | F.exists("methods", lambda m: m.isin("toJSON", "clone", "fromJSON")), "model").otherwise("other")
    return usage.withColumn("role", role)
