"""Names and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bundlelens import rules


def capitalize(word: Column) -> Column:
    """The first letter upper-case, the rest as it is."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def lower_first(word: Column) -> Column:
    return F.concat(F.lower(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+"), "")


def camel(text: Column) -> Column:
    words = F.transform(_words(text), F.lower)
    joined = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(capitalize(w))), "")
    return F.when(joined.rlike("^[0-9]"), F.concat(F.lit("_"), joined)).otherwise(joined)


def pascal(text: Column) -> Column:
    return capitalize(camel(text))


def singular(word: Column) -> Column:
    """The singular of an English plural; null where there is none."""
    n, cut = F.length(word), lambda k: F.substring(word, F.lit(1), F.length(word) - k)
    stem = F.regexp_replace(word, r"(List|Array)$", "")
    return (
        F.when(word.rlike("ies$") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(ss|us|is)$"), F.lit(None).cast("string"))
        .when(word.rlike("(ch|sh|x|s)es$") & (n > 4), cut(2))
        .when(word.rlike("s$") & (n > 3), cut(1))
        .when(word.rlike("(List|Array)$") & (stem != ""), stem)
    )


def strip_verb(name: Column) -> Column:
    found = F.regexp_extract(name, rf"^({'|'.join(rules.VERBS)})([A-Z].*)$", 2)
    return F.when(found == "", name).otherwise(lower_first(found))


def upper_snake(text: Column) -> Column:
    return F.upper(F.array_join(F.array_remove(F.split(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+"), ""), "_"))


def kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1-$2"))


def key_subject(key: Column) -> Column:
    """What a storage key is about: its last word that isn't generic."""
    words = F.transform(F.array_remove(F.split(F.regexp_replace(key, r"([a-z])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+"), ""), F.lower)
    telling = F.filter(words, lambda w: ~w.rlike(rules.GENERIC_KEY_WORD))
    return F.coalesce(F.try_element_at(telling, F.lit(-1)), F.try_element_at(words, F.lit(-1)), key)


def icon_name(raw: Column) -> Column:
    return F.array_join(F.transform(F.array_remove(F.split(raw, r"[-_\s]+"), ""), capitalize), "")


def component_name(selector: Column) -> Column:
    """The class of an element's selector."""
    bare = F.regexp_replace(selector, r"^(?:app|ng|[a-z]{1,3})-([a-z])", "$1")
    return F.concat(icon_name(F.regexp_replace(bare, "[_\\s]", "")), F.lit("Component"))


def route_name(segments: Column, index: Column) -> Column:
    """The component of a route. Parameters make the word before them singular; null for what is no name."""
    star = F.array_contains(segments, "*")
    plain = F.filter(segments, lambda s: s != "*")
    one = lambda w: F.when(w.rlike("ies$"), F.concat(F.regexp_replace(w, "ies$", ""), F.lit("y"))).when(w.rlike("(ss|us)$"), w).otherwise(F.regexp_replace(w, "s$", ""))
    after = lambda i: F.startswith(F.coalesce(F.get(plain, i + 1), F.lit("")), F.lit(":"))
    words = F.filter(F.transform(plain, lambda s, i: F.when(s.startswith(":"), F.lit(None)).otherwise(F.when(after(i), one(pascal(s))).otherwise(pascal(s)))), lambda w: w.isNotNull())
    named = F.forall(plain, lambda s: s.startswith(":") | s.rlike(r"^[A-Za-z][\w.-]*$"))
    joined = F.concat(F.array_join(words, ""), F.when(index & ~star, F.when(F.size(words) > 0, "Index").otherwise("Home")).otherwise(""))
    joined = F.when(joined == "", "Home").otherwise(joined)
    return F.when(star & (F.size(segments) == 1), "NotFound").when(~named, F.when(star, "NotFound")).otherwise(F.concat(joined, F.when(star, "NotFound").otherwise("")))


def snippet(text: Column, most: int = 160) -> Column:
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(clean) > most, F.concat(F.left(clean, F.lit(most - 3)), F.lit("..."))).otherwise(clean)


def counted(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


# Entities that texts of markup use.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")]


def decode_entities(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def protected_email(code: Column) -> Column:
    """An e-mail address that is written as hexadecimal bytes, each combined with the first; null if it is none."""
    pairs = F.regexp_extract_all(code, F.lit("([0-9A-Fa-f]{2})"), 1)
    number = lambda x: F.conv(x, 16, 10).cast("int")
    octets = F.transform(F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0))), lambda x: F.lpad(F.hex(number(x).bitwiseXOR(number(F.get(pairs, F.lit(0))))), 2, "0"))
    found = F.try_validate_utf8(F.unhex(F.array_join(octets, "")).cast("string"))
    return F.when(code.rlike(r"^(?:[0-9A-Fa-f]{2}){2,}$") & found.rlike(r'^[^\s<>"]+@[^\s<>"]+$'), found)


def string_kind(value: Column) -> Column:
    found = F.lit("text")
    for kind, pattern in reversed(rules.STRING_KINDS):
        found = F.when(value.rlike(pattern), kind).otherwise(found)
    return found


def is_minified(name: Column) -> Column:
    return (F.length(name) <= 2) & ~name.isin(rules.SHORT_NAMES)


def third_party(place: Column) -> Column:
    """The service of a script by host and path; null for none."""
    found = F.lit(None).cast("string")
    for pattern, name in reversed(rules.THIRD_PARTIES):
        found = F.when(place.rlike(pattern), name).otherwise(found)
    return found


def license_package(comment: Column) -> Column:
    """struct<package, version> of a licence banner such as `name v1.2.3`."""
    name = F.regexp_extract(comment, r"(?i)(?:^|[\s*!])(@?[a-z][\w./-]*?)[\s@,]+(?:version\s+)?v?(\d+\.\d+(?:\.\d+)?[\w.-]*)", 1)
    version = F.regexp_extract(comment, r"(?i)(?:^|[\s*!])(@?[a-z][\w./-]*?)[\s@,]+(?:version\s+)?v?(\d+\.\d+(?:\.\d+)?[\w.-]*)", 2)
    return F.when(name != "", F.struct(F.lower(name).alias("package"), version.alias("version")))
