"""Scripts and style sheets: tokens, and what can be read off them without running anything."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.functions import urls
from bundlelens.operators.generate import generate


class Token(NamedTuple):
    kind: str  # name, number, string, template, regex, punct
    value: str
    line: int
    raw: str
    start: int = 0
    newline: bool = False  # whether a line ends between the token before and this one


# Keywords after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else await yield".split())
_NAME = re.compile(r"[#@]?[A-Za-z_$\x80-\U0010ffff\\][\w$\x80-\U0010ffff\\]*")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#\\]")
_REGEX = re.compile(r"/(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_STRING = {'"': re.compile(r'"(?:[^"\\\n]|\\.)*"', re.S), "'": re.compile(r"'(?:[^'\\\n]|\\.)*'", re.S)}
_ESCAPE = re.compile(r"\\(?:u\{([\da-fA-F]+)\}|u([\da-fA-F]{4})|x([\da-fA-F]{2})|(\r\n|.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\u2028": "", "\u2029": ""}


def unquoted(text: str) -> str:
    """The value of a string's or template's inside."""
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            number = int(code, 16)
            return chr(number) if number < 0x110000 else "\ufffd"
        return _PLAIN.get(m[4], m[4])

    found = _ESCAPE.sub(one, text)
    return found.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", found) else found


def tokens(code: str) -> Iterator[Token]:
    """Tokens of a script, comments left out. What is malformed is skipped a character at a time. A template is a token
    for each of its pieces of text, with the tokens of its expressions between them."""
    at, line, n = 0, 1, len(code)
    before: Token | None = None  # decides what a slash is
    braces: list[str] = []  # what each open brace is: of code, or of a template's expression
    last_line = 1

    def template(begin: int) -> tuple[int, str, bool]:
        """(after the piece, its raw text, whether an expression follows)."""
        i = begin
        while i < n:
            c = code[i]
            if c == "\\":
                i += 2
            elif c == "`":
                return i + 1, code[begin:i], False
            elif c == "$" and code.startswith("${", i):
                return i + 2, code[begin:i], True
            else:
                i += 1
        return n, code[begin:], False

    while at < n:
        c = code[at]
        if c == "\n":
            line, at = line + 1, at + 1
            continue
        if c.isspace() or c == "\ufeff":
            at += 1
            continue
        if c == "/" and code.startswith("//", at) or (at == 0 and code.startswith("#!")):
            end = code.find("\n", at)
            at = n if end < 0 else end
            continue
        if c == "/" and code.startswith("/*", at):
            end = code.find("*/", at + 2)
            end = n if end < 0 else end + 2
            line += code.count("\n", at, end)
            at = end
            continue
        token = None
        if c in "\"'":
            if m := _STRING[c].match(code, at):
                token = Token("string", unquoted(m[0][1:-1]), line, m[0])
        elif c == "`" or (c == "}" and braces and braces[-1] == "template"):
            if c == "}":
                braces.pop()
            end, raw, goes_on = template(at + 1)
            token = Token("template", unquoted(raw), line, code[at:end])
            if goes_on:
                braces.append("template")
        elif c.isdigit() or (c == "." and code[at + 1 : at + 2].isdigit()):
            m = _NUMBER.match(code, at)
            token = Token("number", m[0], line, m[0])
        elif c == "/" and (before is None or before.kind == "punct" and before.value not in (")", "]", "}") or before.kind == "name" and before.value in _BEFORE_REGEX or before.kind == "template" and before.raw.endswith("${")):
            if m := _REGEX.match(code, at):
                token = Token("regex", m[0], line, m[0])
        elif m := _NAME.match(code, at):
            token = Token("name", m[0], line, m[0])
        if token is None and (m := _PUNCT.match(code, at)):
            token = Token("punct", m[0], line, m[0])
            if m[0] == "{":
                braces.append("code")
            elif m[0] == "}" and braces:
                braces.pop()
        if token is None:
            at += 1
            continue
        yield Token(token.kind, token.value, token.line, token.raw, at, line > last_line)
        line += token.raw.count("\n")
        last_line = line
        at += len(token.raw)
        before = token


def string_literals(code: str | None) -> list[tuple[str, int]]:
    """(value, line) of every string and piece of a template."""
    return [(t.value, t.line) for t in tokens(code or "") if t.kind in ("string", "template")]


def import_specifiers(code: str | None, module: bool = False) -> list[tuple[int, str, str]]:
    """(number, specifier, how): static imports, re-exports and import() of constant strings, each specifier once."""
    found: dict[str, str] = {}
    own = list(tokens(code or ""))
    for i, t in enumerate(own):
        after = own[i + 1 : i + 3]
        if t.kind != "name" or (i and own[i - 1].value == "."):
            continue
        if t.value == "import" and after:
            if after[0].kind == "string":
                found.setdefault(after[0].value, "static")
            elif after[0].value == "(" and len(after) > 1 and (after[1].kind == "string" or after[1].kind == "template" and after[1].raw.endswith("`")):
                found.setdefault(after[1].value, "dynamic")
        elif t.value == "from" and after and after[0].kind == "string" and i and own[i - 1].kind in ("name", "punct") and (own[i - 1].kind == "name" or own[i - 1].value in ("}", "*")):
            found.setdefault(after[0].value, "static")
    return [(i, s, how) for i, (s, how) in enumerate(found.items())]


IMPORTS = "ord int, specifier string, how string"
#: Scripts without any of these have no imports; they never reach Python.
IMPORT_GUARD = r"""\bimport\s*[\w{*"'(`$]|\bexport\s*[{*]"""


def imports(df: DataFrame, keep: list[str], code: str = "code", module: str | None = None) -> DataFrame:
    """Import specifiers of the scripts in `df`: the kept columns, number, specifier, static or dynamic."""
    guard = F.col(code).rlike(IMPORT_GUARD)
    return generate(df.where(guard | F.col(module) if module else guard), keep, [code], import_specifiers, IMPORTS)


def script_resources(assets: DataFrame) -> DataFrame:
    """(asset_id, url, type, initiator, optional): what scripts (asset_id, url, body) load: modules, workers, scripts."""
    own = imports(assets, ["asset_id", "url"], "body").where(urls.is_relative(F.col("specifier")))
    resolved = urls.resolve(F.col("specifier"), F.col("url"))
    p = urls.path(resolved)
    # only what looks like code: a script or sheet by its name, or a name without extension
    modules = own.withColumn("to", resolved).where(F.col("to").isNotNull() & p.rlike(r"(?i)\.(m?js|jsx?|css)$|^[^.]*$"))
    found = modules.select("asset_id", F.col("to").alias("url"), F.when(urls.guess_type(F.col("to")) == "style", "style").otherwise("module").alias("type"), F.concat(F.lit("import:"), F.col("url")).alias("initiator"), F.lit(False).alias("optional"))
    for kind, pattern in (("worker", r"""new\s+(?:Shared)?Worker\(\s*(?:new\s+URL\(\s*)?["'`]([^"'`$]+)["'`]"""), ("worker", r"""serviceWorker\.register\(\s*["'`]([^"'`$]+)["'`]"""), ("script", r"""importScripts\(\s*["'`]([^"'`$]+)["'`]""")):
        named = assets.select("asset_id", "url", F.explode(F.regexp_extract_all("body", F.lit(pattern), 1)).alias("href")).withColumn("to", urls.resolve(F.col("href"), F.col("url"))).where("to IS NOT NULL")
        found = found.unionByName(named.select("asset_id", F.col("to").alias("url"), F.lit(kind).alias("type"), F.concat(F.lit(f"{kind}:"), F.col("url")).alias("initiator"), F.lit(True).alias("optional")))
    return found


def style_resources(sheets: DataFrame) -> DataFrame:
    """(asset_id, url): the sheets that sheets (asset_id, url, body) import."""
    pattern = r"""@import\s+(?:url\(\s*)?["']?([^"')\s;]+)["']?\s*\)?"""
    found = sheets.select("asset_id", "url", F.explode(F.regexp_extract_all("body", F.lit(pattern), 1)).alias("href"))
    return found.select("asset_id", urls.resolve(F.col("href"), F.col("url")).alias("to")).where("to IS NOT NULL").withColumnRenamed("to", "url").distinct()


def css_rules(css: str | None) -> list[tuple[int, str, str]]:
    """(number, text, head) of a sheet's top-level rules and comments."""
    css = css or ""
    pieces, depth, start = [], 0, 0
    # strings, comments and escapes are stepped over as wholes; what is left are braces and semicolons
    for m in re.finditer(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\]|\\.)*(?:"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)|[{};]""", css, re.S):
        mark = m[0]
        if mark.startswith("/*"):
            if depth == 0:
                pieces += [css[start : m.start()], mark]
                start = m.end()
        elif mark == "{":
            depth += 1
        elif mark == "}":
            depth = max(0, depth - 1)
        if (mark == "}" or mark == ";") and depth == 0:
            pieces.append(css[start : m.end()])
            start = m.end()
    pieces.append(css[start:])
    texts = [p.strip() for p in pieces if p.strip()]
    return [(i, t, t.partition("{")[0].strip()) for i, t in enumerate(texts)]


def sheet_rules(sheets: DataFrame, keep: list[str], css: str = "css") -> DataFrame:
    return generate(sheets, keep, [css], css_rules, "ord int, text string, head string")


_SCRIPT_URL = re.compile(r"^(https?://[^\s\"'`<>]+|/[^\s\"'`<>]*)\.(m?js|css)(\?[^\s\"'`<>]*)?$", re.I)


def seen_urls(code: str | None) -> list[tuple[str, int]]:
    """(URL, line) of constant strings that name scripts or sheets."""
    return [(value, line) for value, line in string_literals(code) if _SCRIPT_URL.match(value)]


_LOADER_CALLS = {"eval": "eval", "importScripts": "import-scripts", "require": "dynamic-require", "__webpack_require__": "dynamic-require"}


def loaders(code: str | None) -> list[tuple[str, int]]:
    """(kind, line) of calls that load code whose name isn't a constant."""
    own, found = list(tokens(code or "")), []
    constant = lambda t: t is not None and (t.kind in ("string", "number") or t.kind == "template" and t.raw.startswith("`") and t.raw.endswith("`"))
    get = lambda i: own[i] if 0 <= i < len(own) else None
    for i, t in enumerate(own):
        if t.kind != "name":
            continue
        before, after = get(i - 1), get(i + 1)
        member = before is not None and before.value in (".", "?.")
        called = after is not None and after.value == "("
        first, second = get(i + 2), get(i + 3)
        static = constant(first) and (second is None or second.value in (")", ","))
        empty = first is not None and first.value == ")"
        if t.value == "import" and called and not member:
            if not static:
                found.append(("dynamic-import", t.line))
        elif t.value == "import" and called and member and get(i - 2).value == "System":
            found.append(("system-import", t.line))
        elif t.value == "ensure" and called and member and get(i - 2).value == "require":
            found.append(("require-ensure", t.line))
        elif t.value in _LOADER_CALLS and called and not empty and not static and not (member and t.value != "importScripts") and not (before is not None and before.value == "function"):
            found.append((_LOADER_CALLS[t.value], t.line))
        elif t.value in ("Worker", "SharedWorker", "Function", "URL") and before is not None and before.value == "new" and called and not empty:
            if t.value == "Function":
                if not all(constant(x) or x.value == "," for x in _inside(own, i + 2)):
                    found.append(("eval", t.line))
            elif t.value == "URL":
                if not static and _argument(own, i + 2, 1)[:3] == ["import", ".", "meta"]:
                    found.append(("url-import-meta", t.line))
            elif not static and not (first.value == "new" and second is not None and second.value == "URL" and constant(get(i + 5))):
                found.append(("worker", t.line))
    return found


def _inside(own: list[Token], at: int) -> list[Token]:
    """The tokens of a call's arguments; `at` is the first one after the parenthesis."""
    depth = 0
    for end in range(at, len(own)):
        if own[end].kind == "punct":
            depth += (own[end].value in ("(", "[", "{")) - (own[end].value in (")", "]", "}"))
            if depth < 0:
                return own[at:end]
    return own[at:]


def _argument(own: list[Token], at: int, number: int) -> list[str]:
    """Token values of one of a call's arguments."""
    depth, index, found = 0, 0, []
    for t in _inside(own, at):
        if t.kind == "punct":
            depth += (t.value in ("(", "[", "{")) - (t.value in (")", "]", "}"))
            if t.value == "," and depth == 0:
                index += 1
                continue
        if index == number:
            found.append(t.value)
    return found


def features(code: str | None) -> list[tuple[str]]:
    """Features that minification keeps: P: properties, K: keys, S: strings of 60 characters at most, N: numbers,
    G: global names; each once."""
    own, found = list(tokens(code or "")), {}
    for i, t in enumerate(own):
        before = own[i - 1].value if i else ""
        after = own[i + 1].value if i + 1 < len(own) else ""
        if t.kind == "name":
            if before in (".", "?."):
                if len(t.value) > 1:
                    found[f"P:{t.value}"] = None
            elif after == ":" and before in ("{", ","):
                if len(t.value) > 1:
                    found[f"K:{t.value}"] = None
            elif t.value in _GLOBALS:
                found[f"G:{t.value}"] = None
        elif t.kind == "string":
            if after == ":" and before in ("{", ","):
                found[f"K:{t.value}"] = None
            elif 1 < len(t.value) <= 60:
                found[f"S:{t.value}"] = None
        elif t.kind == "number" and len(t.value) > 1:
            found[f"N:{t.value}"] = None
    return [(f,) for f in found]


# Names of the platform that minifiers can't change.
_GLOBALS = frozenset("Array ArrayBuffer BigInt Boolean DataView Date Error Function Infinity JSON Map Math NaN Number Object Promise Proxy RangeError Reflect RegExp Set String Symbol SyntaxError TypeError URIError WeakMap WeakSet clearTimeout console decodeURIComponent document encodeURIComponent fetch globalThis history isNaN localStorage location navigator parseFloat parseInt performance requestAnimationFrame sessionStorage setInterval setTimeout window".split())


def module_features(modules: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    return generate(modules, keep, [code], features, "feature string")


def numeric_literals(code: str | None) -> list[tuple[int, int]]:
    """(value as unsigned 32 bits, line) of the integers in a script."""
    found = []
    for t in tokens(code or ""):
        if t.kind == "number":
            text = t.value.rstrip("n").replace("_", "")
            try:
                value = int(text, 0) if text[:2].lower() in ("0x", "0b", "0o") else float(text)
            except ValueError:
                continue
            if value == int(value):
                found.append((int(value) & 0xFFFFFFFF, t.line))
    return found
