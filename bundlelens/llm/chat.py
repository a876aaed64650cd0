"""Chat formatting by a compiler for a sandboxed template language.

`compile_template` parses a template into a syntax tree, folds what is constant, and generates nested Python closures.
The language has text, `{{ expr }}`, `{# comment #}`, `{% for x in e %}..{% endfor %}`, `{% if e %}..{% elif e %}..
{% else %}..{% endif %}`, `{% set x = e %}` and `{% generation %}..{% endgeneration %}`; what is written inside the last
is under the loss mask. Expressions have strings, integers, true, false, none, names, `a.b` and `a["b"]` on mappings
(and `a[0]` on lists), or, and, not, comparisons, in, + - * ~, `x if c else y` and filters `value|name(args)`.

Sandbox: names reach only the given variables, members only the keys of mappings, calls only the registered filters.
Python attributes can't be reached, there are no imports, and loops run over the given data alone.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import groupby
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """The template is malformed, or asks for what the sandbox doesn't have."""


class Node(NamedTuple):
    kind: str
    parts: tuple = ()


TURN_END, TURN_BEGIN = "</turn>", "### "


def escape(text: Any) -> str:
    """Break up control strings so that none is left; `unescape` undoes it. Null is empty."""
    text = "" if text is None else str(text)
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    if "##" in text:
        text = re.sub("#(?=#)", "#\\\\", text)
    return text.replace(TURN_END, "<\\/turn>")


def escape_line(text: Any) -> str:
    """`escape`, and line ends too, for texts that end with the line."""
    return escape(text).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable] = {
    "escape": escape,
    "escape_line": escape_line,
    "trim": lambda x: ("" if x is None else str(x)).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "default": lambda x, other="": other if x is None else x,
    "replace": lambda x, old, new: str(x).replace(old, new),
}
BINARY = {"+": operator.add, "-": operator.sub, "*": operator.mul, "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "~": lambda a, b: shown(a) + shown(b), "in": lambda a, b: a in b}
LEVELS = (("==", "!=", "<", ">", "<=", ">=", "in"), ("~",), ("+", "-"), ("*",))
TOKEN = re.compile(r"""\s*(?:(\d+)|([A-Za-z_]\w*)|("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(==|!=|<=|>=|[-+*~<>=|.,()\[\]]))""", re.S)
TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
PLAIN = {"n": "\n", "t": "\t", "r": "\r"}


def shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


class Expression:
    """Recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, Any]] = []
        at, source = 0, source.strip()
        while at < len(source):
            if not (m := TOKEN.match(source, at)):
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            number, name, string, sign = m.groups()
            if string is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: PLAIN.get(e[1], e[1]), string[1:-1], flags=re.S)))
            else:
                self.tokens.append(("const", int(number)) if number else ("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"a name expected, not {value!r}")
        self.at += 1
        return value

    def whole(self) -> Node:
        found = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def choice(self) -> Node:
        value = self.either()
        if self.take("if"):
            test = self.either()
            return Node("choice", (test, value, self.choice() if self.take("else") else Node("const", (None,))))
        return value

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = Node("or", (left, self.both()))
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("and"):
            left = Node("and", (left, self.negated()))
        return left

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.binary(0)

    def binary(self, level: int) -> Node:
        if level == len(LEVELS):
            return self.filtered()
        left = self.binary(level + 1)
        while sign := self.take(*LEVELS[level]):
            left = Node("binary", (sign, left, self.binary(level + 1)))
        return left

    def filtered(self) -> Node:
        value = self.member()
        while self.take("|"):
            name, args = self.name(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.choice())
                    self.take(",")
            value = Node("filter", (name, value, *args))
        return value

    def member(self) -> Node:
        value = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                value = Node("member", (value, Node("const", (self.name(),))))
            else:
                value = Node("member", (value, self.choice()))
                self.need("]")
        return value

    def atom(self) -> Node:
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends too early")
        kind, value = self.tokens[self.at]
        if kind == "const":
            self.at += 1
            return Node("const", (value,))
        name = self.name()
        constants = {"true": True, "false": False, "none": None}
        return Node("const", (constants[name],)) if name in constants else Node("name", (name,))


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    items, at = [], 0
    for m in TAG.finditer(source):
        if m.start() > at:
            items.append(("text", source[at : m.start()]))
        if m[1] is not None:
            items.append(("print", m[1]))
        elif m[2] is not None:
            items.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        items.append(("text", source[at:]))
    tree, end, word = _block(items, 0, ())
    if end < len(items):
        raise TemplateError(f"{word!r} has no beginning")
    return tree


def _block(items: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[Node, int, str]:
    """Nodes up to one of the tags `ends`; where that stands, and its first word."""
    nodes: list[Node] = []
    while at < len(items):
        kind, source = items[at]
        if kind == "text":
            nodes.append(Node("text", (source,)))
        elif kind == "print":
            nodes.append(Node("print", (Expression(source).whole(),)))
        else:
            word, _, rest = source.partition(" ")
            if word in ends:
                return Node("block", tuple(nodes)), at, word
            node, at = _statement(items, at, word, rest)
            nodes.append(node)
            continue
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return Node("block", tuple(nodes)), at, ""


def _statement(items: list[tuple[str, str]], at: int, word: str, rest: str) -> tuple[Node, int]:
    if word == "for":
        name, found, of = rest.partition(" in ")
        if not found or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
            raise TemplateError(f"malformed loop {rest!r}")
        body, at, _ = _block(items, at + 1, ("endfor",))
        return Node("for", (name.strip(), Expression(of).whole(), body)), at + 1
    if word == "if":
        body, at, end = _block(items, at + 1, ("elif", "else", "endif"))
        other = Node("block")
        if end == "elif":
            other, at = _statement(items, at, "if", items[at][1].partition(" ")[2])
            return Node("if", (Expression(rest).whole(), body, other)), at
        if end == "else":
            other, at, _ = _block(items, at + 1, ("endif",))
        return Node("if", (Expression(rest).whole(), body, other)), at + 1
    if word == "set":
        name, found, value = rest.partition("=")
        if not found or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
            raise TemplateError(f"malformed assignment {rest!r}")
        return Node("set", (name.strip(), Expression(value).whole())), at + 1
    if word == "generation":
        body, at, _ = _block(items, at + 1, ("endgeneration",))
        return Node("generation", (body,)), at + 1
    raise TemplateError(f"unknown tag {word!r}")


def fold(node: Any) -> Any:
    """The tree with constant expressions evaluated, dead branches dropped and neighbouring texts joined."""
    if not isinstance(node, Node):
        return node
    node = Node(node.kind, tuple(map(fold, node.parts)))
    kind, parts = node
    constant = lambda x: isinstance(x, Node) and x.kind == "const"
    if kind in ("binary", "filter", "not", "member") and all(constant(x) for x in parts if isinstance(x, Node)):
        try:
            return Node("const", (_value(node)({}),))
        except (TypeError, ValueError):
            return node  # it fails when rendered, if it is reached
    if kind in ("and", "or") and constant(parts[0]):
        return parts[1] if bool(parts[0].parts[0]) == (kind == "and") else parts[0]
    if kind in ("choice", "if") and constant(parts[0]):
        return parts[1] if parts[0].parts[0] else parts[2]
    if kind == "print" and constant(parts[0]):
        return Node("text", (shown(parts[0].parts[0]),))
    if kind == "block":
        flat: list[Node] = []
        for x in parts:
            for y in x.parts if x.kind == "block" else (x,):
                if y.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", (flat[-1].parts[0] + y.parts[0],))
                elif y.kind != "text" or y.parts[0]:
                    flat.append(y)
        return Node("block", tuple(flat))
    return node


def _value(node: Node) -> Callable[[dict], Any]:
    """The closure that evaluates an expression over the variables."""
    kind, parts = node
    if kind == "const":
        return lambda env, value=parts[0]: value
    if kind == "name":
        return lambda env, name=parts[0]: env.get(name)
    if kind == "binary":
        f, a, b = BINARY[parts[0]], _value(parts[1]), _value(parts[2])
        return lambda env: f(a(env), b(env))
    if kind == "filter":
        f, args = FILTERS[parts[0]], tuple(map(_value, parts[1:]))
        if len(args) == 1:
            return lambda env, a=args[0]: f(a(env))
        return lambda env: f(*(a(env) for a in args))
    closures = tuple(map(_value, parts))
    if kind == "member":
        return lambda env: _member(closures[0](env), closures[1](env))
    if kind == "not":
        return lambda env: not closures[0](env)
    if kind == "and":
        return lambda env: closures[0](env) and closures[1](env)
    if kind == "or":
        return lambda env: closures[0](env) or closures[1](env)
    return lambda env: closures[1](env) if closures[0](env) else closures[2](env)


def _member(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, list) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


Write = Callable[[str, bool], None]


def _emit(node: Node) -> Callable[[dict, Write, bool], None]:
    """The closure that writes what a statement makes; its last argument is whether the loss mask is on."""
    kind, parts = node
    if kind == "text":
        return lambda env, write, masked, text=parts[0]: write(text, masked)
    if kind == "print":
        value = _value(parts[0])
        return lambda env, write, masked: write(shown(value(env)), masked)
    if kind == "block":
        closures = tuple(map(_emit, parts))

        def block(env, write, masked):
            for f in closures:
                f(env, write, masked)

        return block
    if kind == "generation":
        body = _emit(parts[0])
        return lambda env, write, masked: body(env, write, True)
    if kind == "set":
        value = _value(parts[1])
        return lambda env, write, masked, name=parts[0]: env.__setitem__(name, value(env))
    if kind == "if":
        test, then, other = _value(parts[0]), _emit(parts[1]), _emit(parts[2])
        return lambda env, write, masked: (then if test(env) else other)(env, write, masked)
    name, of, body = parts[0], _value(parts[1]), _emit(parts[2])

    def loop(env, write, masked):
        items, i = iter(of(env) or ()), 0
        end = object()
        item = next(items, end)
        while item is not end:  # one item ahead, for loop.last; never the whole of a stream
            following, i = next(items, end), i + 1
            body(env | {name: item, "loop": {"index": i, "first": i == 1, "last": following is end}}, write, masked)
            item = following

    return loop


def compile_template(source: str) -> Callable[[dict, Write], None]:
    """render(variables, write): writes the output piece by piece, each with whether it is under the loss mask."""
    emit = _emit(fold(parse(source)))
    return lambda env, write: emit(dict(env), write, False)


def render(source: str, **variables: Any) -> tuple[str, list[tuple[int, int]]]:
    """The whole output, and the (begin, end) code points of its pieces under the loss mask."""
    pieces: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0

    def write(text: str, masked: bool) -> None:
        nonlocal at
        pieces.append(text)
        if masked and text:
            spans.append((at, at + len(text)))
        at += len(text)

    compile_template(source)(variables, write)
    return "".join(pieces), spans


#: Each turn is a line that begins with `### ` and the role, the text, and `</turn>`; assistants' texts are learned.
TEMPLATE = (
    "{% for turn in messages %}" + TURN_BEGIN + "{{ turn.role|escape_line }}\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text|escape }}{% endgeneration %}"
    "{% else %}{{ turn.text|escape }}{% endif %}" + TURN_END + "\n{% endfor %}"
)
ROLE = re.compile(re.escape(TURN_BEGIN) + r"((?:\\.|[^\\\n])*)\n", re.S)


def read_turn(source: str) -> tuple[str, str]:
    """(role, text) of the formatted turn."""
    m = ROLE.match(source)
    if not m or not source.endswith(TURN_END + "\n"):
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(source[m.end() : -len(TURN_END) - 1])


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a conversation formatted by TEMPLATE."""
    return [read_turn(x + TURN_END + "\n") for x in formatted.split(TURN_END + "\n")[:-1]]


def _by_conversation(df: DataFrame) -> DataFrame:
    """Rows dealt by conversation and, in each partition, in order. Equal turns are ordered by role and text."""
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches: Iterable) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True)


def _conversations(batches: Iterable) -> Iterator[tuple[Any, Iterator[dict]]]:
    for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
        yield conv_id, ({"role": role, "text": text} for _, role, text in rows)


def format_conversations(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, spans): every conversation of (conv_id, turn, role, text) rows rendered by `template` with
    `messages`, and the code points under its generation markers.

    Null role or text: empty. A null conv_id is a conversation of its own; repeated rows are turns of their own; equal
    or null turn numbers are ordered by role and text, nulls first. No rows: no conversations. Other columns aren't read.
    """
    import pyarrow as pa

    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    compile_template(template)  # errors show here rather than in tasks

    def run(batches):
        for conv_id, messages in _conversations(batches):
            text, spans = render(template, messages=messages)
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], kind), pa.array([text], pa.string()), pa.array([[{"begin": a, "end": b} for a, b in spans]], span)], ["conv_id", "formatted", "spans"])

    rows = _by_conversation(df)
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[rows.schema["conv_id"].dataType.simpleString()]
    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, formatted string, spans array<struct<begin:bigint,end:bigint>>")


class Digest:
    """Reads formatted output back turn by turn as it is written, so that a conversation of any length fits."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.pending: list[str] = []
        self.masked: list[str] = []

    def write(self, text: str, masked: bool) -> None:
        self.formatted_chars += len(text)
        self.pending.append(text)
        if masked:
            self.masked.append(text)
        if TURN_END + "\n" in text and not masked:
            self.read()

    def read(self) -> None:
        *whole, rest = "".join(self.pending).split(TURN_END + "\n")
        self.pending = [rest]
        for source in whole:
            role, text = read_turn(source + TURN_END + "\n")
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        plain = unescape("".join(self.masked))
        self.masked = []
        self.loss.update(plain.encode())
        self.loss_chars += len(plain)


def digests(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output of
    `template` while it is written. The template must mark turns as TEMPLATE does. Edge cases as in
    `format_conversations`."""
    import pyarrow as pa

    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        write_all, rows = compile_template(template), []
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)
        for conv_id, messages in _conversations(batches):
            digest = Digest()
            write_all({"messages": messages}, digest.write)
            rows.append((conv_id, digest.n_turns, digest.turns.hexdigest(), digest.loss_chars, digest.loss.hexdigest(), digest.formatted_chars))
            if len(rows) >= 4096:
                yield flush()
                rows.clear()
        if rows:
            yield flush()

    rows = _by_conversation(df)
    name = rows.schema["conv_id"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]
    return rows.mapInArrow(run, f"conv_id {name}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the contract adds: control strings inside texts.
PLANTED = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return digests(given.unionByName(planted))
