"""Bundles to modules: the containers that bundlers write, and each module's code as a module of its own.

Code is edited in place rather than printed anew: a factory's parameters get their usual names, calls of its loader
become imports, export definitions become export lists, everything else stays as it was captured.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from bundlelens.js.parser import Node, parse_or_none, walk
from bundlelens.js.scopes import FUNCTIONS, Analysis, edited, rename_edits


@dataclass
class Module:
    id: str
    code: str
    deps: list[str]
    exports: list[str] = field(default_factory=list)
    origin: str = "module"


@dataclass
class Chunk:
    shape: str = "unknown"
    chunk_ids: list[str] = field(default_factory=list)
    containers: int = 0
    recognized: int = 0
    modules: list[Module] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    aliases: list[tuple[str, str]] = field(default_factory=list)

    @property
    def level(self) -> str:
        """raw: nothing was recognised; partial: something was left out; full."""
        return "raw" if not self.recognized else "partial" if self.skipped or self.notes else "full"


def key_of(node: Node | None) -> str | None:
    """The text of a constant key."""
    if node is None:
        return None
    if node.type == "Identifier":
        return node.name
    return node.value if node.type == "Literal" and node.kind in ("string", "number") else None


def constant(node: Node | None) -> str | None:
    return node.value if node is not None and node.type == "Literal" and node.kind in ("string", "number") else None


def stem(url: str) -> str:
    return re.sub(r"\.[mc]?js$", "", re.split(r"[?#]", url)[0].rsplit("/", 1)[-1])


def pushes(tree: Node, code: str, mark: str) -> list[tuple[str, Node]]:
    """(global, call) of `<something with the mark>.push(..)` outside of functions."""
    found, stack = [], [tree]
    while stack:
        n = stack.pop()
        if n.type in FUNCTIONS or n.type in ("ClassDeclaration", "ClassExpression"):
            continue
        if n.type == "CallExpression" and n.callee.type == "MemberExpression" and not n.callee.computed and n.callee.property.name == "push":
            if m := re.search(mark, code[n.callee.object.start : n.callee.property.start]):
                found.append((m[0], n))
        stack.extend(reversed(n.children()))
    return found


def declared_functions(tree: Node) -> dict[str, Node]:
    """Functions that the program itself declares by name, for factories given by reference."""
    found = {s.id: s for s in tree.body if s.type == "FunctionDeclaration"}
    for s in tree.body:
        for d in s.declarations if s.type == "VariableDeclaration" else ():
            if d.init is not None and d.init.type in FUNCTIONS and d.id.type == "Identifier":
                found[d.id.name] = d.init
    return found


def factory_of(value: Node | None, named: dict[str, Node]) -> Node | None:
    if value is None:
        return None
    if value.type in FUNCTIONS:
        return value
    return named.get(value.name) if value.type == "Identifier" else None


def module_map(value: Node, named: dict[str, Node], chunk: Chunk) -> list[tuple[str, Node]]:
    """(id, factory) of an object or array of factories; what is neither is told in `skipped`."""
    if value.type == "ArrayExpression":
        pairs = [(str(i), e) for i, e in enumerate(value.elements) if e is not None]
    else:
        pairs = []
        for p in value.properties:
            name = key_of(p.key) if p.type == "Property" and not (p.computed and p.key.type == "Identifier") else None
            if name is None:
                chunk.skipped.append(("?", "computed module key" if p.type == "Property" else f"unexpected {p.type} in module map"))
            else:
                pairs.append((name, p.value))
    found = []
    for name, v in pairs:
        factory = factory_of(v, named)
        if factory is None:
            chunk.skipped.append((name, f"module value is {v.type}"))
        else:
            found.append((name, factory))
    return found


# The loader's parameter by bundler: what the parameters are, which is the loader, and how it is called.
WEBPACK = (("module", "exports", "__webpack_require__"), 2)
TURBOPACK = (("__turbopack_context__", "module", "exports"), 0)


def _lazy_target(call: Node) -> str | None:
    """The module of `<loader>.e(..).then(<loader>.bind(<loader>, id))` and its other spellings."""
    if not (call.type == "CallExpression" and call.callee.type == "MemberExpression" and not call.callee.computed and call.callee.property.name == "then" and call.arguments):
        return None
    before = call.callee.object
    if not any(n.type == "MemberExpression" and not n.computed and n.property.name == "e" for n in walk(before)):
        return None
    f = call.arguments[0]
    if f.type == "CallExpression" and f.callee.type == "MemberExpression" and f.callee.property.get("name") == "bind" and len(f.arguments) > 1:
        return constant(f.arguments[1])
    if f.type == "ArrowFunctionExpression" and f.body.type == "CallExpression" and f.body.arguments:
        return constant(f.body.arguments[0])
    return None


def build(code: str, factory: Node, names: tuple[str, ...], loader: int, ids: set[str] | None = None) -> Module:
    """A factory's body as a module."""
    program = Node("Program", factory.start, factory.line, body=[Node("ExpressionStatement", factory.start, factory.line, expression=factory)])
    analysis = Analysis(program)
    scope = next(s for s in analysis.scopes if s.node is factory)
    params = [p.name if p.type == "Identifier" else None for p in factory.params]
    edits: list[tuple[int, int, str]] = []
    head: list[str] = []
    deps: dict[str, None] = {}
    exports: dict[str, str] = {}
    own = scope.bindings.get(params[loader]) if len(params) > loader and params[loader] else None
    of_exports = scope.bindings.get(params[names.index("exports")]) if len(params) > names.index("exports") and params[names.index("exports")] else None
    is_own = lambda n: own is not None and n.type == "Identifier" and analysis.binding_of.get(id(n)) is own
    is_exports = lambda n: of_exports is not None and n.type == "Identifier" and analysis.binding_of.get(id(n)) is of_exports
    turbo = names is TURBOPACK[0]
    body = factory.body.body if factory.body.type == "BlockStatement" else [Node("ExpressionStatement", factory.body.start, factory.body.line, expression=factory.body)]
    if factory.body.type != "BlockStatement":
        body[0].end = factory.body.end
    method = lambda n: n.callee.property.name if n.type == "CallExpression" and n.callee.type == "MemberExpression" and not n.callee.computed and is_own(n.callee.object) else None

    def required(n: Node) -> str | None:
        if n.type != "CallExpression":
            return None
        if turbo:
            return constant(n.arguments[0]) if method(n) in ("i", "r") and n.arguments else None
        return constant(n.arguments[0]) if is_own(n.callee) and n.arguments else None

    def defines(n: Node) -> bool:
        """Whether a call defines exports; if so, notes them."""
        name = method(n)
        if not turbo and name == "d" and len(n.arguments) == 2 and is_exports(n.arguments[0]) and n.arguments[1].type == "ObjectExpression":
            for p in n.arguments[1].properties:
                if p.type == "Property" and key_of(p.key) is not None:
                    exports[key_of(p.key)] = _returned(code, p.value)
            return True
        if turbo and name == "s" and n.arguments and n.arguments[0].type == "ArrayExpression":
            elements = n.arguments[0].elements
            for i, e in enumerate(elements):
                if e is not None and e.type == "Literal" and e.kind == "string":
                    getter = next((x for x in elements[i + 1 : i + 4] if x is not None and x.type in FUNCTIONS), None)
                    exports[e.value] = _returned(code, getter) if getter is not None else e.value
            return True
        return not turbo and name == "r" and bool(n.arguments) and is_exports(n.arguments[0])

    for s in body:
        if s.type == "ExpressionStatement" and s.get("directive") == "use strict":
            edits.append((s.start, s.end, ""))
        elif s.type == "ExpressionStatement":
            parts = s.expression.expressions if s.expression.type == "SequenceExpression" else [s.expression]
            kept = [p for p in parts if not defines(p)]
            if len(kept) < len(parts):
                if not kept:
                    edits.append((s.start, s.end, ""))
                else:
                    edits += [(p.start, p.end, "0") for p in parts if p not in kept]
        elif s.type == "VariableDeclaration":
            left = []
            for d in s.declarations:
                wanted = required(d.init) if d.init is not None and d.id.type == "Identifier" else None
                if wanted is None:
                    left.append(d)
                else:
                    head.append(f'import * as {d.id.name} from "./{wanted}.js";')
                    deps[wanted] = None
            if len(left) < len(s.declarations):
                inner = None if left else ""
                if inner is None:
                    for d in s.declarations:
                        if d not in left:
                            edits.append((d.start, d.end, f"{_unused(d.id.name)} = 0"))
                else:
                    edits.append((s.start, s.end, ""))
    for s in body:
        for n in walk(s):
            if (lazy := _lazy_target(n)) is not None and any(is_own(x) for x in walk(n.callee.object)):
                deps[lazy] = None
                edits.append((n.start, n.end, f'import("./{lazy}.js")'))
            elif (wanted := required(n)) is not None:
                deps[wanted] = None
                edits.append((n.start, n.end, f'require("./{wanted}.js")'))
    for i, name in enumerate(params[: len(names)]):
        if name and name in scope.bindings:
            taken = names[i] in analysis.free or any(names[i] in x.bindings for x in analysis.scopes)
            if not taken:
                edits += [e for e in rename_edits(scope.bindings[name], names[i]) if e[0] >= body[0].start] if body else []
    text = edited(code, edits, body[0].start, body[-1].end) if body else ""
    tail = [f"export {{ {', '.join(local if local == name else f'{local} as {name}' for name, local in exports.items())} }};"] if exports else []
    return Module("", "\n".join([*head, *([text.strip()] if text.strip() else []), *tail]) + "\n", list(deps), list(exports))


def _unused(name: str) -> str:
    return f"_{name}"


def _returned(code: str, f: Node) -> str:
    """The source of what a getter gives."""
    if f.type == "ArrowFunctionExpression" and f.body.type != "BlockStatement":
        return code[f.body.start : f.body.end]
    body = f.get("body")
    for s in body.body if isinstance(body, Node) and body.type == "BlockStatement" else ():
        if s.type == "ReturnStatement" and s.argument is not None:
            return code[s.argument.start : s.argument.end]
    return code[f.start : f.end]


def short(code: str, node: Node) -> str:
    text = re.sub(r"\s+", " ", code[node.start : node.end])
    return text if len(text) <= 80 else f"{text[:77]}..."


def webpack(code: str) -> Chunk | None:
    """A chunk that pushes factories to a webpack global; null for anything else."""
    if not re.search(r"webpack(?:Chunk|Jsonp)", code) or (tree := parse_or_none(code)) is None:
        return None
    named, chunk = declared_functions(tree), Chunk()
    for mark, call in pushes(tree, code, r"webpack(?:Chunk|Jsonp)[\w$]*"):
        chunk.containers += 1
        payload = call.arguments[0] if call.arguments else call
        parts = payload.elements if payload.type == "ArrayExpression" else []
        if len(parts) < 2 or parts[0] is None or parts[0].type != "ArrayExpression" or parts[1] is None or parts[1].type not in ("ObjectExpression", "ArrayExpression"):
            chunk.notes.append(f"unknown {mark}.push payload: {short(code, payload)}")
            continue
        entries = len(parts) > 2 and parts[2] is not None and parts[2].type == "ArrayExpression"
        chunk.shape = f"{'webpack4' if mark.startswith('webpackJsonp') else 'webpack5'}-jsonp{'+entries' if entries else ''}{'+array' if parts[1].type == 'ArrayExpression' else ''}"
        chunk.chunk_ids += [x for e in parts[0].elements if (x := constant(e)) is not None]
        for name, factory in module_map(parts[1], named, chunk):
            chunk.recognized += 1
            module = build(code, factory, *WEBPACK)
            module.id = name
            chunk.modules.append(module)
    return chunk if chunk.containers else None


def turbopack(code: str) -> Chunk | None:
    """A chunk that pushes ids and factories, a map of them, or the list of a runtime."""
    if "TURBOPACK" not in code or (tree := parse_or_none(code)) is None:
        return None
    named, chunk = declared_functions(tree), Chunk()
    for mark, call in pushes(tree, code, "TURBOPACK"):
        chunk.containers += 1
        payload = call.arguments[0] if call.arguments else call
        if payload.type != "ArrayExpression":
            chunk.notes.append(f"unknown {mark}.push payload: {short(code, payload)}")
            continue
        if payload.elements and (path := constant(payload.elements[0])) is not None:
            chunk.chunk_ids.append(path)
        pending: list[str] = []
        for e in payload.elements[1:]:
            if e is None:
                continue
            if (number := constant(e)) is not None:
                pending.append(number)
            elif (factory := factory_of(e, named)) is not None:
                chunk.shape = "turbopack-flat"
                if not pending:
                    chunk.notes.append(f"factory without module id: {short(code, e)}")
                else:
                    _add_turbo(chunk, code, pending, factory)
                pending = []
            elif e.type == "ObjectExpression":
                if any(p.type == "Property" and key_of(p.key) in ("otherChunks", "runtimeModuleIds") for p in e.properties):
                    chunk.shape, chunk.recognized = "turbopack-runtime", chunk.recognized + 1
                else:
                    chunk.shape = "turbopack-object"
                    for name, f in module_map(e, named, chunk):
                        _add_turbo(chunk, code, [name], f)
            else:
                chunk.skipped.append((",".join(pending) or "?", f"unexpected {e.type} in TURBOPACK.push"))
                pending = []
        chunk.skipped += [(x, "module id without factory") for x in pending]
    return chunk if chunk.containers else None


def _add_turbo(chunk: Chunk, code: str, ids: list[str], factory: Node) -> None:
    chunk.recognized += 1
    module = build(code, factory, *TURBOPACK)
    module.id = ids[0]
    chunk.modules.append(module)
    # further ids are other names of the module
    for other in ids[1:]:
        chunk.aliases.append((other, ids[0]))
        chunk.modules.append(Module(other, f'export * from "./{ids[0]}.js";\n', [ids[0]], [], "alias"))


def wrapped(code: str, url: str) -> Chunk | None:
    """A bundle of CommonJS wrappers: `var lib = wrap((exports, module) => {..})`, each a module of its own; what is left
    is the entry, which imports those that it calls."""
    if (tree := parse_or_none(code)) is None:
        return None
    body, name, chunk = tree.body, stem(url), Chunk(shape="commonjs-wrapped")
    found: dict[str, tuple[Node, Node]] = {}
    wrappers: dict[str, int] = {}
    for s in body:
        for d in s.declarations if s.type == "VariableDeclaration" else ():
            v = d.init
            if d.id.type == "Identifier" and v is not None and v.type == "CallExpression" and v.callee.type in ("Identifier", "MemberExpression") and len(v.arguments) == 1 and v.arguments[0].type in FUNCTIONS and 1 <= len(v.arguments[0].params) <= 2:
                if _exports_something(v.arguments[0]):
                    found[d.id.name] = (d, v.arguments[0])
                    wrappers[code[v.callee.start : v.callee.end]] = wrappers.get(code[v.callee.start : v.callee.end], 0) + 1
    if not found:
        return None
    analysis = Analysis(tree)
    for local, (_, f) in found.items():
        ids = [f.params[0].name, f.params[1].name if len(f.params) > 1 else None] if all(p.type == "Identifier" for p in f.params) else [None, None]
        scope = next(s for s in analysis.scopes if s.node is f)
        edits = [e for i, to in enumerate(("exports", "module")) if ids[i] for e in rename_edits(scope.bindings[ids[i]], to)]
        deps: dict[str, None] = {}
        inner = f.body.body if f.body.type == "BlockStatement" else [f.body]
        for x in inner:
            for n in walk(x):
                if n.type == "CallExpression" and not n.arguments and n.callee.type == "Identifier" and n.callee.name in found and analysis.binding_of.get(id(n.callee)) is analysis.root.bindings.get(n.callee.name):
                    deps[f"{name}~{n.callee.name}"] = None
                    edits.append((n.start, n.end, f'require("./{name}~{n.callee.name}.js")'))
        text = edited(code, edits, inner[0].start, inner[-1].end) if inner else ""
        chunk.modules.append(Module(f"{name}~{local}", text.strip() + "\n", list(deps), ["default"]))
    edits, head, deps = [], [], {}
    for s in body:
        if s.type == "VariableDeclaration" and (gone := [d for d in s.declarations if any(d is x for x, _ in found.values())]):
            left = [d for d in s.declarations if d not in gone]
            edits.append((s.start, s.end, f"{s.kind} {', '.join(code[d.start : d.end] for d in left)};" if left else ""))
    called: dict[str, None] = {}
    for s in body:
        for n in walk(s):
            if n.type == "CallExpression" and not n.arguments and n.callee.type == "Identifier" and n.callee.name in found and not any(f.start <= n.start < f.end for _, f in found.values()):
                called[n.callee.name] = None
                edits.append((n.start, n.end, f"{n.callee.name}Module"))
    for local in called:
        head.append(f'import * as {local}Module from "./{name}~{local}.js";')
        deps[f"{name}~{local}"] = None
    for d in esm_dependencies(tree):
        deps[d] = None
    chunk.modules.append(Module(name, "\n".join([*head, edited(code, edits).strip()]) + "\n", list(deps), [], "bundle"))
    chunk.containers = chunk.recognized = len(found)
    return chunk


def _exports_something(f: Node) -> bool:
    """Whether a function writes to what its parameters hold."""
    names = {p.name for p in f.params if p.type == "Identifier"}
    for n in walk(f):
        if n.type == "AssignmentExpression" and n.left.type == "MemberExpression":
            at = n.left
            while at.type == "MemberExpression":
                at = at.object
            if at.type == "Identifier" and at.name in names:
                return True
    return False


def esm_dependencies(tree: Node) -> list[str]:
    """Stems of the relative modules that a module imports or re-exports, statically or by import()."""
    found: dict[str, None] = {}
    for n in walk(tree):
        source = None
        if n.type in ("ImportDeclaration", "ExportAllDeclaration", "ExportNamedDeclaration"):
            source = n.source
        elif n.type == "CallExpression" and n.callee.type == "Import" and n.arguments:
            source = constant(n.arguments[0])
        if source and re.match(r"(\.{1,2}/|/|https?://)", source):
            found[stem(source)] = None
    return list(found)


def exports_of(tree: Node) -> list[str]:
    """Names that a module exports."""
    from bundlelens.js.scopes import names_of

    found: dict[str, None] = {}
    for s in tree.body:
        if s.type == "ExportDefaultDeclaration":
            found["default"] = None
        elif s.type == "ExportAllDeclaration" and s.exported:
            found[s.exported] = None
        elif s.type == "ExportNamedDeclaration":
            found |= {x.exported: None for x in s.specifiers}
            d = s.declaration
            if d is not None:
                found |= {d.id: None} if d.type != "VariableDeclaration" else {x.name: None for v in d.declarations for x in names_of(v.id)}
    return list(found)


def esm(code: str, url: str) -> Chunk | None:
    """An ES module chunk: one module, which depends on those it imports."""
    if (tree := parse_or_none(code)) is None:
        return None
    if not any(s.type.startswith(("Import", "Export")) for s in tree.body):
        return None
    name = stem(url)
    return Chunk("esm", [name], 1, 1, [Module(name, code, esm_dependencies(tree), exports_of(tree), "bundle")])


#: What is tried for chunks of each bundler, in order.
STRATEGIES = {
    "next": (webpack, turbopack), "webpack": (webpack, wrapped), "rspack": (webpack, wrapped), "vite": (wrapped, esm), "esbuild": (wrapped, esm),
    "astro": (esm,), "sveltekit": (esm,), "react-router": (esm,), "nuxt": (esm,), "angular": (esm,), "generic": (webpack, turbopack, esm),
}


def unpack(body: str | None, url: str | None, adapter: str | None) -> Chunk | None:
    """The first strategy of the bundler that recognises the chunk; null if none does or it can't be parsed."""
    for f in STRATEGIES.get(adapter or "generic", STRATEGIES["generic"]):
        try:
            found = f(body or "") if f in (webpack, turbopack) else f(body or "", url or "")
        except RecursionError:
            return None
        if found is not None:
            return found
    return None


# Chunk URLs


def templates(code: str | None) -> dict[str, Node]:
    """kind (script or style) -> the function from a chunk's id to its path, as the runtime assigns it."""
    if not re.search(r"\.(u|miniCssF)\s*=|\.p\s*\+|jsonpScriptSrc", code or "") or (tree := parse_or_none(code)) is None:
        return {}
    found: dict[str, Node] = {}
    legacy = None
    for n in walk(tree):
        if n.type == "AssignmentExpression" and n.left.type == "MemberExpression" and not n.left.computed and n.right.type in FUNCTIONS:
            if kind := {"u": "script", "miniCssF": "style"}.get(n.left.property.name):
                found[kind] = n.right
        elif n.type in ("FunctionDeclaration", "FunctionExpression") and len(n.params) == 1 and legacy is None:
            result = result_of(n)
            if result is not None and result.type == "BinaryExpression" and any(x.type == "Literal" and x.kind == "string" and re.search(r"\.m?js$", x.value) for x in walk(result)):
                legacy = n
    if "script" not in found and legacy is not None:
        found["script"] = legacy
    return found


def result_of(f: Node) -> Node | None:
    if f.body.type != "BlockStatement":
        return f.body
    return next((s.argument for s in f.body.body if s.type == "ReturnStatement"), None)


class Impure(ValueError):
    """The expression does more than to combine constants and the id."""


def evaluate(node: Node, env: dict[str, object], depth: int = 64) -> object:
    """A value of constants, the given names, concatenation, comparison, choice and lookup in literals. Calls,
    assignments and everything else are refused; unknown names and properties are the empty string when added."""
    if depth == 0:
        raise Impure("nested too deeply")
    go = lambda n: evaluate(n, env, depth - 1)
    if node.type == "Literal" and node.kind in ("string", "number", "true", "false", "null"):
        return {"true": True, "false": False, "null": None}.get(node.kind, node.value) if node.kind != "number" else number(node.value)
    if node.type == "Identifier":
        return env.get(node.name)
    if node.type == "TemplateLiteral":
        return node.quasis[0] + "".join(text(go(e)) + q for e, q in zip(node.expressions, node.quasis[1:], strict=True))
    if node.type == "BinaryExpression" and node.operator in ("+", "==", "===", "!=", "!=="):
        a, b = go(node.left), go(node.right)
        if node.operator == "+":
            return a + b if isinstance(a, (int, float)) and isinstance(b, (int, float)) else text(a) + text(b)
        return (text(a) == text(b)) == (node.operator[0] == "=")
    if node.type == "LogicalExpression":
        a = go(node.left)
        return (a or go(node.right)) if node.operator == "||" else (a and go(node.right)) if node.operator == "&&" else go(node.right) if a is None else a
    if node.type == "ConditionalExpression":
        return go(node.consequent if go(node.test) else node.alternate)
    if node.type == "UnaryExpression" and node.operator == "!":
        return not go(node.argument)
    if node.type == "MemberExpression":
        if node.object.type != "ObjectExpression":
            return None  # such as the public path, which the caller knows
        wanted = text(go(node.property)) if node.computed else node.property.name
        for p in node.object.properties:
            if p.type == "Property" and key_of(p.key) == wanted:
                return go(p.value)
        return None
    raise Impure(node.type)


def number(raw: str) -> int | float:
    value = float(int(raw, 0)) if re.match(r"0[xXbBoO]", raw) else float(raw.replace("_", "").rstrip("n"))
    return int(value) if value == int(value) else value


def text(value: object) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


def chunk_url(template: Node, chunk_id: str) -> str | None:
    """A chunk's path by a runtime's template; null for what isn't pure."""
    result = result_of(template)
    if result is None or len(template.params) != 1 or template.params[0].type != "Identifier":
        return None
    try:
        found = evaluate(result, {template.params[0].name: chunk_id})
    except (Impure, ValueError, RecursionError):
        return None
    return found if isinstance(found, str) and found else None


def known_ids(template: Node) -> list[str]:
    """Ids that a template's lookups mention."""
    return list(dict.fromkeys(k for n in walk(template) if n.type == "ObjectExpression" for p in n.properties if p.type == "Property" and (k := constant(p.key)) is not None))


def chunk_urls(code: str | None) -> list[tuple[str, str, str]]:
    """(chunk id, script or style, path) of all ids that a runtime knows or asks for."""
    found = templates(code)
    ids = dict.fromkeys([*(x for t in found.values() for x in known_ids(t)), *ensured(code)])
    return [(i, kind, path) for i in ids for kind, t in found.items() if (path := chunk_url(t, i)) and (kind == "script" or i in known_ids(t))]


def ensured(code: str | None) -> list[str]:
    """Ids of the chunks that a script asks the loader for."""
    return list(dict.fromkeys(m.strip('"') for m in re.findall(r'\.e\(\s*(\d+|"[^"\\]+")\s*\)', code or "")))
