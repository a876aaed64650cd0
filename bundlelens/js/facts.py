"""What is read off a script's tree: imports and exports, bindings, data-only scripts, routes, preloads, constants."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from bundlelens import rules
from bundlelens.js.parser import Node, parse_or_none, walk
from bundlelens.js.scopes import FUNCTIONS, Analysis, names_of
from bundlelens.js.unpack import constant, key_of


def outline(code: str | None) -> list[tuple[str, str, str | None, str | None]]:
    """(kind, name, other name, source): import, export, reexport, export-all and dynamic entries of a module."""
    if (tree := parse_or_none(code)) is None:
        return []
    found: list[tuple[str, str, str | None, str | None]] = []
    for s in tree.body:
        if s.type == "ImportDeclaration":
            found += [("import", x.local, x.imported, s.source) for x in s.specifiers] or [("import", "", None, s.source)]
        elif s.type == "ExportAllDeclaration":
            found.append(("export-all", s.exported or "*", None, s.source))
        elif s.type == "ExportDefaultDeclaration":
            found.append(("export", "default", s.declaration.get("id") if isinstance(s.declaration.get("id"), str) else None, None))
        elif s.type == "ExportNamedDeclaration":
            found += [("reexport" if s.source is not None else "export", x.exported, x.local, s.source) for x in s.specifiers]
            d = s.declaration
            if d is not None:
                found += [("export", n, n, None) for n in ([d.id] if d.type != "VariableDeclaration" else [x.name for v in d.declarations for x in names_of(v.id)])]
    found += [("dynamic", "", None, source) for n in walk(tree) if n.type == "CallExpression" and n.callee.type == "Import" and n.arguments and (source := constant(n.arguments[0])) is not None]
    return found


def bindings(code: str | None) -> list[tuple[str, str, int]]:
    """(name, kind, uses) of everything a script declares."""
    if (tree := parse_or_none(code)) is None:
        return []
    return [(b.name, b.kind, len(b.uses)) for b in Analysis(tree).bindings()]


def free_names(code: str | None) -> list[tuple[str, int]]:
    """(name, uses) of what a script uses without declaring it."""
    if (tree := parse_or_none(code)) is None:
        return []
    return [(name, len(uses)) for name, uses in sorted(Analysis(tree).free.items())]


def mangled(code: str | None) -> tuple[int, int]:
    """(bindings, those with names only a minifier gives)."""
    own = [name for name, _, _ in bindings(code)]
    return len(own), sum(len(n) <= 2 and n not in rules.SHORT_NAMES for n in own)


def is_data(node: Node | None) -> bool:
    """Whether a value is written without computing anything."""
    if node is None or node.type == "Literal":
        return node is None or node.kind != "regex"
    if node.type == "TemplateLiteral":
        return not node.expressions
    if node.type == "UnaryExpression":
        return node.operator == "-" and node.argument.type == "Literal" and node.argument.kind == "number"
    if node.type == "ArrayExpression":
        return all(is_data(e) for e in node.elements)
    if node.type == "ObjectExpression":
        return all(p.type == "Property" and not p.computed and p.kind == "init" and not p.shorthand and is_data(p.value) for p in node.properties)
    return False


def data_only(code: str | None) -> bool:
    """Whether a script does nothing but assign data or pass it to calls."""
    tree = parse_or_none(code)
    if tree is None or not tree.body:
        return False
    for s in tree.body:
        e = s.expression if s.type == "ExpressionStatement" else None
        if e is None or not (
            e.type == "AssignmentExpression" and e.right.type in ("ObjectExpression", "ArrayExpression") and is_data(e.right)
            or e.type == "CallExpression" and e.arguments and all(is_data(a) for a in e.arguments)
        ):
            return False
    return True


def value_of(node: Node | None):
    """A data node as Python value; ValueError for anything that would have to be computed."""
    if node is None:
        return None
    if node.type == "Literal" and node.kind != "regex":
        from bundlelens.js.unpack import number

        return {"true": True, "false": False, "null": None}[node.kind] if node.kind in ("true", "false", "null") else number(node.value) if node.kind == "number" else node.value
    if node.type == "TemplateLiteral" and not node.expressions:
        return node.quasis[0]
    if node.type == "UnaryExpression" and node.operator in ("-", "!", "void") and node.argument.type == "Literal":
        inner = value_of(node.argument)
        return -inner if node.operator == "-" else not inner if node.operator == "!" else None
    if node.type == "ArrayExpression":
        return [value_of(e) for e in node.elements]
    if node.type == "ObjectExpression" and all(p.type == "Property" and not p.computed and p.kind == "init" for p in node.properties):
        return {key_of(p.key): value_of(p.value) for p in node.properties}
    raise ValueError(node.type)


def default_export_json(code: str | None) -> str | None:
    """The data that a module exports by default, as JSON."""
    tree = parse_or_none(code)
    for s in tree.body if tree is not None else ():
        if s.type == "ExportDefaultDeclaration":
            try:
                return json.dumps(value_of(s.declaration), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None
    return None


def routes(code: str | None) -> list[tuple[str, str, str | None]]:
    """(path, name, component file) of route tables: objects with a path and a component or children, nested paths
    joined."""
    tree = parse_or_none(code)
    if tree is None:
        return []
    found: list[tuple[str, str, str | None]] = []

    def text(p: Node | None) -> str | None:
        return constant(p)

    def of(table: Node, base: str) -> bool:
        own = {key_of(p.key): p.value for p in table.properties if p.type == "Property"}
        if "path" not in own or not ({"component", "children", "element", "lazy", "redirect"} & own.keys()) or text(own["path"]) is None:
            return False
        path = text(own["path"])
        full = path if path.startswith("/") else f"{base.rstrip('/')}/{path}"
        file = next((constant(n.arguments[0]) for k in ("component", "lazy", "element") if k in own for n in walk(own[k]) if n.type == "CallExpression" and n.callee.type == "Import" and n.arguments), None)
        found.append((full, text(own.get("name")) or "", file))
        children = own.get("children")
        for c in children.elements if children is not None and children.type == "ArrayExpression" else ():
            if c is not None and c.type == "ObjectExpression":
                of(c, full)
        return True

    seen: set[int] = set()
    for n in walk(tree):
        if n.type == "ObjectExpression" and id(n) not in seen and of(n, ""):
            seen |= {id(x) for x in walk(n)}
    return found


def preloads(code: str | None) -> list[tuple[str]]:
    """Files that a bundle's preload helper lists."""
    m = re.search(r"__vite__mapDeps\s*=\s*\([^)]*\)\s*=>[^\[]*?\.f\s*=\s*(\[[^\]]*\])", code or "") or re.search(r"\bm\.f\s*\|\|\s*\(\s*m\.f\s*=\s*(\[[^\]]*\])", code or "")
    try:
        files = json.loads(m[1]) if m else []
    except ValueError:
        return []
    return [(f,) for f in files if isinstance(f, str)]


def top_level(code: str | None) -> list[tuple[str, str, int, int]]:
    """(name, kind, line, length) of a module's own declarations."""
    tree = parse_or_none(code)
    if tree is None:
        return []
    return [(b.name, b.kind, b.node.line, max(0, b.node.end - b.node.start)) for b in Analysis(tree).root.bindings.values()]


def function_facts(code: str | None) -> list[tuple[str, int, list[str], list[str], list[str], list[str]]]:
    """(function, parameters, calls, reads, writes, strings) of a module's named functions."""
    tree = parse_or_none(code)
    found = []
    for name, f in _functions(tree) if tree is not None else ():
        calls, reads, writes, strings = {}, {}, {}, {}
        for n in walk(f.body):
            if n.type == "CallExpression" and (callee := dotted(n.callee)):
                calls[callee] = None
            elif n.type == "AssignmentExpression" and (target := dotted(n.left)):
                writes[target] = None
            elif n.type == "MemberExpression" and (path := dotted(n)):
                reads[path] = None
            elif n.type == "Literal" and n.kind == "string":
                strings[n.value] = None
        found.append((name, len(f.params), list(calls), [r for r in reads if r not in calls and r not in writes], list(writes), list(strings)))
    return found


def _functions(tree: Node) -> Iterator[tuple[str, Node]]:
    for s in tree.body:
        s = s.declaration if s.type in ("ExportNamedDeclaration", "ExportDefaultDeclaration") and s.declaration is not None else s
        if s.type == "FunctionDeclaration" and s.id:
            yield s.id, s
        elif s.type == "VariableDeclaration":
            for d in s.declarations:
                if d.id.type == "Identifier" and d.init is not None and d.init.type in FUNCTIONS:
                    yield d.id.name, d.init


def dotted(node: Node) -> str | None:
    """`a.b.c` of plain member accesses."""
    parts = []
    while node.type == "MemberExpression" and not node.computed:
        parts.append(node.property.name)
        node = node.object
    if node.type == "Identifier":
        parts.append(node.name)
    elif node.type == "ThisExpression":
        parts.append("this")
    else:
        return None
    return ".".join(reversed(parts))


def trivial(code: str | None) -> tuple[str, list[str]] | None:
    """(alias, [source]), (stub, sources) or (empty, []) of modules that only pass others on; null for real ones."""
    tree = parse_or_none(code)
    if tree is None:
        return None
    if not tree.body:
        return "empty", []
    sources = []
    for s in tree.body:
        if s.type in ("ExportAllDeclaration", "ImportDeclaration") or s.type == "ExportNamedDeclaration" and s.source is not None:
            sources.append(s.source)
        elif not (s.type == "ExportNamedDeclaration" and s.declaration is None):
            return None
    if len(sources) == 1 and any(s.type == "ExportAllDeclaration" for s in tree.body):
        return "alias", sources
    return "stub", list(dict.fromkeys(sources))
