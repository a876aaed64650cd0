"""Scopes and bindings of a tree: who declares a name, and who uses which declaration."""

from __future__ import annotations

from collections.abc import Iterator

from bundlelens.js.parser import Node

FUNCTIONS = ("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression")


class Binding:
    """A declared name: its kind, the node that declares it, and the identifiers that are it."""

    def __init__(self, name: str, kind: str, node: Node):
        self.name, self.kind, self.node = name, kind, node
        self.uses: list[Node] = []


class Scope:
    def __init__(self, node: Node, parent: Scope | None, function: bool):
        self.node, self.parent, self.function = node, parent, function
        self.bindings: dict[str, Binding] = {}

    def declare(self, name: str, kind: str, node: Node) -> None:
        self.bindings.setdefault(name, Binding(name, kind, node))

    def find(self, name: str) -> Binding | None:
        scope: Scope | None = self
        while scope is not None:
            if name in scope.bindings:
                return scope.bindings[name]
            scope = scope.parent
        return None


def names_of(pattern: Node | None) -> Iterator[Node]:
    """Identifiers that a pattern declares."""
    if pattern is None:
        return
    if pattern.type == "Identifier":
        yield pattern
    elif pattern.type == "ArrayExpression":
        for x in pattern.elements:
            yield from names_of(x)
    elif pattern.type == "ObjectExpression":
        for x in pattern.properties:
            yield from names_of(x.argument if x.type == "SpreadElement" else x.value)
    elif pattern.type == "AssignmentExpression":
        yield from names_of(pattern.left)
    elif pattern.type == "SpreadElement":
        yield from names_of(pattern.argument)


class Analysis:
    """Scopes of a program, and names that it uses without declaring them."""

    def __init__(self, program: Node):
        self.scopes: list[Scope] = []
        self.free: dict[str, list[Node]] = {}
        self.pending: list[tuple[Scope, Node]] = []
        self.binding_of: dict[int, Binding] = {}
        self.root = self.open(program, None, True)
        self.hoist(program.body, self.root)
        for s in program.body:
            self.visit(s, self.root)
        for scope, node in self.pending:
            found = scope.find(node.name)
            if found is None:
                self.free.setdefault(node.name, []).append(node)
            else:
                found.uses.append(node)
                self.binding_of[id(node)] = found

    def bindings(self) -> Iterator[Binding]:
        for scope in self.scopes:
            yield from scope.bindings.values()

    def open(self, node: Node, parent: Scope | None, function: bool) -> Scope:
        self.scopes.append(Scope(node, parent, function))
        return self.scopes[-1]

    def hoist(self, body: list[Node], scope: Scope) -> None:
        """Declarations of a block: its own, and `var`s below that belong to its function."""
        for s in body:
            s = s.declaration if s.type in ("ExportNamedDeclaration", "ExportDefaultDeclaration") and s.declaration is not None else s
            if s.type in ("FunctionDeclaration", "ClassDeclaration"):
                if s.id:
                    scope.declare(s.id, "function" if s.type == "FunctionDeclaration" else "class", s)
            elif s.type == "VariableDeclaration" and s.kind != "var":
                self.declare_all(s, scope)
            elif s.type == "ImportDeclaration":
                for x in s.specifiers:
                    scope.declare(x.local, "import", x)
        if scope.function:
            for s in body:
                self.hoist_vars(s, scope)

    def declare_all(self, variables: Node, scope: Scope) -> None:
        for d in variables.declarations:
            for x in names_of(d.id):
                scope.declare(x.name, variables.kind, d)

    def hoist_vars(self, node: Node, scope: Scope) -> None:
        stack = [node]
        while stack:
            x = stack.pop()
            if x.type in FUNCTIONS or x.type in ("ClassDeclaration", "ClassExpression"):
                continue
            if x.type == "VariableDeclaration" and x.kind == "var":
                self.declare_all(x, scope)
            stack.extend(x.children())

    def visit(self, node: Node, scope: Scope) -> None:
        kind = node.type
        if kind == "Identifier":
            self.pending.append((scope, node))
        elif kind in FUNCTIONS:
            inner = self.open(node, scope, True)
            if kind == "FunctionExpression" and node.id:
                inner.declare(node.id, "function", node)
            for p in node.params:
                for x in names_of(p):
                    inner.declare(x.name, "param", p)
                self.visit(p, inner)
            if node.body.type == "BlockStatement":
                self.hoist(node.body.body, inner)
                for s in node.body.body:
                    self.visit(s, inner)
            else:
                self.visit(node.body, inner)
        elif kind in ("ClassDeclaration", "ClassExpression"):
            inner = scope
            if kind == "ClassExpression" and node.id:
                inner = self.open(node, scope, False)
                inner.declare(node.id, "class", node)
            for x in node.children():
                self.visit(x, inner)
        elif kind in ("ClassMember", "Property"):
            if node.computed:
                self.visit(node.key, scope)
            if node.value is not None:
                self.visit(node.value, scope)
        elif kind == "MemberExpression":
            self.visit(node.object, scope)
            if node.computed:
                self.visit(node.property, scope)
        elif kind in ("BlockStatement", "SwitchStatement", "ForStatement", "ForInStatement", "ForOfStatement", "TryStatement"):
            inner = self.open(node, scope, False)
            if kind == "BlockStatement":
                self.hoist(node.body, inner)
            elif kind == "SwitchStatement":
                self.hoist([s for c in node.cases for s in c.body], inner)
            elif kind != "TryStatement":
                head = node.get("init") or node.get("left")
                if isinstance(head, Node) and head.type == "VariableDeclaration" and head.kind != "var":
                    self.declare_all(head, inner)
            if kind == "TryStatement" and node.handler is not None:
                caught = self.open(node.handler, inner, False)
                for x in names_of(node.param):
                    caught.declare(x.name, "param", x)
                self.visit(node.block, inner)
                if node.param is not None:
                    self.visit(node.param, caught)
                self.visit(node.handler, caught)
                if node.finalizer is not None:
                    self.visit(node.finalizer, inner)
                return
            for x in node.children():
                self.visit(x, inner)
        elif kind == "ExportNamedDeclaration" and node.source is None:
            for x in node.specifiers:
                name = Node("Identifier", x.start, x.line, name=x.local)
                name.end = x.start + len(x.local)
                self.pending.append((scope, name))
            if node.declaration is not None:
                self.visit(node.declaration, scope)
        elif kind in ("ImportDeclaration", "ExportNamedDeclaration", "ExportAllDeclaration"):
            return
        else:
            for x in node.children():
                self.visit(x, scope)


def edited(code: str, edits: list[tuple[int, int, str]], begin: int = 0, end: int | None = None) -> str:
    """A stretch of source with (begin, end, text) replacements; of overlapping ones the outermost counts."""
    out, at, end = [], begin, len(code) if end is None else end
    for a, b, text in sorted(edits, key=lambda e: (e[0], -e[1])):
        if a < at or b > end:
            continue
        out += [code[at:a], text]
        at = b
    return "".join(out) + code[at:end]


def rename_edits(binding: Binding, to: str) -> list[tuple[int, int, str]]:
    """Replacements that give a binding's uses another name; shorthand properties keep their key."""
    return [(n.start, n.start + len(n.name), f"{n.name}: {to}" if n.get("shorthand_of") else to) for n in binding.uses]
