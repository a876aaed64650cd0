"""Readable code from minified code: structural rules on trees, and names by votes.

Each rule undoes one thing that minifiers do and keeps what the code does. Printing is by `printer`.
"""

from __future__ import annotations

from collections.abc import Callable

from bundlelens import rules
from bundlelens.js.parser import Node, parse_or_none, walk
from bundlelens.js.printer import show
from bundlelens.js.scopes import FUNCTIONS, Analysis, Binding, edited, rename_edits
from bundlelens.js.unpack import constant, key_of


def literal(kind: str) -> Node:
    return Node("Literal", 0, 0, kind=kind, value=kind, raw=kind)


def _is_number(n: Node, *values: str) -> bool:
    return n.type == "Literal" and n.kind == "number" and n.raw in values


def _expression(n: Node) -> Node:
    """Rules on single expressions."""
    if n.type == "UnaryExpression":
        if n.operator == "!" and _is_number(n.argument, "0", "1"):
            return literal("true" if n.argument.raw == "0" else "false")
        if n.operator == "void" and _is_number(n.argument, "0"):
            return Node("Identifier", n.start, n.line, name="undefined")
    if n.type == "BinaryExpression" and n.operator in ("==", "===", "!=", "!==", "<", ">", "<=", ">="):
        fixed = lambda x: x.type == "Literal" and x.kind != "regex" or x.type == "Identifier" and x.name == "undefined"
        if fixed(n.left) and not fixed(n.right):
            n.left, n.right = n.right, n.left
            n.operator = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(n.operator, n.operator)
    if n.type == "BinaryExpression" and n.operator in ("<", ">") and n.left.type == "UnaryExpression" and n.left.operator == "typeof" and n.right.type == "Literal" and n.right.kind == "string" and n.right.value == "u":
        n.operator, n.right = "===" if n.operator == ">" else "!==", Node("Literal", 0, 0, kind="string", value="undefined", raw='"undefined"')
    if n.type == "CallExpression" and n.callee.type == "SequenceExpression" and len(n.callee.expressions) == 2 and _is_number(n.callee.expressions[0], "0") and n.callee.expressions[1].type == "Identifier":
        n.callee = n.callee.expressions[1]
    if n.type == "MemberExpression" and n.computed and n.property.type == "Literal" and n.property.kind == "string" and n.property.value.isidentifier():
        n.computed, n.property = False, Node("Identifier", n.property.start, n.property.line, name=n.property.value)
    return n


def _negated(n: Node) -> Node:
    if n.type == "UnaryExpression" and n.operator == "!":
        return n.argument
    if n.type == "BinaryExpression" and n.operator in ("==", "!=", "===", "!=="):
        n.operator = {"==": "!=", "!=": "==", "===": "!==", "!==": "==="}[n.operator]
        return n
    return Node("UnaryExpression", n.start, n.line, operator="!", prefix=True, argument=n)


def _block(n: Node) -> Node:
    return n if n.type == "BlockStatement" else Node("BlockStatement", n.start, n.line, body=[n])


def _statement_of(e: Node) -> Node:
    return Node("ExpressionStatement", e.start, e.line, expression=e)


def _split(s: Node) -> list[Node]:
    """Statements that one statement stands for."""
    if s.type == "ExpressionStatement":
        e = s.expression
        if e.type == "SequenceExpression":
            return [x for part in e.expressions for x in _split(_statement_of(part))]
        if e.type == "LogicalExpression" and e.operator in ("&&", "||"):
            test = e.left if e.operator == "&&" else _negated(e.left)
            return [Node("IfStatement", s.start, s.line, test=test, consequent=Node("BlockStatement", 0, s.line, body=_split(_statement_of(e.right))), alternate=None)]
        if e.type == "ConditionalExpression":
            return [Node("IfStatement", s.start, s.line, test=e.test, consequent=Node("BlockStatement", 0, s.line, body=_split(_statement_of(e.consequent))), alternate=Node("BlockStatement", 0, s.line, body=_split(_statement_of(e.alternate))))]
    elif s.type in ("ReturnStatement", "ThrowStatement") and s.argument is not None:
        e = s.argument
        if e.type == "SequenceExpression":
            return [x for part in e.expressions[:-1] for x in _split(_statement_of(part))] + _split(Node(s.type, s.start, s.line, argument=e.expressions[-1]))
        if s.type == "ReturnStatement" and e.type == "UnaryExpression" and e.operator == "void":
            return _split(_statement_of(e.argument)) + [Node("ReturnStatement", s.start, s.line, argument=None)] if e.argument.type != "Literal" else [Node("ReturnStatement", s.start, s.line, argument=None)]
    elif s.type == "IfStatement" and s.test.type == "SequenceExpression":
        first, s.test = s.test.expressions[:-1], s.test.expressions[-1]
        return [x for part in first for x in _split(_statement_of(part))] + [s]
    elif s.type == "VariableDeclaration" and len(s.declarations) > 1:
        return [Node("VariableDeclaration", d.start, d.line, kind=s.kind, declarations=[d]) for d in s.declarations]
    return [s]


def transform(node: Node, f: Callable[[Node], Node]) -> Node:
    """f over all nodes, innermost first."""
    for name, value in list(node.parts()):
        if isinstance(value, Node):
            setattr(node, name, transform(value, f))
        else:
            setattr(node, name, [transform(x, f) if isinstance(x, Node) else x for x in value])
    return f(node)


def _structure(n: Node) -> Node:
    if n.type in ("Program", "BlockStatement"):
        n.body = [x for s in n.body for x in _split(s)]
    elif n.type == "SwitchCase":
        n.body = [x for s in n.body for x in _split(s)]
    if n.type == "IfStatement":
        n.consequent = _block(n.consequent)
        if n.alternate is not None and n.alternate.type != "IfStatement":
            inner = n.alternate.body if n.alternate.type == "BlockStatement" else []
            n.alternate = inner[0] if len(inner) == 1 and inner[0].type == "IfStatement" else _block(n.alternate)
    elif n.type in ("ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoWhileStatement"):
        n.body = _block(n.body)
    return n


def _rules(n: Node) -> Node:
    return _structure(_expression(n))


def deminify(code: str | None) -> str | None:
    """The code laid out and with minifiers' shorthands undone; null if it can't be parsed."""
    if (tree := parse_or_none(code)) is None:
        return None
    try:
        # blocks that rules make hold statements that rules split again
        text = show(transform(tree, _rules))
        again = parse_or_none(text)
        return text if again is None else show(transform(again, _rules))
    except RecursionError:
        return None


# Names by votes. What results of calls are called, and methods that tell what their owner is.
RESULT_NAMES = {
    "useRef": "ref", "useMemo": "memoized", "useCallback": "callback", "useContext": "context", "useId": "id", "useRouter": "router", "usePathname": "pathname", "useSearchParams": "searchParams",
    "useParams": "params", "createContext": "Context", "forwardRef": "Component", "memo": "Component", "lazy": "LazyComponent", "encodeURIComponent": "encoded", "decodeURIComponent": "decoded", "match": "match", "exec": "match", "test": "matches",
}
OWNER_METHODS = [({"push", "forEach", "filter", "reduce", "reduceRight", "flatMap", "splice", "findIndex", "every", "some", "map"}, "items", 2), ({"then"}, "promise", 1), ({"setAttribute", "getAttribute", "appendChild", "classList", "addEventListener", "removeEventListener", "querySelector", "innerHTML", "textContent"}, "element", 2)]
#: Names of at least this weight are given.
LEAST_WEIGHT = 2


def votes(analysis: Analysis) -> dict[Binding, dict[str, int]]:
    """binding -> name -> weight: evidence of how minified bindings would be called."""
    found: dict[Binding, dict[str, int]] = {}
    of = lambda n: analysis.binding_of.get(id(n)) if n is not None and n.type == "Identifier" else None

    def vote(b: Binding | None, name: str | None, weight: int) -> None:
        if b is not None and name and name.isidentifier() and len(name) > 2 and minified(b.name):
            own = found.setdefault(b, {})
            own[name] = own.get(name, 0) + weight

    for n in walk(analysis.root.node):
        if n.type == "VariableDeclarator" and n.init is not None:
            if n.id.type == "Identifier":
                vote(of(n.id), name_from(n.init), 3)
            elif n.id.type == "ArrayExpression" and n.init.type == "CallExpression" and called(n.init) == "useState":
                state, setter = [*n.id.elements, None, None][:2]
                subject = next((b.name for b in (of(state),) if b and not minified(b.name)), None)
                vote(of(state), "state", 2)
                vote(of(setter), f"set{(subject or 'state')[0].upper()}{(subject or 'state')[1:]}", 3)
        elif n.type == "Property" and not n.computed and n.key.type == "Identifier" and not n.shorthand and n.value.type == "Identifier":
            vote(of(n.value), n.key.name, 4)
        elif n.type == "AssignmentExpression" and n.left.type == "MemberExpression" and not n.left.computed and n.right.type == "Identifier":
            vote(of(n.right), n.left.property.name, 3)
        elif n.type == "MemberExpression" and not n.computed:
            for methods, name, weight in OWNER_METHODS:
                if n.property.name in methods:
                    vote(of(n.object), name, weight)
        elif n.type == "TryStatement" and n.param is not None:
            vote(of(n.param), "error", 5)
        elif n.type == "CallExpression" and called(n) == "addEventListener" and len(n.arguments) > 1 and n.arguments[1].type in FUNCTIONS and n.arguments[1].params:
            vote(of(n.arguments[1].params[0]), "event", 4)
        elif n.type == "CallExpression" and called(n) in ("map", "forEach", "filter", "find", "some", "every", "flatMap", "findIndex") and n.arguments and n.arguments[0].type in FUNCTIONS:
            params = n.arguments[0].params
            vote(of(params[0]) if params else None, "item", 2)
            vote(of(params[1]) if len(params) > 1 else None, "index", 3)
    return found


def minified(name: str) -> bool:
    return len(name) <= 2 and name not in rules.SHORT_NAMES


def called(call: Node) -> str | None:
    callee = call.callee
    if callee.type == "SequenceExpression":
        callee = callee.expressions[-1]
    return callee.name if callee.type == "Identifier" else callee.property.name if callee.type == "MemberExpression" and not callee.computed else None


def name_from(e: Node) -> str | None:
    """What a value's expression says of its name."""
    if e.type == "AwaitExpression":
        return name_from(e.argument)
    if e.type == "MemberExpression" and not e.computed:
        return e.property.name
    if e.type == "CallExpression" and (name := called(e)):
        if name in RESULT_NAMES:
            return RESULT_NAMES[name]
        if name in ("getElementById", "querySelector"):
            return "element"
        for verb in rules.VERBS:
            if name.startswith(verb) and name[len(verb) : len(verb) + 1].isupper():
                return name[len(verb)].lower() + name[len(verb) + 1 :]
    if e.type == "NewExpression" and e.callee.type == "Identifier" and len(e.callee.name) > 2:
        return e.callee.name[0].lower() + e.callee.name[1:]
    return None


def vote_rows(code: str | None) -> list[tuple[str, int, str, int]]:
    """(binding, position, name, weight) of every vote, for sums in tables."""
    if (tree := parse_or_none(code)) is None:
        return []
    return [(b.name, b.node.start, name, weight) for b, own in votes(Analysis(tree)).items() for name, weight in own.items()]


def rename(code: str | None) -> str | None:
    """The code with the best voted names, each unique where it is used; null if it can't be parsed. Globals keep
    theirs, and a program's own top-level names too if it exports or shares them."""
    if (tree := parse_or_none(code)) is None:
        return None
    analysis = Analysis(tree)
    edits: list[tuple[int, int, str]] = []
    everywhere = set(analysis.free) | {b.name for b in analysis.bindings()} | RESERVED_NAMES
    for b, own in sorted(votes(analysis).items(), key=lambda x: x[0].node.start):
        name, weight = max(own.items(), key=lambda x: (x[1], -list(own).index(x[0])))
        if weight < LEAST_WEIGHT or b.kind == "import":
            continue
        # names already in use anywhere get a number, so no binding is captured
        free, n = name, 2
        while free in everywhere:
            free, n = f"{name}{n}", n + 1
        everywhere.add(free)
        edits += rename_edits(b, free)
        if b.kind in ("function", "class"):
            at = code.find(b.name, b.node.start)
            edits.append((at, at + len(b.name), free))
    return edited(code or "", edits)


# Names that a module can't give to its own bindings.
RESERVED_NAMES = set(
    "arguments await break case catch class const continue debugger default delete do else enum eval export extends false finally for function if implements import in instanceof interface let new null package private protected public return static super switch this throw true try typeof var void while with yield undefined NaN Infinity module exports require window document self globalThis".split()
)


def default_name(selector: str) -> str:
    return "".join(part[:1].upper() + part[1:] for part in selector.split("-") if part)


def react_roles(code: str | None) -> list[tuple[str, str]]:
    """(function, role): component if it returns elements, hook by its name, else function."""
    tree = parse_or_none(code)
    found = []
    for n in walk(tree) if tree is not None else ():
        if n.type == "FunctionDeclaration" and n.id:
            makes = any(x.type == "CallExpression" and called(x) in ("jsx", "jsxs", "createElement", "createElementVNode", "h") for x in walk(n.body))
            found.append((n.id, "component" if makes else "hook" if n.id.startswith("use") and n.id[3:4].isupper() else "function"))
    return found


def storage_keys(code: str | None) -> list[tuple[str, str, str]]:
    """(store, method, key) of constant keys in web storage."""
    tree = parse_or_none(code)
    found = []
    for n in walk(tree) if tree is not None else ():
        if n.type == "CallExpression" and n.callee.type == "MemberExpression" and n.callee.object.type == "Identifier" and n.callee.object.name in ("localStorage", "sessionStorage") and n.arguments and (key := constant(n.arguments[0])) is not None:
            found.append((n.callee.object.name, key_of(n.callee.property) or "", key))
    return found
