"""Syntax trees to readable source: two spaces, one statement a line, parentheses only where they are needed."""

from __future__ import annotations

from bundlelens.js.parser import BINARY, Node

# How tightly expressions bind; an operand that binds less is put in parentheses.
_SEQUENCE, _ASSIGN, _CONDITIONAL, _BINARY, _UNARY, _POSTFIX, _CALL, _PRIMARY = 0, 1, 2, 3, 20, 21, 22, 23
_LEVELS = {
    "SequenceExpression": _SEQUENCE, "AssignmentExpression": _ASSIGN, "ArrowFunctionExpression": _ASSIGN, "YieldExpression": _ASSIGN, "SpreadElement": _ASSIGN, "ConditionalExpression": _CONDITIONAL,
    "UnaryExpression": _UNARY, "AwaitExpression": _UNARY, "CallExpression": _CALL, "MemberExpression": _CALL, "TaggedTemplateExpression": _CALL, "NewExpression": _CALL,
}


def level(node: Node) -> int:
    if node.type in ("BinaryExpression", "LogicalExpression"):
        return _BINARY + BINARY[node.operator]
    if node.type == "UpdateExpression":
        return _UNARY if node.prefix else _POSTFIX
    return _LEVELS.get(node.type, _PRIMARY)


def indent(text: str) -> str:
    return "\n".join(f"  {line}" if line else line for line in text.split("\n"))


def show(node: Node) -> str:
    return _PRINTERS[node.type](node)


def expr(node: Node, least: int = _ASSIGN) -> str:
    text = show(node)
    return f"({text})" if level(node) < least else text


def _leftmost(node: Node) -> Node:
    while True:
        for part in ("left", "object", "callee", "tag", "test", "argument" if node.type == "UpdateExpression" and not node.prefix else "", "expressions"):
            found = node.get(part)
            if node.type in ("UnaryExpression", "ArrowFunctionExpression", "NewExpression", "TemplateLiteral"):
                return node
            if isinstance(found, list) and found and node.type == "SequenceExpression":
                node = found[0]
                break
            if isinstance(found, Node):
                node = found
                break
        else:
            return node


def block(body: list[Node]) -> str:
    return "{\n" + indent("\n".join(map(show, body))) + "\n}" if body else "{}"


def _nested(node: Node) -> str:
    return f" {show(node)}" if node.type == "BlockStatement" else f"\n{indent(show(node))}"


def _program(n: Node) -> str:
    return "".join(f"{show(s)}\n" for s in n.body)


def _expression_statement(n: Node) -> str:
    text = show(n.expression)
    first = _leftmost(n.expression).type
    return f"({text});" if first in ("ObjectExpression", "FunctionExpression", "ClassExpression") else f"{text};"


def _variables(n: Node) -> str:
    return f"{n.kind} " + ", ".join(map(show, n.declarations))


def _declarator(n: Node) -> str:
    return show(n.id) if n.init is None else f"{show(n.id)} = {expr(n.init)}"


def _if(n: Node) -> str:
    text = f"if ({show(n.test)}){_nested(n.consequent)}"
    if n.alternate is None:
        return text
    start = " else" if n.consequent.type == "BlockStatement" else "\nelse"
    return text + start + (f" {show(n.alternate)}" if n.alternate.type == "IfStatement" else _nested(n.alternate))


def _head(n: Node | None) -> str:
    return "" if n is None else _variables(n) if n.type == "VariableDeclaration" else show(n)


def _for(n: Node) -> str:
    return f"for ({_head(n.init)}; {_head(n.test)}; {_head(n.update)}){_nested(n.body)}"


def _for_each(n: Node) -> str:
    word = "in" if n.type == "ForInStatement" else "of"
    return f"for{' await' if n.is_await else ''} ({_head(n.left)} {word} {expr(n.right)}){_nested(n.body)}"


def _try(n: Node) -> str:
    text = f"try {show(n.block)}"
    if n.handler is not None:
        text += f" catch{f' ({show(n.param)})' if n.param is not None else ''} {show(n.handler)}"
    return text + (f" finally {show(n.finalizer)}" if n.finalizer is not None else "")


def _case(n: Node) -> str:
    head = "default:" if n.test is None else f"case {show(n.test)}:"
    return head + ("\n" + indent("\n".join(map(show, n.body))) if n.body else "")


def _import(n: Node) -> str:
    parts = [s.local for s in n.specifiers if s.imported == "default" and not s.get("named")] + [f"* as {s.local}" for s in n.specifiers if s.imported == "*"]
    named = [_renamed(s.imported, s.local) for s in n.specifiers if s.get("named")]
    if named:
        parts.append(f"{{ {', '.join(named)} }}")
    return f"import {', '.join(parts)}{' from ' if parts else ''}{quote(n.source)};"


def _renamed(a: str, b: str) -> str:
    return a if a == b else f"{a} as {b}"


def _export(n: Node) -> str:
    if n.type == "ExportAllDeclaration":
        return f"export *{f' as {n.exported}' if n.exported else ''} from {quote(n.source)};"
    if n.type == "ExportDefaultDeclaration":
        text = f"export default {expr(n.declaration)}"
        return text if n.declaration.type in ("FunctionDeclaration", "ClassDeclaration") else f"{text};"
    if n.declaration is not None:
        return f"export {show(n.declaration)}"
    names = ", ".join(_renamed(s.local, s.exported) for s in n.specifiers)
    return f"export {{{f' {names} ' if names else ''}}}{f' from {quote(n.source)}' if n.source is not None else ''};"


def quote(text: str) -> str:
    """A string literal in double quotes."""
    out = text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    return '"' + "".join(c if c >= " " or c == "\t" else f"\\x{ord(c):02x}" for c in out) + '"'


def _literal(n: Node) -> str:
    return n.raw if n.raw is not None else quote(n.value)


def params(n: Node) -> str:
    return f"({', '.join(expr(p) for p in n.params)})"


def _function(n: Node) -> str:
    return f"{'async ' if n.is_async else ''}function{'*' if n.generator else ''}{f' {n.id}' if n.id else ' ' if n.type == 'FunctionExpression' else ''}{params(n)} {show(n.body)}"


def _arrow(n: Node) -> str:
    body = show(n.body) if n.body.type == "BlockStatement" else expr(n.body)
    if n.body.type != "BlockStatement" and _leftmost(n.body).type == "ObjectExpression":
        body = f"({show(n.body)})"
    return f"{'async ' if n.is_async else ''}{params(n)} => {body}"


def _class(n: Node) -> str:
    return f"class{f' {n.id}' if n.id else ''}{f' extends {expr(n.superclass, _CALL)}' if n.superclass is not None else ''} {block(n.body)}"


def _key(n: Node) -> str:
    return f"[{expr(n.key)}]" if n.computed else show(n.key)


def _method(n: Node) -> str:
    f = n.value
    return f"{'async ' if f.is_async else ''}{'*' if f.generator else ''}{f'{n.kind} ' if n.kind in ('get', 'set') else ''}{_key(n)}{params(f)} {show(f.body)}"


def _member(n: Node) -> str:
    static = "static " if n.static else ""
    if n.kind == "block":
        return f"static {show(n.value)}"
    if n.kind == "field":
        return f"{static}{_key(n)}{f' = {expr(n.value)}' if n.value is not None else ''};"
    return static + _method(n)


def _property(n: Node) -> str:
    if n.kind in ("get", "set") or n.value.get("method"):
        return _method(n)
    return show(n.value) if n.shorthand else f"{_key(n)}: {expr(n.value)}"


def _list(parts: list[str], open_: str, close: str, pad: str = "") -> str:
    text = ", ".join(parts)
    if len(text) <= 80 and "\n" not in text:
        return f"{open_}{pad}{text}{pad}{close}" if parts else open_ + close
    return open_ + "\n" + indent(",\n".join(parts)) + "\n" + close


def _array(n: Node) -> str:
    parts = ["" if e is None else expr(e) for e in n.elements]
    return _list(parts, "[", "]") if not (parts and parts[-1] == "") else f"[{', '.join(parts)},]"


def _member_access(n: Node) -> str:
    of = expr(n.object, _CALL)
    if n.object.type == "Literal" and n.object.kind == "number" and not n.computed:
        of = f"({of})"
    if n.object.type == "NewExpression" and not n.object.arguments:
        of = f"({of})" if not of.endswith(")") else of
    dot = "?." if n.optional else "." if not n.computed else ""
    return f"{of}{dot}[{show(n.property)}]" if n.computed else f"{of}{dot}{n.property.name}"


def _call(n: Node) -> str:
    callee = expr(n.callee, _CALL)
    if n.callee.type in ("FunctionExpression", "ArrowFunctionExpression"):
        callee = f"({show(n.callee)})"
    return f"{callee}{'?.' if n.optional else ''}({', '.join(expr(a) for a in n.arguments)})"


def _new(n: Node) -> str:
    callee = expr(n.callee, _CALL)
    at = n.callee
    while at.type in ("MemberExpression", "CallExpression"):
        if at.type == "CallExpression":
            callee = f"({show(n.callee)})"
            break
        at = at.object
    return f"new {callee}({', '.join(expr(a) for a in n.arguments)})"


def _binary(n: Node) -> str:
    own = level(n)
    right_first = n.operator == "**"
    left, right = expr(n.left, own + right_first), expr(n.right, own + (not right_first))
    # ?? does not mix with || and && without parentheses
    mixed = lambda x: x.type == "LogicalExpression" and (n.operator == "??") != (x.operator == "??") and n.operator in ("??", "||", "&&")
    if n.type == "LogicalExpression":
        left = f"({show(n.left)})" if mixed(n.left) else left
        right = f"({show(n.right)})" if mixed(n.right) else right
    return f"{left} {n.operator} {right}"


def _unary(n: Node) -> str:
    inner = expr(n.argument, _UNARY)
    space = " " if n.operator.isalpha() or inner[:1] == n.operator[:1] and n.operator in ("+", "-") else ""
    return f"{n.operator}{space}{inner}"


def _update(n: Node) -> str:
    return f"{n.operator}{expr(n.argument, _UNARY)}" if n.prefix else f"{expr(n.argument, _CALL)}{n.operator}"


def _conditional(n: Node) -> str:
    return f"{expr(n.test, _BINARY)} ? {expr(n.consequent)} : {expr(n.alternate)}"


def _template(n: Node) -> str:
    text = n.raws[0]
    for e, raw in zip(n.expressions, n.raws[1:], strict=True):
        text += f"${{{show(e)}}}{raw}"
    return f"`{text}`"


_PRINTERS = {
    "Program": _program, "ExpressionStatement": _expression_statement, "VariableDeclaration": lambda n: _variables(n) + ";", "VariableDeclarator": _declarator, "EmptyStatement": lambda n: ";", "BlockStatement": lambda n: block(n.body),
    "IfStatement": _if, "ForStatement": _for, "ForInStatement": _for_each, "ForOfStatement": _for_each, "WhileStatement": lambda n: f"while ({show(n.test)}){_nested(n.body)}",
    "DoWhileStatement": lambda n: f"do{_nested(n.body)}{' ' if n.body.type == 'BlockStatement' else chr(10)}while ({show(n.test)});", "ReturnStatement": lambda n: f"return {show(n.argument)};" if n.argument is not None else "return;",
    "ThrowStatement": lambda n: f"throw {show(n.argument)};", "BreakStatement": lambda n: f"break{f' {n.label}' if n.label else ''};", "ContinueStatement": lambda n: f"continue{f' {n.label}' if n.label else ''};", "DebuggerStatement": lambda n: "debugger;",
    "LabeledStatement": lambda n: f"{n.label}: {show(n.body)}", "TryStatement": _try, "SwitchStatement": lambda n: f"switch ({show(n.discriminant)}) {block(n.cases)}", "SwitchCase": _case,
    "ImportDeclaration": _import, "ExportNamedDeclaration": _export, "ExportDefaultDeclaration": _export, "ExportAllDeclaration": _export,
    "FunctionDeclaration": _function, "FunctionExpression": _function, "ArrowFunctionExpression": _arrow, "ClassDeclaration": _class, "ClassExpression": _class, "ClassMember": _member,
    "Identifier": lambda n: n.name, "Literal": _literal, "ThisExpression": lambda n: "this", "Super": lambda n: "super", "Import": lambda n: "import", "MetaProperty": lambda n: f"new.{n.name}",
    "ArrayExpression": _array, "ObjectExpression": lambda n: _list(list(map(show, n.properties)), "{", "}", " "), "Property": _property, "SpreadElement": lambda n: f"...{expr(n.argument)}",
    "SequenceExpression": lambda n: ", ".join(expr(e) for e in n.expressions), "AssignmentExpression": lambda n: f"{expr(n.left, _CALL)} {n.operator} {expr(n.right)}", "ConditionalExpression": _conditional,
    "BinaryExpression": _binary, "LogicalExpression": _binary, "UnaryExpression": _unary, "AwaitExpression": lambda n: f"await {expr(n.argument, _UNARY)}", "UpdateExpression": _update,
    "YieldExpression": lambda n: f"yield{'*' if n.delegate else ''}{f' {expr(n.argument)}' if n.argument is not None else ''}", "CallExpression": _call, "NewExpression": _new, "MemberExpression": _member_access,
    "TaggedTemplateExpression": lambda n: f"{expr(n.tag, _CALL)}{show(n.quasi)}", "TemplateLiteral": _template,
}
