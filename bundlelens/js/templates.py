"""Markup from what it was compiled to: element calls to JSX, and render functions to templates."""

from __future__ import annotations

import json
import re

from bundlelens.js.parser import Node, parse_or_none, walk
from bundlelens.js.printer import expr, show
from bundlelens.js.refine import called, transform
from bundlelens.js.scopes import FUNCTIONS
from bundlelens.js.unpack import constant, key_of

# Calls that make elements, by runtime.
JSX_CALLS = frozenset(("jsx", "jsxs", "jsxDEV", "_jsx", "_jsxs"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Markup(Node):
    """An expression that is printed as the markup it stands for."""


def _props(node: Node | None) -> list[Node]:
    return node.properties if node is not None and node.type == "ObjectExpression" else []


def _tag(node: Node) -> str | None:
    if node.type == "Literal" and node.kind == "string":
        return node.value
    if node.type == "Identifier":
        return "" if node.name == "Fragment" else node.name
    if node.type == "MemberExpression" and not node.computed:
        of = _tag(node.object)
        return "" if node.property.name == "Fragment" else f"{of}.{node.property.name}" if of else None
    return None


def _jsx_text(value: str) -> str:
    return value if not re.search(r"[{}<>&]|^\s|\s$", value) and value else "{" + json.dumps(value, ensure_ascii=False) + "}"


def _jsx_child(node: Node) -> str:
    if node.type == "Markup":
        return node.text
    if node.type == "Literal" and node.kind == "string":
        return _jsx_text(node.value)
    return "{" + ("..." + expr(node.argument) if node.type == "SpreadElement" else show(node)) + "}"


def _jsx(call: Node) -> Node:
    tag = _tag(call.arguments[0]) if call.arguments else None
    if tag is None or len(call.arguments) < 2 or call.arguments[1].type not in ("ObjectExpression",):
        return call
    attributes, children = [], []
    for p in _props(call.arguments[1]):
        if p.type == "SpreadElement":
            attributes.append(f"{{...{expr(p.argument)}}}")
        elif p.computed or p.kind != "init" or key_of(p.key) is None:
            return call
        elif key_of(p.key) == "children":
            children = p.value.elements if p.value.type == "ArrayExpression" else [p.value]
        elif p.value.type == "Literal" and p.value.kind == "string" and '"' not in p.value.value and "\\" not in p.value.value:
            attributes.append(f'{key_of(p.key)}="{p.value.value}"')
        elif p.value.type == "Literal" and p.value.kind == "true":
            attributes.append(key_of(p.key))
        else:
            attributes.append(f"{key_of(p.key)}={{{show(p.value)}}}")
    if len(call.arguments) > 2:
        attributes.insert(0, f"key={{{show(call.arguments[2])}}}")
    head = " ".join([tag, *attributes])
    inner = "".join(_jsx_child(c) for c in children if c is not None)
    found = Markup("Markup", call.start, call.line)
    found.text = f"<{head} />" if not children and tag else f"<{head}>{inner}</{tag}>"
    return found


def jsx(code: str | None) -> str | None:
    """The code with element calls as JSX; null if it can't be parsed."""
    from bundlelens.js import printer

    if (tree := parse_or_none(code)) is None:
        return None
    printer._PRINTERS.setdefault("Markup", lambda n: n.text)
    return show(transform(tree, lambda n: _jsx(n) if n.type == "CallExpression" and called(n) in JSX_CALLS else n))


# Vue. Helpers of compiled render functions.
ELEMENTS = frozenset(("createElementVNode", "createElementBlock", "createVNode", "createBlock", "h"))
WRAPPERS = frozenset(("openBlock", "withCtx", "normalizeClass", "normalizeStyle", "toDisplayString", "unref", "renderList", "createTextVNode", "createCommentVNode", "withDirectives", "renderSlot"))


class Unsupported(ValueError):
    """A render function does something that a template doesn't say."""


def vue_template(code: str | None) -> str | None:
    """The template of the first render function in a script; null if there is none that templates can express."""
    tree = parse_or_none(code)
    for f in walk(tree) if tree is not None else ():
        if f.type in FUNCTIONS:
            result = f.body if f.body.type != "BlockStatement" else next((s.argument for s in f.body.body if s.type == "ReturnStatement"), None)
            if result is not None and _is_element(_last(result)):
                context = [p.name for p in f.params[:1] if p.type == "Identifier"]
                try:
                    return "\n".join(_vue(result, context))
                except Unsupported:
                    return None
    return None


def _last(n: Node) -> Node:
    return n.expressions[-1] if n.type == "SequenceExpression" else n


def _is_element(n: Node) -> bool:
    return n.type == "CallExpression" and (called(n) or "").lstrip("_") in ELEMENTS


def _code(n: Node, context: list[str]) -> str:
    """An expression of a template: what the context has needs no prefix."""
    text = show(n)
    for name in context:
        text = re.sub(rf"(?<![\w$.]){re.escape(name)}\.", "", text)
    return text.replace('"', "'")


def _attributes(n: Node | None, context: list[str]) -> list[str]:
    found = []
    for p in _props(n):
        if p.type == "SpreadElement":
            found.append(f'v-bind="{_code(p.argument, context)}"')
            continue
        name, value = key_of(p.key), p.value
        if name is None or p.computed:
            raise Unsupported("a computed attribute")
        if value.type == "CallExpression" and (called(value) or "").lstrip("_") in ("normalizeClass", "normalizeStyle") and value.arguments:
            value = value.arguments[0]
        if re.match(r"on[A-Z]", name):
            if name.startswith("onUpdate:"):
                continue
            event = name[2].lower() + name[3:]
            found.append(f'@{event}="{_handler(value, context)}"')
        elif name == "key":
            found.append(f':key="{_code(value, context)}"')
        elif value.type == "Literal" and value.kind == "string":
            found.append(f'{name}="{value.value}"' if value.value else name)
        else:
            found.append(f':{name}="{_code(value, context)}"')
    return found


def _handler(n: Node, context: list[str]) -> str:
    # handlers are kept in a cache: `cache[0] || (cache[0] = ...)`
    if n.type == "LogicalExpression" and n.operator == "||" and n.right.type == "AssignmentExpression":
        n = n.right.right
    if n.type == "ArrowFunctionExpression" and n.body.type != "BlockStatement" and not (n.params and n.params[0].type == "SpreadElement"):
        return _code(n.body, context).replace(n.params[0].name, "$event") if n.params and n.params[0].type == "Identifier" else _code(n.body, context)
    if n.type == "ArrowFunctionExpression" and n.params and n.body.type != "BlockStatement":
        body = _last(n.body)
        callee = next((x for x in walk(body) if x.type == "CallExpression"), None)
        return _code(callee.callee, context) if callee is not None else _code(body, context)
    return _code(n, context)


def _text(n: Node, context: list[str]) -> str:
    if n.type == "BinaryExpression" and n.operator == "+":
        return _text(n.left, context) + _text(n.right, context)
    if n.type == "Literal" and n.kind == "string":
        return n.value
    if n.type == "CallExpression" and (called(n) or "").lstrip("_") == "toDisplayString" and n.arguments:
        return f"{{{{ {_code(n.arguments[0], context)} }}}}"
    raise Unsupported(n.type)


def _vue(n: Node, context: list[str], extra: tuple[str, ...] = ()) -> list[str]:
    n = _last(n)
    if n.type == "ConditionalExpression":
        lines = _vue(n.consequent, context, (*extra, f'v-if="{_code(n.test, context)}"'))
        other = _last(n.alternate)
        if other.type == "CallExpression" and (called(other) or "").lstrip("_") == "createCommentVNode":
            return lines
        if other.type == "ConditionalExpression":
            rest = _vue(other, context)
            return lines + [rest[0].replace("v-if=", "v-else-if=", 1), *rest[1:]]
        return lines + _vue(other, context, ("v-else",))
    if n.type != "CallExpression":
        if n.type == "Literal" and n.kind == "string":
            return [n.value]
        raise Unsupported(n.type)
    name = (called(n) or "").lstrip("_")
    if name == "createTextVNode":
        return [_text(n.arguments[0], context)] if n.arguments else [""]
    if name == "createCommentVNode":
        return []
    if name == "renderSlot":
        slot = constant(n.arguments[1]) if len(n.arguments) > 1 else "default"
        return ["<slot />" if slot == "default" else f'<slot name="{slot}" />']
    if name == "withDirectives":
        return _vue(n.arguments[0], context, (*extra, *_directives(n.arguments[1] if len(n.arguments) > 1 else None, context, n.arguments[0])))
    if name not in ELEMENTS or not n.arguments:
        raise Unsupported(name)
    tag = _tag(n.arguments[0])
    if tag is None:
        raise Unsupported("a computed element")
    children = n.arguments[2] if len(n.arguments) > 2 else None
    if tag == "" and children is not None and children.type == "CallExpression" and (called(children) or "").lstrip("_") == "renderList":
        return _repeated(children, context, extra)
    attributes = [*extra, *_attributes(n.arguments[1] if len(n.arguments) > 1 else None, context)]
    inner = _children(children, context)
    head = " ".join([tag or "template", *attributes])
    if not inner:
        return [f"<{head}>" if tag in VOID else f"<{head} />"]
    if len(inner) == 1 and not inner[0].startswith("<") and len(inner[0]) < 60:
        return [f"<{head}>{inner[0]}</{tag or 'template'}>"]
    return [f"<{head}>", *(f"  {line}" for line in inner), f"</{tag or 'template'}>"]


def _repeated(call: Node, context: list[str], extra: tuple[str, ...]) -> list[str]:
    if len(call.arguments) < 2 or call.arguments[1].type not in FUNCTIONS:
        raise Unsupported("a loop without a function")
    f = call.arguments[1]
    names = ", ".join(show(p) for p in f.params)
    names = f"({names})" if len(f.params) > 1 else names
    body = f.body if f.body.type != "BlockStatement" else next((s.argument for s in f.body.body if s.type == "ReturnStatement"), None)
    if body is None:
        raise Unsupported("a loop without a result")
    return _vue(body, context, (*extra, f'v-for="{names} in {_code(call.arguments[0], context)}"'))


def _directives(n: Node | None, context: list[str], element: Node) -> list[str]:
    found = []
    for d in n.elements if n is not None and n.type == "ArrayExpression" else ():
        if d is None or d.type != "ArrayExpression" or not d.elements or d.elements[0].type != "Identifier":
            raise Unsupported("a directive")
        name = d.elements[0].name.lstrip("_")
        value = f'="{_code(d.elements[1], context)}"' if len(d.elements) > 1 else ""
        kind = "model" if name.startswith("vModel") else "show" if name == "vShow" else re.sub(r"^v(?=[A-Z])", "", name).lower()
        found.append(f"v-{kind}{value}")
    return found


def _children(n: Node | None, context: list[str]) -> list[str]:
    if n is None or n.type == "Literal" and n.kind == "null":
        return []
    if n.type == "ArrayExpression":
        return [line for c in n.elements if c is not None for line in _vue(c, context)]
    if n.type == "ObjectExpression":
        lines = []
        for p in n.properties:
            name = key_of(p.key) if p.type == "Property" else None
            if name == "_" or p.type == "SpreadElement":
                continue
            f = p.value
            if f.type == "CallExpression" and (called(f) or "").lstrip("_") == "withCtx" and f.arguments:
                f = f.arguments[0]
            if f.type not in FUNCTIONS:
                continue
            body = f.body if f.body.type != "BlockStatement" else next((s.argument for s in f.body.body if s.type == "ReturnStatement"), None)
            inner = _children(body, context)
            scope = f'="{show(f.params[0])}"' if f.params else ""
            if name == "default" and not f.params:
                lines += inner
            else:
                lines += [f"<template #{name}{scope}>", *(f"  {line}" for line in inner), "</template>"]
        return lines
    if n.type == "CallExpression" and (called(n) or "").lstrip("_") == "renderList":
        return _repeated(n, context, ())
    if n.type in ("CallExpression", "ConditionalExpression", "SequenceExpression") and (called(n) if n.type == "CallExpression" else "") != "toDisplayString":
        try:
            return _vue(n, context)
        except Unsupported:
            if n.type != "CallExpression":
                raise
    return [_text(n, context)]
