"""Scripts to syntax trees. Patterns are read as the expressions they look like; types are those of the ESTree names."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from bundlelens.operators.scripts import Token, tokens


class ParseError(ValueError):
    """The script is none that this parser reads."""


class Node:
    """A syntax node: `type`, `start` and `end` in the source, `line`, and the parts of its kind as attributes."""

    def __init__(self, type: str, start: int, line: int, **parts: Any):
        self.type, self.start, self.end, self.line = type, start, start, line
        self.__dict__.update(parts)

    def get(self, part: str) -> Any:
        return self.__dict__.get(part)

    def parts(self) -> Iterator[tuple[str, Any]]:
        for name, value in self.__dict__.items():
            if isinstance(value, (Node, list)):
                yield name, value

    def children(self) -> list[Node]:
        found: list[Node] = []
        for value in self.__dict__.values():
            if isinstance(value, Node):
                found.append(value)
            elif isinstance(value, list):
                found += [x for x in value if isinstance(x, Node)]
        return found

    def __repr__(self) -> str:
        return f"{self.type}({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items() if k not in ('type', 'start', 'end', 'line'))})"


def walk(node: Node) -> Iterator[Node]:
    """The node and all below it, in the order of the source, without recursion."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x.children()))


BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
UNARY = frozenset("! ~ + - typeof void delete".split())
RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with".split())
#: Deepest nesting that is read; what is deeper is refused rather than left to the interpreter's stack.
DEPTH = 160
END = Token("end", "", 0, "", 0, True)


class Parser:
    def __init__(self, code: str):
        self.code = code
        self.tokens = list(tokens(code))
        self.at, self.depth = 0, 0
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "punct":
                if t.value in ("(", "[", "{"):
                    stack.append(i)
                elif t.value in (")", "]", "}") and stack:
                    self.close[stack.pop()] = i

    # tokens

    @property
    def token(self) -> Token:
        return self.tokens[self.at] if self.at < len(self.tokens) else END

    def peek(self, n: int = 1) -> Token:
        return self.tokens[self.at + n] if self.at + n < len(self.tokens) else END

    def fail(self, wanted: str) -> ParseError:
        return ParseError(f"line {self.token.line}: {wanted} expected, not {self.token.value[:20]!r}")

    def sees(self, *values: str) -> bool:
        t = self.tokens[self.at] if self.at < len(self.tokens) else END
        return t.value in values and t.kind in ("punct", "name")

    def take(self, *values: str) -> str | None:
        t = self.tokens[self.at] if self.at < len(self.tokens) else END
        if t.value in values and t.kind in ("punct", "name"):
            self.at += 1
            return t.value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise self.fail(repr(value))

    def begin(self, type: str, **parts: Any) -> Node:
        return Node(type, self.token.start, self.token.line, **parts)

    def done(self, node: Node) -> Node:
        last = self.tokens[self.at - 1] if self.at else END
        node.end = last.start + len(last.raw)
        return node

    def semicolon(self) -> None:
        if not self.take(";") and not (self.sees("}") or self.token is END or self.token.newline):
            raise self.fail("';'")

    # statements

    def program(self) -> Node:
        node = self.begin("Program", body=[])
        while self.token is not END:
            node.body.append(self.statement())
        node.end = len(self.code)
        return node

    def statement(self) -> Node:
        self.depth += 1
        if self.depth > DEPTH:
            raise ParseError("nested too deeply")
        try:
            return self._statement()
        finally:
            self.depth -= 1

    def _statement(self) -> Node:
        t = self.token
        if t.kind == "punct":
            if t.value == "{":
                return self.block()
            if t.value == ";":
                node = self.begin("EmptyStatement")
                self.at += 1
                return self.done(node)
        if t.kind == "name":
            after = self.peek()
            if t.value in ("var", "const") or t.value == "let" and (after.kind == "name" and after.value not in ("in", "of", "instanceof") or after.value in ("[", "{")):
                node = self.variables()
                self.semicolon()
                return self.done(node)
            if t.value == "function" or t.value == "async" and after.value == "function" and not after.newline:
                return self.function("FunctionDeclaration")
            if t.value == "class":
                return self.klass("ClassDeclaration")
            method = getattr(self, f"_{t.value}", None) if t.value in ("if", "for", "while", "do", "return", "break", "continue", "throw", "try", "switch", "debugger", "export") else None
            if method:
                return self.done(method())
            if t.value == "import" and after.value not in ("(", "."):
                return self.done(self._import())
            if after.value == ":" and after.kind == "punct" and t.value not in RESERVED:
                node = self.begin("LabeledStatement", label=t.value)
                self.at += 2
                node.body = self.statement()
                return self.done(node)
        node = self.begin("ExpressionStatement")
        if t.kind == "string" and (self.peek().value in (";", "}") or self.peek().newline or self.peek() is END):
            node.directive = t.value
        node.expression = self.expression()
        self.semicolon()
        return self.done(node)

    def block(self) -> Node:
        node = self.begin("BlockStatement", body=[])
        self.need("{")
        while not self.take("}"):
            if self.token is END:
                raise self.fail("'}'")
            node.body.append(self.statement())
        return self.done(node)

    def variables(self, within_for: bool = False) -> Node:
        node = self.begin("VariableDeclaration", kind=self.token.value, declarations=[])
        self.at += 1
        while True:
            one = self.begin("VariableDeclarator")
            one.id = self.binding()
            one.init = self.assignment(within_for) if self.take("=") else None
            node.declarations.append(self.done(one))
            if not self.take(","):
                return self.done(node)

    def binding(self) -> Node:
        return self.primary() if self.sees("[", "{") else self.identifier()

    def identifier(self) -> Node:
        t = self.token
        if t.kind != "name" or t.value in RESERVED:
            raise self.fail("a name")
        node = self.begin("Identifier", name=t.value)
        self.at += 1
        return self.done(node)

    def _if(self) -> Node:
        node = self.begin("IfStatement")
        self.at += 1
        node.test = self.parenthesised()
        node.consequent = self.statement()
        node.alternate = self.statement() if self.take("else") else None
        return node

    def parenthesised(self) -> Node:
        self.need("(")
        found = self.expression()
        self.need(")")
        return found

    def _for(self) -> Node:
        node = self.begin("ForStatement", init=None, test=None, update=None)
        self.at += 1
        is_await = bool(self.take("await"))
        self.need("(")
        if not self.sees(";"):
            if self.sees("var", "const") or self.sees("let") and (self.peek().kind == "name" and self.peek().value not in ("in", "of") or self.peek().value in ("[", "{")):
                node.init = self.variables(within_for=True)
            else:
                node.init = self.expression(within_for=True)
            if kind := self.take("in", "of"):
                node.type = "ForInStatement" if kind == "in" else "ForOfStatement"
                node.left, node.right, node.is_await = node.init, self.expression() if kind == "in" else self.assignment(), is_await
                del node.init, node.test, node.update
                self.need(")")
                node.body = self.statement()
                return node
        self.need(";")
        node.test = None if self.sees(";") else self.expression()
        self.need(";")
        node.update = None if self.sees(")") else self.expression()
        self.need(")")
        node.body = self.statement()
        return node

    def _while(self) -> Node:
        node = self.begin("WhileStatement")
        self.at += 1
        node.test = self.parenthesised()
        node.body = self.statement()
        return node

    def _do(self) -> Node:
        node = self.begin("DoWhileStatement")
        self.at += 1
        node.body = self.statement()
        self.need("while")
        node.test = self.parenthesised()
        self.take(";")
        return node

    def _return(self) -> Node:
        node = self.begin("ReturnStatement", argument=None)
        self.at += 1
        if not (self.sees(";", "}") or self.token.newline or self.token is END):
            node.argument = self.expression()
        self.semicolon()
        return node

    def _throw(self) -> Node:
        node = self.begin("ThrowStatement")
        self.at += 1
        node.argument = self.expression()
        self.semicolon()
        return node

    def _break(self) -> Node:
        node = self.begin("BreakStatement" if self.token.value == "break" else "ContinueStatement", label=None)
        self.at += 1
        if self.token.kind == "name" and not self.token.newline:
            node.label = self.token.value
            self.at += 1
        self.semicolon()
        return node

    _continue = _break

    def _debugger(self) -> Node:
        node = self.begin("DebuggerStatement")
        self.at += 1
        self.semicolon()
        return node

    def _try(self) -> Node:
        node = self.begin("TryStatement", param=None, handler=None, finalizer=None)
        self.at += 1
        node.block = self.block()
        if self.take("catch"):
            if self.take("("):
                node.param = self.binding()
                self.need(")")
            node.handler = self.block()
        if self.take("finally"):
            node.finalizer = self.block()
        return node

    def _switch(self) -> Node:
        node = self.begin("SwitchStatement", cases=[])
        self.at += 1
        node.discriminant = self.parenthesised()
        self.need("{")
        while not self.take("}"):
            case = self.begin("SwitchCase", test=None, body=[])
            if self.take("case"):
                case.test = self.expression()
            else:
                self.need("default")
            self.need(":")
            while not self.sees("case", "default", "}"):
                case.body.append(self.statement())
            node.cases.append(self.done(case))
        return node

    def _import(self) -> Node:
        node = self.begin("ImportDeclaration", specifiers=[])
        self.at += 1
        if self.token.kind != "string":
            if self.token.kind == "name" and not self.sees("from"):
                node.specifiers.append(Node("ImportSpecifier", self.token.start, self.token.line, imported="default", local=self.identifier().name))
                self.take(",")
            if self.take("*"):
                self.need("as")
                node.specifiers.append(Node("ImportSpecifier", self.token.start, self.token.line, imported="*", local=self.identifier().name))
            elif self.sees("{"):
                node.specifiers += [Node("ImportSpecifier", start, line, imported=a, local=b, named=True) for a, b, start, line in self.names()]
            self.need("from")
        node.source = self.string()
        self.attributes()
        self.semicolon()
        return node

    def string(self) -> str:
        if self.token.kind != "string":
            raise self.fail("a string")
        self.at += 1
        return self.tokens[self.at - 1].value

    def attributes(self) -> None:
        if self.sees("with", "assert") and self.peek().value == "{":
            self.at += 1
            self.at = self.close.get(self.at, self.at) + 1

    def names(self) -> list[tuple[str, str, int, int]]:
        """(name, name after `as` or the same, start, line) of a list in braces."""
        found = []
        self.need("{")
        while not self.take("}"):
            t = self.token
            if t.kind not in ("name", "string"):
                raise self.fail("a name")
            self.at += 1
            other = t.value
            if self.take("as"):
                other = self.token.value
                self.at += 1
            found.append((t.value, other, t.start, t.line))
            if not self.sees("}"):
                self.need(",")
        return found

    def _export(self) -> Node:
        node = self.begin("ExportNamedDeclaration", declaration=None, specifiers=[], source=None)
        self.at += 1
        if self.take("default"):
            node.type = "ExportDefaultDeclaration"
            if self.sees("function") or self.sees("async") and self.peek().value == "function":
                node.declaration = self.function("FunctionDeclaration", anonymous=True)
            elif self.sees("class"):
                node.declaration = self.klass("ClassDeclaration")
            else:
                node.declaration = self.assignment()
                self.semicolon()
            return node
        if self.take("*"):
            node.type, node.exported = "ExportAllDeclaration", None
            if self.take("as"):
                node.exported = self.token.value
                self.at += 1
            self.need("from")
            node.source = self.string()
        elif self.sees("{"):
            node.specifiers = [Node("ExportSpecifier", start, line, local=a, exported=b) for a, b, start, line in self.names()]
            if self.take("from"):
                node.source = self.string()
        else:
            node.declaration = self.statement()
            return node
        self.attributes()
        self.semicolon()
        return node

    # functions and classes

    def function(self, type: str, anonymous: bool = False) -> Node:
        node = self.begin(type, id=None, is_async=bool(self.take("async")), generator=False)
        self.need("function")
        node.generator = bool(self.take("*"))
        if self.token.kind == "name" and not self.sees("("):
            node.id = self.token.value
            self.at += 1
        elif type == "FunctionDeclaration" and not anonymous:
            raise self.fail("a name")
        node.params = self.params()
        node.body = self.block()
        return self.done(node)

    def params(self) -> list[Node]:
        found = []
        self.need("(")
        while not self.take(")"):
            found.append(self.element())
            if not self.sees(")"):
                self.need(",")
        return found

    def element(self) -> Node:
        """A parameter or an element of a list: spread, or an assignment (for a default)."""
        if self.sees("..."):
            node = self.begin("SpreadElement")
            self.at += 1
            node.argument = self.assignment()
            return self.done(node)
        return self.assignment()

    def klass(self, type: str) -> Node:
        node = self.begin(type, id=None, superclass=None, body=[])
        self.need("class")
        if self.token.kind == "name" and not self.sees("extends"):
            node.id = self.token.value
            self.at += 1
        if self.take("extends"):
            node.superclass = self.unary()
        self.need("{")
        while not self.take("}"):
            if not self.take(";"):
                node.body.append(self.member())
        return self.done(node)

    def member(self) -> Node:
        node = self.begin("ClassMember", static=False, kind="method", computed=False, value=None)
        end_of_name = ("(", "=", ";", "}")
        if self.sees("static") and self.peek().value not in end_of_name:
            self.at += 1
            node.static = True
            if self.sees("{"):
                node.kind, node.key, node.value = "block", None, self.block()
                return self.done(node)
        return self.method(node, end_of_name)

    def method(self, node: Node, end_of_name: tuple[str, ...]) -> Node:
        """What follows modifiers in classes and object literals: accessors, methods, fields."""
        is_async = generator = False
        if self.sees("async") and self.peek().value not in (*end_of_name, ",", ":") and not self.peek().newline:
            self.at += 1
            is_async = True
        if self.take("*"):
            generator = True
        if self.sees("get", "set") and self.peek().value not in (*end_of_name, ",", ":") and not (self.peek().newline and node.type == "ClassMember"):
            node.kind = self.token.value
            self.at += 1
        node.key, node.computed = self.key()
        if self.sees("("):
            value = self.begin("FunctionExpression", id=None, is_async=is_async, generator=generator, method=True)
            value.params = self.params()
            value.body = self.block()
            node.value = self.done(value)
        elif node.type == "ClassMember":
            node.kind = "field"
            node.value = self.assignment() if self.take("=") else None
            self.semicolon()
        return self.done(node)

    def key(self) -> tuple[Node, bool]:
        t = self.token
        if self.take("["):
            found = self.assignment()
            self.need("]")
            return found, True
        if t.kind == "name":
            node = self.begin("Identifier", name=t.value)
        elif t.kind in ("string", "number"):
            node = self.begin("Literal", kind=t.kind, value=t.value, raw=t.raw)
        else:
            raise self.fail("a key")
        self.at += 1
        return self.done(node), False

    # expressions

    def expression(self, within_for: bool = False) -> Node:
        first = self.assignment(within_for)
        if not self.sees(","):
            return first
        node = Node("SequenceExpression", first.start, first.line, expressions=[first])
        while self.take(","):
            node.expressions.append(self.assignment(within_for))
        return self.done(node)

    def assignment(self, within_for: bool = False) -> Node:
        self.depth += 1
        if self.depth > DEPTH:
            raise ParseError("nested too deeply")
        try:
            if arrow := self.arrow():
                return arrow
            if self.sees("yield"):
                node = self.begin("YieldExpression", delegate=False, argument=None)
                self.at += 1
                node.delegate = bool(self.take("*"))
                if not (self.sees(")", "]", "}", ",", ";", ":", "in", "of") or self.token.newline or self.token is END):
                    node.argument = self.assignment(within_for)
                return self.done(node)
            left = self.conditional(within_for)
            if self.token.kind == "punct" and self.token.value in ASSIGN:
                if left.type not in ("Identifier", "MemberExpression", "ObjectExpression", "ArrayExpression"):
                    raise self.fail("something to assign to")
                node = Node("AssignmentExpression", left.start, left.line, operator=self.token.value, left=left)
                self.at += 1
                node.right = self.assignment(within_for)
                return self.done(node)
            return left
        finally:
            self.depth -= 1

    def arrow(self) -> Node | None:
        begun, is_async = self.at, False
        if self.sees("async") and not self.peek().newline and (self.peek().kind == "name" and self.peek(2).value == "=>" or self.peek().value == "("):
            is_async = True
            at = self.at + 1
        else:
            at = self.at
        t = self.tokens[at] if at < len(self.tokens) else END
        if t.kind == "name" and t.value not in RESERVED:
            end = at
        elif t.kind == "punct" and t.value == "(" and at in self.close:
            end = self.close[at]
        else:
            return None
        sign = self.tokens[end + 1] if end + 1 < len(self.tokens) else END
        if sign.value != "=>" or sign.kind != "punct":
            return None
        node = self.begin("ArrowFunctionExpression", id=None, is_async=is_async, generator=False)
        self.at = at
        node.params = self.params() if t.value == "(" else [self.identifier()]
        self.need("=>")
        node.body = self.block() if self.sees("{") else self.assignment()
        node.start = self.tokens[begun].start
        return self.done(node)

    def conditional(self, within_for: bool) -> Node:
        test = self.binary(1, within_for)
        if not self.take("?"):
            return test
        node = Node("ConditionalExpression", test.start, test.line, test=test)
        node.consequent = self.assignment()
        self.need(":")
        node.alternate = self.assignment(within_for)
        return self.done(node)

    def binary(self, least: int, within_for: bool) -> Node:
        left = self.unary()
        while True:
            t = self.token
            level = BINARY.get(t.value, 0) if t.kind in ("punct", "name") else 0
            if level < least or not level or (within_for and t.value == "in"):
                return left
            self.at += 1
            node = Node("LogicalExpression" if level <= 3 else "BinaryExpression", left.start, left.line, operator=t.value, left=left)
            node.right = self.binary(level if t.value == "**" else level + 1, within_for)
            left = self.done(node)

    def unary(self) -> Node:
        t = self.token
        if t.kind in ("punct", "name") and (t.value in UNARY or t.value in ("++", "--") or t.value == "await" and self._awaits()):
            self.depth += 1
            if self.depth > DEPTH:
                raise ParseError("nested too deeply")
            type = "AwaitExpression" if t.value == "await" else "UpdateExpression" if t.value in ("++", "--") else "UnaryExpression"
            node = self.begin(type, operator=t.value, prefix=True)
            self.at += 1
            node.argument = self.unary()
            self.depth -= 1
            return self.done(node)
        found = self.calls(self.primary())
        if self.sees("++", "--") and not self.token.newline:
            node = Node("UpdateExpression", found.start, found.line, operator=self.token.value, prefix=False, argument=found)
            self.at += 1
            return self.done(node)
        return found

    def _awaits(self) -> bool:
        after = self.peek()
        return not after.newline and (after.kind in ("name", "string", "number", "template", "regex") and after.value not in ("in", "of", "instanceof") or after.value in ("(", "[", "{", "!", "+", "-", "~", "@"))

    def calls(self, found: Node, new: bool = False) -> Node:
        while True:
            t = self.token
            if t.kind == "template" and t.raw.startswith("`"):
                node = Node("TaggedTemplateExpression", found.start, found.line, tag=found)
                node.quasi = self.template()
            elif t.kind != "punct":
                return found
            elif t.value in (".", "?."):
                self.at += 1
                optional = t.value == "?."
                if optional and self.sees("("):
                    node = Node("CallExpression", found.start, found.line, callee=found, optional=True)
                    node.arguments = self.arguments()
                elif optional and self.take("["):
                    node = Node("MemberExpression", found.start, found.line, object=found, computed=True, optional=True)
                    node.property = self.expression()
                    self.need("]")
                else:
                    name = self.token
                    if name.kind != "name":
                        raise self.fail("a property")
                    node = Node("MemberExpression", found.start, found.line, object=found, computed=False, optional=optional, property=Node("Identifier", name.start, name.line, name=name.value))
                    self.at += 1
            elif t.value == "[":
                self.at += 1
                node = Node("MemberExpression", found.start, found.line, object=found, computed=True, optional=False)
                node.property = self.expression()
                self.need("]")
            elif t.value == "(" and not new:
                node = Node("CallExpression", found.start, found.line, callee=found, optional=False)
                node.arguments = self.arguments()
            else:
                return found
            found = self.done(node)

    def arguments(self) -> list[Node]:
        return self.params()

    def primary(self) -> Node:
        t = self.token
        if t.kind in ("string", "number", "regex"):
            node = self.begin("Literal", kind=t.kind, value=t.value, raw=t.raw)
            self.at += 1
            return self.done(node)
        if t.kind == "template":
            return self.template()
        if t.kind == "name":
            if t.value == "function" or t.value == "async" and self.peek().value == "function" and not self.peek().newline:
                return self.function("FunctionExpression")
            if t.value == "class":
                return self.klass("ClassExpression")
            if t.value == "new":
                return self.new()
            if t.value in ("this", "super"):
                node = self.begin("ThisExpression" if t.value == "this" else "Super")
            elif t.value in ("null", "true", "false"):
                node = self.begin("Literal", kind=t.value, value=t.value, raw=t.value)
            elif t.value == "import":
                node = self.begin("Import")
            elif t.value in RESERVED:
                raise self.fail("an expression")
            else:
                node = self.begin("Identifier", name=t.value)
            self.at += 1
            return self.done(node)
        if t.value == "(":
            self.at += 1
            found = self.expression()
            self.need(")")
            found.parenthesised = True
            return found
        if t.value == "[":
            node = self.begin("ArrayExpression", elements=[])
            self.at += 1
            while not self.take("]"):
                if self.take(","):
                    node.elements.append(None)
                    continue
                node.elements.append(self.element())
                if not self.sees("]"):
                    self.need(",")
            return self.done(node)
        if t.value == "{":
            node = self.begin("ObjectExpression", properties=[])
            self.at += 1
            while not self.take("}"):
                node.properties.append(self.property())
                if not self.sees("}"):
                    self.need(",")
            return self.done(node)
        raise self.fail("an expression")

    def property(self) -> Node:
        if self.sees("..."):
            return self.element()
        node = self.method(self.begin("Property", kind="init", computed=False, shorthand=False, value=None), ("(", "}"))
        if node.value is None:
            if self.take(":"):
                node.value = self.assignment()
            else:
                if node.key.type != "Identifier":
                    raise self.fail("':'")
                node.shorthand, node.value = True, Node("Identifier", node.key.start, node.key.line, name=node.key.name, shorthand_of=True)
                node.value.end = node.key.end
                if self.sees("="):  # the default of a pattern
                    self.at += 1
                    node.value = Node("AssignmentExpression", node.key.start, node.key.line, operator="=", left=node.value, right=self.assignment())
        return self.done(node)

    def new(self) -> Node:
        node = self.begin("NewExpression", arguments=[])
        self.at += 1
        if self.take("."):
            node.type, node.name = "MetaProperty", self.token.value
            self.at += 1
            return self.done(node)
        node.callee = self.calls(self.new() if self.sees("new") else self.primary(), new=True)
        if self.sees("("):
            node.arguments = self.arguments()
        return self.done(node)

    def template(self) -> Node:
        node = self.begin("TemplateLiteral", quasis=[], raws=[], expressions=[])
        while True:
            t = self.token
            if t.kind != "template":
                raise self.fail("a template")
            self.at += 1
            open_end = t.raw.endswith("${")
            node.quasis.append(t.value)
            node.raws.append(t.raw[1 : -2 if open_end else -1])
            if not open_end:
                return self.done(node)
            node.expressions.append(self.expression())


def parse(code: str) -> Node:
    """The tree of a script or module; ParseError if it is none."""
    return Parser(code).program()


def parse_or_none(code: str | None) -> Node | None:
    try:
        return parse(code or "")
    except (ParseError, RecursionError):
        return None
