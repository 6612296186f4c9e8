"""Expressions to syntax trees: a lexer, and a precedence-climbing parser that builds paths as it goes."""

from __future__ import annotations

import re

from .values import ParseError

#: How tightly an operator binds to what stands left of it.
BINDING = {
    "[": 80, "(": 80, "@": 80, "#": 80, ".": 75, "{": 70, "*": 60, "/": 60, "%": 60, "+": 50, "-": 50, "&": 50,
    "=": 40, "!=": 40, "<": 40, "<=": 40, ">": 40, ">=": 40, "in": 40, "^": 40, "~>": 40, "?:": 40, "??": 40,
    "and": 30, "or": 25, "?": 20, "..": 20, ":=": 10,
}
_SYMBOL = re.compile(r":=|!=|<=|>=|\*\*|\.\.|~>|\?:|\?\?|[.\[\]{}()@#,;:?+\-*/%|=<>^&]")
_SPACE = re.compile(r"(?:[ \t\n\r\v]+|/\*.*?\*/)*", re.S)
_NUMBER = re.compile(r"(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_NAME = re.compile(r"[^ \t\n\r\v.\[\]{}()@#,;:?+\-*/%|=<>^&~!\"'`]+")
_ESCAPE = {'"': '"', "'": "'", "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


class Node:
    """A kind and what belongs to it; ``stages`` are the filters on it, ``group`` its group-by pairs."""

    def __init__(self, kind: str, **parts):
        self.kind, self.stages, self.group, self.keep, self.focus, self.index = kind, [], None, False, None, None
        self.__dict__.update(parts)

    def __repr__(self) -> str:
        return f"Node({ {k: v for k, v in self.__dict__.items() if v not in (None, [], False)} })"


class _Lexer:
    def __init__(self, source: str):
        self.source, self.at = source, 0

    def fail(self, message: str):
        raise ParseError(message)

    def next(self, prefix: bool) -> tuple[str, object]:
        """(kind, value); a slash where a value may start opens a regular expression."""
        s = self.source
        while True:
            self.at = _SPACE.match(s, self.at).end()
            if s.startswith("/*", self.at):
                self.fail("comment has no end")
            break
        if self.at >= len(s):
            return "end", None
        c = s[self.at]
        if c == "/" and prefix:
            return "regex", self._regex()
        if m := _SYMBOL.match(s, self.at):
            self.at = m.end()
            return "symbol", m[0]
        if c == "!":
            self.fail("unknown operator '!'")
        if c in "\"'":
            return "string", self._string(c)
        if m := _NUMBER.match(s, self.at):
            self.at = m.end()
            value = float(m[0])
            if value in (float("inf"), float("-inf")):
                self.fail(f"number out of range: {m[0]}")
            return "number", value
        if c == "`":
            end = s.find("`", self.at + 1)
            if end < 0:
                self.fail("quoted name has no end")
            name, self.at = s[self.at + 1 : end], end + 1
            return "name", name
        if not (m := _NAME.match(s, self.at)):
            self.fail(f"unexpected character {c!r}")
        self.at = m.end()
        if m[0][0] == "$":
            return "variable", m[0][1:]
        return "name" if m[0] not in ("and", "or", "in", "true", "false", "null") else "word", m[0]

    def _string(self, quote: str) -> str:
        s, i, out = self.source, self.at + 1, []
        while i < len(s):
            c = s[i]
            if c == quote:
                self.at = i + 1
                try:
                    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16")
                except UnicodeDecodeError:
                    self.fail("lone surrogate escape")
            if c == "\\":
                i += 1
                e = s[i : i + 1]
                if e == "u":
                    if not re.fullmatch("[0-9a-fA-F]{4}", s[i + 1 : i + 5]):
                        self.fail("\\u needs four hexadecimal digits")
                    out.append(chr(int(s[i + 1 : i + 5], 16)))
                    i += 4
                elif e in _ESCAPE and e:
                    out.append(_ESCAPE[e])
                else:
                    self.fail(f"unsupported escape \\{e}")
            else:
                out.append(c)
            i += 1
        self.fail("string has no end")

    def _regex(self) -> tuple[str, str]:
        s, i, depth = self.source, self.at + 1, 0
        while i < len(s):
            c = s[i]
            if c == "\\":
                i += 1
            elif c in "[({":
                depth += 1
            elif c in "])}":
                depth -= 1
            elif c == "/" and depth <= 0:
                body, i = s[self.at + 1 : i], i + 1
                flags = re.compile("[im]*").match(s, i)[0]
                self.at = i + len(flags)
                if not body:
                    self.fail("empty regular expression")
                return body, flags
            i += 1
        self.fail("regular expression has no end")


class _Parser:
    def __init__(self, source: str):
        self.lexer = _Lexer(source)
        self.token: tuple[str, object] = ("end", None)
        self.advance(True)

    def advance(self, prefix: bool, want: str | None = None) -> None:
        if want is not None and self.token != ("symbol", want):
            self.unexpected(want)
        self.token = self.lexer.next(prefix)

    def unexpected(self, want: str | None = None):
        kind, value = self.token
        got = "end of expression" if kind == "end" else repr(value)
        raise ParseError(f"expected {want!r}, got {got}" if want else f"unexpected {got}")

    def at_symbol(self, *symbols: str) -> bool:
        return self.token[0] == "symbol" and self.token[1] in symbols

    def infix(self) -> str | None:
        """The operator that the token is after a value."""
        kind, value = self.token
        return value if kind == "symbol" or kind == "word" and value in ("and", "or", "in") else None

    def expression(self, binding: int = 0) -> Node:
        left = self.prefix()
        while (op := self.infix()) is not None and BINDING.get(op, 0) > binding:
            left = self.after(left, op)
        return left

    # what starts a value

    def prefix(self) -> Node:
        kind, value = self.token
        if kind == "word" and value in ("true", "false", "null"):
            self.advance(False)
            return Node("literal", value={"true": True, "false": False, "null": None}[value])
        if kind in ("string", "number"):
            self.advance(False)
            return Node("literal", value=value)
        if kind == "variable":
            self.advance(False)
            return Node("variable", name=value)
        if kind == "regex":
            self.advance(False)
            flags = (re.I if "i" in value[1] else 0) | (re.M if "m" in value[1] else 0)
            try:
                return Node("regex", pattern=re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", value[0]), flags))
            except re.error as error:
                raise ParseError(f"regular expression: {error}") from None
        if kind in ("name", "word"):
            self.advance(False)
            if value in ("function", "λ") and self.at_symbol("("):
                return self.function()
            return Node("path", steps=[Node("name", name=value)])
        if kind != "symbol":
            self.unexpected()
        if value == "-":
            self.advance(True)
            inner = self.expression(70)
            if inner.kind == "literal" and type(inner.value) is float and not inner.stages:
                return Node("literal", value=-inner.value)
            return Node("negative", inner=inner)
        if value in ("*", "**", "%"):
            self.advance(False)
            return Node("path", steps=[Node({"*": "wildcard", "**": "descendants", "%": "parent"}[value])])
        if value == "(":
            self.advance(True)
            parts = []
            while not self.at_symbol(")"):
                parts.append(self.expression())
                if not self.at_symbol(";"):
                    break
                self.advance(True)
            self.advance(False, ")")
            return Node("block", parts=parts)
        if value == "[":
            self.advance(True)
            items = []
            while not self.at_symbol("]"):
                item = self.expression(BINDING[".."])
                if self.at_symbol(".."):
                    self.advance(True)
                    item = Node("range", low=item, high=self.expression(BINDING[".."]))
                items.append(item)
                if not self.at_symbol(","):
                    break
                self.advance(True)
            self.advance(False, "]")
            return Node("array", items=items)
        if value == "{":
            return Node("object", pairs=self.pairs())
        if value == "|":
            self.advance(True)
            pattern = self.expression()
            self.advance(True, "|")
            update, delete = self.expression(), None
            if self.at_symbol(","):
                self.advance(True)
                delete = self.expression()
            self.advance(False, "|")
            return Node("transform", pattern=pattern, update=update, delete=delete)
        self.unexpected()

    def pairs(self) -> list[tuple[Node, Node]]:
        self.advance(True, "{")
        found = []
        while not self.at_symbol("}"):
            key = self.expression()
            self.advance(True, ":")
            if self.token[0] == "regex":
                raise ParseError("a regular expression can't be an object's value")
            found.append((key, self.expression()))
            if not self.at_symbol(","):
                break
            self.advance(True)
        self.advance(False, "}")
        return found

    def function(self) -> Node:
        self.advance(True, "(")
        names = []
        while not self.at_symbol(")"):
            if self.token[0] != "variable":
                raise ParseError("a function's parameters are variables")
            names.append(self.token[1])
            self.advance(True)
            if not self.at_symbol(","):
                break
            self.advance(True)
        self.advance(True, ")")
        if self.at_symbol("<"):  # a signature; nested in pairs
            depth = 0
            while True:
                depth += self.at_symbol("<") - self.at_symbol(">")
                if self.token[0] == "end":
                    self.unexpected(">")
                self.advance(True)
                if not depth:
                    break
        self.advance(True, "{")
        body = self.expression()
        self.advance(False, "}")
        return Node("function", names=names, body=body)

    # what follows one

    def after(self, left: Node, op: str) -> Node:
        if op == ".":
            self.advance(True)
            right = self.expression(BINDING["."])
            steps = self.steps(left)
            for step in right.steps if right.kind == "path" and not right.group else [right]:
                if step.kind == "literal":
                    if type(step.value) is not str:
                        raise ParseError(f"{step.value!r} can't be a step of a path")
                    step = Node("name", name=step.value, stages=step.stages, keep=step.keep)
                steps.append(step)
            path = Node("path", steps=steps)
            path.keep = any(s.keep for s in steps) or left.keep or right.keep
            return path
        if op == "[":
            self.advance(True)
            if self.at_symbol("]"):
                self.advance(False)
                (left.steps[-1] if left.kind == "path" else left).keep = True
                left.keep = True
                return left
            stage = self.expression()
            self.advance(False, "]")
            if left.group:
                raise ParseError("a filter can't follow a group-by")
            (left.steps[-1] if left.kind == "path" else left).stages.append(stage)
            return left
        if op == "{":
            if left.group:
                raise ParseError("only one group-by may follow a step")
            left.group = self.pairs()
            return left
        if op == "(":
            return self.call(left)
        if op == "^":
            self.advance(True)
            self.advance(True, "(")
            terms = []
            while True:
                down = self.at_symbol(">")
                if self.at_symbol("<", ">"):
                    self.advance(True)
                terms.append((self.expression(), down))
                if not self.at_symbol(","):
                    break
                self.advance(True)
            self.advance(False, ")")
            return Node("path", steps=[*self.steps(left), Node("sort", terms=terms)], keep=left.keep)
        if op in ("@", "#"):
            self.advance(True)
            if self.token[0] != "variable":
                raise ParseError(f"{op} needs a variable")
            path = left if left.kind == "path" else Node("path", steps=[left])
            step = path.steps[-1]
            if op == "@":
                if step.stages or step.kind == "sort":
                    raise ParseError("@ can't follow a filter or a sort")
                step.focus = self.token[1]
            elif step.stages or step.kind == "sort":
                step.stages.append(Node("position", name=self.token[1]))
            else:
                step.index = self.token[1]
            self.advance(False)
            return path
        if op == "?":
            self.advance(True)
            then, other = self.expression(), None
            if self.at_symbol(":"):
                self.advance(True)
                other = self.expression()
            return Node("condition", test=left, then=then, other=other)
        if op == ":=":
            if left.kind != "variable":
                raise ParseError("only a variable can be assigned to")
            self.advance(True)
            return Node("assign", name=left.name, value=self.expression(BINDING[":="] - 1))
        if op == "..":
            raise ParseError("a range stands between brackets")
        self.advance(True)
        right = self.expression(BINDING[op])
        return Node({"~>": "apply", "?:": "elvis", "??": "coalesce"}.get(op, "binary"), op=op, left=left, right=right)

    @staticmethod
    def steps(left: Node) -> list[Node]:
        if left.kind == "path" and not left.group:
            return left.steps
        if left.kind == "literal" and type(left.value) is str:
            return [Node("name", name=left.value, stages=left.stages, keep=left.keep)]
        if left.kind == "literal":
            raise ParseError(f"{left.value!r} can't be a step of a path")
        return [left]

    def call(self, left: Node) -> Node:
        self.advance(True)
        args = []
        while not self.at_symbol(")"):
            if self.at_symbol("?"):
                self.advance(True)
                args.append(None)
            else:
                args.append(self.expression())
            if not self.at_symbol(","):
                break
            self.advance(True)
        self.advance(False, ")")
        if left.kind == "path" and len(left.steps) == 1 and left.steps[0].kind == "name":
            left = Node("unknown_function", name=left.steps[0].name)
        return Node("partial" if None in args else "call", function=left, args=args)


def parse(source: str) -> Node:
    """The expression's tree. Raises ParseError."""
    try:
        parser = _Parser(source)
        tree = parser.expression()
        if parser.token[0] != "end":
            parser.unexpected()
    except RecursionError:
        raise ParseError("nested too deeply") from None
    return tree
