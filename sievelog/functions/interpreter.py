"""Syntax trees to Python closures, each called with the current value and the scope."""

from __future__ import annotations

import copy
import math
import time
from contextvars import ContextVar
from functools import cmp_to_key

from .parser import Node, parse
from .values import UNDEF, Constructed, ExpressionError, Seq, collapse, equal, is_number, kind_of, truth

UP = "\0up"  # in a scope: (value, scope) of what the current value was reached from
MOST_RANGE = 10_000_000
#: Milliseconds at which the evaluation under way began.
CLOCK: ContextVar[int | None] = ContextVar("clock", default=None)


class Scope:
    __slots__ = ("names", "outer")

    def __init__(self, names: dict, outer: Scope | None):
        self.names, self.outer = names, outer

    def get(self, name: str):
        scope = self
        while scope is not None:
            if name in scope.names:
                return scope.names[name]
            scope = scope.outer
        return UNDEF


class Function:
    """Called with a list of arguments and the current value."""

    arity = 0

    def __call__(self, args: list, value=UNDEF):
        raise NotImplementedError


class Lambda(Function):
    def __init__(self, names: list[str], body, scope: Scope, value):
        self.names, self.body, self.scope, self.value, self.arity = names, body, scope, value, len(names)

    def __call__(self, args: list, value=UNDEF):
        given = {n: args[i] if i < len(args) else UNDEF for i, n in enumerate(self.names)}
        return self.body(self.value, Scope(given, self.scope))


class Builtin(Function):
    """``context``: the current value stands in for a first argument that is left out; for a last one, if it is "last"."""

    def __init__(self, name: str, call, least: int, most: int, context: bool | str):
        self.name, self.call, self.least, self.most, self.context, self.arity = name, call, least, most, context, most

    def __call__(self, args: list, value=UNDEF):
        if self.context == "last" and len(args) == self.most - 1:
            args = [*args, value]
        elif self.context and len(args) < self.least:
            args = [value, *args]
        if not self.least <= len(args) <= self.most:
            raise ExpressionError(f"${self.name}: {len(args)} arguments")
        return self.call(*args)


class Partial(Function):
    def __init__(self, function: Function, args: list):
        self.function, self.args, self.arity = function, args, sum(a is None for a in args)

    def __call__(self, args: list, value=UNDEF):
        given = iter(args)
        return self.function([next(given, UNDEF) if a is None else a() for a in self.args], value)


class Wrapped(Function):
    """A Python callable of one argument."""

    def __init__(self, call):
        self.call, self.arity = call, 1

    def __call__(self, args: list, value=UNDEF):
        return self.call(args[0] if args else UNDEF)


class Regex(Function):
    def __init__(self, pattern):
        self.pattern, self.arity = pattern, 1

    def __call__(self, args: list, value=UNDEF):
        if not args or type(args[0]) is not str:
            return UNDEF
        found = self.pattern.search(args[0])
        return {"match": found[0], "start": float(found.start()), "end": float(found.end()), "groups": [g or "" for g in found.groups()]} if found else UNDEF


def call_with(function, *args):
    """A call with as many of ``args`` as the function takes."""
    if not isinstance(function, Function):
        raise ExpressionError("not a function")
    return function(list(args[: function.arity] if isinstance(function, (Lambda, Partial)) else args[: max(1, function.arity)]))


def items_of(x) -> list:
    return [] if x is UNDEF else x if isinstance(x, list) else [x]


class Compiler:
    def __init__(self, tree: Node):
        self.parents = _mentions(tree, "parent")

    def compile(self, node: Node):
        base = getattr(self, f"_{node.kind}")(node)
        if node.kind == "path":
            return base
        run = base
        if node.stages:
            filters = [self.stage(s) for s in node.stages]

            def run(value, scope, base=base):
                out = base(value, scope)
                for f in filters:
                    if out is UNDEF:
                        return out
                    out = f(out, scope)
                return collapse(out)

        if node.group:
            grouped, inner = self.grouping(node.group), run

            def run(value, scope):
                return grouped(inner(value, scope), scope)

        if node.keep:
            single = run

            def run(value, scope):
                out = single(value, scope)
                return out if out is UNDEF or isinstance(out, list) and type(out) is not Seq else Seq(items_of(out), True)

        return run

    # values

    def _literal(self, node):
        value = node.value
        return lambda v, s: value

    def _variable(self, node):
        name = node.name
        if name == "":
            return lambda v, s: v
        if name == "$":
            return lambda v, s: s.get("$")
        return lambda v, s: s.get(name)

    def _regex(self, node):
        found = Regex(node.pattern)
        return lambda v, s: found

    def _name(self, node):
        name = node.name

        def read(v, s):
            if type(v) is dict:
                return v.get(name, UNDEF)
            if isinstance(v, list):
                out = Seq()
                for i in v:
                    x = read(i, s)
                    if x is not UNDEF:
                        out.extend(x) if isinstance(x, list) else out.append(x)
                return collapse(out)
            return UNDEF

        return read

    def _wildcard(self, node):
        def read(v, s):
            out = Seq()
            for x in v.values() if type(v) is dict else items_of(v) if isinstance(v, list) else []:
                out.extend(_flat(x)) if isinstance(x, list) else out.append(x)
            return collapse(out)

        return read

    def _descendants(self, node):
        def walk(x, out):
            if isinstance(x, list):
                for i in x:
                    walk(i, out)
            else:
                out.append(x)
                if type(x) is dict:
                    for i in x.values():
                        walk(i, out)

        def read(v, s):
            out = Seq()
            if v is not UNDEF:
                walk(v, out)
            return collapse(out)

        return read

    def _parent(self, node):
        def read(v, s):
            up = s.get(UP)
            return up[0] if up is not UNDEF else UNDEF

        return read

    def _negative(self, node):
        inner = self.compile(node.inner)

        def run(v, s):
            x = inner(v, s)
            if x is UNDEF:
                return x
            if not is_number(x):
                raise ExpressionError("cannot negate a non-numeric value")
            return -x

        return run

    def _array(self, node):
        parts = [(self.compile(i), i.kind == "array") for i in node.items]

        def run(v, s):
            out = []
            for part, whole in parts:
                x = part(v, s)
                if x is UNDEF:
                    continue
                if isinstance(x, list) and not whole:
                    out.extend(x)
                else:
                    out.append(x)
            return out

        return run

    def _range(self, node):
        low, high = self.compile(node.low), self.compile(node.high)

        def run(v, s):
            a, b = low(v, s), high(v, s)
            for x in (a, b):
                if x is not UNDEF and not (is_number(x) and x == int(x)):
                    raise ExpressionError("the ends of a range must be integers")
            if a is UNDEF or b is UNDEF or a > b:
                return UNDEF
            if b - a >= MOST_RANGE:
                raise ExpressionError("range too large")
            return Seq(map(float, range(int(a), int(b) + 1)), True)

        return run

    def _object(self, node):
        grouped = self.grouping(node.pairs)
        return lambda v, s: grouped(v, s)

    def grouping(self, pairs):
        compiled = [(self.compile(k), self.compile(x)) for k, x in pairs]

        def run(v, s, tuples=None):
            groups: dict = {}
            for item, scope in tuples if tuples is not None else [(i, s) for i in (v if isinstance(v, list) and v else [UNDEF if isinstance(v, list) else v])]:
                for n, (key, _) in enumerate(compiled):
                    k = key(item, scope)
                    if k is UNDEF:
                        continue
                    if type(k) is not str:
                        raise ExpressionError("an object's key must be a string")
                    if k in groups:
                        if groups[k][0] != n:
                            raise ExpressionError(f"several pairs give the key {k!r}")
                        groups[k][1].append(item)
                    else:
                        groups[k] = (n, [item], scope)
            out = {}
            for k, (n, items, scope) in groups.items():
                items = [i for i in items if i is not UNDEF]
                x = compiled[n][1](items[0] if len(items) == 1 else items if items else UNDEF, scope)
                if x is not UNDEF:
                    out[k] = x
            return out

        return run

    def _block(self, node):
        parts = [self.compile(p) for p in node.parts]

        def run(v, s):
            inner, out = Scope({}, s), UNDEF
            for part in parts:
                out = part(v, inner)
            return out

        return run

    def _assign(self, node):
        name, value = node.name, self.compile(node.value)

        def run(v, s):
            out = s.names[name] = value(v, s)
            return out

        return run

    def _function(self, node):
        names, body = node.names, self.compile(node.body)
        return lambda v, s: Lambda(names, body, s, v)

    def _condition(self, node):
        test, then = self.compile(node.test), self.compile(node.then)
        other = self.compile(node.other) if node.other is not None else lambda v, s: UNDEF
        return lambda v, s: then(v, s) if truth(test(v, s)) else other(v, s)

    def _elvis(self, node):
        left, right = self.compile(node.left), self.compile(node.right)

        def run(v, s):
            x = left(v, s)
            return x if truth(x) else right(v, s)

        return run

    def _coalesce(self, node):
        left, right = self.compile(node.left), self.compile(node.right)

        def run(v, s):
            x = left(v, s)
            return right(v, s) if x is UNDEF else x

        return run

    def _binary(self, node):
        left, right, op = self.compile(node.left), self.compile(node.right), node.op
        if op == "and":
            return lambda v, s: truth(left(v, s)) and truth(right(v, s))
        if op == "or":
            return lambda v, s: truth(left(v, s)) or truth(right(v, s))
        act = OPERATORS[op]
        return lambda v, s: act(left(v, s), right(v, s))

    # functions

    def _unknown_function(self, node):
        def run(v, s):
            raise ExpressionError(f"attempted to invoke a non-function: did you mean ${node.name}?")

        return run

    def _call(self, node):
        function, args = self.compile(node.function), [self.compile(a) for a in node.args]
        name = getattr(node.function, "name", None)

        def run(v, s, first=None):
            f = function(v, s)
            if not isinstance(f, Function):
                raise ExpressionError(f"attempted to invoke a non-function{f': ${name}' if name else ''}")
            given = [a(v, s) for a in args]
            return collapse(f(given if first is None else [first[0], *given], v))

        return run

    def _partial(self, node):
        function, args = self.compile(node.function), [a and self.compile(a) for a in node.args]

        def run(v, s):
            f = function(v, s)
            if not isinstance(f, Function):
                raise ExpressionError("attempted to partially apply a non-function")
            return Partial(f, [a and (lambda x=a(v, s): x) for a in args])

        return run

    def _apply(self, node):
        left = self.compile(node.left)
        if node.right.kind == "call" and not node.right.stages:
            right = self._call(node.right)
            return lambda v, s: right(v, s, (left(v, s),))
        right = self.compile(node.right)

        def run(v, s):
            x, f = left(v, s), right(v, s)
            if not isinstance(f, Function):
                raise ExpressionError("the right side of ~> must be a function")
            if isinstance(x, Function):
                return Wrapped(lambda y: f([x([y])]))
            return collapse(f([x], v))

        return run

    def _transform(self, node):
        pattern, update, delete = self.compile(node.pattern), self.compile(node.update), node.delete and self.compile(node.delete)

        def run(v, s):
            def change(x):
                if x is UNDEF:
                    return x
                if not isinstance(x, (dict, list)):
                    raise ExpressionError("a transform takes an object or array")
                x = copy.deepcopy(x)
                for match in items_of(pattern(x, s)):
                    new = update(match, s)
                    if new is not UNDEF:
                        if type(new) is not dict:
                            raise ExpressionError("a transform's update must be an object")
                        match.update(new)
                    if delete is not None and (gone := delete(match, s)) is not UNDEF:
                        for k in items_of(gone):
                            if type(k) is not str:
                                raise ExpressionError("a transform's deletions must be strings")
                            if type(match) is dict:
                                match.pop(k, None)
                return x

            return Wrapped(change)

        return run

    # paths

    def stage(self, node):
        """A filter of an array or a single value."""
        if node.kind == "literal" and is_number(node.value):
            at = math.floor(node.value)

            def pick(x, s):
                items = x if isinstance(x, list) else [x]
                i = at + len(items) if at < 0 else at
                if not 0 <= i < len(items):
                    return UNDEF
                return Seq(items[i]) if isinstance(items[i], list) else Seq([items[i]])

            return pick
        test = self.compile(node)

        def run(x, s):
            items = x if isinstance(x, list) else [x]
            return Seq([item for i, item in enumerate(items) if _kept(test(item, s), i, len(items))])

        return run

    def step(self, node):
        """One step of a path without its stages: a closure of one item."""
        stages, node.stages = node.stages, []
        try:
            if node.kind == "array":
                make = self._array(node)
                return lambda v, s: Constructed(make(v, s))
            return self.compile(node)
        finally:
            node.stages = stages

    def _sort(self, node):
        raise AssertionError

    def sorter(self, node):
        terms = [(self.compile(t), down) for t, down in node.terms]

        def compare(a, b):
            for term, down in terms:
                x, y = term(*a), term(*b)
                if x is UNDEF or y is UNDEF:
                    if x is not y:
                        return 1 if x is UNDEF else -1
                    continue
                if type(x) is not type(y) or type(x) not in (float, str):
                    raise ExpressionError("sort keys must be all numbers or all strings")
                if x != y:
                    return 1 if (x > y) != down else -1
            return 0

        return lambda items: sorted(items, key=cmp_to_key(compare))

    def _path(self, node):
        steps = node.steps
        if self.parents or any(s.focus or s.index or any(x.kind == "position" for x in s.stages) for s in steps):
            return self.tracked(node)
        keep = node.keep or any(s.keep for s in steps)
        grouped = self.grouping(node.group) if node.group else None
        if len(steps) == 1 and steps[0].kind == "name" and not steps[0].stages and not keep and not grouped:
            return self._name(steps[0])
        compiled = []
        for s in steps:
            kept, s.keep = s.keep, False
            compiled.append((s.kind, self.sorter(s) if s.kind == "sort" else self.step(s), [self.stage(x) for x in s.stages]))
            s.keep = kept
        first_is_variable = steps[0].kind == "variable"
        last = len(compiled) - 1

        def run(v, s):
            items = v if isinstance(v, list) and not first_is_variable else [v]
            for n, (kind, step, stages) in enumerate(compiled):
                if kind == "sort":
                    items = [i for i, _ in step([(i, s) for i in items])]
                    for f in stages:
                        items = f(items, s)
                        if items is UNDEF:
                            return UNDEF
                    continue
                if n == 0 and kind == "array":
                    found = step(v, s)
                    for f in stages:
                        found = f(found, s)
                        if found is UNDEF:
                            return UNDEF
                    items = Seq(found)
                    if last == 0:
                        items = list(found)
                    continue
                results = []
                for item in items:
                    x = step(item, s)
                    for f in stages:
                        if x is UNDEF:
                            break
                        x = f(x, s)
                    x = collapse(x)
                    if x is not UNDEF:
                        results.append(x)
                if n == last and len(results) == 1 and isinstance(results[0], list) and type(results[0]) is not Seq:
                    items = results[0]
                else:
                    items = Seq()
                    for x in results:
                        items.extend(x) if isinstance(x, list) and type(x) is not Constructed else items.append(x)
                if not items and n < last:
                    return UNDEF
            if keep:
                items = Seq(items, True)
            elif type(items) is not Seq and isinstance(items, list) and compiled[-1][0] == "sort":
                items = Seq(items)
            if grouped:
                return grouped(items, s) if items else UNDEF
            return collapse(items)

        return run

    def tracked(self, node):
        """A path whose items carry scopes: bound variables, and what each was reached from."""
        compiled = [(s, self.sorter(s) if s.kind == "sort" else None if s.kind == "parent" else self.step(s), [(None, x.name) if x.kind == "position" else (self.compile(x), None) for x in s.stages]) for s in node.steps]
        keep, grouped = node.keep or any(s.keep for s in node.steps), self.grouping(node.group) if node.group else None
        first_is_variable = node.steps[0].kind in ("variable", "parent")

        def run(v, s):
            items = [(i, s) for i in v] if isinstance(v, list) and not first_is_variable else [(v, s)]
            whole = None
            for step, act, stages in compiled:
                whole = None
                if step.kind == "sort":
                    found = act(items)
                else:
                    found = []
                    for value, scope in items:
                        if step.kind == "parent":
                            up = scope.get(UP)
                            if up is not UNDEF:
                                found.append(up)
                            continue
                        x = act(value, scope)
                        if isinstance(x, list) and type(x) not in (Seq, Constructed):
                            whole = x
                        for i, item in enumerate([x] if type(x) is Constructed else items_of(x)):
                            names = {UP: (value, scope)}
                            if step.index:
                                names[step.index] = float(i)
                            if step.focus:
                                names[step.focus] = item
                            found.append((value if step.focus else item, Scope(names, scope)))
                for test, name in stages:
                    if name is not None:
                        found = [(x, Scope({name: float(i)}, scope)) for i, (x, scope) in enumerate(found)]
                    else:
                        found = [f for i, f in enumerate(found) if _kept(test(*f), i, len(found))]
                items = found
                if not items:
                    return UNDEF
            if grouped:
                return grouped(None, s, items)
            out = [x for x, _ in items]
            if whole is not None and len(out) == len(whole) == 1 and not keep:
                return out
            return collapse(Seq(out, keep))

        return run


def _kept(answer, i: int, n: int) -> bool:
    """Whether a filter's answer keeps the item at ``i`` of ``n``: numbers are places, other answers are Booleans."""
    numbers = answer if isinstance(answer, list) and answer and all(map(is_number, answer)) else [answer] if is_number(answer) else None
    if numbers is not None:
        return any(math.floor(x) + (n if x < 0 else 0) == i for x in numbers)
    return truth(answer)


def _flat(x) -> list:
    out = []
    for i in x:
        out.extend(_flat(i)) if isinstance(i, list) else out.append(i)
    return out


def _mentions(x, kind: str) -> bool:
    if isinstance(x, Node):
        return x.kind == kind or any(_mentions(v, kind) for v in x.__dict__.values())
    return isinstance(x, (list, tuple)) and any(_mentions(i, kind) for i in x)


def _numeric(act):
    def run(a, b):
        for x in (a, b):
            if x is not UNDEF and not is_number(x):
                raise ExpressionError("an arithmetic operand must be a number")
        if a is UNDEF or b is UNDEF:
            return UNDEF
        try:
            out = act(a, b)
        except (ZeroDivisionError, OverflowError, ValueError):
            out = math.inf
        if not math.isfinite(out):
            raise ExpressionError("number out of range")
        return out

    return run


def _ordering(act):
    def run(a, b):
        for x in (a, b):
            if x is not UNDEF and type(x) not in (float, str):
                raise ExpressionError("only numbers or strings can be ordered")
        if a is UNDEF or b is UNDEF:
            return UNDEF
        if type(a) is not type(b):
            raise ExpressionError("a number and a string can't be ordered")
        return act(a, b)

    return run


def _concatenated(a, b):
    from .library import to_string

    return ("" if a is UNDEF else to_string(a)) + ("" if b is UNDEF else to_string(b))


OPERATORS = {
    "+": _numeric(lambda a, b: a + b), "-": _numeric(lambda a, b: a - b), "*": _numeric(lambda a, b: a * b), "/": _numeric(lambda a, b: a / b), "%": _numeric(math.fmod),
    "<": _ordering(lambda a, b: a < b), "<=": _ordering(lambda a, b: a <= b), ">": _ordering(lambda a, b: a > b), ">=": _ordering(lambda a, b: a >= b),
    "=": lambda a, b: a is not UNDEF and b is not UNDEF and equal(a, b), "!=": lambda a, b: a is not UNDEF and b is not UNDEF and not equal(a, b),
    "in": lambda a, b: a is not UNDEF and b is not UNDEF and any(equal(a, x) for x in items_of(b)), "&": _concatenated,
}


class Expression:
    """A compiled expression. ``parse`` errors are raised here."""

    def __init__(self, source: str):
        self.source, tree = source, parse(source)
        self.tree, self.run = tree, Compiler(tree).compile(tree)

    def evaluate(self, document, variables=UNDEF):
        """The result for one document; each evaluation has a scope of its own."""
        from .library import library

        value = Seq([document], True) if isinstance(document, list) else document
        names = {"$": document}
        if variables is not UNDEF:
            names["vars"] = variables
        # the time is that of the outermost evaluation, whatever it calls
        began = CLOCK.set(time.time_ns() // 1_000_000) if CLOCK.get() is None else None
        try:
            return collapse(self.run(document if not isinstance(document, list) else value[0], Scope(names, Scope(library(), None))))
        except RecursionError:
            raise ExpressionError("evaluation nested too deeply") from None
        finally:
            if began is not None:
                CLOCK.reset(began)
