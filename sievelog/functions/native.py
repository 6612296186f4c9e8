"""The native tier: expressions as columns, where they are surely equal to the interpreter's result.

An expression compiles to (answerable, kind, value) columns over a parsed VARIANT. A row is ``answerable`` if every path
met only objects on its way and a scalar (or nothing) at its end, so no array is mapped over and nothing nested is
compared; other rows, and everything that isn't strict JSON, are left to the interpreter. Supported: literals, field
paths, $vars, = != < <= > >= and or, in with a constant array, conditionals, ??, and projections that are an object
constructor of such values or one such value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parser import Node, parse
from .values import UNDEF, json_string, parse_json

class Unsupported(Exception):
    pass


@dataclass
class Value:
    """kind: a string column of b, n, s, z (null) or u (absent); one typed column each. ok: whether the row is answerable."""

    ok: Column
    kind: Column
    boolean: Column
    number: Column
    string: Column


def _constant(x) -> Value:
    kind = "u" if x is UNDEF else "z" if x is None else {bool: "b", float: "n", str: "s"}.get(type(x))
    if kind is None:
        raise Unsupported
    none = F.lit(None)
    return Value(F.lit(True), F.lit(kind), (F.lit(x) if kind == "b" else none).cast("boolean"), (F.lit(x) if kind == "n" else none).cast("double"), (F.lit(x) if kind == "s" else none).cast("string"))


def _boolean(ok: Column, x: Column) -> Value:
    return Value(ok, F.lit("b"), x, F.lit(None).cast("double"), F.lit(None).cast("string"))


class Native:
    def __init__(self, document: Column, variables):
        self.document, self.variables, self.found = document, variables, {}

    def compile(self, node: Node) -> Value:
        if node.stages or node.group or node.keep:
            raise Unsupported
        if (made := getattr(self, f"_{node.kind}", None)) is None:
            raise Unsupported
        return made(node)

    def _literal(self, node):
        return _constant(node.value)

    def _names(self, node) -> list[str]:
        names = []
        for s in node.steps:
            if s.kind != "name" or s.stages or s.group or s.keep or s.focus or s.index or not s.name or "'" in s.name or "\\" in s.name:
                raise Unsupported
            names.append(s.name)
        return names

    def _constant_of(self, node):
        """What a constant expression is: a literal, an array of such, or a path into $vars."""
        if node.stages or node.group or node.keep:
            raise Unsupported
        if node.kind == "literal":
            return node.value
        if node.kind == "array":
            return [self._constant_of(i) for i in node.items]
        if node.kind == "path" and node.steps[0].kind == "variable" and node.steps[0].name == "vars" and not node.steps[0].stages:
            at = self.variables
            for name in self._names(Node("path", steps=node.steps[1:])):
                if isinstance(at, list):
                    raise Unsupported
                at = at.get(name, UNDEF) if type(at) is dict else UNDEF
            return at
        raise Unsupported

    def _path(self, node):
        if node.keep:
            raise Unsupported
        if node.steps[0].kind == "variable":
            return _constant(self._constant_of(node))
        names = tuple(self._names(node))
        at = self.found.setdefault(names, f"_found.p{len(self.found)}")
        part = lambda x: F.col(f"{at}.{x}")
        return Value(part("ok"), part("kind"), part("boolean"), part("number"), part("string"))

    def extracted(self) -> Column:
        """A struct of what each path that the expressions name finds; each is read once a row."""

        def one(names: tuple[str, ...]) -> Column:
            get = lambda n, kind="variant": F.try_variant_get(self.document, "$" + "".join(f"['{x}']" for x in names[:n]), kind)
            ok = F.lit(True)
            for n in range(1, len(names)):
                # an array on the way would be mapped over
                ok = ok & ~F.coalesce(F.schema_of_variant(get(n)).startswith("ARRAY"), F.lit(False))
            end = get(len(names))
            shape = F.schema_of_variant(end)
            kind = F.when(end.isNull(), "u").when(shape == "STRING", "s").when(shape.rlike("^(BIGINT|DOUBLE|DECIMAL)"), "n").when(shape == "BOOLEAN", "b").when(shape == "VOID", "z").otherwise("?")
            return F.struct((ok & (kind != "?")).alias("ok"), kind.alias("kind"), get(len(names), "boolean").alias("boolean"), get(len(names), "double").alias("number"), get(len(names), "string").alias("string"))

        return F.struct(F.lit(0).alias("none"), *[one(names).alias(at.partition(".")[2]) for names, at in self.found.items()])

    def _block(self, node):
        if len(node.parts) != 1:
            raise Unsupported
        return self.compile(node.parts[0])

    @staticmethod
    def truth(x: Value) -> Column:
        return F.coalesce(F.when(x.kind == "b", x.boolean).when(x.kind == "n", x.number != 0).when(x.kind == "s", x.string != ""), F.lit(False))

    def _binary(self, node):
        op = node.op
        if op in ("and", "or"):
            a, b = self.compile(node.left), self.compile(node.right)
            x, y = self.truth(a), self.truth(b)
            return _boolean(a.ok & b.ok, x & y if op == "and" else x | y)
        if op == "in":
            a, items = self.compile(node.left), self._constant_of(node.right)
            if not isinstance(items, list) or any(type(i) not in (str, float, bool) for i in items):
                raise Unsupported
            hit = F.lit(False)
            for kind, tag, column in ((str, "s", a.string), (float, "n", a.number), (bool, "b", a.boolean)):
                if own := [i for i in items if type(i) is kind]:
                    hit = hit | F.coalesce((a.kind == tag) & column.isin(*own), F.lit(False))
            return _boolean(a.ok, hit)
        a, b = self.compile(node.left), self.compile(node.right)
        both = lambda tag: (a.kind == tag) & (b.kind == tag)
        if op in ("=", "!="):
            same = F.coalesce((both("b") & (a.boolean == b.boolean)) | (both("n") & (a.number == b.number)) | (both("s") & (a.string == b.string)) | both("z"), F.lit(False))
            present = (a.kind != "u") & (b.kind != "u")
            return _boolean(a.ok & b.ok, present & same if op == "=" else present & ~same)
        if op in ("<", "<=", ">", ">="):
            compare = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
            # anything but two numbers or two ASCII strings is an absent value, an error, or ordered otherwise
            ascii_ = F.coalesce(~a.string.rlike("[^\\x00-\\x7f]") & ~b.string.rlike("[^\\x00-\\x7f]"), F.lit(False))
            return _boolean(a.ok & b.ok & (both("n") | (both("s") & ascii_)), F.when(both("n"), compare(a.number, b.number)).otherwise(compare(a.string, b.string)))
        raise Unsupported

    def _choice(self, test: Column, ok: Column, a: Value, b: Value) -> Value:
        pick = lambda x, y: F.when(test, x).otherwise(y)
        return Value(ok & pick(a.ok, b.ok), pick(a.kind, b.kind), pick(a.boolean, b.boolean), pick(a.number, b.number), pick(a.string, b.string))

    def _condition(self, node):
        test = self.compile(node.test)
        other = self.compile(node.other) if node.other is not None else _constant(UNDEF)
        return self._choice(self.truth(test), test.ok, self.compile(node.then), other)

    def _coalesce(self, node):
        a = self.compile(node.left)
        return self._choice(a.kind != "u", a.ok, a, self.compile(node.right))

    def _call(self, node):
        f = node.function
        if f.kind == "variable" and f.name in ("not", "boolean", "exists") and len(node.args) == 1 and not f.stages:
            a = self.compile(node.args[0])
            if f.name == "exists":
                return _boolean(a.ok, a.kind != "u")
            # of an absent value these are absent
            return _boolean(a.ok & (a.kind != "u"), self.truth(a) if f.name == "boolean" else ~self.truth(a))
        raise Unsupported


def _json_of(x: Value) -> tuple[Column, Column]:
    """(answerable, JSON text or NULL if absent). Numbers whose shortest text Spark writes alike: up to 15 digits, no exponent."""
    from ..operators.render import json_string as quoted

    whole = F.coalesce((x.number == F.floor(x.number)) & (F.abs(x.number) < 1e15), F.lit(False))
    text = F.when(whole, F.floor(x.number).cast("string")).otherwise(x.number.cast("string"))
    plain = F.coalesce(whole | ((F.abs(x.number) >= 1e-3) & (F.abs(x.number) < 1e7)), F.lit(False))
    out = F.when(x.kind == "n", text).when(x.kind == "b", x.boolean.cast("string")).when(x.kind == "z", "null").when(x.kind == "s", quoted(x.string))
    return x.ok & ((x.kind != "n") | plain), out


def native_action(plan, embeds_json: bool, log: DataFrame) -> tuple[DataFrame, Column, Column] | None:
    """(log with what the expressions read of it, proven, action struct), or None if a part of the plan isn't supported."""
    if not plan.has_expressions:
        return None
    value, text = F.col("value"), F.col("value").cast("string")
    document = F.col("_document")
    try:
        native = Native(document, UNDEF if plan.variables is None else parse_json(plan.variables))
        drops, tombstones = [native.compile(parse(s)) for s in plan.drops], [native.compile(parse(s)) for s in plan.tombstones]
        projection = _projection(native, parse(plan.projection)) if plan.projection is not None else None
    except Unsupported:
        return None
    # one strict JSON object: the parser alone would accept text after it, which brackets around it make an error
    whole = F.when(F.is_valid_utf8(text), F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    one = F.coalesce(text.rlike(r"^[ \t\r\n]*\{") & text.rlike(r"\}[ \t\r\n]*$") & F.try_variant_get(whole, "$[1]", "variant").isNull(), F.lit(False))
    log = _once(log, "_document", F.when(one, F.try_variant_get(whole, "$[0]", "variant")))
    log = _once(log, "_found", native.extracted())
    strict = document.isNotNull()
    if embeds_json and projection is None:
        return None
    ok = strict
    for p in [*drops, *tombstones]:
        # a predicate that isn't a Boolean is an error, and its text the interpreter's
        ok = ok & p.ok & (p.kind == "b")
    none = F.lit(None)

    def act(name: str, payload: Column, length: Column) -> Column:
        return F.struct(F.lit(name).alias("action"), payload.cast("binary").alias("payload"), length.cast("long").alias("payload_length"), none.cast("string").alias("issue"), none.cast("string").alias("error"))

    if projection is None:
        out = act("pass", value, F.octet_length(value))
    else:
        ok = ok & projection[0]
        out = act("project", projection[1], F.octet_length(projection[1]))
    for found, name in ((tombstones, "drop" if plan.drop_tombstones else "tombstone"), (drops, "drop")):
        hit = F.lit(False)
        for p in found:
            hit = hit | p.boolean
        if found:
            out = F.when(hit, act(name, none, none)).otherwise(out)
    source = act("drop" if plan.drop_tombstones else "tombstone", none, none)
    proven = value.isNull() | F.coalesce(ok, F.lit(False))
    return log, proven, F.when(value.isNull(), source).otherwise(out)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later expressions read and Spark doesn't compute again in each of them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _projection(native: Native, tree: Node) -> tuple[Column, Column]:
    if tree.kind != "object" or tree.stages or tree.group or tree.keep:
        ok, out = _json_of(native.compile(tree))
        return ok & out.isNotNull(), out
    ok, parts, keys = F.lit(True), [], set()
    for key, x in tree.pairs:
        if key.kind != "literal" or type(key.value) is not str or key.stages or key.value in keys:
            raise Unsupported
        keys.add(key.value)
        fine, out = _json_of(native.compile(x))
        ok = ok & fine
        parts.append(F.concat(F.lit(f"{json_string(key.value)}:"), out))  # NULL, and left out, if absent
    return ok, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
