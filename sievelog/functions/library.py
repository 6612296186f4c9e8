"""The language's built-in functions."""

from __future__ import annotations

import base64
import math
import random
import re
import urllib.parse
from functools import cache, cmp_to_key

from . import pictures
from .interpreter import CLOCK, Builtin, Function, Regex, call_with, items_of
from .values import UNDEF, ExpressionError, Seq, equal, is_number, json_text, kind_of, number_text, truth

_FUNCTIONS: dict[str, Builtin] = {}


def builtin(name: str, least: int, most: int | None = None, context: bool | str = False, undefined: bool = True):
    """Registers a function. ``undefined``: an absent first argument gives an absent result."""

    def register(call):
        def guarded(*args):
            if undefined and (not args or args[0] is UNDEF):
                return UNDEF
            return call(*args)

        _FUNCTIONS[name] = Builtin(name, guarded if undefined else call, least, least if most is None else most, context)
        return call

    return register


@cache
def library() -> dict[str, Builtin]:
    return _FUNCTIONS


def want(name: str, kind: str, *values) -> None:
    for x in values:
        if x is not UNDEF and kind_of(x) != kind:
            raise ExpressionError(f"${name}: {kind} expected, got {kind_of(x)}")


def to_string(x, pretty: bool = False) -> str:
    if type(x) is str:
        return x
    if isinstance(x, Function):
        return ""
    if is_number(x) and not math.isfinite(x):
        raise ExpressionError("a non-finite number has no text")
    return _pretty(x, 0) if pretty else _text(x)


def _short(x: float) -> str:
    return number_text(float(f"{x:.15g}"))


def _text(x) -> str:
    if is_number(x):
        return _short(x)
    if isinstance(x, list):
        return "[" + ",".join('""' if isinstance(i, Function) else _text(i) for i in x) + "]"
    if type(x) is dict:
        return "{" + ",".join(f"{json_text(k)}:{'""' if isinstance(v, Function) else _text(v)}" for k, v in x.items()) + "}"
    return json_text(x, False)


def _pretty(x, depth: int) -> str:
    pad, end = "  " * (depth + 1), "  " * depth
    if isinstance(x, list) and x:
        return "[\n" + ",\n".join(pad + _pretty(i, depth + 1) for i in x) + f"\n{end}]"
    if type(x) is dict and x:
        return "{\n" + ",\n".join(f"{pad}{json_text(k)}: {_pretty(v, depth + 1)}" for k, v in x.items()) + f"\n{end}}}"
    return _text(x)


# strings


@builtin("string", 1, 2, context=True)
def _string(x, pretty=False):
    return to_string(x, truth(pretty))


@builtin("length", 1, context=True)
def _length(x):
    want("length", "string", x)
    return float(len(x))


@builtin("substring", 2, 3, context=True)
def _substring(x, start, length=UNDEF):
    want("substring", "string", x)
    want("substring", "number", start, length)
    at = int(start) if start >= 0 else max(0, len(x) + int(start))
    if length is UNDEF:
        return x[at:]
    return x[at : at + int(length)] if length > 0 else ""


@builtin("substringBefore", 2, context=True)
def _before(x, mark):
    want("substringBefore", "string", x, mark)
    return x.split(mark, 1)[0] if mark else ""


@builtin("substringAfter", 2, context=True)
def _after(x, mark):
    want("substringAfter", "string", x, mark)
    return x.split(mark, 1)[1] if mark and mark in x else x


@builtin("uppercase", 1, context=True)
def _upper(x):
    want("uppercase", "string", x)
    return x.upper()


@builtin("lowercase", 1, context=True)
def _lower(x):
    want("lowercase", "string", x)
    return x.lower()


@builtin("trim", 1, context=True)
def _trim(x):
    want("trim", "string", x)
    return re.sub(r"[ \t\n\r]+", " ", x).strip(" ")


@builtin("pad", 2, 3, context=True)
def _pad(x, width, fill=UNDEF):
    want("pad", "string", x, fill)
    want("pad", "number", width)
    fill = " " if fill is UNDEF or fill == "" else fill
    missing = abs(int(width)) - len(x)
    if missing <= 0:
        return x
    if missing > 10_000_000:
        raise ExpressionError("$pad: width too large")
    padding = (fill * (missing // len(fill) + 1))[:missing]
    return x + padding if width > 0 else padding + x


@builtin("contains", 2, context=True)
def _contains(x, part):
    want("contains", "string", x)
    if isinstance(part, Function):
        return call_with(part, x) is not UNDEF
    want("contains", "string", part)
    return part in x


@builtin("split", 2, 3, context=True)
def _split(x, mark, limit=UNDEF):
    want("split", "string", x)
    want("split", "number", limit)
    if limit is not UNDEF and limit < 0:
        raise ExpressionError("$split: the limit can't be negative")
    if isinstance(mark, Regex):
        parts, at = [], 0
        for found in mark.pattern.finditer(x):
            parts.append(x[at : found.start()])
            at = found.end()
        parts.append(x[at:])
    else:
        want("split", "string", mark)
        parts = x.split(mark) if mark else list(x)
    return parts if limit is UNDEF else parts[: int(limit)]


@builtin("join", 1, 2, context=False)
def _join(parts, mark=""):
    parts = items_of(parts)
    want("join", "string", mark, *parts)
    return ("" if mark is UNDEF else mark).join(parts)


@builtin("match", 2, 3, context=True)
def _match(x, pattern, limit=UNDEF):
    want("match", "string", x)
    if not isinstance(pattern, Regex):
        raise ExpressionError("$match: a regular expression expected")
    out = Seq()
    for found in pattern.pattern.finditer(x):
        if limit is not UNDEF and len(out) >= limit:
            break
        out.append({"match": found[0], "index": float(found.start()), "groups": [g or "" for g in found.groups()]})
    return out


@builtin("replace", 3, 4, context=True)
def _replace(x, pattern, new, limit=UNDEF):
    want("replace", "string", x)
    want("replace", "number", limit)
    if limit is not UNDEF and limit < 0:
        raise ExpressionError("$replace: the limit can't be negative")
    if not isinstance(new, Function):
        want("replace", "string", new)
    count = None if limit is UNDEF else int(limit)
    if count == 0:
        return x
    if not isinstance(pattern, Regex):
        want("replace", "string", pattern)
        if not pattern:
            raise ExpressionError("$replace: the pattern can't be empty")
        return x.replace(pattern, new, -1 if count is None else count)

    def one(found: re.Match) -> str:
        if isinstance(new, Function):
            out = call_with(new, {"match": found[0], "start": float(found.start()), "end": float(found.end()), "groups": [g or "" for g in found.groups()]})
            want("replace", "string", out)
            return out

        def group(m: re.Match) -> str:
            if m[0] == "$$":
                return "$"
            digits = m[1]
            while digits:  # the longest number that names a group
                if int(digits) <= (found.re.groups or 0):
                    return (found[int(digits)] or "") + m[1][len(digits) :]
                digits = digits[:-1]
            return m[1][1:] if found.re.groups < int(m[1][0]) else ""

        return re.sub(r"\$\$|\$(\d+)", group, new)

    return pattern.pattern.sub(one, x, 0 if count is None else count)


@builtin("eval", 1, 2, context="last")
def _eval(source, document=UNDEF):
    from .interpreter import Expression
    from .values import ParseError

    want("eval", "string", source)
    try:
        return Expression(source).evaluate(document)
    except ParseError as error:
        raise ExpressionError(f"$eval: {error}") from None


@builtin("base64encode", 1, context=True)
def _to64(x):
    want("base64encode", "string", x)
    return base64.b64encode(x.encode()).decode()


@builtin("base64decode", 1, context=True)
def _from64(x):
    want("base64decode", "string", x)
    try:
        return base64.b64decode(x).decode()
    except ValueError:
        raise ExpressionError("$base64decode: not base64 of UTF-8") from None


for _name, _safe in (("encodeUrlComponent", "-_.!~*'()"), ("encodeUrl", "-_.!~*'();/?:@&=+$,#")):

    @builtin(_name, 1, context=True)
    def _encode_url(x, name=_name, safe=_safe):
        want(name, "string", x)
        return urllib.parse.quote(x, safe=safe)

    _FUNCTIONS[_name].most = 1

for _name, _kept in (("decodeUrlComponent", ""), ("decodeUrl", ";/?:@&=+$,#")):

    @builtin(_name, 1, context=True)
    def _decode_url(x, name=_name, kept=_kept):
        want(name, "string", x)
        if re.search("%(?![0-9a-fA-F]{2})", x):
            raise ExpressionError(f"${name}: malformed escape")
        try:
            return re.sub("(?:%[0-9a-fA-F]{2})+", lambda m: "".join(urllib.parse.quote(c, safe="") if c in kept else c for c in urllib.parse.unquote_to_bytes(m[0]).decode()), x)
        except UnicodeDecodeError:
            raise ExpressionError(f"${name}: not UTF-8") from None

    _FUNCTIONS[_name].most = 1

# numbers


@builtin("number", 1, context=True)
def _number(x):
    if is_number(x):
        return x
    if type(x) is bool:
        return float(x)
    if type(x) is str:
        text = x.strip()
        try:
            if re.fullmatch("0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", text):
                return float(int(text, 0))
            if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?", text) and math.isfinite(float(text)):
                return float(text)
        except ValueError:
            pass
    raise ExpressionError(f"$number: can't convert {kind_of(x)}")


def _numeric(name: str, act, context: bool = True):
    @builtin(name, 1, context=context)
    def run(x):
        want(name, "number", x)
        return act(x)


_numeric("abs", abs)
_numeric("floor", lambda x: float(math.floor(x)))
_numeric("ceil", lambda x: float(math.ceil(x)))


@builtin("round", 1, 2, context=True)
def _round(x, places=UNDEF):
    want("round", "number", x, places)
    return float(round(x, 0 if places is UNDEF else int(places)))


@builtin("power", 2, context=True)
def _power(x, y):
    want("power", "number", x, y)
    try:
        out = x**y
    except (OverflowError, ZeroDivisionError):
        out = math.inf
    if type(out) is complex or not math.isfinite(out):
        raise ExpressionError("$power: number out of range")
    return float(out)


@builtin("sqrt", 1, context=True)
def _sqrt(x):
    want("sqrt", "number", x)
    if x < 0:
        raise ExpressionError("$sqrt of a negative number")
    return math.sqrt(x)


@builtin("random", 0, undefined=False)
def _random():
    return random.random()


@builtin("formatNumber", 2, 3, context=True)
def _format_number(x, picture, options=UNDEF):
    want("formatNumber", "number", x)
    want("formatNumber", "string", picture)
    return pictures.format_number(x, picture, {} if options is UNDEF else options)


@builtin("formatBase", 1, 2, context=True)
def _format_base(x, radix=UNDEF):
    want("formatBase", "number", x, radix)
    n, radix = round(x), 10 if radix is UNDEF else round(radix)
    if not 2 <= radix <= 36:
        raise ExpressionError("$formatBase: the radix is 2 to 36")
    digits, rest = "", abs(n)
    while rest:
        rest, d = divmod(rest, radix)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return ("-" if n < 0 else "") + (digits or "0")


@builtin("formatInteger", 2, context=True)
def _format_integer(x, picture):
    want("formatInteger", "number", x)
    want("formatInteger", "string", picture)
    return pictures.format_integer(math.floor(x), picture)


@builtin("parseInteger", 2, context=True)
def _parse_integer(x, picture):
    want("parseInteger", "string", x, picture)
    return float(pictures.parse_integer(x, picture))


# aggregates


def _numbers(name: str, x) -> list[float]:
    found = items_of(x)
    if not all(map(is_number, found)):
        raise ExpressionError(f"${name}: an array of numbers expected")
    return found


@builtin("sum", 1)
def _sum(x):
    total = 0.0
    for i in _numbers("sum", x):
        total += i
    return total


@builtin("max", 1)
def _max(x):
    return max(_numbers("max", x), default=UNDEF)


@builtin("min", 1)
def _min(x):
    return min(_numbers("min", x), default=UNDEF)


@builtin("average", 1)
def _average(x):
    found = _numbers("average", x)
    return sum(found) / len(found) if found else UNDEF


@builtin("count", 1, undefined=False)
def _count(x):
    return float(len(items_of(x)))


# Booleans


@builtin("boolean", 1, context=True)
def _boolean(x):
    return truth(x)


@builtin("not", 1, context=True)
def _not(x):
    return not truth(x)


@builtin("exists", 1, undefined=False)
def _exists(x):
    return x is not UNDEF


# arrays


@builtin("append", 2, undefined=False)
def _append(a, b):
    if a is UNDEF or b is UNDEF:
        return b if a is UNDEF else a
    return [*items_of(a), *items_of(b)]


@builtin("sort", 1, 2)
def _sort(x, after=UNDEF):
    found = items_of(x)
    if after is UNDEF:
        if not (all(map(is_number, found)) or all(type(i) is str for i in found)):
            raise ExpressionError("$sort: an array of numbers or of strings, or a function, expected")
        return sorted(found)
    # ``after(a, b)`` is true if a belongs after b
    return sorted(found, key=cmp_to_key(lambda a, b: 1 if truth(call_with(after, a, b)) else -1 if truth(call_with(after, b, a)) else 0))


@builtin("reverse", 1)
def _reverse(x):
    return items_of(x)[::-1]


@builtin("shuffle", 1)
def _shuffle(x):
    return random.sample(items_of(x), len(items_of(x)))


@builtin("distinct", 1)
def _distinct(x):
    if not isinstance(x, list):
        return x
    out: list = Seq() if type(x) is Seq else []
    for i in x:
        if not any(equal(i, j) for j in out):
            out.append(i)
    return out


@builtin("zip", 1, 99)
def _zip(*arrays):
    if any(a is UNDEF for a in arrays):
        return []
    return [list(row) for row in zip(*map(items_of, arrays), strict=False)]


# objects


@builtin("keys", 1, context=True)
def _keys(x):
    out: dict = {}
    for i in items_of(x):
        if type(i) is dict:
            out.update(dict.fromkeys(i))
    return Seq(out)


@builtin("lookup", 2, context=True)
def _lookup(x, key):
    want("lookup", "string", key)
    if type(x) is dict:
        return x.get(key, UNDEF)
    out = Seq()
    for i in items_of(x) if isinstance(x, list) else []:
        found = _lookup(i, key)
        if found is not UNDEF:
            out.extend(found) if isinstance(found, list) else out.append(found)
    return out


@builtin("spread", 1, context=True)
def _spread(x):
    if type(x) is dict:
        return Seq({k: v} for k, v in x.items())
    if isinstance(x, list):
        return Seq(j for i in x for j in items_of(_spread(i)))
    return x


@builtin("merge", 1, context=False)
def _merge(x):
    want("merge", "object", *items_of(x))
    return {k: v for i in items_of(x) for k, v in i.items()}


@builtin("error", 0, 1, undefined=False)
def _error(message=UNDEF):
    want("error", "string", message)
    raise ExpressionError("$error() function evaluated" if message is UNDEF else message)


@builtin("assert", 1, 2, undefined=False)
def _assert(x, message=UNDEF):
    want("assert", "boolean", x)
    want("assert", "string", message)
    if x is not True:
        raise ExpressionError("$assert() statement failed" if message is UNDEF else message)
    return UNDEF


@builtin("type", 1, context=True)
def _type(x):
    return kind_of(x)


# functions of functions


@builtin("map", 2)
def _map(x, f):
    found, out = items_of(x), Seq()
    for i, item in enumerate(found):
        y = call_with(f, item, float(i), found)
        if y is not UNDEF:
            out.append(y)
    return out


@builtin("filter", 2)
def _filter(x, f):
    found = items_of(x)
    return Seq(item for i, item in enumerate(found) if truth(call_with(f, item, float(i), found)))


@builtin("single", 1, 2)
def _single(x, f=UNDEF):
    found = items_of(x)
    hits = [item for i, item in enumerate(found) if f is UNDEF or truth(call_with(f, item, float(i), found))]
    if len(hits) != 1:
        raise ExpressionError(f"$single: {len(hits)} items match")
    return hits[0]


@builtin("reduce", 2, 3)
def _reduce(x, f, first=UNDEF):
    found = items_of(x)
    if not isinstance(f, Function) or f.arity < 2:
        raise ExpressionError("$reduce: a function of at least two arguments expected")
    at = 0
    if first is UNDEF:
        if not found:
            return UNDEF
        first, at = found[0], 1
    for i in range(at, len(found)):
        first = call_with(f, first, found[i], float(i), found)
    return first


@builtin("sift", 1, 2, context=True, undefined=False)
def _sift(x, f=UNDEF):
    if x is UNDEF:
        return UNDEF
    want("sift", "object", x)
    out = {k: v for k, v in x.items() if truth(call_with(f, v, k, x))}
    return out or UNDEF


_FUNCTIONS["sift"].least = 2


@builtin("each", 2, context=True)
def _each(x, f):
    want("each", "object", x)
    return Seq(y for k, v in x.items() if (y := call_with(f, v, k, x)) is not UNDEF)


# time: one for all calls of an evaluation


@builtin("millis", 0, undefined=False)
def _millis():
    return float(CLOCK.get())


@builtin("now", 0, 2, undefined=False)
def _now(picture=UNDEF, zone=UNDEF):
    return pictures.from_millis(_millis(), picture, zone)


@builtin("fromMillis", 1, 3, context=True)
def _from_millis(x, picture=UNDEF, zone=UNDEF):
    want("fromMillis", "number", x)
    want("fromMillis", "string", picture, zone)
    return pictures.from_millis(x, picture, zone)


@builtin("toMillis", 1, 2, context=True)
def _to_millis(x, picture=UNDEF):
    want("toMillis", "string", x, picture)
    return pictures.to_millis(x, picture)
