"""Values of the expression language, strict JSON text, and number formatting.

JSON null is None, an absent value is UNDEF, numbers are floats. A ``Seq`` is what a path collects: it collapses to its
only item, or to UNDEF when empty, unless it is asked to stay an array.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal


class ExpressionError(Exception):
    """Evaluation failed."""


class ParseError(Exception):
    """The expression isn't one."""


class _Undefined:
    __slots__ = ()

    def __repr__(self) -> str:
        return "UNDEF"

    def __bool__(self) -> bool:
        return False

    def __reduce__(self):
        return "UNDEF"


UNDEF = _Undefined()


class Seq(list):
    __slots__ = ("keep",)

    def __init__(self, items=(), keep: bool = False):
        super().__init__(items)
        self.keep = keep


class Constructed(list):
    """An array made by ``[…]`` as a path step: not flattened into the step's result."""

    __slots__ = ()


def collapse(value):
    if type(value) is Seq:
        if not value:
            return UNDEF
        if len(value) == 1 and not value.keep:
            return value[0]
    return value


def is_number(x) -> bool:
    return type(x) is float


def kind_of(x) -> str:
    if x is UNDEF:
        return "undefined"
    if x is None:
        return "null"
    if type(x) is bool:
        return "boolean"
    if type(x) is float:
        return "number"
    if type(x) is str:
        return "string"
    if isinstance(x, list):
        return "array"
    if type(x) is dict:
        return "object"
    return "function"


def truth(x):
    """Effective Boolean of a value."""
    if x is UNDEF or x is None:
        return False
    if type(x) is bool:
        return x
    if type(x) is float:
        return x != 0
    if isinstance(x, list):
        return any(truth(i) for i in x)
    if type(x) in (str, dict):
        return len(x) > 0
    return False


def equal(a, b) -> bool:
    """Deep and strict in type."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if type(a) is dict and type(b) is dict:
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    if type(a) is not type(b):
        return False
    return a is b if callable(a) else a == b


def number_text(x: float) -> str:
    """The shortest decimal that gives the number back: integers without a point, exponents from 1e21 and below 1e-6."""
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    text = repr(x)
    if "e" in text or abs(x) >= 1e16 or abs(x) < 1e-4:
        size = abs(x)
        if 1e-6 <= size < 1e21:
            return format(Decimal(text), "f").removesuffix(".0")
        digits, _, exponent = (text if "e" in text else f"{x:e}").partition("e")
        power = int(exponent)
        return f"{digits.removesuffix('.0')}e{'+' if power > 0 else '-'}{abs(power)}"
    return text.removesuffix(".0")


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_TABLE = {i: _ESCAPES.get(chr(i), f"\\u{i:04x}") for i in [*range(32), 34, 92]}


def json_string(x: str) -> str:
    return f'"{x.translate(_TABLE)}"'


def json_text(x, check: bool = True) -> str:
    """Compact JSON. With ``check``, values that aren't JSON raise."""
    if x is None:
        return "null"
    kind = type(x)
    if kind is bool:
        return "true" if x else "false"
    if kind is float:
        if not math.isfinite(x):
            raise ExpressionError("non-finite number is not JSON")
        return number_text(x)
    if kind is str:
        return json_string(x)
    if isinstance(x, list):
        return "[" + ",".join([json_text(i, check) for i in x]) + "]"
    if kind is dict:
        return "{" + ",".join([f"{json_string(k)}:{json_text(v, check)}" for k, v in x.items()]) + "}"
    if x is UNDEF:
        raise ExpressionError("undefined is not a JSON value")
    if check:
        raise ExpressionError("a function or regular expression is not a JSON value")
    return '""'


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError("number out of range")
    return x


#: Numbers that may lie beyond doubles. All others are read without a call of ours for each.
_HUGE = re.compile(r"[0-9][eE]\+?[0-9]{3}|[0-9]{300}")
_DECODE = json.JSONDecoder(parse_int=float, parse_constant=_no_constant).decode
_DECODE_HUGE = json.JSONDecoder(parse_float=_finite, parse_int=_finite, parse_constant=_no_constant).decode


def parse_json(data: bytes | str):
    """Exactly one strict JSON value; of repeated keys the last wins. Raises ValueError."""
    text = data if isinstance(data, str) else bytes(data).decode("utf-8")
    try:
        value = (_DECODE_HUGE if _HUGE.search(text) else _DECODE)(text)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    if "\\u" in text:
        try:
            text.encode()
            json.dumps(value, ensure_ascii=False).encode()
        except UnicodeEncodeError:
            raise ValueError("lone surrogate escape") from None
    return value
