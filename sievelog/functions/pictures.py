"""Picture strings: numbers, integers, dates and times as text and back."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from decimal import ROUND_HALF_EVEN, Decimal

from .values import UNDEF, ExpressionError

#: Names of numbers, days and months.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
POWERS = ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"))
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
MONTHS = "January February March April May June July August September October November December".split()


def words(n: int) -> str:
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10 - 2] + (f"-{ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{ONES[n // 100]} hundred" + (f" and {words(n % 100)}" if n % 100 else "")
    for size, name in POWERS:
        if n >= size:
            rest = n % size
            return f"{words(n // size)} {name}" + ((" and " if rest < 100 else ", ") + words(rest) if rest else "")
    raise AssertionError


def ordinal(text: str) -> str:
    head, mark, last = re.fullmatch(r"(?:(.*)([ -]))?([a-z]+)", text).groups()
    last = ORDINALS.get(last) or (f"{last[:-1]}ieth" if last.endswith("y") else f"{last}th")
    return f"{head or ''}{mark or ''}{last}"


def _suffix(n: int) -> str:
    return "th" if 10 <= n % 100 <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


def format_integer(n: int, picture: str) -> str:
    body, _, modifier = picture.partition(";")
    sign, n, is_ordinal = ("-" if n < 0 else ""), abs(n), modifier.startswith("o")
    if body in ("i", "I"):
        out = ""
        for size, letters in ROMAN:
            out += letters * (n // size)
            n %= size
        return sign + (out.upper() if body == "I" else out)
    if body in ("a", "A"):
        out = ""
        while n > 0:
            n, d = divmod(n - 1, 26)
            out = chr(ord(body) + d) + out
        return sign + out
    if body in ("w", "W", "Ww"):
        out = ordinal(words(n)) if is_ordinal else words(n)
        return sign + (out.upper() if body == "W" else re.sub("[a-z]+", lambda m: m[0] if m[0] == "and" else m[0].title(), out) if body == "Ww" else out)
    digits = [c for c in body if c.isdigit() or c == "#"]
    if not any(c.isdigit() for c in digits):
        raise ExpressionError(f"unsupported integer picture {picture!r}")
    out = str(n).rjust(sum(c.isdigit() for c in digits), "0")
    marks = [(sum(x.isdigit() or x == "#" for x in body[i:]), c) for i, c in enumerate(body) if not (c.isdigit() or c == "#")]
    if marks:
        sizes = [at for at, _ in marks]
        step = sizes[-1]
        if len({c for _, c in marks}) == 1 and sorted(sizes) == [step * (k + 1) for k in range(len(sizes))]:
            marks = [(k, marks[0][1]) for k in range(step, len(out), step)]
        for at, c in sorted(marks, reverse=True):
            if at < len(out):
                cut = len(out) - at
                out = out[:cut] + "\0" + out[cut:] if c == "\0" else out[:cut] + c + out[cut:]
                # places count digits from the right, so marks already set stand left of this one
    return sign + out + (_suffix(n) if is_ordinal else "")


def parse_integer(text: str, picture: str) -> int:
    body, _, modifier = picture.partition(";")
    if body in ("i", "I"):
        value, rest = 0, text.lower()
        for size, letters in ROMAN:
            while rest.startswith(letters):
                value, rest = value + size, rest[len(letters) :]
        return value
    if body in ("a", "A"):
        value = 0
        for c in text.lower():
            value = value * 26 + ord(c) - 96
        return value
    if body in ("w", "W", "Ww"):
        small = {w: i for i, w in enumerate(ONES)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)}
        small |= {ordinal(w): n for w, n in small.items()}
        large = {name: size for size, name in POWERS} | {f"{name}th": size for size, name in POWERS}
        total = part = 0
        for w in re.findall("[a-z]+", text.lower()):
            if w in small:
                part += small[w]
            elif w in ("hundred", "hundredth"):
                part *= 100
            elif w in large:
                total, part = total + part * large[w], 0
            elif w != "and":
                raise ExpressionError(f"not a number in words: {text!r}")
        return total + part
    digits = re.sub(r"[^0-9-]", "", text)
    if not re.fullmatch("-?[0-9]+", digits):
        raise ExpressionError(f"not an integer: {text!r}")
    return int(digits)


def format_number(x: float, picture: str, options: dict) -> str:
    """A decimal picture: # and 0 digits, grouping, percent and per-mille, exponent, and a second picture for negatives."""
    symbol = {"decimal-separator": ".", "grouping-separator": ",", "exponent-separator": "e", "minus-sign": "-", "percent": "%", "per-mille": "‰", "zero-digit": "0", "digit": "#", "pattern-separator": ";"} | options
    zero = ord(symbol["zero-digit"])
    family = {chr(zero + i) for i in range(10)}
    parts = picture.split(symbol["pattern-separator"])
    if len(parts) > 2:
        raise ExpressionError("a picture has two parts at most")
    part = parts[1] if x < 0 and len(parts) == 2 else parts[0]
    active = family | {symbol["decimal-separator"], symbol["grouping-separator"], symbol["digit"]}
    places = [i for i, c in enumerate(part) if c in active]
    if not any(part[i] in family or part[i] == symbol["digit"] for i in places):
        raise ExpressionError("a picture needs a digit")
    begin, end = places[0], places[-1] + 1
    before, body, after = part[:begin], part[begin:end], part[end:]
    mantissa, exponent_digits = body, 0
    if (e := re.search(rf"(?<=[{re.escape(''.join(active))}]){re.escape(symbol['exponent-separator'])}(?=[{re.escape(''.join(family))}]+$)", body)) is not None:
        mantissa, exponent_digits = body[: e.start()], len(body) - e.end()
    whole, _, fraction = mantissa.partition(symbol["decimal-separator"])
    least_whole, least_fraction = sum(c in family for c in whole), sum(c in family for c in fraction)
    most_fraction = sum(c in family or c == symbol["digit"] for c in fraction)
    value = abs(Decimal(repr(x)))
    if symbol["percent"] in before + after:
        value *= 100
    elif symbol["per-mille"] in before + after:
        value *= 1000
    power = 0
    if exponent_digits:
        if value:
            power = value.adjusted() - (least_whole - 1)
        value = value.scaleb(-power)
    value = value.quantize(Decimal(1).scaleb(-most_fraction), rounding=ROUND_HALF_EVEN)
    left, _, right = format(value, "f").partition(".")
    left, right = left.lstrip("0").rjust(least_whole, "0"), right.rstrip("0").ljust(least_fraction, "0")
    if not left and not right:
        left = "0"
    if symbol["grouping-separator"] in whole:
        sizes = [len(re.sub(re.escape(symbol["grouping-separator"]), "", whole[i + 1 :])) for i, c in enumerate(whole) if c == symbol["grouping-separator"]]
        step = sizes[-1]
        regular = sorted(sizes) == [step * (k + 1) for k in range(len(sizes))]
        cuts = range(step, len(left), step) if regular else sorted(s for s in sizes if s < len(left))
        for n, at in enumerate(cuts):
            i = len(left) - at - n * len(symbol["grouping-separator"])
            left = left[:i] + symbol["grouping-separator"] + left[i:]
    out = left + (symbol["decimal-separator"] + right if right else "")
    if exponent_digits:
        out += symbol["exponent-separator"] + ("-" if power < 0 else "") + str(abs(power)).rjust(exponent_digits, "0")
    if zero != 48:
        out = "".join(chr(zero + int(c)) if c in "0123456789" else c for c in out)
    sign = symbol["minus-sign"] if x < 0 and len(parts) == 1 else ""
    return sign + before + out + after


def _offset(zone) -> timedelta:
    if zone is UNDEF:
        return timedelta(0)
    if not (m := re.fullmatch(r"([-+]?)(\d{2}):?(\d{2})", zone)):
        raise ExpressionError(f"unsupported time zone {zone!r}")
    return (-1 if m[1] == "-" else 1) * timedelta(hours=int(m[2]), minutes=int(m[3]))


def from_millis(ms: float, picture=UNDEF, zone=UNDEF) -> str:
    shift = _offset(zone)
    try:
        at = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=int(ms)) + shift
    except OverflowError:
        raise ExpressionError("time out of range") from None
    if picture is UNDEF:
        text = at.strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0") + f".{at.microsecond // 1000:03d}"
        return text + ("Z" if not shift else _zone(shift, "01:01"))
    out = re.sub(r"\[\[|\]\]|\[([^\]]*)\]", lambda m: m[0][0] if m[1] is None else _component(at, shift, re.sub(r"\s", "", m[1])), picture)
    return out


def _zone(shift: timedelta, style: str) -> str:
    minutes = int(shift.total_seconds() // 60)
    sign, (h, m) = "-" if minutes < 0 else "+", divmod(abs(minutes), 60)
    return f"{sign}{h:02d}{':' if ':' in style else ''}{m:02d}"


def _component(at: datetime, shift: timedelta, marker: str) -> str:
    name, rest = marker[:1], marker[1:]
    style, _, width = rest.partition(",")
    iso = at.isocalendar()
    values = {
        "Y": at.year, "M": at.month, "D": at.day, "d": at.timetuple().tm_yday, "F": at.isoweekday(), "W": iso[1], "w": (at.day + at.replace(day=1).weekday() - 1) // 7 + 1,
        "H": at.hour, "h": at.hour % 12 or 12, "m": at.minute, "s": at.second, "f": at.microsecond // 1000, "X": iso[0], "x": at.month,
    }
    if name == "P":
        text = "am" if at.hour < 12 else "pm"
        return text.upper() if style.startswith("N") and not style.startswith("Nn") else text
    if name in "Zz" and name:
        if style.endswith("t") and not shift:
            return "Z"
        text = _zone(shift, style if style else "01:01")
        if name == "z":
            return f"GMT{text}"
        return str(int(text[0] + text[1:3])) if style == "0" else text
    if name in ("C", "E"):
        return "ISO"
    if name not in values:
        raise ExpressionError(f"unsupported date component [{marker}]")
    n = values[name]
    if name == "F" and not style or style[:1] in ("N", "n"):
        text = {"M": MONTHS, "x": MONTHS, "F": DAYS}.get(name, [str(n)] * 60)[n - 1 if name in "MxF" else 0]
        if m := re.search(r"-(\d+)$", width):
            text = text[: int(m[1])]
        return text.upper() if style.startswith("N") and not style.startswith("Nn") else text.lower() if style.startswith("n") or name == "F" and not style else text
    style = style or {"m": "01", "s": "01", "f": "001"}.get(name, "1")
    text = format_integer(n, style.removesuffix("o") + (";o" if style.endswith("o") else ""))
    if name == "f":
        text = f"{n:03d}"[: max(1, len(re.sub(r"\D", "", style)))].ljust(len(re.sub(r"\D", "", style)), "0") if re.fullmatch(r"\d+", style) and style != "1" else str(n)
    if name == "Y" and (re.fullmatch(r"[0-9]{2}", style) or (m := re.search(r"-(\d+)$", width))):
        text = text[-(2 if re.fullmatch(r"[0-9]{2}", style) else int(m[1])) :]
    if m := re.match(r"(\d+)", width):
        text = text.rjust(int(m[1]), "0")
    return text


def to_millis(text: str, picture=UNDEF):
    if picture is UNDEF:
        m = re.fullmatch(r"(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(Z|[-+]\d{2}:?\d{2})?)?)?)?", text)
        if not m:
            raise ExpressionError(f"not an ISO 8601 time: {text!r}")
        y, mo, d, h, mi, s = (int(x) if x else 1 if k in (1, 2) else 0 for k, x in enumerate(m.groups()[:6]))
        try:
            at = datetime(y, mo, d, h, mi, s, tzinfo=UTC)
        except ValueError as error:
            raise ExpressionError(str(error)) from None
        ms = int((m[7] or "0").ljust(3, "0")[:3])
        shift = _offset(m[8]) if m[8] and m[8] != "Z" else timedelta(0)
        return float((at - shift - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1) + ms)
    pattern, names = "", []
    for m in re.finditer(r"\[\[|\]\]|\[([^\]]*)\]|[^\[\]]+", picture):
        if m[1] is None:
            pattern += re.escape(m[0] if m[0] not in ("[[", "]]") else m[0][0])
            continue
        marker = re.sub(r"\s", "", m[1])
        style = marker[1:].partition(",")[0]
        names.append((marker[0], style))
        if marker[0] == "P":
            pattern += "([aApP][mM])"
        elif marker[0] in "Zz":
            pattern += r"((?:GMT)?[-+]\d{1,2}:?\d{0,2}|Z)"
        elif style[:1] in ("N", "n") or marker[0] == "F":
            pattern += "([A-Za-z]+)"
        elif style[:1] in ("i", "I", "w", "W", "a", "A"):
            pattern += "([A-Za-z, -]+)"
        else:
            n = len(re.sub(r"\D", "", style))
            pattern += (r"(\d+" if n < 2 else rf"(\d{{{n}}}") + (")(?:st|nd|rd|th)" if style.endswith("o") else ")")
    found = re.fullmatch(pattern, text)
    if not found:
        return UNDEF
    got: dict = {"Y": 1970, "M": 1, "D": 1, "H": 0, "m": 0, "s": 0, "f": 0}
    shift = timedelta(0)
    for (name, style), value in zip(names, found.groups(), strict=True):
        if name == "P":
            got["P"] = value.lower()
        elif name in "Zz":
            value = value.removeprefix("GMT")
            shift = timedelta(0) if value == "Z" else _offset(value[0] + value[1:].replace(":", "").zfill(2).ljust(4, "0"))
        elif style[:1] in ("N", "n") and name == "M":
            got["M"] = next((i + 1 for i, x in enumerate(MONTHS) if x.lower().startswith(value.lower()[:3])), 0)
        elif name == "F":
            continue
        elif name == "f":
            got["f"] = int(value.ljust(3, "0")[:3])
        else:
            got[name] = parse_integer(value, style.removesuffix("o") or "1")
    if "h" in got:
        got["H"] = got["h"] % 12 + (12 if got.get("P") == "pm" else 0)
    try:
        at = datetime(got["Y"], got["M"], got["D"], got["H"], got["m"], got["s"], tzinfo=UTC)
    except ValueError as error:
        raise ExpressionError(str(error)) from None
    if "d" in got:
        at = at.replace(month=1, day=1) + timedelta(days=got["d"] - 1)
    return float((at - shift - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1) + got["f"])
