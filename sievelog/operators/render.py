"""Records as text: printf-like formats and JSON envelopes, as column expressions over (record, action)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TIMESTAMP_NAMES

DEFAULT_FORMAT = "%s\\n"
PLACEHOLDERS = "oksKSLRtpTha"


class FormatError(ValueError):
    pass


def parse_format(source: str) -> list[tuple[str, bytes | str]]:
    """("text", bytes) and ("field", letter) in order."""
    out: list[tuple[str, bytes | str]] = []
    text, i = b"", 0
    while i < len(source):
        c, follows = source[i], source[i + 1 : i + 2]
        if c == "%":
            if not follows:
                raise FormatError("incomplete placeholder at the end of the format")
            if follows == "%":
                text += b"%"
            elif follows in PLACEHOLDERS:
                if text:
                    out.append(("text", text))
                out.append(("field", follows))
                text = b""
            else:
                raise FormatError(f"unsupported placeholder %{follows}")
            i += 2
        elif c == "\\":
            simple = {"n": b"\n", "r": b"\r", "t": b"\t", "\\": b"\\"}
            if follows in simple and follows:
                text += simple[follows]
                i += 2
            elif follows == "x":
                digits = source[i + 2 : i + 4]
                body = digits[1:] if digits[:1] == "+" else digits
                if len(digits) != 2 or not all(x in "0123456789abcdefABCDEF" for x in body):
                    raise FormatError(f"invalid hexadecimal escape \\x{digits}")
                text += bytes([int(body, 16)])
                i += 4
            else:
                raise FormatError(f"unsupported escape \\{follows}")
        else:
            text += c.encode()
            i += 1
    if text:
        out.append(("text", text))
    return out


def fields_used(source: str) -> set[str]:
    """Record columns that a format reads, so that others needn't be."""
    named = {"o": "offset", "k": "key", "K": "key", "L": "value", "t": "topic", "p": "partition", "T": "timestamp", "h": "headers"}
    return {named[x] for kind, x in parse_format(source) if kind == "field" and x in named}


def _binary(x: Column) -> Column:
    return x.cast("string").cast("binary")


def _length(x: Column) -> Column:
    return F.coalesce(F.octet_length(x).cast("long"), F.lit(-1).cast("long"))


def format_column(source: str, payload: str = "payload", action: str = "action") -> Column:
    """The rendered bytes. A payload above 2^31 - 1 bytes under %R is an error before anything of its record is written."""
    nothing = F.lit(b"")
    body = F.col(payload)
    signed = F.when(_length(body) > 2**31 - 1, F.raise_error(F.lit("payload exceeds the %R length limit")).cast("long")).otherwise(_length(body))
    header = lambda out, h: F.concat(out, F.when(F.length(out) > 0, F.lit(b",")).otherwise(nothing), h["key"].cast("binary"), F.lit(b"="), F.coalesce(h["value"], F.lit(b"NULL")))
    fields = {
        "o": lambda: _binary(F.col("offset")), "p": lambda: _binary(F.col("partition")), "t": lambda: F.col("topic").cast("binary"),
        "k": lambda: F.coalesce("key", nothing), "K": lambda: _binary(_length(F.col("key"))),
        "s": lambda: F.coalesce(body, nothing), "S": lambda: _binary(_length(body)), "L": lambda: _binary(_length(F.col("value"))),
        "R": lambda: F.unhex(F.right(F.lpad(F.hex(signed), F.lit(16), F.lit("0")), F.lit(8))),
        "T": lambda: _binary(F.coalesce(F.unix_millis("timestamp"), F.lit(-1))),
        "h": lambda: F.aggregate(F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")), nothing, header),
        "a": lambda: F.col(action).cast("binary"),
    }
    parts = [F.lit(x) if kind == "text" else fields[x]() for kind, x in parse_format(source)]
    return F.concat(*parts) if parts else nothing


def json_string(x: Column) -> Column:
    """A JSON string literal: quote, backslash and control characters escaped, hexadecimal ones in lower case."""
    out = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code, escaped in short.items():
        out = F.replace(out, F.lit(chr(code)), F.lit(escaped))
    # the other controls are rare: one test for all of them keeps the common case to a few passes
    rare = out
    for code in (c for c in range(32) if c not in short):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(x.rlike("[\\x00-\\x07\\x0b\\x0e-\\x1f]"), rare).otherwise(out), F.lit('"'))


def _base64(x: Column) -> Column:
    return F.replace(F.base64(x), F.lit("\r\n"), F.lit(""))


def _bytes_fields(name: str, x: Column) -> Column:
    """``"name":…,"nameEncoding":…,"nameLength":…`` of bytes that may be null."""
    text = x.cast("string")
    value = F.when(x.isNull(), "null").when(F.is_valid_utf8(text), json_string(text)).otherwise(F.concat(F.lit('"'), _base64(x), F.lit('"')))
    encoding = F.when(x.isNull(), "null").when(F.is_valid_utf8(text), '"utf8"').otherwise('"base64"')
    return F.concat(F.lit(f'"{name}":'), value, F.lit(f',"{name}Encoding":'), encoding, F.lit(f',"{name}Length":'), _length(x).cast("string"))


def envelope_column(value_payload: bool = False, payload: str = "payload", action: str = "action", payload_length: str = "payload_length") -> Column:
    """One JSON object a record, ended by a newline. ``value_payload`` embeds the payload as JSON."""
    kind = F.lit("null")
    for code, name in TIMESTAMP_NAMES.items():
        kind = F.when(F.col("timestampType") == code, f'"{name}"').otherwise(kind)
    headers = F.array_join(F.transform(F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")), lambda h: F.concat(F.lit('{"name":'), json_string(h["key"]), F.lit(","), _bytes_fields("value", h["value"]), F.lit("}"))), ",")
    body = _bytes_fields("payload", F.col(payload))
    if value_payload:
        embedded = F.concat(F.lit('"payload":'), F.col(payload).cast("string"), F.lit(',"payloadEncoding":"json","payloadLength":'), F.coalesce(F.col(payload_length), _length(F.col(payload))).cast("string"))
        body = F.when(F.col(payload).isNull(), body).otherwise(embedded)
    return F.concat(
        F.lit('{"topic":'), json_string(F.col("topic")), F.lit(',"partition":'), F.col("partition").cast("string"), F.lit(',"offset":'), F.col("offset").cast("string"),
        F.lit(',"timestamp":'), F.coalesce(F.unix_millis("timestamp").cast("string"), F.lit("null")), F.lit(',"timestampType":'), F.when(F.col("timestamp").isNull(), "null").otherwise(kind),
        F.lit(","), _bytes_fields("key", F.col("key")), F.lit(',"headers":['), headers, F.lit('],"action":"'), F.col(action), F.lit('",'), body, F.lit("}\n"),
    )
