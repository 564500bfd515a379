"""Text rules of JavaScript strings and numbers as Spark column expressions.

Everything here is ``Column -> Column`` and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that ECMAScript's String.prototype.trim removes.
JS_WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The whitespace RFC 8259 allows around a JSON value.
JSON_WHITESPACE = " \t\n\r"

# The two-character escapes JSON.stringify writes.
SHORT_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}

# Below this Java prints two digits where one identifies the number.
SMALL = 1e-322


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _trim(text: Column, chars: str) -> Column:
    # Trimming with a character list indexes the whole string, so look at the
    # two ends first.
    edge = F.instr(F.lit(chars), F.left(text, F.lit(1))) > 0
    edge = edge | (F.instr(F.lit(chars), F.right(text, F.lit(1))) > 0)
    return F.when(edge, F.btrim(text, F.lit(chars))).otherwise(text)


def js_trim(text: Column) -> Column:
    return _trim(text, JS_WHITESPACE)


def json_trim(text: Column) -> Column:
    return _trim(text, JSON_WHITESPACE)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; Spark's ``length`` counts code points."""
    encoded = (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(encoded)  # ASCII


def js_slice(text: Column, units: Column | int) -> Column:
    """``text.slice(0, units)``; a cut through a surrogate pair keeps the pair."""
    units = F.lit(units) if isinstance(units, int) else units
    start = F.lit(1)

    def cut(raw: Column) -> Column:
        last = F.hex(F.substr(raw, 2 * units - 1, start))
        bytes_kept = F.when(last.between("D8", "DB"), 2 * units + 2).otherwise(2 * units)
        return F.decode(F.substr(raw, start, bytes_kept), "UTF-16BE")

    # Only texts with characters beyond the BMP among the first units differ.
    return let(
        F.substr(text, start, units),
        lambda short: F.when(utf16_length(short) == F.length(short), short).otherwise(
            let(F.encode(text, "UTF-16BE"), cut)
        ),
    )


def json_quote(text: Column) -> Column:
    """The JSON string literal of ``text`` as JSON.stringify writes it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    short = out
    for char, escape in SHORT_ESCAPES.items():
        short = F.replace(short, F.lit(char), F.lit(escape))
    rare = short
    for code in set(range(0x20)) - set(map(ord, SHORT_ESCAPES)):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    # Few texts hold control characters at all, and hardly any those without a short escape.
    body = (
        F.when(text.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare)
        .when(text.rlike(r"[\x08-\x0d]"), short)
        .otherwise(out)
    )
    return F.concat(F.lit('"'), body, F.lit('"'))


def _layout(digits: Column, point: Column) -> Column:
    """ECMAScript Number::toString of ``0.digits * 10^point``."""
    count = F.length(digits)
    power = point - 1
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string"))
    tail = F.substring(digits, F.lit(2), count)
    return (
        F.when((count <= point) & (point <= 21), F.rpad(digits, point, F.lit("0")))
        .when(
            (point > 0) & (point <= 21),
            F.concat(
                F.substring(digits, F.lit(1), point),
                F.lit("."),
                F.substring(digits, point + 1, count),
            ),
        )
        .when(
            (point > -6) & (point <= 0),
            F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits),
        )
        .when(count == 1, F.concat(digits, exponent))
        .otherwise(F.concat(F.left(digits, F.lit(1)), F.lit("."), tail, exponent))
    )


def _shortest(number: Column, digits: Column, point: Column) -> Column:
    """struct(digits, point) with fewer digits where they still read back as
    ``number``; some Java versions print more digits than needed."""

    def candidate(keep: int) -> Column:
        up = F.substring(digits, keep + 1, 1) >= "5"
        text = (
            F.substring(digits, 1, keep).try_cast("bigint") + F.when(up, 1).otherwise(0)
        ).cast("string")
        exponent = point - keep
        value = F.concat(text, F.lit("e"), exponent.cast("string")).try_cast("double")
        return F.when(
            (F.length(digits) > keep) & (value == number),
            F.struct(
                F.rtrim(text, F.lit("0")).alias("digits"),
                (F.length(text) + exponent).cast("int").alias("point"),
            ),
        )

    kept = F.struct(digits.alias("digits"), point.cast("int").alias("point"))
    subnormal = F.when(number < SMALL, candidate(1))
    return F.coalesce(subnormal, candidate(15), candidate(16), candidate(17), kept)


def _shortest_text(number: Column, digits: Column, point: Column) -> Column:
    def laid_out(parts: Column) -> Column:
        long = (F.length(parts["digits"]) > 15) | (number < SMALL)
        best = F.when(long, _shortest(number, parts["digits"], parts["point"])).otherwise(parts)
        return let(best, lambda b: _layout(b["digits"], b["point"]))

    return let(F.struct(digits.alias("digits"), point.cast("int").alias("point")), laid_out)


def _large_text(number: Column) -> Column:
    """JS text of a large integral double, from its exact digits."""
    exact = number.try_cast("bigint").cast("string")
    return let(
        exact, lambda d: _shortest_text(number, F.rtrim(d, F.lit("0")), F.length(d))
    )


def _fraction_text(number: Column) -> Column:
    """JS text of a positive finite double from Java's ``m.mmmE±x`` or ``m.mmm``."""

    def split(java: Column) -> Column:
        mantissa = F.substring_index(java, "E", 1)
        exponent = F.when(
            F.contains(java, F.lit("E")), F.substring_index(java, "E", -1).try_cast("int")
        ).otherwise(0)
        whole = F.substring_index(mantissa, ".", 1)
        raw = F.replace(mantissa, F.lit("."), F.lit(""))
        lead = F.length(raw) - F.length(F.ltrim(raw, F.lit("0")))
        return _shortest_text(
            number, F.btrim(raw, F.lit("0")), F.length(whole) - lead + exponent
        )

    return let(number.cast("string"), split)


def js_number(number: Column) -> Column:
    """``String(number)``: 1.0 -> 1, 1e21 -> 1e+21, 1e-7 -> 1e-7, -0 -> 0."""
    size = F.abs(number)
    text = (
        F.when(size == float("inf"), "Infinity")
        .when((size < 1e15) & (size == F.floor(size)), size.try_cast("bigint").cast("string"))
        # From 2^53 on doubles are integral; Java may round their digits.
        .when((size >= 2.0**53) & (size < 2.0**63), _large_text(size))
        .otherwise(_fraction_text(size))
    )
    return F.when(number < 0, F.concat(F.lit("-"), text)).otherwise(text)
