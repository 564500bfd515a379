"""JSON values as *cells*: one string column that keeps a value's type.

``from_json`` into strings un-quotes JSON strings, so ``12`` and ``"12"`` look
alike.  We therefore put an ``s`` inside every string literal of a text once,
before it is parsed.  All parts taken out of it then say what they are by their
first character:

=========  ==========================================================
``s…``     string, followed by its decoded content
``{`` ``[``  object or array, still marked JSON text
``t`` ``f``  boolean
``n``      null
other      number (``Infinity`` for a literal beyond the double range)
=========  ==========================================================

A *value* is ``struct(cell, children)``: the cell, for a container just its
bracket, and the cells one level below.  Checking a text and taking it apart is
one parse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from jsonloom.functions.shared import shared
from jsonloom.functions.text import JS_WHITESPACE, js_number, js_trim, json_trim, let

# Options that narrow Spark's JSON reader to RFC 8259.
STRICT = {
    "allowSingleQuotes": "false",
    "allowUnquotedFieldNames": "false",
    "allowNumericLeadingZeros": "false",
    "allowNonNumericNumbers": "false",
    "allowUnquotedControlChars": "false",
    "allowComments": "false",
    "allowBackslashEscapingAnyCharacter": "false",
    "maxNumLen": "2147483647",
    "maxStringLen": "2147483647",
}
# What Spark's parser refuses although the text may be valid; no option lifts these.
LONGEST_KEY = 50_000
DEEPEST = 1_000
NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
# Canonical array-index keys; JavaScript moves those first in an object.
INDEX_KEY = r"^(?:0|[1-9][0-9]{0,9})\z"
LAST_INDEX_KEY = 4294967294

# First characters of a JSON text, of what a trim may leave in front of it included.
JSON_STARTS = '{["-0123456789tfn' + JS_WHITESPACE

Check = Callable[[Column], Column]

ENTRIES = "array<struct<key:string,cell:string>>"
VALUE = f"struct<cell:string,children:{ENTRIES}>"


def mark(text: Column) -> Column:
    """Put ``s`` at the start of every string literal.

    Escaped backslashes and quotes become \\u escapes first, so that each quote
    left over opens or closes a literal.
    """
    text = F.replace(text, F.lit("\\\\"), F.lit("\\u005c"))
    text = F.replace(text, F.lit('\\"'), F.lit("\\u0022"))
    return F.regexp_replace(text, r'"([^"]*)"', r'"s$1"')


def unmark(cell: Column) -> Column:
    """Plain JSON text of a container cell."""
    text = F.replace(cell, F.lit("\\\\"), F.lit("\\u005c"))
    text = F.replace(text, F.lit('\\"'), F.lit("\\u0022"))
    return F.regexp_replace(text, r'"s([^"]*)"', r'"$1"')


def _bounded(trimmed: Column, first: str, last: str) -> Column:
    return trimmed.startswith(first) & trimmed.endswith(last) & (F.octet_length(trimmed) > 1)


def could_be_json(trimmed: Column) -> Column:
    """Cheap test of both ends, ahead of any parse."""
    return (
        _bounded(trimmed, "{", "}")
        | _bounded(trimmed, "[", "]")
        | _bounded(trimmed, '"', '"')
        | _is_plain(trimmed)
    )


def _is_plain(trimmed: Column) -> Column:
    return trimmed.isin("true", "false", "null") | trimmed.rlike(NUMBER)


def _value(cell: Column, children: Column) -> Column:
    return F.struct(cell.alias("cell"), children.alias("children"))


def _no_children() -> Column:
    return F.array().cast(ENTRIES)


def _parse_marked(text: Column) -> Column:
    """Value of a marked text that could be JSON; NULL unless strictly valid.

    The text is parsed as the first of two array elements.  The second holds an
    unmarked string, which no part of the text can equal: if it is not found in
    second place, the text ended the array itself or held several values.
    """

    def parsed(sentinel: str, schema: str, is_sentinel: Check, value: Check) -> Column:
        wrapped = F.concat(F.lit("["), text, F.lit(f",{sentinel}]"))
        return let(
            F.from_json(wrapped, f"array<{schema}>", STRICT),
            lambda parts: F.when(
                (F.size(parts) == 2) & is_sentinel(F.get(parts, F.lit(1))),
                value(F.get(parts, F.lit(0))),
            ),
        )

    as_object = parsed(
        '{"!":""}',
        "map<string,string>",
        lambda last: last["!"] == "",
        lambda fields: _value(F.lit("{"), _object_entries(fields)),
    )
    as_array = parsed(
        '["!"]',
        "array<string>",
        lambda last: F.get(last, F.lit(0)) == "!",
        lambda items: _value(F.lit("["), _array_elements(items)),
    )
    as_string = parsed(
        '"!"',
        "string",
        lambda last: last == "!",
        lambda content: _value(content, _no_children()),
    )
    return (
        F.when(text.startswith("{"), as_object)
        .when(text.startswith("["), as_array)
        .when(text.startswith('"'), as_string)
        .when(text.isNotNull(), _value(text, _no_children()))
        .cast(VALUE)
    )


def _mark_candidate(trimmed: Column) -> Column:
    return F.when(could_be_json(trimmed), mark(trimmed))


def parse_value(trimmed: Column) -> Column:
    """Value of a JSON text without outer whitespace; NULL unless strictly valid."""
    return let(_mark_candidate(trimmed), _parse_marked)


def parse_text(text: Column) -> Column:
    """Value of a text in which only JSON whitespace may surround it."""
    return let(json_trim(text), parse_value)


@shared
def is_json(text: str) -> Column:
    """True where the text of a column is exactly one JSON value."""
    return parse_text(F.col(text)).isNotNull()


def limit_error(text: Column) -> Column:
    """Why a refused text may be valid JSON all the same: a key or a nesting beyond
    the parser's limits; NULL where no limit is passed."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("__")), F.lit('\\"'), F.lit("__"))
    long_key = plain.rlike(f'"[^"]{{{LONGEST_KEY + 1},}}"\\s*:')

    def deepest(brackets: Column) -> Column:
        state = "struct<now:int,most:int>"
        step = lambda a, b: F.struct(
            (a["now"] + F.when(b.isin("[", "{"), 1).otherwise(-1)).alias("now"),
            F.greatest(a["most"], a["now"] + 1).alias("most"),
        ).cast(state)
        start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")).cast(state)
        return F.aggregate(F.split(brackets, ""), start, step, lambda a: a["most"])

    brackets = F.regexp_replace(F.regexp_replace(plain, '"[^"]*"', ""), r"[^\[\]{}]", "")
    deep = let(brackets, lambda b: F.when(F.length(b) > DEEPEST, deepest(b)).otherwise(0)) > DEEPEST
    return F.when(
        F.length(text) > DEEPEST,
        F.when(long_key, f"Key longer than the parser's {LONGEST_KEY} characters").when(
            deep, f"Nesting deeper than the parser's {DEEPEST} levels"
        ),
    )


def kind(cell: Column) -> Column:
    first = F.left(cell, F.lit(1))
    return (
        F.when(cell.isNull(), F.lit(None).cast("string"))
        .when(first == "s", "string")
        .when(first == "{", "object")
        .when(first == "[", "array")
        .when(first.isin("t", "f"), "boolean")
        .when(first == "n", "null")
        .otherwise("number")
    )


def is_container(cell: Column) -> Column:
    return cell.startswith("{") | cell.startswith("[")


def string_value(cell: Column) -> Column:
    return F.when(cell.startswith("s"), F.substr(cell, F.lit(2)))


def _number(cell: Column) -> Column:
    # A literal beyond the double range may come as a quoted word.
    return F.btrim(cell, F.lit('"')).try_cast("double")


def number_value(cell: Column) -> Column:
    return F.when(kind(cell) == "number", _number(cell))


def boolean_value(cell: Column) -> Column:
    return F.when(kind(cell) == "boolean", cell == "true")


def printed(cell: Column) -> Column:
    """``String(value)`` of a number or boolean cell."""
    return F.when(kind(cell) == "number", js_number(_number(cell))).otherwise(cell)


def _last_value_first_place(entries: Column) -> Column:
    """Repeated keys: keep the first position and the last value."""

    def pick(sorted_: Column) -> Column:
        def other(index: Column, step: int) -> Column:
            return F.get(sorted_, index + step)["key"]

        firsts = F.filter(
            sorted_, lambda e, i: (i == 0) | ~e["key"].eqNullSafe(other(i, -1))
        )
        lasts = F.filter(sorted_, lambda e, i: ~e["key"].eqNullSafe(other(i, 1)))
        merged = F.transform(
            F.arrays_zip(firsts.alias("first"), lasts.alias("last")),
            lambda z: F.struct(
                z["first"]["place"].alias("place"),
                z["first"]["key"].alias("key"),
                z["last"]["cell"].alias("cell"),
            ),
        )
        return F.transform(
            F.array_sort(merged),
            lambda e: F.struct(e["key"].alias("key"), e["cell"].alias("cell")),
        )

    keyed = F.transform(
        entries,
        lambda e, i: F.struct(e["key"].alias("key"), i.alias("place"), e["cell"].alias("cell")),
    )
    return let(F.array_sort(keyed), pick)


def _index_keys_first(entries: Column) -> Column:
    def ranked(e: Column, i: Column) -> Column:
        number = F.when(e["key"].rlike(INDEX_KEY), e["key"].try_cast("bigint"))
        is_index = F.coalesce(number <= LAST_INDEX_KEY, F.lit(False))
        return F.struct(
            F.when(is_index, 0).otherwise(1).alias("group"),
            F.when(is_index, number).otherwise(i.cast("bigint")).alias("rank"),
            e["key"].alias("key"),
            e["cell"].alias("cell"),
        )

    return F.transform(
        F.array_sort(F.transform(entries, ranked)),
        lambda e: F.struct(e["key"].alias("key"), e["cell"].alias("cell")),
    )


def _object_entries(fields: Column) -> Column:
    """Entries of a map with marked keys, in JavaScript order."""
    names = F.map_keys(fields)
    plain = F.transform(
        F.map_entries(fields),
        lambda p: F.struct(
            F.substr(p["key"], F.lit(2)).alias("key"),
            F.coalesce(p["value"], F.lit("null")).alias("cell"),
        ),
    )
    repeated = F.size(F.array_distinct(names)) < F.size(names)
    has_index = F.exists(names, lambda n: F.substring(n, 2, 1).between("0", "9"))
    return (
        F.when(repeated, _index_keys_first(_last_value_first_place(plain)))
        .when(has_index, _index_keys_first(plain))
        .otherwise(plain)
    )


def _array_elements(items: Column) -> Column:
    return F.transform(
        items,
        lambda x: F.struct(
            F.lit(None).cast("string").alias("key"),
            F.coalesce(x, F.lit("null")).alias("cell"),
        ),
    )


def _open_container(cell: Column) -> Column:
    """Value of a container cell, which the parse of its parent has proved to be one strict value."""
    return (
        F.when(cell.startswith("{"), let(F.from_json(cell, "map<string,string>", STRICT), lambda x: _value(F.lit("{"), _object_entries(x))))
        .otherwise(_value(F.lit("["), _array_elements(F.from_json(cell, "array<string>", STRICT))))
        .cast(VALUE)
    )


def open_cell(cell: Column, may_unwrap: Column) -> Column:
    """Value one level into a cell: a container's, or that of the JSON text in a
    string if ``may_unwrap``; NULL where there is nothing to open."""
    # Only a few characters start a JSON text: cells beyond are left without a look inside.
    worth = may_unwrap & (F.instr(F.lit(JSON_STARTS), F.substring(cell, 2, 1)) > 0)
    content = let(F.substr(cell, F.lit(2)), js_trim)
    return F.when(is_container(cell), _open_container(cell)).when(
        cell.startswith("s") & worth, let(content, parse_value)
    )
