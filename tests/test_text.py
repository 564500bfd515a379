import json
import random
import struct

from pyspark.sql import functions as F

from jsonloom.functions.cells import open_cell
from jsonloom.functions.text import js_number, js_slice, js_trim, json_quote, utf16_length


def expected_number(d):
    if d in (float("inf"), float("-inf")):
        return "Infinity" if d > 0 else "-Infinity"
    if d == 0:
        return "0"
    mantissa, _, exponent = repr(abs(d)).partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits, point = whole + fraction, len(whole) + int(exponent or 0)
    point -= len(digits) - len(digits.lstrip("0"))
    digits = digits.strip("0")
    if len(digits) <= point <= 21:
        out = digits.ljust(point, "0")
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        power = f"e{point - 1:+d}"
        out = (digits if len(digits) == 1 else f"{digits[0]}.{digits[1:]}") + power
    return ("-" if d < 0 else "") + out


def test_numbers_print_as_in_javascript(spark):
    rnd = random.Random(3)
    values = [0.0, -0.0, 1.0, 1e21, 1e20, 1e-7, 1e-6, 2e23, 8.41e21, 5e-324, 1e-323, 1.5, 0.1,
              1e15, 1e16, 2.0**53 + 2, 126598580116302512.0, -1.5e-9, float("inf"), float("-inf")]
    for _ in range(4000):
        bits = struct.unpack("d", struct.pack("Q", rnd.getrandbits(64)))[0]
        values += [bits] if bits == bits else []
        values.append(rnd.randint(1, 10**6) * 10.0 ** rnd.randint(-30, 30))
        values.append(round(rnd.uniform(-1e6, 1e6), rnd.randint(0, 6)))
    df = spark.createDataFrame([(v,) for v in values], "d double")
    rows = df.select("d", js_number(F.col("d")).alias("s")).collect()
    assert [(r.d, r.s) for r in rows if r.s != expected_number(r.d)] == []


def test_quote_trim_slice_length(spark):
    texts = ["a\tb", '\x00\x01\x0b\x1f"\\/é😀 \x7f', "", "plain", "\\u001F", "﻿\xa0 x　"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for row in df.select("t", json_quote(t).alias("q"), utf16_length(t).alias("n"), js_trim(t).alias("x")).collect():
        assert row.q == json.dumps(row.t, ensure_ascii=False)
        assert row.n == len(row.t.encode("utf-16-be")) // 2
    assert [r[0] for r in df.select(js_trim(t)).collect()][-1] == "x"


def test_slice_counts_utf16_units(spark):
    df = spark.createDataFrame([("a😀" * 40,), ("b" + "a😀" * 40,), ("x" * 80,)], "t string")
    units = [len(r[0].encode("utf-16-be")) // 2 for r in df.select(js_slice(F.col("t"), 48)).collect()]
    # A cut through a pair keeps the pair.
    assert units == [48, 49, 48]


def test_only_cells_that_can_be_json_are_looked_into(spark):
    cells = {
        "s﻿[1] ": "[", "s 7": "7", "s\x0b{}": "{", 's"q"': "sq", "snull": "null", "s": None, "sx[1]": None, "s[1": None,
        's"a" "b"': None, "s-": None, '{"sa":[1],"s1":"sb"}': "{", "[]": "[", "n": None, "12": None,
    }
    opened = spark.createDataFrame([(c,) for c in cells], "c string").select("c", open_cell(F.col("c"), F.lit(True)).alias("v"))
    assert {r.c: r.v and r.v.cell for r in opened.collect()} == cells
    assert "0123456789tfn" in opened._jdf.queryExecution().analyzed().toString()
