import random

import pytest
from pyspark.sql import functions as F

import brute
from jsonloom.functions.cells import is_json
from jsonloom.operators.records import (
    detect_format,
    document_stats,
    parse,
    parse_documents,
    quarantine,
    records_of,
    summaries,
    table_of_contents,
)

VALID = ["1", '"a"', '{"a": 1, "b": [1, 2.50, "x"], "a": 3}', "null", "[null]", ' {"a":1}\n', "-0",
         "1e400", '"\\ud800"', '"a\\\\\\"b"', "9" * 1500, "[" * 600 + "]" * 600, "true", '"!"', "{}"]
INVALID = ["", " ", "1 2", "{} x", "1],[2", "1,2", "[1,]", "01", "+1", ".5", "1.", "NaN", "[NaN]",
           "Infinity", "{'a':1}", '{"a"}', '"a\tb"', "// c\n1", '"a\\x"', "{a:1}", "﻿1",
           "\xa01", '"\\u12"', "tru", '1],"!"', '{},{"!":""}', '{}],[{}', '"x', '"\\', "{}],[{}"]


def test_strict_validity(spark):
    df = spark.createDataFrame([(t, True) for t in VALID] + [(t, False) for t in INVALID], "t string, ok boolean")
    wrong = df.where(F.coalesce(is_json("t"), F.lit(False)) != F.col("ok")).collect()
    assert wrong == []


def test_validity_against_python_on_damaged_json(spark):
    rnd = random.Random(11)
    base = ['{"a":[1,"x\\"y",{"b":null}],"c":"{\\"k\\":1}"}', '[1.5,-2e3,"é",[],{}]', '"s\\\\"', "12"]
    extra = list('{}[]",:\\ 01.eE+-tn!') + ['\\"', '\\\\', ',{"!":""}', ',"!"', "},{", "],["]
    texts = set()
    while len(texts) < 6000:
        t = rnd.choice(base)
        for _ in range(rnd.randint(1, 3)):
            p = rnd.randint(0, len(t))
            t = t[:p] + t[p + 1:] if rnd.random() < 0.4 else t[:p] + rnd.choice(extra) + t[p:]
        texts.add(t)
    df = spark.createDataFrame([(t, brute.strict(t)[0]) for t in sorted(texts)], "t string, ok boolean")
    assert df.where(F.coalesce(is_json("t"), F.lit(False)) != F.col("ok")).collect() == []


def test_forced_jsonl_keeps_bad_lines(docs):
    d = docs({"a": '{"type":"ping"}\n{"type":"pong"}', "b": '{"n":12}\n{n:12]\n\r\n"x"\r\n7\r8'})
    toc = {(r.doc_id, r.line_number): (r.state, r.summary) for r in table_of_contents(parse(d, "jsonl")).collect()}
    assert toc == {
        ("a", 1): ("ok", "type:ping"),
        ("a", 2): ("ok", "type:pong"),
        ("b", 1): ("ok", "n:12"),
        ("b", 2): ("err", "{n:12]"),
        ("b", 4): ("ok", "x"),
        ("b", 5): ("err", "7\r8"),
    }
    good, bad = quarantine(parse(d, "jsonl"))
    assert good.count() == 4
    assert {r.error for r in bad.collect()} == {"Invalid JSON"}
    spread = parse(d, "jsonl", spread=True).select("doc_id", "line_number", "error")
    assert spread.count() == 6 and spread.where("error is not null").count() == 2
    assert parse(d, spread=True).count() == 3
    # The array form of the same records.
    same = records_of(parse_documents(d, "jsonl")).select("doc_id", "line_number", "cell")
    assert sorted(same.collect(), key=str) == sorted(parse(d, "jsonl").select("doc_id", "line_number", "cell").collect(), key=str)


def test_automatic_format(docs):
    d = docs({
        "two": '{"a":1}\n{"a":2}', "one": '\n\n{"a":1}\n', "bad": '{"a":1}\n{bad}', "blank": " \n ",
        "pretty": '{\n"a": [1,\n2]\n}', "nbsp": '{"a":1}\n\xa0{"a":2}',
    })
    stats = {r.doc_id: tuple(r)[1:] for r in document_stats(d).collect()}
    assert stats == {
        "two": ("jsonl", 2, 2, 0), "one": ("json", 1, 1, 0), "bad": ("json", 1, 0, 1),
        "blank": ("json", 0, 0, 0), "pretty": ("json", 1, 1, 0),
        # Lines are trimmed for detection and not for parsing.
        "nbsp": ("json", 1, 0, 1),
    }
    formats = {r.doc_id: r.f for r in d.select("doc_id", detect_format("text").alias("f")).collect()}
    assert formats == {"two": "jsonl", "one": "json", "bad": "json", "blank": "json", "pretty": "json", "nbsp": "jsonl"}
    lines = {(r.doc_id, r.line_number) for r in parse(d).collect()}
    assert lines == {("two", 1), ("two", 2), ("one", 1), ("bad", 1), ("pretty", 1), ("nbsp", 1)}
    assert {r.summary for r in summaries(parse(d).where("doc_id = 'bad'")).collect()} == {"Parse error"}
    forced = {r.doc_id: r.total for r in document_stats(d, "json").collect()}
    assert forced["two"] == 1 and forced["blank"] == 0
    with pytest.raises(ValueError):
        parse(d, "xml")


def test_summaries(docs):
    long = "x" * 100
    cases = {
        '{"message":"ok","event":" login "}': "event:login · message:ok",
        '{"type":1.0,"name":true,"timestamp":""}': "type:1 · name:true",
        '{"type":null,"z":[1],"q":false}': "q:false",
        '{"2":"b","1":" "}': "2:b",
        '{"a":{},"b":[]}': "Object(2)",
        f'{{"event":"{long}"}}': "event:" + "x" * 48,
        f'{{"other":"{long}"}}': "other:" + "x" * 72,
        "[1,2,3]": "Array(3)", "null": "null", '""': '""', "1e21": "1e+21", f'"{long}"': "x" * 72,
        '"{}"': "{}", '{"a":1,"a":2}': "a:2", "{}": "Object(0)",
    }
    d = docs({str(i): t for i, t in enumerate(cases)})
    got = {r.text: r.summary for r in summaries(parse(d, "json")).collect()}
    assert got == cases
