"""Sizes, odd names, repeated and null ids: what must not change an answer."""

import pytest
from pyspark.sql import functions as F

from jsonloom.functions.ranges import SEPARATORS, find_ranges
from jsonloom.functions.regex import Invalid, Unsupported, to_java
from jsonloom.operators.expand import expand, unopened
from jsonloom.operators.files import file_stats, parse_files
from jsonloom.operators.materialise import materialise, materialise_records
from jsonloom.operators.records import parse
from jsonloom.operators.search import build_pattern
from jsonloom.operators.view import restore_all_set, visible_rows
from jsonloom.plans import inputs
from jsonloom.sources.documents import from_column


def large(spark, prefix, length, suffix):
    text = F.concat(F.lit(prefix), F.repeat(F.lit("x"), length), F.lit(suffix))
    return spark.range(1).select(F.lit("d").alias("doc_id"), text.alias("text"))


def test_long_strings_are_valid(spark):
    top = parse(large(spark, '{"a":"', 21_000_000, '"}'), "json").select("error", F.length(F.get("children", F.lit(0))["cell"]))
    assert tuple(top.first()) == (None, 21_000_001)
    inner = expand(parse(large(spark, '{"a":"{\\"b\\":\\"', 21_000_000, '\\"}"}'), "json"), levels=3)
    assert inner.where("path_text = '$.a.b'").select(F.length("str_value")).first()[0] == 21_000_000
    line = parse(large(spark, '{"e":1}\n{"e":"', 21_000_000, '"}'))
    assert [(r.format, r.error) for r in line.select("format", "error").collect()] == [("jsonl", None)] * 2


def test_limits_of_the_parser_are_named(docs):
    texts = {
        "key": '{"' + "k" * 60_000 + '":1}',
        "deep": "[" * 1001 + "]" * 1001,
        "deeper": '{"a":' * 1500 + "1" + "}" * 1500,
        "bad": "[" * 1200,
        "long": "[" + "1," * 900 + "x]",
    }
    errors = {r.doc_id: r.error for r in parse(docs(texts), "json").collect()}
    assert "Key longer" in errors["key"]
    assert "Nesting deeper" in errors["deep"] and "Nesting deeper" in errors["deeper"]
    assert errors["long"] == "Invalid JSON"


@pytest.fixture
def same_ids(spark):
    rows = [("d1", '{"p":"{\\"q\\":1}"}'), ("d2", '{"p":"{\\"q\\":2}"}'), (None, '{"p":"{\\"q\\":3}"}')]
    records = parse(spark.createDataFrame(rows, "doc_id string, text string"), "json")
    return records, expand(records, levels=3)


def test_restoring_goes_by_document(spark, same_ids):
    records, nodes = same_ids

    def texts(chosen):
        return {r.doc_id: r.json for r in materialise_records(records, nodes, chosen).collect()}

    opened = {d: f'{{"p":{{"q":{i}}}}}' for d, i in (("d1", 1), ("d2", 2), (None, 3))}
    closed = {d: f'{{"p":"{{\\"q\\":{i}}}"}}' for d, i in (("d1", 1), ("d2", 2), (None, 3))}
    assert texts([("d1", "record-1")]) == opened | {"d1": closed["d1"]}
    assert texts(restore_all_set(records)) == closed
    assert texts(["record-1"]) == closed and texts(()) == opened
    none = spark.createDataFrame([(None, "record-1")], "doc_id string, record_id string")
    assert texts(none) == opened | {None: closed[None]}


def test_rows_do_not_depend_on_the_size_of_a_set(spark, same_ids):
    _, nodes = same_ids
    few = visible_rows(nodes, ["$.p"]).count()
    many = spark.createDataFrame([("$.p",)] + [(f"$.x{i}",) for i in range(1500)], "path_text string")
    assert few == visible_rows(nodes, many).count() == visible_rows(nodes, [f"$.x{i}" for i in range(1500)] + ["$.p"]).count() == 9
    assert visible_rows(nodes, ["$.none"]).count() == visible_rows(nodes).count() == 6


def test_repeated_ids(spark):
    df = spark.createDataFrame([("e", '{"p":{"q":1}}'), ("e", '{"p":{"q":2}}')], "id string, text string")
    with pytest.raises(Exception, match="same doc_id"):
        materialise(expand(parse(from_column(df, "id", "text"), "json"), levels=3)).collect()
    nodes = expand(parse(from_column(df, "id", "text", numbered=True), "json"), levels=3)
    assert sorted(r.json for r in materialise(nodes).collect()) == ['{"p":{"q":1}}', '{"p":{"q":2}}']


def test_files_with_odd_names(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    names = ["a[1].json", "a1.json", "b*.json", "bb.json", "c{d}.json", "e%41+f.json", "g h.json"]
    for i, name in enumerate(names):
        (folder / name).write_text(f'{{"n":\n{i}}}')
    for i in range(200):
        (folder / f"t{i}").write_text("[1]")
    (folder / "blank.json").write_text(" \n")
    (folder / "mark.jsonl").write_text('﻿{"e":1}\n{"e":2}\n', encoding="utf8")
    records = parse_files(spark, str(folder))
    assert records.where("error is null").count() == records.count() == len(names) + 200 + 2
    assert records.select("doc_id").distinct().count() == len(names) + 200 + 1
    stats = {r.doc_id.rsplit("/", 1)[1]: (r.total, r.failed) for r in file_stats(spark, str(folder)).collect()}
    assert stats["blank.json"] == (0, 0) and stats["mark.jsonl"] == (2, 0)
    assert len(stats) == len(names) + 202


def test_deep_records_do_not_stop_a_plan(docs):
    text = {"deep": '{"a":{"b":{"c":{"d":1}}}}', "flat": '{"a":1}'}
    nodes = expand(parse(docs(text), "json"), levels=2, keep_deep=True)
    assert {r.doc_id for r in unopened(nodes).collect()} == {"deep"}
    assert nodes.where("doc_id = 'flat'").count() == 2


def test_ranges_without_a_free_separator(spark):
    text = "".join(SEPARATORS)
    df = spark.createDataFrame([(text + "ab" + text + "ab",), ("ab" + text,), (text,)], "t string")
    got = [[tuple(x) for x in r[0]] for r in df.select(find_ranges(F.col("t"), "ab")).collect()]
    assert got == [[(32, 34), (66, 68)], [(0, 2)], []]
    empty = spark.createDataFrame([("x" + text,)], "t string").select(find_ranges(F.col("t"), "(?=x)")).first()[0]
    assert [tuple(x) for x in empty] == [(0, 0)]


@pytest.mark.parametrize(
    ("pattern", "text", "found"),
    [
        ("{", "a{b", [(1, 2)]),
        ("[^]", "a\n", [(0, 1), (1, 2)]),
        ("[[a]", "[a", [(0, 1), (1, 2)]),
        ("a{,3}", "xa{,3}", [(1, 6)]),
        (r"\u{3}", "uuu", [(0, 3)]),
        (r"b$", "b\n", []),
        (r"[a&&b]", "&", [(0, 1)]),
        (r"\h\/", "h/", [(0, 2)]),
        (r"(?<y>a)\k<y>", "aa", [(0, 2)]),
        # an escape with no such group is a character code
        (r"\1", "\x01", [(0, 1)]),
        (r"\2(a)", "\x02a", [(0, 2)]),
        (r"\101\8", "A8", [(0, 2)]),
        # a group that has not taken part matches the empty text
        (r"(?:\1(a))b", "ab", [(0, 2)]),
        (r"(a\1)", "a", [(0, 1)]),
        (r"x(a)|(b)\1", "b", [(0, 1)]),
        (r"(a|b)\1", "abb", [(1, 3)]),
        (r"(?<n_$>x)\k<n_$>1", "xx1", [(0, 3)]),
        # a set has no range
        (r"[a-\d]+", "a-5b", [(0, 3)]),
        (r"[\w-z]", "-", [(0, 1)]),
        (r"(?=a)*b", "b", [(0, 1)]),
    ],
)
def test_javascript_patterns(spark, pattern, text, found):
    java = build_pattern(spark, pattern, regex=True, case_sensitive=True)
    got = spark.createDataFrame([(text,)], "t string").select(find_ranges(F.col("t"), java)).first()[0]
    assert [tuple(x) for x in got] == found


def test_invalid_and_unsupported_patterns(spark):
    wrong = ("a**", "(", "[a", "*", "a++", "(?i)a", "(?>a)", "\\", "a)", "a{2,1}", "[b-a]", "(?<=a)*", "^*", r"(?<a>x)\k<b>", "(?<a>x)(?<a>y)")
    for pattern in wrong:
        assert build_pattern(spark, pattern, regex=True) is None, pattern
    for pattern in (r"[\S]", r"(?:(a)|b)\1", r"(a)?\1", r"(?!(a))\1", r"(a)(?<=\1)"):
        with pytest.raises(Unsupported):
            build_pattern(spark, pattern, regex=True)
    with pytest.raises(Invalid):
        to_java("a{2}{3}")


def test_tasks_of_a_table_have_bounded_rows(spark, monkeypatch):
    """One small file with many rows is more tasks than cores; a task's rows do not grow with the table."""
    monkeypatch.setattr(inputs, "TASK_ROWS", 50)
    events = inputs.table(spark, "/root/testdata/sf0.001", "events", "event_id")
    rows = [r["count"] for r in events.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 1000 and max(rows) <= 100
