import json
import random
import re

import pytest
from pyspark.sql import functions as F

from jsonloom.functions.ranges import find_ranges
from jsonloom.operators.expand import expand
from jsonloom.operators.materialise import materialise_records
from jsonloom.operators.records import parse
from jsonloom.operators.search import (
    build_pattern,
    highlight,
    kth_match,
    match_counts,
    paths_to_expand,
    record_matches,
    search,
)
from jsonloom.operators.view import (
    expand_all,
    restore_all_set,
    row_counts,
    stringified_paths,
    visible_rows,
)

TEXT = "\n".join(
    [json.dumps({"p": json.dumps({"q": json.dumps({"z": 1})}), "name": "Ada"}), '{"p":"{\\"q\\":[]}"}']
)


@pytest.fixture(scope="module")
def parsed(spark):
    docs = spark.createDataFrame([("d", TEXT), ("bad", "{")], "doc_id string, text string")
    records = parse(docs).persist()
    return records, expand(records, levels=6).persist()


def test_rows_open_layer_by_layer(spark, parsed):
    _, nodes = parsed

    def shown(expanded=(), restored=()):
        rows = visible_rows(nodes, expanded, restored).orderBy("source_line", "ord").collect()
        return [(r.id, r.value_label, r.expanded) for r in rows]

    closed = shown()
    assert closed == [
        ("record-1:$", "{2}", True), ("record-1:$.p", "{1}", False), ("record-1:$.name", '"Ada"', True),
        ("record-2:$", "{1}", True), ("record-2:$.p", "{1}", False),
    ]
    step = [r.path_text for r in expand_all(nodes).collect()]
    assert step == ["$.p"]
    assert {r.path_text for r in expand_all(nodes, step).collect()} == {"$.p", "$.p.q"}
    assert {r.path_text for r in expand_all(nodes, fixpoint=True).collect()} == {"$.p", "$.p.q"}
    # The set holds for all records; a restored record has nothing to open.
    opened = shown(["$.p"], ["record-2"])
    assert ("record-1:$.p.q", "{1}", False) in opened
    assert ("record-2:$.p", '"{\\"q\\":[]}"', True) in opened
    many = spark.createDataFrame([("$.p",)] + [(f"$.x{i}",) for i in range(1500)], "path_text string")
    assert shown(many, ["record-2"]) == opened
    counts = {r.record_id: r.rows for r in row_counts(visible_rows(nodes, ["$.p"])).collect()}
    assert counts == {"record-1": 4, "record-2": 3}


def test_restore_all_set_leaves_nothing_to_expand(parsed):
    records, nodes = parsed
    ids = restore_all_set(records)
    assert sorted(r.record_id for r in ids.collect()) == ["record-1", "record-2"]
    assert stringified_paths(nodes, (), ids).collect() == []


def test_materialised_records_keep_failed_ones(parsed):
    records, nodes = parsed
    got = {(r.doc_id, r.record_id): r.json for r in materialise_records(records, nodes, ["record-2"]).collect()}
    assert got == {
        ("d", "record-1"): '{"p":{"q":{"z":1}},"name":"Ada"}',
        ("d", "record-2"): '{"p":"{\\"q\\":[]}"}',
        ("bad", "record-1"): None,
    }


def test_search_modes(spark, parsed):
    _, nodes = parsed
    assert search(nodes, "") is None
    assert search(nodes, "(", regex=True) is None
    assert [(r.source_line, r.path_text) for r in search(nodes, "ada", ordered=True).collect()] == [(1, "$.name")]
    assert search(nodes, "ada", case_sensitive=True).count() == 0
    assert search(nodes, "{1}").count() == 4
    assert search(nodes, "$.p.q").count() == 0
    found = search(nodes, "$.p.q", jq=True, ordered=True)
    assert [(r.source_line, r.path_text, list(r.stringified_chain)) for r in found.collect()] == [
        (1, "$.p.q", ["$.p", "$.p.q"]), (1, "$.p.q.z", ["$.p", "$.p.q"]), (2, "$.p.q", ["$.p"]),
    ]
    assert [(x.start, x.end) for x in found.collect()[0].path_ranges] == [(0, 5)]
    assert match_counts(found).collect()[0].matches == 3
    places = [(r.source_line, r.path_text) for r in found.collect()]
    for k in range(-4, 5):
        row = kth_match(found, k).collect()[0]
        assert (row.source_line, row.path_text) == places[k % 3]
    assert {r.path_text for r in paths_to_expand(found, ["$.o"]).collect()} == {"$.p", "$.p.q", "$.o"}
    assert record_matches(found, "record-1").count() == 2
    marked = highlight(found, build_pattern(spark, "$.p.q")).orderBy("source_line", "ord").collect()[1]
    assert [(s.text, s.marked) for s in marked.key_segments] == [("z", True)]
    assert [(s.text, s.marked) for s in marked.value_segments] == [("1", False)]
    # A literal ASCII letter folds within ASCII only.
    assert re.fullmatch(build_pattern(spark, "s.K"), "S.k") and "ſ" not in build_pattern(spark, "s")


def test_last_match_wins_per_path_text(docs):
    nodes = expand(parse(docs({"d": '{"a.b":"x1","a":{"b":"x2"}}'}), "json"), levels=4)
    assert [r.value_label for r in record_matches(search(nodes, "x")).collect()] == ['"x2"']


def test_matches_make_no_ranges_that_nobody_reads(docs):
    found = record_matches(search(expand(parse(docs({"d": '{"a":"x1"}'}), "json"), levels=2), "x"))
    ranges = lambda df: "UTF-16BE" in df._jdf.queryExecution().optimizedPlan().toString()
    assert not ranges(found.select("value_label")) and ranges(found)
    assert [tuple(x) for x in found.first().value_ranges] == [(1, 2)]


def code_units(text):
    """The text as the UTF-16 units JavaScript's regular expressions step by."""
    raw = text.encode("utf-16-be")
    return "".join(chr(int.from_bytes(raw[i : i + 2], "big")) for i in range(0, len(raw), 2))


@pytest.mark.parametrize("pattern", ["a", "a*", "", "b|$", "[ab]{2}", "^", "(?i)A", "😀"])
def test_ranges_against_python(spark, pattern):
    rnd = random.Random(2)
    texts = ["", "baac", "aaaa", "a😀b😀", "\ufdd0a\ufdd1"] + [
        "".join(rnd.choice("abc 😀é") for _ in range(rnd.randint(0, 300))) for _ in range(20)
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", find_ranges(F.col("t"), pattern).alias("r")).collect():
        expected = [m.span() for m in re.finditer(code_units(pattern), code_units(r.t))]
        assert [(x.start, x.end) for x in r.r] == expected


def test_ranges_of_a_long_text(spark):
    df = spark.createDataFrame([("ab" * 20000,)], "t string")
    got = df.select(find_ranges(F.col("t"), "b").alias("r")).collect()[0].r
    assert [(x.start, x.end) for x in got] == [(2 * i + 1, 2 * i + 2) for i in range(20000)]
