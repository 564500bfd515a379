import json
import random

import pytest
from pyspark.sql import functions as F

import brute
from jsonloom.operators.control import with_hits
from jsonloom.operators.expand import expand, expand_at
from jsonloom.operators.format import format_documents, format_records
from jsonloom.operators.materialise import expand_again, materialise, materialise_records, node_values
from jsonloom.operators.records import document_stats, parse, parse_lines
from jsonloom.operators.render import document_texts, format_record_texts, record_texts, value_texts
from jsonloom.operators.restore import restore_all
from jsonloom.operators.view import visible_rows
from jsonloom.operators.wanted import Wanted
from test_expand import TRAPS, nested


#: Without the deep ones, so that a plan of LEVELS levels does.
SHALLOW = {name: text for name, text in TRAPS.items() if name not in ("deep", "deeper")}
LEVELS = 7


def random_texts(n=120, seed=8):
    rnd = random.Random(seed)

    def value(d):
        if d == 0 or rnd.random() < 0.3:
            return rnd.choice([None, True, 1, 2.5, "x", "12", "", 'a"b', "[", "é😀", "\x01"])
        inner = [value(d - 1) for _ in range(rnd.randint(0, 3))]
        v = inner if rnd.random() < 0.5 else {rnd.choice(["a", "b", "7", "x.y"]) + str(i): x for i, x in enumerate(inner)}
        return json.dumps(v, ensure_ascii=rnd.random() < 0.5) if rnd.random() < 0.4 else v

    return {f"r{i}": json.dumps(value(4)) for i in range(n)}


def exchanges(df):
    """Exchanges in the plan of a frame."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize(("indent", "levels"), [(0, LEVELS), (3, None)])
def test_texts_equal_the_nodes_texts(docs, indent, levels):
    texts = (SHALLOW if levels else TRAPS) | random_texts() | {"bad": "{"}
    records = parse(docs(texts), "json").persist()
    nodes = expand(records, levels=levels).persist()
    want = {r.doc_id: r.json for r in materialise(nodes, indent).collect()}
    got = {r.doc_id: r.json for r in record_texts(records, indent=indent, levels=levels).collect()}
    assert got == want and "bad" not in got
    for name, text in random_texts().items():
        assert json.loads(got[name]) == brute.rebuilt(json.loads(text))
    formatted = {r.doc_id: r.text for r in format_record_texts(records, indent, levels=levels).collect()}
    assert formatted == {r.doc_id: r.text for r in format_records(records, nodes, indent).collect()}
    assert formatted["bad"] == "null"


def test_depth_limit_and_restored_records(docs):
    records = parse(docs(SHALLOW), "json").persist()
    for limit in (2,):
        want = {r.doc_id: r.json for r in materialise(expand(records, limit, levels=LEVELS)).collect()}
        assert {r.doc_id: r.json for r in record_texts(records, max_depth=limit, levels=LEVELS).collect()} == want
    chosen = [("double", "record-1"), ("root", "record-1"), ("nothing", "record-1")]
    want = {r.doc_id: r.json for r in materialise_records(records, expand(records, levels=LEVELS), chosen).collect()}
    assert {r.doc_id: r.json for r in record_texts(records, chosen, levels=LEVELS).collect()} == want
    assert want["root"] == '"[1,2]"'


def test_no_exchange(docs):
    records = parse(docs(SHALLOW), "json")
    assert exchanges(record_texts(records, levels=3)) == 0
    assert exchanges(value_texts(records, "$.a.b", levels=3)) == 0
    assert exchanges(document_texts(docs(SHALLOW), levels=3)) == 0
    assert exchanges(expand(records, levels=3, only=[["a"]])) == 0
    assert exchanges(visible_rows(expand(records, levels=3), ["$.a"])) == 0


def test_too_deep(docs):
    with pytest.raises(Exception, match="deeper than 3 levels"):
        record_texts(parse(docs({"a": nested(5)}), "json"), levels=3).collect()
    deep = nested(14)
    got = record_texts(parse(docs({"a": deep}), "json")).collect()[0].json  # passes, as deep as it takes
    assert json.loads(got) == brute.rebuilt(json.loads(deep))


def test_whole_documents(docs):
    texts = {name: SHALLOW[name] for name in ("empty", "numbers", "root")} | {
        "lines": '{"a":"[1]"}\r\n\n{"b":2}\n', "broken": '{"a":"[1]"}\n{\n"2"', "blank": " \n", "bad": "{", "long": "[" + "1," * 5000 + "1]",
    }
    frame = docs(texts)
    for forced in (None, "json", "jsonl"):
        records = parse(frame, forced)
        want = format_documents(frame, records, expand(records, levels=3), 1, forced)
        got = document_texts(frame, forced, 1, levels=3)
        assert {r.doc_id: r.text for r in got.collect()} == {r.doc_id: r.text for r in want.collect()}, forced


def test_null_texts_are_blank(spark):
    frame = spark.createDataFrame([("n", None), ("b", " \t"), ("x", "1")], "doc_id string, text string")
    for forced in (None, "json", "jsonl"):
        stats = {r.doc_id: (r.total, r.success, r.failed) for r in document_stats(frame, forced).collect()}
        assert stats == {"n": (0, 0, 0), "b": (0, 0, 0), "x": (1, 1, 0)}, forced
        assert [r.doc_id for r in parse(frame, forced).collect()] == ["x"]
        empty = "" if forced == "jsonl" else "null"
        assert {r.doc_id: r.text for r in document_texts(frame, forced, levels=2).collect()} == {"n": empty, "b": empty, "x": "1"}
    lines = frame.withColumn("line_number", F.lit(1))
    assert [r.doc_id for r in parse_lines(lines).collect()] == ["x"]


# --- wanted paths ----------------------------------------------------------------

PATTERNS = [[["a"]], [["*", "b"]], [["a", "*"], ["*", "c", "0"], ["a.b"]], [[]], [["nowhere"]]]


def leads_to(path, pattern):
    return len(path) > len(pattern) and all(p in ("*", s) for p, s in zip(pattern, path[1:], strict=False))


@pytest.fixture(scope="module")
def everything(spark):
    texts = spark.createDataFrame(list((SHALLOW | random_texts(60)).items()), "doc_id string, text string")
    records = parse(texts, "json").persist()
    return records, expand(records, levels=LEVELS).persist()


@pytest.mark.parametrize(("patterns", "levels"), [*((p, LEVELS) for p in PATTERNS), (PATTERNS[2], None)])
def test_only_wanted_nodes(everything, patterns, levels):
    records, nodes = everything
    columns = ("doc_id", "ord", "path", "kind", "raw_string", "n_children", "layers", "str_value")
    want = (r for r in map(tuple, nodes.select(*columns).collect()) if any(leads_to(r[2], p) for p in patterns))
    want = list(want)
    got = sorted(map(tuple, expand(records, levels=levels, only=patterns).select(*columns).collect()), key=repr)
    assert got == sorted(want, key=repr)


def test_automaton():
    wanted = Wanted([["a", "b"], ["*", "c"]])
    a = wanted.edges[wanted.start]["a"]
    assert wanted.edges[a] == {"b": 0, "c": 0} and wanted.others[a] == -1
    assert wanted.edges[wanted.others[wanted.start]] == {"c": 0}
    assert Wanted([[]]).start == 0 and wanted.levels == 2
    with pytest.raises(ValueError, match="at least one"):
        Wanted([])


def test_unwanted_containers_stay_shut(docs):
    deep = '{"way":{"x":"[7]"},"beside":' + nested(14) + "}"  # beside the way it may be as deep as it likes
    got = expand(parse(docs({"d": deep}), "json"), levels=4, only=[["way"]]).collect()
    assert sorted(r.path_text for r in got) == ["$.way", "$.way.x", "$.way.x[0]"]


@pytest.mark.parametrize("wanted", ["$", "$.a.b", "$[1]", "$.i.ü"])
def test_values_and_expanding_again(everything, wanted):
    records, nodes = everything
    want = sorted((r.doc_id, r.json) for r in node_values(nodes, wanted, 1).collect())
    assert sorted((r.doc_id, r.json) for r in value_texts(records, wanted, 1, levels=LEVELS).collect()) == want, wanted
    columns = ("doc_id", "ord", "path", "kind", "str_value", "num_value", "raw_string", "n_children", "layers")
    # An infinite number survives only where no text is rebuilt on the way.
    finite = F.col("doc_id") != "numbers"
    again = expand_again(nodes.where(finite), wanted, levels=LEVELS).select(*columns).collect()
    got = expand_at(records.where(finite), wanted, levels=LEVELS).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr), wanted


# --- control sets ------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [True, False])
def test_dictionary_of_chains(spark, everything, monkeypatch, broadcast):
    from jsonloom.operators import control

    if not broadcast:
        monkeypatch.setattr(control, "DICTIONARY_BYTES", -1)
    nodes = restore_all(everything[1]).unionByName(everything[1])
    paths = sorted({p for r in nodes.select("stringified_chain").collect() for p in r[0]})[::2]
    as_frame = spark.createDataFrame([(p,) for p in [*paths, None, *paths]], "p string")
    small = with_hits(nodes, F.col("stringified_chain"), paths, "hits")
    large = with_hits(nodes, F.col("stringified_chain"), as_frame, "hits")
    assert large.columns == small.columns == [*nodes.columns, "hits"]
    key = lambda r: (r.doc_id, list(r.ord), r.was_stringified, sorted(r.hits))
    want = sorted(map(key, small.collect()))
    assert sorted(map(key, large.collect())) == want and any(x[3] for x in want)
    many = [*paths, *(f"$.none{i}" for i in range(3000))]
    assert sorted(map(key, with_hits(nodes, F.col("stringified_chain"), many, "hits").collect())) == want
    assert not any(r.hits for r in with_hits(nodes, F.col("stringified_chain"), [], "hits").collect())
    if broadcast:
        assert "Exchange hash" not in large._jdf.queryExecution().executedPlan().toString()  # rows stay where they are
