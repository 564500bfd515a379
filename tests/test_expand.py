import json
import random

import pytest
from pyspark.sql import functions as F

import brute
from jsonloom.functions.paths import node_shape, shape_text
from jsonloom.operators.expand import expand
from jsonloom.operators.flatten import flatten
from jsonloom.operators.materialise import expand_again, materialise, node_values
from jsonloom.operators.records import parse
from jsonloom.operators.restore import restore_all, restore_paths
from jsonloom.operators.view import visible_nodes


def nodes_of(nodes):
    rows = nodes.select("doc_id", "ord", "path_text", "kind", "raw_string", "stringified_chain").collect()
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(
            (tuple(r.ord), r.path_text, r.kind, r.raw_string, tuple(r.stringified_chain))
        )
    return {k: sorted(v) for k, v in out.items()}


def nested(depth):
    """Objects within objects, ``depth`` of them, around a string with JSON."""
    return json.dumps({"a": json.loads(nested(depth - 1))} if depth else {"s": '{"x":1}'})


TRAPS = {
    "scalars": '{"n":"42","t":" true ","z":"null","s":"plain","e":"","w":"  "}',
    "double": json.dumps({"a": json.dumps(json.dumps({"k": 1})), "b": json.dumps({"c": json.dumps([1, "2"])})}),
    "root": '"[1,2]"',
    "spaces": json.dumps({"a": "\xa0﻿{\"x\": 1} ", "b": "\x0b1"}),
    "keys": '{"b":1,"10":2,"2":3,"01":4,"a":5,"b":6,"4294967295":7,"4294967294":8,"":9}',
    "dots": '{"a.b":"[1]","a":{"b":"[2]","0":"x"}}',
    "numbers": '[1.0,1e21,1e-7,1e400,-0,12345678901234567890,0.1,"1e400"]',
    "deep": nested(9),
    "deeper": nested(14),
    "empty": '{"a":{},"b":[],"c":"{}","d":"[]"}',
    "quotes": json.dumps({'k"\\': 'a"\\b', "j": json.dumps({'x"': "\\\"s\"'"})}),
    "unicode": json.dumps({"é😀": " ", "i": json.dumps({"ü": "😀"})}, ensure_ascii=False),
}


@pytest.mark.parametrize("levels", [17, None])
def test_nodes_match_brute_force(docs, levels):
    got = nodes_of(expand(parse(docs(TRAPS), "json"), levels=levels))
    for name, text in TRAPS.items():
        assert got[name] == sorted(brute.walk(json.loads(text))), name


def test_depth_limit(docs):
    for limit in (-1, 2):
        got = nodes_of(expand(parse(docs(TRAPS), "json"), max_depth=limit, levels=17))
        for name, text in TRAPS.items():
            assert got[name] == sorted(brute.walk(json.loads(text), limit)), (limit, name)


def test_random_documents(docs):
    rnd = random.Random(5)

    def value(d):
        if d == 0 or rnd.random() < 0.3:
            return rnd.choice([None, True, 1, 2.5, "x", "12", "", "a\"b", "[", "é😀"])
        inner = [value(d - 1) for _ in range(rnd.randint(0, 3))]
        v = inner if rnd.random() < 0.5 else {rnd.choice(["a", "b", "7", "x.y"]) + str(i): x for i, x in enumerate(inner)}
        return json.dumps(v, ensure_ascii=rnd.random() < 0.5) if rnd.random() < 0.4 else v

    texts = {str(i): json.dumps(value(5)) for i in range(150)}
    nodes = expand(parse(docs(texts), "json")).persist()
    got = nodes_of(nodes)
    rebuilt = {r.doc_id: r.json for r in materialise(nodes).collect()}
    original = {r.doc_id: r.json for r in materialise(restore_all(nodes)).collect()}
    for name, text in texts.items():
        assert got[name] == sorted(brute.walk(json.loads(text))), text
        assert json.loads(rebuilt[name]) == brute.rebuilt(json.loads(text)), text
        assert json.loads(original[name]) == json.loads(text), text
    nodes.unpersist()


def test_too_few_levels_is_an_error(docs):
    with pytest.raises(Exception, match="deeper than 3 levels"):
        expand(parse(docs({"a": nested(5)}), "json"), levels=3).count()
    with pytest.raises(Exception, match="deeper than 3 levels"):
        expand(parse(docs({"a": nested(5)}), "json"), levels=3).select("path_text").collect()


def test_materialised_text(docs):
    texts = {
        "order": '{"b":"{\\"y\\":1.0}","2":[],"1":{}}', "inf": '{"a":1e400,"b":-0,"c":"\\u001f"}',
        "pretty": '{"a":[1,{"b":"[true]"}],"c":null}',
    }
    nodes = expand(parse(docs(texts), "json"), levels=6)
    compact = {r.doc_id: r.json for r in materialise(nodes).collect()}
    assert compact["order"] == '{"1":{},"2":[],"b":{"y":1}}'
    assert compact["inf"] == '{"a":null,"b":0,"c":"\\u001f"}'
    pretty = {r.doc_id: r.json for r in materialise(nodes, 3).collect()}
    assert pretty["pretty"] == json.dumps({"a": [1, {"b": [True]}], "c": None}, indent=3)
    wide = {r.doc_id: r.json for r in materialise(nodes, 99).collect()}
    assert wide["pretty"] == json.dumps({"a": [1, {"b": [True]}], "c": None}, indent=10)


def test_restore_paths(spark, docs):
    text = json.dumps({"p": '{"q":"[1]"}', "a.b": "[1]", "a": {"b": "[2]"}, "plain": 1})
    nodes = expand(parse(docs({"d": text}), "json"), levels=6)

    def kinds(restored):
        rows = restored.select("path", "kind", "was_stringified", "str_value", "n_children").collect()
        return {tuple(r.path): (r.kind, r.was_stringified, r.str_value) for r in rows}

    one = kinds(restore_paths(nodes, [["$", "p"]]))
    assert one[("$", "p")] == ("string", False, '{"q":"[1]"}') and ("$", "p", "q") not in one
    inner = kinds(restore_paths(nodes, [["$", "p", "q"], ["$", "plain"]]))
    assert inner[("$", "p")][0] == "object" and inner[("$", "p", "q")] == ("string", False, "[1]")
    # Joined with dots both paths read the same.
    both = kinds(restore_paths(nodes, [["$", "a", "b"]]))
    assert both[("$", "a.b")][0] == both[("$", "a", "b")][0] == "string"
    assert kinds(restore_paths(nodes, [])) == kinds(nodes)
    many = spark.createDataFrame([("$.p",)] + [(f"$.x{i}",) for i in range(1500)], "path string")
    assert kinds(restore_paths(nodes, many)) == one


def test_expand_again_and_node_values(docs):
    inner = {"k": '{"z":"1"}', "l": [1, "2"]}
    text = json.dumps({"twice": json.dumps(json.dumps(inner)), "once": json.dumps(inner), "n": "5"})
    nodes = expand(parse(docs({"d": text}), "json"), levels=5)
    twice = {r.path_text: r for r in expand_again(nodes, "$.twice", levels=5).collect()}
    assert twice["$.twice"].kind == "object" and twice["$.twice"].was_stringified
    assert twice["$.twice.k.z"].num_value == 1.0
    once = {r.path_text: r for r in expand_again(nodes, "$.once", levels=5).collect()}
    assert not once["$.once"].was_stringified and once["$.once.k"].was_stringified
    assert list(once["$.once.k.z"].stringified_chain) == ["$.once.k", "$.once.k.z"]
    again = {r.path_text: r for r in expand_again(restore_all(nodes), "$.once", levels=5).collect()}
    assert again["$.once"].was_stringified and again["$.once.k"].was_stringified
    number = expand_again(nodes, "$.n", levels=5).collect()
    assert [(r.kind, r.num_value, r.was_stringified) for r in number] == [("number", 5.0, False)]
    assert json.loads(node_values(nodes, "$.once").collect()[0].json) == inner
    assert node_values(nodes, "$.once.k", 0).collect()[0].json == '{"z":"1"}'
    assert node_values(nodes, "$", 0).collect()[0].json == json.dumps(
        json.loads(text), separators=(",", ":")
    )


def test_flatten_reads_what_nodes_hold(docs):
    texts = {
        "a": '{"p":"{\\"k\\": 1.50, \\"l\\":[\\"x\\",\\"{\\\\\\"m\\\\\\":true}\\"]}","0":"zero"}',
        "b": '"{\\"p\\":{\\"k\\":\\"7\\"}}"', "c": "[1]", "d": '{"p":"not json"}', "e": "bad",
    }
    columns = {
        "k": (["p", "k"], "double"), "m": (["p", "l", "1", "m"], "boolean"), "p": (["p"], "kind"),
        "l": (["p", "l"], "string"), "zero": (["0"], "string"), "root": ([], "kind"),
    }
    got = {r.doc_id: r for r in flatten(parse(docs(texts), "json"), columns).collect()}
    assert set(got) == set("abcd")
    a = got["a"]
    assert (a.k, a.m, a.p, a.zero, a.root) == (1.5, True, "object", "zero", "object")
    assert json.loads(a.l) == ["x", '{"m":true}']
    assert (got["b"].k, got["b"].root) == (7.0, "object")
    assert (got["c"].zero, got["c"].root, got["c"].k) == ("1", "array", None)
    assert got["d"].p == "string"


def test_restore_paths_looks_at_keys_only_near_a_path(spark, docs):
    text = json.dumps({"p": '{"q":"[1]"}', "pq": '{"q":"[1]"}', "p.q": "[2]", "x": '{"p":"[3]"}'})
    nodes = expand(parse(docs({"d": text}), "json"), levels=6)
    rows = lambda df: sorted((r.path_text, r.kind, r.num_value or 0) for r in df.collect())
    for paths in ([["$", "p"]], [["$", "p", "q"]], [["$", "pq", "q"], ["$", "x", "p"]]):
        few = restore_paths(nodes, paths)
        frame = spark.createDataFrame([(".".join(p),) for p in paths], "path string")
        assert rows(few) == rows(restore_paths(nodes, frame))
        assert "startswith(array_join(path" in few._jdf.queryExecution().optimizedPlan().toString().lower()


def test_nodes_on_view_are_those_kept_of_all(docs):
    texts = {name: text for name, text in TRAPS.items() if not name.startswith("deep")}
    records = parse(docs(texts), "json")
    nodes = expand(records, levels=5).persist()
    for view in ([], ["$", "$.a", "$.i"], ["$.b", "$.b.c"]):
        assert nodes_of(expand(records, levels=5, view=view)) == nodes_of(visible_nodes(nodes, view)), view
    # a record is opened as far as it shows, so closed parts need no levels
    assert expand(parse(docs({"d": json.dumps({"s": nested(9)})}), "json"), levels=2, view=[]).count() == 2


def test_chains_are_carried_not_cut_out_of_paths(docs):
    nodes = expand(parse(docs(TRAPS), "json"), levels=6)
    plan = nodes.select("stringified_chain")._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(path" not in plan


def test_shapes_of_awkward_keys(docs):
    text = json.dumps({"a[0]": 1, "a": [1, {"b": ["x"]}], "7": {"[1]": [2]}, "]": [[3]], "é.x": [4]})
    nodes = expand(parse(docs({"d": text}), "json"), levels=6)
    shapes = nodes.select(shape_text(F.col("path")).alias("old"), node_shape(F.col("path"), F.col("path_text")).alias("new"))
    rows = shapes.collect()
    assert len(rows) == 15 and all(r.old == r.new for r in rows)
