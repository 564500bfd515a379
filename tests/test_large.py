import json

import pytest
from pyspark.sql import functions as F

from jsonloom.operators.expand import expand
from jsonloom.operators import files
from jsonloom.operators.files import TOO_LARGE, expand_files, parse_files
from jsonloom.operators.format import write_formatted
from jsonloom.operators.large import expand_large
from jsonloom.operators.records import parse
from jsonloom.sources.documents import read_documents

COLUMNS = ["doc_id", "record_id", "source_line", "ord", "path", "path_text", "depth", "kind", "str_value", "num_value", "n_children",
           "raw_string", "was_stringified", "member", "layers", "stringified_chain"]
GOOD = {
    "array": json.dumps([{"i": i, "p": json.dumps({"k": [i, "x,y"]}), "t": "a,]}\\\"[{," * (i % 4)} for i in range(120)]),
    "object": json.dumps({f"k{i}": [i, {"s": 'q"," ,[', "é": "\\"}] for i in range(60)}, indent=1),
    "keys": '﻿ {"b":1,"10":2, "2":3,"01":4,"b":{"x":"[5]"},"a":6} \n',
    "empty": " [ ] ", "none": "{}", "one": "[1]", "comma": '[","]', "pair": '{"a,b":"c,d"}', "quote": '["\\\\",",\\"",[[],{}]]',
}
BAD = {
    "trailing": "[1,]", "after": "[1] 2", "two": "[1],[2]", "twins": "[1][2]", "open": "[1,2", "string": '["a,b]', "cross": "[1,2}",
    "lead": "[,1]", "double": "[1,,2]", "key": '{"a":1,2}', "ends": '{"a":1},', "scalar": "12", "blank": " \n", "text": '"a,b"',
}


@pytest.mark.parametrize("size", ["300", "100000"])
def test_elements_over_splits(spark, tmp_path, size):
    for name, text in (GOOD | BAD).items():
        (tmp_path / f"{name}.json").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        nodes, failed = expand_large(spark, str(tmp_path), levels=6)
        got = sorted(map(repr, nodes.select(*COLUMNS).collect()))
        wrong = {r.doc_id.rsplit("/", 1)[1] for r in failed.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = read_documents(spark, [str(tmp_path / f"{n}.json") for n in GOOD])
    want = expand(parse(whole, "json"), levels=6)
    assert got == sorted(map(repr, want.select(*COLUMNS).collect()))
    assert wrong == {f"{n}.json" for n in BAD}


def test_files_of_any_size_have_the_same_nodes(spark, tmp_path):
    texts = {"big.json": GOOD["array"], "small.json": '{"a":"[1]"}', "log.jsonl": '{"e":1}\n[2]\n', "bad.json": BAD["cross"] + " " * 400}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rows = lambda pair: tuple(sorted(map(repr, x.collect())) for x in (pair[0].select(*COLUMNS), pair[1]))
    want = rows(expand_files(spark, str(tmp_path), levels=6))
    assert rows(expand_files(spark, str(tmp_path), levels=6, row_bytes=300)) == want and "bad.json" in want[1][0]
    forced = rows(expand_files(spark, str(tmp_path), "json", levels=6))
    assert rows(expand_files(spark, str(tmp_path), "json", levels=6, row_bytes=300)) == forced
    assert {r.error for r in parse_files(spark, str(tmp_path), row_bytes=300).collect()} == {None, TOO_LARGE}


def test_names_of_documents_stay_out_of_the_plan(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"single{i}.json").write_text('{\n "a": 1\n}\n')
        (tmp_path / f"lines{i}.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    records = parse_files(spark, str(tmp_path))
    assert "single7.json" not in records._jdf.queryExecution().analyzed().toString()
    assert sorted(r.format for r in records.collect()) == ["json"] * 30 + ["jsonl"] * 60


def test_large_files_of_lines_are_not_read_as_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PRUNED_BYTES", 10)
    (tmp_path / "one.json").write_text('{\n "a": 1\n}\n')
    (tmp_path / "two.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert sorted(r.format for r in parse_files(spark, str(tmp_path)).collect()) == ["json", "jsonl", "jsonl"]


def test_written_texts_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return f"line {i}"

    rows = spark.range(40, numPartitions=4).select(
        F.lit("d").alias("doc_id"), F.col("id").alias("line_number"), F.udf(text, "string")("id").alias("text")
    )
    write_formatted(rows, str(tmp_path / "out"))
    assert made.value == 40
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).orderBy(F.monotonically_increasing_id()).collect()][0] == "line 0"
