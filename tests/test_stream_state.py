import json

import pytest
from pyspark.sql import functions as F

from jsonloom.operators.expand import expand
from jsonloom.operators.files import parse_files
from jsonloom.operators.records import parse
from jsonloom.streaming.changes import ROCKS_DB, current_nodes, write_changes
from jsonloom.streaming.files import literal_path, write_file_nodes

COLUMNS = ["doc_id", "ord", "path_text", "kind", "str_value", "num_value", "raw_string"]


def rows_of(nodes):
    return sorted(map(repr, nodes.select(*COLUMNS).collect()))


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_changed_documents(rocks, tmp_path):
    spark, source, out = rocks, tmp_path / "in", str(tmp_path / "out")
    text = lambda x: json.dumps({"p": json.dumps({"k": x})})
    steps = [
        [("a", 1, text(1)), ("b", 1, text(1)), ("c", 1, text(1)), ("gone", 1, None)],
        [("a", 2, text(1)), ("b", 2, text(2)), ("c", 2, None)],  # a repeat, an update, a delete
        [("a", 1, text(9)), ("b", 3, text(3)), ("b", 4, text(2)), ("d", 1, "not json"), ("d", None, "x")],  # late, several
        [("c", 3, text(7)), ("a", 5, text(5))],
    ]
    schema = "doc_id string, version bigint, text string"
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        write_changes(stream, out, str(tmp_path / "cp"), available_now=True).awaitTermination(120)  # each a restart
    last = [("a", text(5)), ("b", text(2)), ("c", text(7)), ("d", "not json")]
    want = expand(parse(spark.createDataFrame(last, "doc_id string, text string")), levels=4)
    assert rows_of(current_nodes(spark, out)) == rows_of(want)
    changes = spark.read.parquet(f"{out}/changes").collect()
    seen = sorted((r.doc_id, r.version, r.withdraws, r.text is None) for r in changes if r.doc_id in "abc")
    assert seen == [
        ("a", 1, None, False), ("a", 5, 1, False), ("b", 1, None, False), ("b", 2, 1, False),
        ("c", 1, None, False), ("c", 2, 1, True), ("c", 3, None, False),
    ]
    expanded = spark.read.parquet(f"{out}/nodes").select("doc_id", "version").distinct().collect()
    assert ("a", 2) not in {tuple(r) for r in expanded}  # what did not change was not expanded


def test_files_on_a_stream(spark, tmp_path):
    folder, out = tmp_path / "in [x]", str(tmp_path / "out")
    folder.mkdir()
    first = {
        "log.jsonl": "\n".join(json.dumps({"i": i, "p": json.dumps([i])}) for i in range(400)) + "\n",
        "pretty {1}.json": '{\r\n "a": "[1]"\r\n}\r\n', "broken.jsonl": '{"e":1}\n{bad}\n',
    }
    later = {"more.jsonl": "﻿[1]\n\n[2]\n", "one.json": '"[\\"3\\"]"', "empty.json": ""}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for texts in (first, later):
            for name, text in texts.items():
                (folder / name).write_bytes(text.encode())
            query = write_file_nodes(spark, literal_path(str(folder)), out, str(tmp_path / "cp"), max_files=2, available_now=True)
            query.awaitTermination(200)
        want = expand(parse_files(spark, literal_path(str(folder))), levels=4)
        assert rows_of(spark.read.parquet(out)) == rows_of(want)
        lines = spark.read.parquet(out).where(F.col("doc_id").endswith("log.jsonl")).select("source_line").distinct()
        assert sorted(r[0] for r in lines.collect()) == list(range(1, 401))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_whole_texts_are_read_as_they_are(spark, tmp_path):
    texts = {"a.json": b"not json\r\nhere\r\n", "b.json": b'{\r\n"a": 1\r\n}\r\n', "c d.json": "﻿{\n".encode()}
    for name, raw in texts.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.doc_id.rsplit("/", 1)[1]: r.text for r in parse_files(spark, str(tmp_path)).collect()}
    assert got == {"a.json": "not json\r\nhere\r\n", "b.json": '{\r\n"a": 1\r\n}\r\n', "c%20d.json": "{\n"}
