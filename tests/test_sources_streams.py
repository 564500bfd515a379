import json

from pyspark.sql import functions as F

from jsonloom.operators.expand import expand
from jsonloom.operators.files import parse_files
from jsonloom.operators.format import format_documents, format_records, write_formatted, write_split
from jsonloom.operators.records import line_formats, parse, parse_lines
from jsonloom.plans.reports import nesting_histogram, parse_quality, path_profile
from jsonloom.sources.documents import from_column, read_documents, read_lines
from jsonloom.streaming.streams import stream_matches, stream_nodes, stream_quality, write_matches, write_nodes


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿{\n"p":"[1]"}', encoding="utf8")
    (tmp_path / "b.json").write_text('{"e":1}\n{"e":2}\n', encoding="utf8")
    docs = read_documents(spark, str(tmp_path))
    got = {r.doc_id.rsplit("/", 1)[1]: r.n for r in parse(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"a.json": 1, "b.json": 2}
    assert parse(docs).where("cell is null").count() == 0


def test_format_is_decided_per_file(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    texts = {
        "log.jsonl": '{"e":1}\n\n{"e":2}\n', "pretty.json": '{\n "a": 1\n}', "one.json": '\n[1]\n',
        "broken.jsonl": '{"e":1}\n{bad}\n', "blank.json": " \n",
    }
    for name, text in texts.items():
        (folder / name).write_text(text)

    def found(forced=None):
        rows = parse_files(spark, str(folder), forced).collect()
        return sorted((r.doc_id.rsplit("/", 1)[1], r.line_number, r.format, r.error is None) for r in rows)

    assert found() == [
        ("broken.jsonl", 1, "json", False), ("log.jsonl", 1, "jsonl", True), ("log.jsonl", 3, "jsonl", True),
        ("one.json", 1, "json", True), ("pretty.json", 1, "json", True),
    ]
    assert ("broken.jsonl", 2, "jsonl", False) in found("jsonl")
    assert ("log.jsonl", 1, "json", False) in found("json")


def test_line_numbers_across_splits(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    expected = set()
    for name, ending in (("x", "\n"), ("y", "\r\n")):
        lines = ["" if i % 7 == 3 else json.dumps({"i": i, "pad": "é" * (i % 50), "cr": "a"}) for i in range(1, 3001)]
        lines[0] = "﻿" + lines[0]
        lines[9] = '{"a":1}\r{"b":2}'
        (folder / name).write_bytes((ending.join(lines) + ending).encode("utf8"))
        expected |= {(name, i + 1, line.lstrip("﻿")) for i, line in enumerate(lines)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        frame = read_lines(spark, str(folder))
        assert frame.rdd.getNumPartitions() > 1
        got = {(r.doc_id.rsplit("/", 1)[1], r.line_number, r.text) for r in frame.collect()}
        records = parse_lines(frame)
        bad = [(r.line_number, r.text) for r in records.where("cell is null").collect()]
        formats = {r.format for r in line_formats(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == expected
    assert bad == [(10, '{"a":1}\r{"b":2}')] * 2
    assert formats == {"json"}


def test_formatted_output_and_quarantine(spark, docs, tmp_path):
    d = docs({"j": '{"call":"{\\"args\\":[7]}"}', "l": '{"a":1}\n{a=1}\n[]', "f": "nope", "b": " "})
    records = parse(d, None)
    jsonl = parse(d.where("doc_id = 'l'"), "jsonl")
    text = {r.doc_id: r.text for r in format_documents(d, records, expand(records, levels=4)).collect()}
    assert text["j"] == '{\n  "call": {\n    "args": [\n      7\n    ]\n  }\n}'
    assert (text["f"], text["b"], text["l"]) == ("null", "null", "null")
    lines = format_records(jsonl, expand(jsonl, levels=4))
    write_formatted(lines, str(tmp_path / "out"))
    written = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert written == ["{", '  "a": 1', "}", "/* line 2: Invalid JSON */", "[]"]
    write_split(jsonl, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2
    assert spark.read.parquet(str(tmp_path / "bad")).collect()[0].excerpt == "{a=1}"


def test_ids_of_several_columns(spark):
    df = spark.createDataFrame([("a", 1, "[1]"), ("a", 2, "[2]")], "x string, y int, t string")
    nodes = expand(parse(from_column(df, ["x", "y"], "t"), "json"), levels=3)
    assert nodes.where("doc_id.y = 2").count() == 2


def test_stream_equals_batch(spark, docs, tmp_path):
    texts = {str(i): json.dumps({"i": i, "p": json.dumps({"k": [i, "x"]})}) for i in range(40)}
    source = str(tmp_path / "source")
    docs(texts).withColumn("ts", F.timestamp_seconds(F.col("doc_id").cast("int") * 60)).coalesce(2).write.parquet(source)
    batch = spark.read.parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def run(frame, name, mode="append"):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.table(name)

    columns = ["doc_id", "ord", "path_text", "kind", "raw_string"]
    nodes = expand(parse(batch.select("doc_id", "text")), levels=5)
    want = sorted(nodes.select(*columns).collect(), key=str)
    plain = stream.select("doc_id", "text")
    assert sorted(run(stream_nodes(plain, 5).select(*columns), "s_nodes").collect(), key=str) == want
    assert run(stream_matches(plain, 5, "k").select("path_text"), "s_hits").count() == 40
    quality = run(stream_quality(stream, "ts", "10 minutes", "1 minute"), "s_quality", "complete")
    assert sorted((r.total, r.success, r.failed) for r in quality.collect()) == [(10, 10, 0)] * 4

    out = str(tmp_path / "nodes")
    query = write_nodes(plain, out, str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(120)
    assert sorted(spark.read.parquet(out).select(*columns).collect(), key=str) == want


def test_stream_search_of_deep_records(spark, docs, tmp_path):
    deep = {"needle": [1]}
    for _ in range(8):
        deep = {"a": json.dumps(deep)} if "b" in deep else {"b": deep}
    source = str(tmp_path / "source")
    docs({"deep": json.dumps(deep), "flat": '{"needle": 2}'}).write.parquet(source)
    stream = spark.readStream.schema("doc_id string, text string").parquet(source)
    query = stream_matches(stream, 3, "needle").writeStream.format("memory").queryName("deep_hits").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {(r.doc_id, r.unopened) for r in spark.table("deep_hits").collect()} == {("deep", True), ("flat", False)}
    out = str(tmp_path / "matches")
    write_matches(stream, out, str(tmp_path / "cp"), "needle", available_now=True).awaitTermination(120)
    assert sorted((r.doc_id, r.key_label) for r in spark.read.parquet(out).collect()) == [("deep", "needle"), ("flat", "needle")]
    assert write_matches(stream, out, str(tmp_path / "cp2"), "") is None


def test_reports(docs):
    d = docs({"a": '{"p":"{\\"q\\":[1,\\"2\\"]}"}', "b": "[1]", "c": "x"})
    records = parse(d)
    nodes = expand(records, levels=5)
    quality = {r.doc_id: (r.total, r.failed) for r in parse_quality(records, "doc_id", subtotals=True).collect()}
    assert quality == {"a": (1, 0), "b": (1, 0), "c": (1, 1), None: (3, 1)}
    shape = {r.path_shape: (r.nodes, r.n_number, r.stringified) for r in path_profile(nodes).collect()}
    assert shape["$.p.q[*]"] == (2, 2, 1) and shape["$[*]"] == (1, 1, 0)
    histogram = {(r.string_layers, r.max_depth): r.records for r in nesting_histogram(nodes).collect()}
    assert histogram == {(2, 3): 1, (0, 1): 1}
