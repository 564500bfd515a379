"""The registered queries and, where SQL can say the same, their oracles.

Results hold plain columns only; ranges and paths are written as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.config import scratch_path
from jsonloom.functions.cells import is_json
from jsonloom.functions.paths import shape_text
from jsonloom.functions.text import js_number, utf16_length
from jsonloom.operators.expand import expand, expand_at
from jsonloom.operators.files import parse_files
from jsonloom.operators.flatten import flatten
from jsonloom.operators.format import write_formatted
from jsonloom.operators.labels import key_label, value_label
from jsonloom.operators.materialise import materialise, materialise_records
from jsonloom.operators.records import (
    detect_format,
    document_stats,
    has_many_records,
    parse,
    parse_lines,
    quarantine,
    record_stats,
    summaries,
    table_of_contents,
)
from jsonloom.operators.render import document_texts, format_record_texts, record_texts, value_texts
from jsonloom.operators.restore import restore_all, restore_paths
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
    rows_page,
    stringified_paths,
    visible_rows,
)
from jsonloom.plans import inputs
from jsonloom.plans.reports import (
    nesting_histogram,
    parse_quality,
    path_profile,
    top_paths,
    top_records,
)
from jsonloom.sources.documents import from_column, split_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- shared inputs -------------------------------------------------------------


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(inputs.event_log(spark, sf_dir))


def event_nodes(spark: SparkSession, sf_dir: str, view: list[str] | None = None) -> DataFrame:
    return expand(event_records(spark, sf_dir), levels=4, view=view)


def call_nodes(spark: SparkSession, sf_dir: str, max_depth: int = 10, view: list[str] | None = None) -> DataFrame:
    return expand(parse(inputs.order_calls(spark, sf_dir), "json"), max_depth, levels=5, view=view)


def ranges_text(ranges: str) -> Column:
    return F.array_join(
        F.transform(ranges, lambda r: F.concat_ws("-", r["start"], r["end"])), ","
    )


EVENT = """
ev AS (
  SELECT event_id + 1 AS line, event_type, user_id, value, props,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
              ELSE CAST(value AS VARCHAR) END AS value_text
  FROM events),
ev_nodes AS (
  SELECT line, 0 AS pos, '$' AS path_text, '$' AS key_label, '{4}' AS label, 'object' AS kind FROM ev
  UNION ALL SELECT line, 1, '$.event', 'event', '"' || event_type || '"', 'string' FROM ev
  UNION ALL SELECT line, 2, '$.user_id', 'user_id', CAST(user_id AS VARCHAR), 'number' FROM ev
  UNION ALL SELECT line, 3, '$.value', 'value', value_text, 'number' FROM ev
  UNION ALL SELECT line, 4, '$.props', 'props', '{1}', 'object' FROM ev
  UNION ALL SELECT line, 5, '$.props.k', 'k', CAST(k AS VARCHAR), 'number' FROM ev)
"""
EVENT_TEXT = """
'{"event":"' || event_type || '","user_id":' || user_id || ',"value":' || value_text || ',"props":'
"""
BLOB = """
bl AS (
  SELECT event_id, event_id // 40 AS doc_id,
         event_id % 17 = 0 AND (event_id // 40) % 3 <> 0 AS bad,
         event_type, user_id, props,
         CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
              ELSE CAST(value AS VARCHAR) END AS value_text,
         row_number() OVER w + coalesce(sum(CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END)
           OVER (PARTITION BY event_id // 40 ORDER BY event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_number,
         '{"event":"' || event_type || '","user_id":' || user_id || ',"value":'
           || CAST(value AS VARCHAR) || ',"props":' || CAST(to_json(props) AS VARCHAR) || '}' AS text
  FROM events WINDOW w AS (PARTITION BY event_id // 40 ORDER BY event_id))
"""
CALLS = """
calls AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, i
  FROM orders, LATERAL (SELECT unnest(range(1, CAST(2 + o_orderkey % 5 AS BIGINT))) AS i))
"""


# --- flagship, sources, parsing -------------------------------------------------


@register(
    "expand_events_k",
    "SELECT event_id + 1 AS line_number, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events",
)
def expand_events_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inner ``k`` of every event, out of the string that holds it."""
    flat = flatten(event_records(spark, sf_dir), {"k": (["props", "k"], "double")})
    return flat.select("line_number", "k")


@register(
    "strict_validity",
    """SELECT 'documents' AS source, count(*) AS texts, count(*) FILTER (json_valid(text)) AS valid FROM documents
       UNION ALL SELECT 'conversations', count(*), count(*) FILTER (json_valid(text)) FROM conversations
       UNION ALL SELECT 'pages', count(*), count(*) FILTER (json_valid(html)) FROM pages
       UNION ALL SELECT 'events', count(*), count(*) FILTER (json_valid(props)) FROM events""",
)
def strict_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each table are JSON."""
    columns = {"documents": "text", "conversations": "text", "pages": "html", "events": "props"}
    parts = [
        inputs.table(spark, sf_dir, name, column).agg(
            F.lit(name).alias("source"),
            F.count("*").alias("texts"),
            F.count_if(is_json(column)).alias("valid"),
        )
        for name, column in columns.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@register(
    "plain_text_invalid",
    """SELECT doc_id, 'Parse error' AS excerpt, 'Invalid JSON' AS error FROM documents
       WHERE trim(text) <> ''""",
)
def plain_text_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantine of documents that are prose."""
    docs = from_column(inputs.table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return quarantine(parse(docs, "json"))[1].select("doc_id", "excerpt", "error")


@register(
    "prose_lines",
    r"""WITH l AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)
        SELECT doc_id, CAST(line_number AS BIGINT) AS line_number,
               left(rtrim(line, chr(13)), 72) AS excerpt
        FROM l WHERE trim(line, ' ' || chr(9) || chr(10) || chr(13)) <> ''""",
)
def prose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prose line as a failed JSON Lines record, with number and excerpt."""
    docs = from_column(inputs.table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return quarantine(parse(docs, "jsonl"))[1].select("doc_id", "line_number", "excerpt")


@register(
    "jsonl_tolerant_stats",
    f"""WITH {BLOB}
    SELECT doc_id, 'jsonl' AS format, count(*) AS total, count(*) FILTER (NOT bad) AS success,
           count(*) FILTER (bad) AS failed FROM bl GROUP BY doc_id""",
)
def jsonl_tolerant_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_stats(inputs.event_blobs(spark, sf_dir), "jsonl")


@register(
    "line_source_stats",
    f"""WITH {BLOB}
    SELECT doc_id, count(*) AS total, count(*) FILTER (NOT bad) AS success,
           count(*) FILTER (bad) AS failed FROM bl GROUP BY doc_id""",
)
def line_source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts as a mergeable aggregate over lines."""
    return record_stats(parse_lines(split_lines(inputs.event_blobs(spark, sf_dir))))


@register(
    "auto_format",
    f"""WITH {BLOB}
    SELECT doc_id, CASE WHEN bool_or(bad) OR count(*) < 2 THEN 'json' ELSE 'jsonl' END AS format,
           CASE WHEN bool_or(bad) THEN 1 ELSE count(*) END AS total,
           CASE WHEN bool_or(bad) THEN 0 ELSE count(*) END AS success,
           CASE WHEN bool_or(bad) THEN 1 ELSE 0 END AS failed,
           NOT bool_or(bad) AND count(*) > 1 AS multi_record
    FROM bl GROUP BY doc_id""",
)
def auto_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic format: one bad line makes the whole text a JSON document."""
    return has_many_records(document_stats(inputs.event_blobs(spark, sf_dir)))


@register(
    "detect_formats",
    f"""WITH {BLOB}
    SELECT doc_id, CASE WHEN bool_or(bad) OR count(*) < 2 THEN 'json' ELSE 'jsonl' END AS format
    FROM bl GROUP BY doc_id""",
)
def detect_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = inputs.event_blobs(spark, sf_dir)
    return blobs.select("doc_id", detect_format("text").alias("format"))


@register(
    "blob_records_auto",
    f"""WITH {BLOB}, fmt AS (SELECT doc_id, bool_or(bad) AS broken FROM bl GROUP BY doc_id)
    SELECT doc_id, line_number, 'record-' || line_number AS record_id, TRUE AS ok
    FROM bl JOIN fmt USING (doc_id) WHERE NOT broken
    UNION ALL SELECT doc_id, 1, 'record-1', FALSE FROM fmt WHERE broken""",
)
def blob_records_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = parse(inputs.event_blobs(spark, sf_dir))
    return records.select(
        "doc_id", "line_number", "record_id", F.col("cell").isNotNull().alias("ok")
    )


@register(
    "toc",
    f"""WITH {BLOB}
    SELECT doc_id, line_number, CASE WHEN bad THEN 'err' ELSE 'ok' END AS state,
           CASE WHEN bad THEN left(text, CAST(least(72, length(text) - 1) AS BIGINT))
                ELSE 'event:' || event_type END AS summary
    FROM bl""",
)
def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table of contents of tolerant JSON Lines, blank lines counted."""
    return table_of_contents(parse(inputs.event_blobs(spark, sf_dir), "jsonl"))


@register(
    "summary_named",
    "SELECT event_id + 1 AS line_number, 'event:' || event_type AS summary FROM events",
)
def summary_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(event_records(spark, sf_dir)).select("line_number", "summary")


@register("summary_first", "SELECT o_orderkey AS doc_id, 'o_orderkey:' || o_orderkey AS summary FROM orders")
def summary_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a known key the first primitive field is shown."""
    return summaries(parse(inputs.order_calls(spark, sf_dir))).select("doc_id", "summary")


@register(
    "files_read_back",
    """SELECT '$.props.k' AS path_shape, 'jsonl' AS format, count(*) AS nodes,
              sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS total FROM events
       UNION ALL SELECT '$.messages[*].payload.turn', 'json', count(*), CAST(sum(turn) AS DOUBLE) FROM conversations""",
)
def files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log written as JSON Lines and each session as a pretty-printed file, read back
    with the format decided per file."""
    folder = scratch_path(spark, "files")
    write_formatted(format_record_texts(event_records(spark, sf_dir), 0, levels=4), f"{folder}/log")
    sessions = document_texts(inputs.session_log(spark, sf_dir), "json", 2, levels=6)
    # A file for each row, in one folder: a folder for each file would be a task for each in every listing.
    sessions.select("text").write.option("maxRecordsPerFile", 1).text(f"{folder}/sessions")
    records = parse_files(spark, [f"{folder}/log", f"{folder}/sessions"])
    wanted = [["props", "k"], ["messages", "*", "payload", "turn"]]
    # By format, each of which is one branch of the records: every file is parsed once and nodes meet no records.
    nodes = [
        expand(records.where(F.col("format") == name), levels=6, only=wanted).withColumn("format", F.lit(name))
        for name in ("jsonl", "json")
    ]
    found = nodes[0].unionByName(nodes[1]).groupBy(shape_text(F.col("path")).alias("path_shape"), "format")
    return found.agg(F.count("*").alias("nodes"), F.sum("num_value").alias("total"))


# --- expansion -------------------------------------------------------------------


@register(
    "nodes_by_path_kind",
    f"WITH {EVENT} SELECT path_text, kind, count(*) AS n FROM ev_nodes GROUP BY ALL",
)
def nodes_by_path_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = event_nodes(spark, sf_dir)
    return nodes.groupBy("path_text", "kind").agg(F.count("*").alias("n"))


@register(
    "node_table",
    f"""WITH {EVENT}
    SELECT 'record-' || line AS record_id, line AS source_line, path_text, key_label,
           label AS value_label, kind, path_text = '$.props' AS was_stringified,
           kind = 'object' AS expandable,
           CASE WHEN path_text = '$' THEN 0 WHEN path_text = '$.props.k' THEN 2 ELSE 1 END AS depth,
           CASE WHEN path_text LIKE '$.props%' THEN '$.props' ELSE '' END AS chain
    FROM ev_nodes""",
)
def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the event log with their annotations."""
    return event_nodes(spark, sf_dir).select(
        "record_id",
        "source_line",
        "path_text",
        key_label().alias("key_label"),
        value_label().alias("value_label"),
        "kind",
        "was_stringified",
        "expandable",
        "depth",
        F.array_join("stringified_chain", " ").alias("chain"),
    )


@register(
    "nested_array_nodes",
    f"""WITH {CALLS}
    SELECT o_orderkey AS doc_id, '$.items[' || (i - 1) || '].note.rank' AS path_text,
           CAST(i * 10 AS DOUBLE) AS num_value, 2 AS string_layers FROM calls""",
)
def nested_array_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = parse(inputs.order_calls(spark, sf_dir), "json")
    nodes = expand(records, levels=5, only=[["items", "*", "note", "rank"]])
    return nodes.select(
        "doc_id", "path_text", "num_value", F.size("layers").alias("string_layers")
    )


@register(
    "double_layer",
    """WITH t AS (
      SELECT conv_id || '-' || (turn // 16) AS doc_id, role, turn, text,
             row_number() OVER (PARTITION BY conv_id, turn // 16 ORDER BY turn) - 1 AS i
      FROM conversations)
    SELECT doc_id, '$.messages[' || i || '].payload.text' AS path_text, text AS str_value,
           '$.messages $.messages[' || i || '].payload' AS chain FROM t""",
)
def double_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns from two layers of strings, by the open-ended expansion."""
    nodes = expand(parse(inputs.session_log(spark, sf_dir)))
    return nodes.where(F.endswith("path_text", F.lit(".payload.text"))).select(
        "doc_id", "path_text", "str_value", F.array_join("stringified_chain", " ").alias("chain")
    )


@register(
    "double_encoded",
    "SELECT event_id + 1 AS source_line, 'string' AS kind, props AS str_value, TRUE AS was_stringified FROM events",
)
def double_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string encoded twice opens one layer only."""
    nodes = expand(parse_lines(inputs.double_log(spark, sf_dir)), levels=4)
    return nodes.where(F.col("path_text") == "$.props").select(
        "source_line", "kind", "str_value", "was_stringified"
    )


@register(
    "peel_again",
    """SELECT event_id + 1 AS source_line, '$.props.k' AS path_text, 'number' AS kind,
              CAST(json_extract(props, '$.k') AS DOUBLE) AS num_value FROM events
       UNION ALL SELECT event_id + 1, '$.props', 'object', NULL FROM events""",
)
def peel_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding the node again opens the second layer."""
    records = parse_lines(inputs.double_log(spark, sf_dir))
    return expand_at(records, "$.props", levels=4).select(
        "source_line", "path_text", "kind", "num_value"
    )


@register(
    "depth_limit",
    """SELECT o_orderkey AS doc_id, '$.items' AS path_text, FALSE AS was_stringified FROM orders""",
)
def depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit of 0 strings below the root stay closed."""
    nodes = call_nodes(spark, sf_dir, max_depth=0)
    return nodes.where(F.startswith("path_text", F.lit("$.items"))).select(
        "doc_id", "path_text", "was_stringified"
    )


@register(
    "depth_limit_inner",
    f"""WITH {CALLS}
    SELECT o_orderkey AS doc_id, '$.items[' || (i - 1) || '].note' AS path_text, 'string' AS kind,
           '{{"customer":' || o_custkey || ',"rank":' || (i * 10) || '}}' AS str_value FROM calls""",
)
def depth_limit_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit of 1 the array opens and the notes at depth 3 do not."""
    nodes = call_nodes(spark, sf_dir, max_depth=1)
    return nodes.where(F.endswith("path_text", F.lit(".note"))).select(
        "doc_id", "path_text", "kind", "str_value"
    )


@register(
    "key_order",
    """SELECT p_partkey AS doc_id,
              p_size || ',' || (p_size + 100) || ',name,0' || p_size AS keys,
              '"' || p_partkey || '"' AS name_label
       FROM part""",
)
def key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index keys first, repeated keys in first place with the last value."""
    records = parse(inputs.keyed_log(spark, sf_dir))
    entry = F.filter("children", lambda e: e["key"] == "name")
    return records.select(
        "doc_id",
        F.array_join(F.transform("children", lambda e: e["key"]), ",").alias("keys"),
        F.concat(
            F.lit('"'), F.substr(F.get(entry, F.lit(0))["cell"], F.lit(2)), F.lit('"')
        ).alias("name_label"),
    )


# --- restore, materialise, format ------------------------------------------------


@register(
    "restore_all",
    f"""WITH {EVENT}
    SELECT line AS source_line, path_text,
           CASE WHEN path_text = '$.props' THEN 'string' ELSE kind END AS kind,
           CASE WHEN path_text = '$.props' THEN (SELECT any_value(props) FROM ev e WHERE e.line = n.line)
                WHEN kind = 'string' THEN label[2:-2] END AS str_value
    FROM ev_nodes n WHERE path_text <> '$.props.k'""",
)
def restore_all_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    restored = restore_all(event_nodes(spark, sf_dir))
    return restored.select("source_line", "path_text", "kind", "str_value")


@register(
    "restore_paths",
    f"""WITH {CALLS}
    SELECT o_orderkey AS doc_id, '$.items[0].note' AS path_text, 'string' AS kind,
           FALSE AS was_stringified FROM orders
    UNION ALL SELECT o_orderkey, '$.items[' || (i - 1) || '].note', 'object', TRUE
    FROM calls WHERE i > 1
    UNION ALL SELECT o_orderkey, '$.items[' || (i - 1) || '].note.' || unnest(['customer', 'rank']),
                     'number', FALSE FROM calls WHERE i > 1""",
)
def restore_paths_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first note of each order goes back to its string."""
    restored = restore_paths(call_nodes(spark, sf_dir), [["$", "items", "0", "note"]])
    return restored.where(F.contains("path_text", F.lit(".note"))).select(
        "doc_id", "path_text", "kind", "was_stringified"
    )


@register(
    "restore_all_view",
    f"""WITH {BLOB}, fmt AS (SELECT doc_id, bool_or(bad) AS broken FROM bl GROUP BY doc_id),
    ok AS (SELECT bl.* FROM bl JOIN fmt USING (doc_id) WHERE NOT broken)
    SELECT doc_id, 'record-' || line_number AS record_id, CAST(5 AS BIGINT) AS rows,
           '{{"event":"' || event_type || '","user_id":' || user_id || ',"value":' || value_text
             || ',"props":' || CAST(to_json(props) AS VARCHAR) || '}}' AS json
    FROM ok""",
)
def restore_all_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restore-all set as it is, in the row view and in rebuilt records."""
    records = parse(inputs.event_blobs(spark, sf_dir))
    nodes = expand(records, levels=4)
    chosen = restore_all_set(records)
    rows = row_counts(visible_rows(nodes, restored=chosen))
    texts = materialise_records(records, nodes, chosen).where(F.col("json").isNotNull())
    return rows.join(texts, ["doc_id", "record_id"])


@register(
    "restore_one_record",
    f"""WITH {BLOB}, fmt AS (SELECT doc_id, bool_or(bad) AS broken FROM bl GROUP BY doc_id)
    SELECT bl.doc_id, 'record-' || line_number AS record_id,
           '{{"event":"' || event_type || '","user_id":' || user_id || ',"value":' || value_text
             || ',"props":' || CASE WHEN bl.doc_id = 3 AND line_number = 1
                  THEN CAST(to_json(props) AS VARCHAR) ELSE '{{"k":' || json_extract(props, '$.k') || '}}' END
             || '}}' AS json
    FROM bl JOIN fmt USING (doc_id) WHERE NOT broken""",
)
def restore_one_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restoring a record of one document leaves the same record of the others open."""
    records = parse(inputs.event_blobs(spark, sf_dir))
    return record_texts(records, [(3, "record-1")], levels=4).select("doc_id", "record_id", "json")


@register(
    "many_open_paths",
    f"""WITH {EVENT}
    SELECT line AS source_line, count(*) AS rows FROM ev_nodes GROUP BY line""",
)
def many_open_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of open paths as large as the event table, taken from it."""
    events = inputs.table(spark, sf_dir, "events", "event_id")
    paths = events.select(F.concat(F.lit("$.path"), F.col("event_id").cast("string")).alias("path"))
    nodes = event_nodes(spark, sf_dir)
    rows = visible_rows(nodes, paths.union(nodes.where("was_stringified").select("path_text")))
    return rows.groupBy("source_line").agg(F.count("*").alias("rows"))


@register(
    "repeated_ids",
    """SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY conv_id""",
)
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as documents under their conversation's id, rebuilt one by one."""
    turns = inputs.table(spark, sf_dir, "conversations", "conv_id", "text")
    texts = turns.select("conv_id", F.to_json(F.struct("text")).alias("json"))
    nodes = expand(parse(from_column(texts, "conv_id", "json", numbered=True), "json"), levels=3)
    rebuilt = materialise(nodes).select(
        F.col("doc_id.conv_id").alias("conv_id"), F.get_json_object("json", "$.text").alias("text")
    )
    return rebuilt.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars")
    )


@register(
    "blank_documents",
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    l AS (SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279)) <> '' AS shown,
            len(list_filter(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279)) <> '')) AS lines
          FROM t)
    SELECT doc_id, mode, CASE WHEN mode = 'jsonl' THEN lines ELSE shown::INT END AS total,
           CASE WHEN mode = 'jsonl' THEN lines ELSE shown::INT END AS failed
    FROM l, (SELECT unnest(['auto', 'json', 'jsonl']) AS mode)""",
)
def blank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all texts in each format: a blank or null text has none."""
    docs = inputs.table(spark, sf_dir, "documents", "doc_id", "text")
    modes = {"auto": None, "json": "json", "jsonl": "jsonl"}
    parts = [
        document_stats(docs, forced).select("doc_id", F.lit(mode).alias("mode"), "total", "failed")
        for mode, forced in modes.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "primitive_summaries",
    """SELECT p_partkey AS doc_id, CASE p_partkey % 4
           WHEN 0 THEN 'Array(' || (p_partkey % 3 + 1) || ')' WHEN 1 THEN p_name
           WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE 'true' END AS summary FROM part""",
)
def primitive_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of records that are arrays, strings, numbers and booleans."""
    parts = inputs.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    key = F.col("p_partkey")
    text = (
        F.when(key % 4 == 0, F.to_json(F.array_repeat("p_size", (key % 3 + 1).cast("int"))))
        .when(key % 4 == 1, F.concat(F.lit('"'), "p_name", F.lit('"')))
        .when(key % 4 == 2, F.col("p_size").cast("string"))
        .otherwise("true")
    )
    docs = parts.select(key.alias("doc_id"), text.alias("text"))
    return summaries(parse(docs, "json")).select("doc_id", "summary")


@register(
    "materialise_expanded",
    f"""WITH {EVENT}
    SELECT line AS source_line, {EVENT_TEXT} || '{{"k":' || k || '}}}}' AS json FROM ev""",
)
def materialise_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_texts(event_records(spark, sf_dir), levels=4).select("source_line", "json")


@register(
    "materialise_restored",
    f"""WITH {EVENT}
    SELECT 'record-' || line AS record_id,
           {EVENT_TEXT} || CASE WHEN line <= 3 THEN CAST(to_json(props) AS VARCHAR)
                                ELSE '{{"k":' || k || '}}' END || '}}' AS json FROM ev""",
)
def materialise_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three records restored, the others expanded."""
    chosen = [f"record-{n}" for n in (1, 2, 3)]
    return record_texts(event_records(spark, sf_dir), chosen, levels=4).select("record_id", "json")


@register(
    "round_trip",
    """SELECT doc_id, md5(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'text': text}) AS VARCHAR)) AS digest
       FROM documents""",
)
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without inner JSON come back as they went in, whole texts."""
    nodes = expand(parse(inputs.document_log(spark, sf_dir), "json"), levels=2)
    return materialise(nodes).select("doc_id", F.md5("json").alias("digest"))


@register(
    "format_pretty",
    f"""WITH {EVENT}
    SELECT line AS line_number,
      '{{' || chr(10) || '  "event": "' || event_type || '",' || chr(10)
      || '  "user_id": ' || user_id || ',' || chr(10) || '  "value": ' || value_text || ','
      || chr(10) || '  "props": {{' || chr(10) || '    "k": ' || k || chr(10) || '  }}' || chr(10)
      || '}}' AS text
    FROM ev""",
)
def format_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_record_texts(event_records(spark, sf_dir), levels=4).select("line_number", "text")


@register(
    "format_blobs",
    f"""WITH {BLOB}
    SELECT doc_id, string_agg(
      CASE WHEN bad THEN '/* line ' || line_number || ': Invalid JSON */'
           ELSE '{{"event":"' || event_type || '","user_id":' || user_id || ',"value":' || value_text
             || ',"props":{{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}}}}' END,
      chr(10) ORDER BY line_number) AS text
    FROM bl GROUP BY doc_id""",
)
def format_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, failed lines as comments, without indentation."""
    return document_texts(inputs.event_blobs(spark, sf_dir), "jsonl", 0, levels=4)


@register("copy_node", "SELECT event_id + 1 AS source_line, '{' || chr(10) || '  \"k\": ' || CAST(json_extract(props, '$.k') AS BIGINT) || chr(10) || '}' AS json FROM events")
def copy_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unexpanded value of one node, pretty-printed."""
    return value_texts(event_records(spark, sf_dir), "$.props", levels=3).select("source_line", "json")


@register(
    "copy_container",
    f"""WITH {CALLS}
    SELECT o_orderkey AS doc_id, '[' || string_agg('{{"step":' || i || ',"note":"{{\\"customer\\":'
      || o_custkey || ',\\"rank\\":' || (i * 10) || '}}"}}', ',' ORDER BY i) || ']' AS json
    FROM calls GROUP BY o_orderkey""",
)
def copy_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container's value keeps the strings inside it closed."""
    records = parse(inputs.order_calls(spark, sf_dir), "json")
    return value_texts(records, "$.items", 0, levels=3).select("doc_id", "json")


# --- rows --------------------------------------------------------------------------


@register(
    "visible_rows_collapsed",
    f"""WITH {EVENT}
    SELECT line AS source_line, path_text, key_label, label AS value_label,
           path_text <> '$.props' AS expanded FROM ev_nodes WHERE path_text <> '$.props.k'""",
)
def visible_rows_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_rows(event_nodes(spark, sf_dir, view=[])).select(
        "source_line", "path_text", "key_label", "value_label", "expanded"
    )


@register(
    "visible_row_counts",
    """SELECT 'record-' || (event_id + 1) AS record_id,
              CASE WHEN event_id + 1 IN (2, 4) THEN 5 ELSE 6 END AS rows FROM events""",
)
def visible_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on view with the string path opened, two records restored."""
    rows = visible_rows(event_nodes(spark, sf_dir), ["$.props"], ["record-2", "record-4"])
    return row_counts(rows).select("record_id", "rows")


@register(
    "visible_page",
    f"""WITH {EVENT}
    SELECT line AS source_line, pos AS place, path_text, label AS value_label
    FROM ev_nodes WHERE pos BETWEEN 2 AND 4""",
)
def visible_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 2 to 4 of each record's collapsed display."""
    rows = rows_page(visible_rows(event_nodes(spark, sf_dir, view=[])), 2, 3)
    return rows.select("source_line", "place", "path_text", "value_label")


@register(
    "document_match_counts",
    """SELECT doc_id, CASE WHEN contains(CAST(to_json(text) AS VARCHAR), 'the ') THEN 1 ELSE 0 END
           + CASE WHEN contains(lang, 'the ') THEN 1 ELSE 0 END AS matches FROM documents""",
)
def document_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching nodes of every document, zero where there are none."""
    docs = inputs.document_log(spark, sf_dir)
    found = search(expand(parse(docs, "json"), levels=2), "the ", case_sensitive=True)
    return match_counts(found, docs).select("doc_id", F.col("matches").cast("int").alias("matches"))


@register(
    "stringified_paths",
    f"""WITH {CALLS}
    SELECT DISTINCT '$.items[' || (i - 1) || '].note' AS path_text FROM calls
    UNION SELECT '$.items' FROM calls""",
)
def stringified_paths_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stringified_paths(call_nodes(spark, sf_dir, view=["$.items"]), ["$.items"])


@register("expand_all_step", f"WITH {CALLS} SELECT DISTINCT '$.items' AS path_text FROM calls")
def expand_all_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand_all(call_nodes(spark, sf_dir, view=[]))


@register(
    "restore_all_set",
    f"WITH {BLOB} SELECT doc_id, 'record-' || line_number AS record_id FROM bl WHERE NOT bad",
)
def restore_all_set_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore_all_set(parse(inputs.event_blobs(spark, sf_dir), "jsonl"))


# --- search --------------------------------------------------------------------------

_HITS = """SELECT line AS source_line, path_text FROM ev_nodes WHERE """


@register(
    "search_literal",
    f"WITH {EVENT} {_HITS} contains(lower(key_label), 'er') OR contains(lower(label), 'er')",
)
def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(event_nodes(spark, sf_dir), "ER").select("source_line", "path_text")


@register(
    "search_regex",
    f"WITH {EVENT} {_HITS} regexp_matches(label, '^[1-4]\\d?$') OR regexp_matches(key_label, '^[1-4]\\d?$')",
)
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(event_nodes(spark, sf_dir), r"^[1-4]\d?$", regex=True, case_sensitive=True)
    return found.select("source_line", "path_text")


@register(
    "search_path",
    f"""WITH {EVENT} {_HITS} contains(path_text, '$.pro') OR contains(label, '$.pro')""",
)
def search_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are matched as text."""
    found = search(event_nodes(spark, sf_dir), "$.pro", case_sensitive=True, jq=True)
    return found.select("source_line", "path_text")


def _positions(column: str) -> str:
    return (
        f"array_to_string(list_transform(list_filter(range(length({column})), "
        f"lambda i: substr({column}, i + 1, 2) = 'er'), lambda i: i || '-' || (i + 2)), ',')"
    )


@register(
    "search_ranges",
    f"""WITH {EVENT}
    SELECT line AS source_line, path_text, {_positions('key_label')} AS key_ranges,
           {_positions('label')} AS value_ranges, {_positions('path_text')} AS path_ranges
    FROM ev_nodes WHERE contains(label, 'er') OR contains(path_text, 'er')""",
)
def search_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(event_nodes(spark, sf_dir), "er", case_sensitive=True, jq=True)
    return found.select(
        "source_line",
        "path_text",
        ranges_text("key_ranges").alias("key_ranges"),
        ranges_text("value_ranges").alias("value_ranges"),
        ranges_text("path_ranges").alias("path_ranges"),
    )


@register(
    "search_documents",
    """WITH d AS (SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS label FROM documents),
    h AS (SELECT doc_id, label, (length(label) - length(replace(label, 'the ', ''))) // 4 AS hits FROM d)
    SELECT doc_id, '$.text' AS path_text, CAST(hits AS INTEGER) AS hits,
           CAST(strpos(label, 'the ') - 1 AS INTEGER) AS first_start,
           CAST(length(label) - strpos(reverse(label), ' eht') + 1 AS INTEGER) AS last_end
    FROM h WHERE hits > 0""",
)
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in whole texts, every match counted."""
    nodes = expand(parse(inputs.document_log(spark, sf_dir), "json"), levels=2)
    found = search(nodes, "the ", case_sensitive=True)
    ranges = F.col("value_ranges")
    return found.select(
        "doc_id",
        "path_text",
        F.size(ranges).alias("hits"),
        F.get(ranges, F.lit(0))["start"].alias("first_start"),
        F.element_at(ranges, -1)["end"].alias("last_end"),
    )


@register(
    "match_count",
    f"""WITH {EVENT} SELECT count(*) AS matches FROM ev_nodes WHERE label = '"error"'""",
)
def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_counts(search(event_nodes(spark, sf_dir), '"error"')).select("matches")


@register(
    "kth_match",
    f"""WITH {EVENT}, m AS (
      SELECT line, path_text, row_number() OVER (ORDER BY line, pos) - 1 AS i, count(*) OVER () AS n
      FROM ev_nodes WHERE contains(label, 'er') OR contains(key_label, 'er'))
    SELECT line AS source_line, path_text, i AS k FROM m WHERE i = (n + (-3) % n) % n""",
)
def kth_match_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps back from the first match, around the end."""
    found = search(event_nodes(spark, sf_dir), "er", case_sensitive=True)
    return kth_match(found, -3).select("source_line", "path_text", "k")


@register(
    "paths_to_expand",
    f"""WITH {EVENT}
    SELECT DISTINCT '$.props' AS path_text FROM ev_nodes
    WHERE path_text LIKE '$.props%' AND (contains(lower(key_label), 'k') OR contains(lower(label), 'k'))
    UNION SELECT '$.other' FROM events UNION SELECT '$.props' FROM events""",
)
def paths_to_expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths_to_expand(search(event_nodes(spark, sf_dir), "k"), ["$.other", "$.props"])


@register(
    "record_matches",
    f"""WITH {EVENT}
    SELECT 'record-' || line AS record_id, path_text, label AS value_label FROM ev_nodes
    WHERE contains(label, 'er') OR contains(key_label, 'er')""",
)
def record_matches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(event_nodes(spark, sf_dir), "er", case_sensitive=True)
    return record_matches(found).select("record_id", "path_text", "value_label")


@register(
    "last_match_wins",
    """SELECT o_orderkey AS doc_id, '$.a.b' AS path_text, '"' || o_orderstatus || '-late"' AS value_label
       FROM orders""",
)
def last_match_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nodes of a record with the same path text: the later match counts."""
    orders = inputs.table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    status = F.col("o_orderstatus")
    text = F.concat(
        F.lit('{"a.b":"'), status, F.lit('-early","a":{"b":"'), status, F.lit('-late"}}')
    )
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    found = search(expand(parse(docs, "json"), levels=3), "-", case_sensitive=True)
    return record_matches(found).select("doc_id", "path_text", "value_label")


@register(
    "highlight",
    f"""WITH {EVENT}
    SELECT line AS source_line, path_text, replace(key_label, 'er', '<er>') AS key_shown,
           replace(label, 'er', '<er>') AS value_shown
    FROM ev_nodes WHERE contains(label, 'er') OR contains(key_label, 'er')""",
)
def highlight_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(event_nodes(spark, sf_dir), "er", case_sensitive=True)
    marked = highlight(found, build_pattern(spark, "er", case_sensitive=True))

    def shown(column: str) -> Column:
        return F.array_join(
            F.transform(
                column,
                lambda s: F.when(
                    s["marked"], F.concat(F.lit("<"), s["text"], F.lit(">"))
                ).otherwise(s["text"]),
            ),
            "",
        )

    return marked.select(
        "source_line",
        "path_text",
        shown("key_segments").alias("key_shown"),
        shown("value_segments").alias("value_shown"),
    )


# --- reports ----------------------------------------------------------------------


@register(
    "parse_quality",
    f"""WITH {BLOB}
    SELECT doc_id % 3 AS batch, doc_id % 2 AS half, count(*) AS total,
           count(*) FILTER (NOT bad) AS success, count(*) FILTER (bad) AS failed
    FROM bl GROUP BY ROLLUP (doc_id % 3, doc_id % 2)""",
)
def parse_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = parse(inputs.event_blobs(spark, sf_dir), "jsonl")
    doc = F.col("doc_id")
    return parse_quality(records, (doc % 3).alias("batch"), (doc % 2).alias("half"), subtotals=True)


@register(
    "path_profile",
    f"""WITH {CALLS}, n AS (
      SELECT '$' AS path_shape, 'object' AS kind, FALSE AS s FROM orders
      UNION ALL SELECT '$.' || unnest(['o_orderkey', 'status']), unnest(['number', 'string']), FALSE FROM orders
      UNION ALL SELECT '$.items', 'array', TRUE FROM orders
      UNION ALL SELECT '$.items[*]' || unnest(['', '.step', '.note', '.note.customer', '.note.rank']),
                       unnest(['object', 'number', 'object', 'number', 'number']),
                       unnest([FALSE, FALSE, TRUE, FALSE, FALSE]) FROM calls)
    SELECT path_shape, count(*) AS nodes, count(*) FILTER (kind = 'object') AS n_object,
      count(*) FILTER (kind = 'array') AS n_array, count(*) FILTER (kind = 'string') AS n_string,
      count(*) FILTER (kind = 'number') AS n_number, count(*) FILTER (kind = 'boolean') AS n_boolean,
      count(*) FILTER (kind = 'null') AS n_null, count(*) FILTER (s) AS stringified
    FROM n GROUP BY path_shape""",
)
def path_profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_profile(call_nodes(spark, sf_dir))


@register(
    "nesting_histogram",
    """SELECT 2 AS string_layers, 4 AS max_depth, count(DISTINCT (conv_id, turn // 16)) AS records
       FROM conversations""",
)
def nesting_histogram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nesting_histogram(expand(parse(inputs.session_log(spark, sf_dir)), levels=6))


@register(
    "top_paths",
    f"""WITH {EVENT} SELECT path_text, count(*) AS hits FROM ev_nodes
    WHERE contains(label, '1') OR contains(key_label, '1')
    GROUP BY path_text ORDER BY hits DESC, path_text LIMIT 3""",
)
def top_paths_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_paths(search(event_nodes(spark, sf_dir), "1"), 3)


@register(
    "top_records",
    f"""WITH {EVENT} SELECT line AS source_line, count(*) AS hits FROM ev_nodes
    WHERE contains(label, '1') OR contains(key_label, '1')
    GROUP BY line ORDER BY hits DESC, line LIMIT 10""",
)
def top_records_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_records(search(event_nodes(spark, sf_dir), "1"), 10).select("source_line", "hits")


@register(
    "flatten_columns",
    """SELECT o_orderkey AS doc_id, o_orderstatus AS status, CAST(o_custkey AS DOUBLE) AS customer,
              CASE WHEN o_orderkey % 5 >= 1 THEN CAST(20 AS DOUBLE) END AS second_rank,
              'array' AS items_kind
       FROM orders""",
)
def flatten_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns from two layers of strings, one row per record throughout."""
    records = parse(inputs.order_calls(spark, sf_dir), "json")
    return flatten(
        records,
        {
            "status": (["status"], "string"),
            "customer": (["items", "0", "note", "customer"], "double"),
            "second_rank": (["items", "1", "note", "rank"], "double"),
            "items_kind": (["items"], "kind"),
        },
    ).drop("line_number")


@register(
    "number_labels",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
              CASE WHEN l_extendedprice = floor(l_extendedprice)
                   THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR)
                   ELSE CAST(l_extendedprice AS VARCHAR) END AS price_label
       FROM lineitem""",
)
def number_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as JavaScript prints them."""
    items = inputs.table(spark, sf_dir, "lineitem")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        js_number(F.col("l_extendedprice")).alias("price_label"),
    )


@register(
    "text_labels",
    """SELECT page_id, md5(CAST(to_json(html) AS VARCHAR)) AS digest,
              CAST(length(CAST(to_json(html) AS VARCHAR)) AS INTEGER) AS units FROM pages""",
)
def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted labels of whole web pages and their length in UTF-16 units."""
    pages = inputs.table(spark, sf_dir, "pages", "page_id", "html")
    records = parse(
        pages.select(F.col("page_id").alias("doc_id"), F.to_json(F.struct("html")).alias("text")),
        "json",
    )
    nodes = expand(records, levels=2).where(F.col("path_text") == "$.html")
    label = nodes.select(F.col("doc_id").alias("page_id"), value_label().alias("label"))
    return label.select("page_id", F.md5("label").alias("digest"), utf16_length(F.col("label")).alias("units"))
