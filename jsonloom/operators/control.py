"""Control sets - paths, records - tested against node rows.

A set is a frame or a Python iterable.  The rows do not depend on how it is given or on
how many entries it has, only the plan does.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.config import scratch_path

Control = Iterable | DataFrame
#: Entries and characters up to which an iterable is tested in the row.
LITERALS, LITERAL_CHARS = 1_000, 100_000
#: Characters up to which a dictionary of chains is broadcast.
DICTIONARY_BYTES = 8 << 20


def control_frame(nodes: DataFrame, control: Control, schema: str) -> DataFrame | None:
    """The distinct entries; None for an iterable without any."""
    if not isinstance(control, DataFrame):
        rows = [x if isinstance(x, tuple) else (x,) for x in control]
        if not rows:
            return None
        control = nodes.sparkSession.createDataFrame(rows, schema)
    return control.distinct()


def _literals(control: Control) -> list[str] | None:
    """The entries of a small iterable; None for frames and for larger ones."""
    if isinstance(control, DataFrame):
        return None
    entries = list(dict.fromkeys(x[0] if isinstance(x, tuple) else x for x in control))
    small = len(entries) <= LITERALS and sum(len(x) for x in entries if x is not None) <= LITERAL_CHARS
    return [x for x in entries if x is not None] if small else None


def chain_hits(nodes: DataFrame, keys: Column, wanted: DataFrame) -> DataFrame:
    """``chain, hits``: the distinct arrays of keys that have any key in ``wanted``, with those keys.

    Keys are structure, not data, so there are few; what is exchanged are arrays of keys
    after a partial aggregate, never rows.
    """
    chains = nodes.select(keys.alias("chain")).where(F.size("chain") > 0).distinct()
    spread = chains.select("chain", F.explode(F.array_distinct("chain")).alias("key"))
    met = spread.join(wanted.select(F.col(wanted.columns[0]).alias("key")).distinct(), "key")
    return met.groupBy("chain").agg(F.collect_list("key").alias("hits"))


def with_hits(nodes: DataFrame, keys: Column, control: Control, name: str) -> DataFrame:
    """``nodes`` with ``name``: those of each row's ``keys`` that are in ``control``
    (a frame's first column).

    A small iterable is tested in the row itself.  Anything else meets the distinct key
    chains first; the dictionary that this gives is written, and rows look their chain up
    in it: from a broadcast if its measured size allows, by a join on the chain if not.
    Rows without keys take no part in that join, and hot chains are left to Spark's skew
    handling, as each has one row on the other side.
    """
    none = F.array().cast("array<string>")
    entries = _literals(control)
    if entries is not None:
        found = F.filter(keys, lambda k: k.isin(entries)) if entries else none
        return nodes.withColumn(name, F.coalesce(F.array_distinct(found), none))
    spark = nodes.sparkSession
    path = scratch_path(spark, "chains")
    hits = chain_hits(nodes, keys, control_frame(nodes, control, "key string"))
    hits.write.parquet(path)
    found = spark.read.schema(hits.schema).parquet(path)
    size = found.select(F.sum(F.length(F.to_json("chain")) + F.length(F.to_json("hits")))).first()[0] or 0
    found = found.select(F.col("chain").alias("_chain"), F.lit(-1).cast("bigint").alias("_spread"), F.col("hits").alias(name))
    alone = F.size("_chain") == 0
    rows = nodes.withColumn("_chain", F.coalesce(keys, none)).withColumn(
        "_spread", F.when(alone, F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("bigint"))
    )
    joined = rows.join(F.broadcast(found) if size <= DICTIONARY_BYTES else found, ["_chain", "_spread"], "left")
    return joined.select(*nodes.columns, F.coalesce(name, none).alias(name))


def with_chosen(nodes: DataFrame, records: Control, name: str) -> DataFrame:
    """``nodes`` with the flag ``name``: the row's record is in ``records``.

    Records go by ``(doc_id, record_id)``: a frame with these columns or an iterable of
    such pairs.  A frame or iterable of record ids alone means them in every document.
    """
    if not isinstance(records, DataFrame):
        records = list(records)
    pairs = isinstance(records, list) and any(isinstance(x, tuple) for x in records)
    kind = nodes.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, record_id string" if pairs else "record_id string"
    wanted = control_frame(nodes, records, schema)
    if wanted is None:
        return nodes.withColumn(name, F.lit(False))
    if "record_id" not in wanted.columns:
        raise ValueError("a frame of records needs a column record_id")
    keys = [c for c in ("doc_id", "record_id") if c in wanted.columns]
    wanted = wanted.select(*(F.col(c).alias(f"wanted_{c}") for c in keys)).distinct().withColumn(name, F.lit(True))
    condition = F.lit(True)
    for c in keys:
        condition = condition & nodes[c].eqNullSafe(wanted[f"wanted_{c}"])
    joined = nodes.join(wanted, condition, "left")
    return joined.select(*nodes.columns, F.coalesce(name, F.lit(False)).alias(name))
