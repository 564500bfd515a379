"""Expansion and search on streams.

Records do not depend on each other, so the batch operators with a fixed number
of levels run on a streaming frame as they are.  The open-ended expansion needs
jobs of its own and runs per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jsonloom.config import drop_path
from jsonloom.functions.cells import is_json
from jsonloom.operators.expand import DEFAULT_MAX_DEPTH, expand
from jsonloom.operators.records import parse
from jsonloom.operators.search import build_pattern, search


def stream_nodes(
    docs: DataFrame,
    levels: int,
    forced_format: str | None = None,
    max_depth: int = DEFAULT_MAX_DEPTH,
) -> DataFrame:
    """Nodes of a stream of documents, stateless and in append mode.

    A record deeper than ``levels`` does not stop the stream: its nodes below stay
    unopened (``n_children`` NULL, see ``operators.expand.unopened``).
    """
    return expand(parse(docs, forced_format), max_depth, levels, keep_deep=True)


def stream_matches(
    docs: DataFrame,
    levels: int,
    query: str,
    forced_format: str | None = None,
    max_depth: int = DEFAULT_MAX_DEPTH,
    **options: bool,
) -> DataFrame | None:
    """Matches of a stream of documents, with an ``unopened`` column.

    What ``levels`` leaves unopened cannot be searched below; such nodes are rows of the
    result, too, with ``unopened`` true, whether they match or not.  ``write_matches``
    searches records of any depth.
    """
    nodes = stream_nodes(docs, levels, forced_format, max_depth)
    return search(nodes, query, keep_unopened=True, **options)


def stream_quality(docs: DataFrame, time_col: str, window: str, watermark: str) -> DataFrame:
    """Valid and invalid texts per time window; late data beyond the watermark is
    left out, as state for closed windows is gone."""
    checked = docs.select(time_col, is_json("text").alias("valid"))
    return (
        checked.withWatermark(time_col, watermark)
        .groupBy(F.window(time_col, window).alias("window"))
        .agg(
            F.count("*").alias("total"),
            F.count_if("valid").alias("success"),
            F.count_if(~F.col("valid")).alias("failed"),
        )
    )


def write_nodes(
    docs: DataFrame,
    path: str,
    checkpoint: str,
    forced_format: str | None = None,
    max_depth: int = DEFAULT_MAX_DEPTH,
    available_now: bool = False,
) -> StreamingQuery:
    """Expand each micro-batch to any depth into ``path/batch=<id>``.

    A batch that is run again replaces its own folder, so no node is written
    twice.
    """
    return _write(docs, path, checkpoint, lambda nodes: nodes, forced_format, max_depth, available_now)


def write_matches(
    docs: DataFrame,
    path: str,
    checkpoint: str,
    query: str,
    forced_format: str | None = None,
    max_depth: int = DEFAULT_MAX_DEPTH,
    available_now: bool = False,
    **options: bool,
) -> StreamingQuery | None:
    """Matches in records of any depth, written like ``write_nodes``; None when there is no pattern."""
    pattern = {k: v for k, v in options.items() if k in ("regex", "case_sensitive")}
    if build_pattern(docs.sparkSession, query, **pattern) is None:
        return None
    return _write(
        docs, path, checkpoint, lambda nodes: search(nodes, query, **options), forced_format, max_depth, available_now
    )


def _write(
    docs: DataFrame,
    path: str,
    checkpoint: str,
    result: Callable[[DataFrame], DataFrame],
    forced_format: str | None,
    max_depth: int,
    available_now: bool,
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        scratch: list[str] = []
        nodes = expand(parse(batch, forced_format), max_depth, scratch=scratch)
        result(nodes).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        for folder in scratch:
            drop_path(batch.sparkSession, folder)

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
