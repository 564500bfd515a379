"""Files that arrive on a stream, with the lines, formats and records of the batch reader.

The stream is one of file names; a file is the unit, so its splits are counted and its
format is decided in the micro-batch that it arrives in, by the same jobs as in batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from jsonloom.config import drop_path
from jsonloom.operators.expand import DEFAULT_MAX_DEPTH, expand
from jsonloom.operators.files import parse_files

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
MAX_FILES = 1_000


def literal_path(path: str) -> str:
    """A path in which nothing is read as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def write_file_nodes(
    spark: SparkSession,
    folder: str,
    path: str,
    checkpoint: str,
    forced_format: str | None = None,
    max_depth: int = DEFAULT_MAX_DEPTH,
    max_files: int = MAX_FILES,
    available_now: bool = False,
    result: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Nodes of the files that arrive in ``folder``, to ``path/batch=<id>``.

    ``max_files`` bounds the names that a micro-batch brings to the driver.  ``result``
    changes what is written of the nodes.  A batch that is run again replaces its own
    folder.
    """
    names = spark.readStream.schema(BINARY_FILE).format("binaryFile").option("maxFilesPerTrigger", max_files)
    arriving = names.load(folder).select("path")  # without the content, which is not read then

    def write(batch: DataFrame, batch_id: int) -> None:
        scratch: list[str] = []
        # the source may list a file of a batch more than once
        found = sorted({literal_path(r.path) for r in batch.collect()})
        if not found:
            return
        nodes = expand(parse_files(batch.sparkSession, found, forced_format), max_depth, scratch=scratch)
        (result(nodes) if result else nodes).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        for written in scratch:
            drop_path(batch.sparkSession, written)

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
