"""Documents that change on a stream: only a changed text is expanded, and its old nodes are withdrawn.

Each document's last version and the digest of its text are state; a text that comes
again as it was leaves no trace, a changed one withdraws the version before it, a null
text deletes the document.  State needs the RocksDB provider
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from jsonloom.config import drop_path
from jsonloom.operators.expand import DEFAULT_MAX_DEPTH, expand
from jsonloom.operators.records import parse
from jsonloom.sources.documents import from_column

if TYPE_CHECKING:
    import pandas as pd

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELETED = ""


class _LastTexts(StatefulProcessor):
    """State per document: the last version and the digest of its text (empty once deleted)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version bigint, digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import pandas as pd

        version, text = None, None
        for batch in rows:  # of several versions in a batch the latest counts
            i = batch["version"].idxmax()
            if version is None or batch["version"][i] > version:
                version, text = int(batch["version"][i]), batch["text"][i]
        known = self.last.get() if self.last.exists() else None
        digest = DELETED if text is None else hashlib.sha256(text.encode()).hexdigest()
        if known is not None and version <= known[0]:
            return
        withdraws = known[0] if known is not None and known[1] != DELETED else None
        if digest == (known[1] if known is not None else DELETED):
            # The same text, or nothing to delete: the version whose nodes stand stays the known one.
            return
        self.last.update((version, digest))
        yield pd.DataFrame(
            {
                "doc_id": [key[0]],
                "version": pd.array([version], dtype="Int64"),
                "withdraws": pd.array([withdraws], dtype="Int64"),
                "text": [text],
            }
        )

    def close(self) -> None:
        pass


def changed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, version, withdraws, text`` of the texts that differ from their document's last.

    ``docs`` is a stream of ``doc_id, version, text``; ``version`` is a number that grows
    with each change, and a version that is not later than the known one is left out.
    ``withdraws`` is the version whose nodes no longer hold.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("version").cast("bigint").alias("version"), "text").where("version is not null")
    return rows.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=_LastTexts(),
        outputStructType=f"doc_id {kind}, version bigint, withdraws bigint, text string",
        outputMode="Append",
        timeMode="None",
    )


def write_changes(
    docs: DataFrame,
    path: str,
    checkpoint: str,
    forced_format: str | None = None,
    max_depth: int = DEFAULT_MAX_DEPTH,
    available_now: bool = False,
) -> StreamingQuery:
    """Changed texts to ``path/changes`` and their nodes to ``path/nodes``, by batch.

    A batch that is run again replaces its own folders.  Read with :func:`current_nodes`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, scratch = batch.sparkSession, []
        folder = f"{path}/changes/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        written = spark.read.schema(batch.schema).parquet(folder)
        texts = from_column(written.where(F.col("text").isNotNull()), ["doc_id", "version"], "text")
        nodes = expand(parse(texts, forced_format), max_depth, scratch=scratch)
        nodes = nodes.withColumn("version", F.col("doc_id.version")).withColumn("doc_id", F.col("doc_id.doc_id"))
        nodes.write.mode("overwrite").parquet(f"{path}/nodes/batch={batch_id}")
        for written_pass in scratch:
            drop_path(spark, written_pass)

    writer = changed_texts(docs).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of each document's last text; deleted documents have none."""
    changes = spark.read.parquet(f"{path}/changes")
    last = changes.groupBy("doc_id").agg(
        F.max("version").alias("version"), F.max_by(F.col("text").isNotNull(), "version").alias("stands")
    )
    standing = last.where("stands").select("doc_id", "version")
    return spark.read.parquet(f"{path}/nodes").join(standing, ["doc_id", "version"], "left_semi").drop("batch")
