"""Helpers that the operators share: tables, scratch tables, Arrow batches, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from jsonloom.config import scratch_path

#: Fixed value: a word is a run of anything but the ASCII white space that bytes.split() cuts at.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows, written once to the shared folder: lost executors do not repeat the work."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator's run in the shared folder; each can go when it has been used."""

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows; the shuffle files of the write go with its end."""
        before = self.spark.conf.get(self.CLEANUP, "false")
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            path = scratch_path(self.spark, name)
            out = stored(df, name, path)
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes the table behind a frame of `store`."""
        _, path = self.paths.pop(id(df))
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)

    def drop_all(self, *keep: DataFrame) -> None:
        """Deletes all tables but those of `keep`."""
        for df, _ in list(self.paths.values()):
            if not any(df is x for x in keep):
                self.drop(df)


#: Rows that a task takes at once where a text becomes many rows or numbers.
AT_ONCE = 500


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows at most; no data is copied."""
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def arrow_map(
    df: DataFrame, fn: Callable[..., dict | list], schema: str | StructType, at_once: int | None = None
) -> DataFrame:
    """fn(columns as lists) -> columns as lists or arrays, one Arrow batch, or so many of its rows, at a time."""
    out = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at_once or max(whole.num_rows, 1))):
            if batch.num_rows:
                columns = fn(**{n: batch.column(i) for i, n in enumerate(batch.schema.names)})
                arrays = [
                    x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type)
                    for x, f in zip(columns, out, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays],
                    schema=out,
                )

    return df.mapInArrow(run, schema)


def numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents under column names c0, c1, ..., and the new names of `text` and `source`."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index
    source = names[place("source")] if "source" in docs.columns else ""
    return docs.toDF(*names), names[place("text")], source


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def smallest(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows with the smallest hashes of a key.

    Hashes are even, so a count tells a bound that some four times as many rows are under:
    only those are sent to be ranked, instead of k from each task.
    """
    h = F.xxhash64(key)
    n = rows.count()
    if n > 8 * k:
        below = h <= -(1 << 63) + (1 << 64) * 4 * k // n
        under = rows.filter(below)
        if under.count() >= k:  # else one key holds most rows
            rows = under
    return rows.orderBy(h, key).limit(k)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def site(source: Column) -> tuple[Column, Column]:
    """Host and first path segment of a source."""
    parts = F.split(F.regexp_replace(F.coalesce(source, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "[/?#]")
    return parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def row_groups(lengths, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of at most `limit` in total length; a longer row is a run of its own."""
    start, end, total = 0, 0, 0
    for n in lengths:
        if end > start and total + n > limit:
            yield start, end
            start, total = end, 0
        end, total = end + 1, total + n
    if end > start:
        yield start, end


__all__ = ["F", "SPACE", "Scratch", "arrow_map", "numbered", "row_groups", "same", "site", "shuffle_partitions", "slices", "smallest", "stored", "table", "words_of"]
