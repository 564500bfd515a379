"""Chosen expanded paths as typed columns, without building nodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.cells import (
    ENTRIES,
    VALUE,
    boolean_value,
    is_container,
    kind,
    number_value,
    open_cell,
    printed,
    string_value,
    unmark,
)
from jsonloom.functions.shared import shared
from jsonloom.functions.text import let
from jsonloom.operators.expand import DEFAULT_MAX_DEPTH

Path = tuple[str, ...]


def _text(cell: Column) -> Column:
    return (
        F.when(cell.startswith("s"), string_value(cell))
        .when(is_container(cell), unmark(cell))
        .when(cell != "null", printed(cell))
    )


TYPES = {"string": _text, "double": number_value, "boolean": boolean_value, "kind": kind}


def _child_cell(value: Column, segment: str) -> Column:
    by_key = F.get(F.filter(value["children"], lambda e: e["key"] == segment), F.lit(0))["cell"]
    is_index = segment == "0" or (segment.isascii() and segment.isdigit() and segment[0] != "0")
    if not is_index:
        return F.when(value["cell"] == "{", by_key)
    by_index = F.get(value["children"], F.lit(int(segment)))["cell"]
    return F.when(value["cell"] == "{", by_key).when(value["cell"] == "[", by_index)


def _settled(cell: Column, found: Column) -> Column:
    """struct(own, value): the cell itself, unwrapped, and what lies below it."""
    empty = F.struct(cell.alias("cell"), F.array().cast(ENTRIES).alias("children"))
    own = F.when(is_container(cell), cell)
    return F.struct(
        F.coalesce(own, found["cell"], cell).alias("own"),
        F.coalesce(found, empty.cast(VALUE)).alias("value"),
    )


@shared
def _root(may_unwrap: bool) -> Column:
    cell = F.col("cell")
    known = F.when(is_container(cell), F.struct("cell", "children").cast(VALUE))
    return let(
        F.coalesce(known, open_cell(cell, F.lit(may_unwrap))), lambda v: _settled(cell, v)
    )


@shared
def _opened(may_unwrap: bool) -> Column:
    """The cells of column ``cells``, each settled; a container is only taken
    apart where something below it is wanted."""

    def settle(item: Column) -> Column:
        cell = item["cell"]
        needed = F.when(item["inner"] | cell.startswith("s"), cell)
        return let(open_cell(needed, F.lit(may_unwrap)), lambda v: _settled(cell, v))

    return F.transform("cells", settle)


def flatten(
    records: DataFrame,
    columns: Mapping[str, tuple[Sequence[str], str]],
    max_depth: int = DEFAULT_MAX_DEPTH,
) -> DataFrame:
    """``doc_id, line_number`` and one column per ``name: (path, type)``.

    Paths are segments below the root, such as ``["props", "k"]``; types are
    those of ``TYPES``.  Only containers on the way to a chosen path are opened,
    each once, and a record stays one row throughout.
    """
    wanted = {name: tuple(path) for name, (path, _) in columns.items()}
    inner = {p[:n] for p in wanted.values() for n in range(len(p))}
    levels: list[list[Path]] = [[()]]
    for depth in range(1, max(map(len, wanted.values()), default=0) + 1):
        levels.append(sorted({p[:depth] for p in wanted.values() if len(p) >= depth}))

    def at(path: Path) -> Column:
        place = levels[len(path)].index(path)
        return F.get(F.col(f"level_{len(path)}"), F.lit(place))

    frame = records.where(F.col("cell").isNotNull()).select(
        "doc_id", "line_number", F.array(_root(max_depth >= 0)).alias("level_0")
    )
    for depth, here in enumerate(levels[1:], start=1):
        cells = [
            F.struct(
                _child_cell(at(p[:-1])["value"], p[-1]).alias("cell"),
                F.lit(p in inner).alias("inner"),
            )
            for p in here
        ]
        frame = (
            frame.withColumn("cells", F.array(*cells))
            .withColumn(f"level_{depth}", _opened(depth <= max_depth))
            .drop("cells")
        )
    return frame.select(
        "doc_id",
        "line_number",
        *[TYPES[columns[name][1]](at(path)["own"]).alias(name) for name, path in wanted.items()],
    )
