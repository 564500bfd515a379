"""Regular-expression matches as offset ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jsonloom.functions.text import let, utf16_length

# Characters that Unicode reserves as never assigned; one that the text does not
# contain separates the matches from the rest.
SEPARATORS = [chr(code) for code in range(0xFDD0, 0xFDF0)]
RANGES = "array<struct<start:int,end:int>>"
# Up to this many values running totals are built in one go.
DIRECT = 64


def pieces(text: Column, pattern: str) -> Column:
    """``[gap, match, gap, …, match, gap]``, an odd number of strings.

    Matches are found by one ``regexp_replace`` that sets them off, so empty
    matches come out as in a scan that moves on by one after each.
    """

    def cut(separator: Column) -> Column:
        marked = F.regexp_replace(
            text, F.lit(pattern), F.concat(separator, F.lit("$0"), separator)
        )
        return F.split(marked, separator, -1)

    # nearly every text lacks the first one
    first = F.lit(SEPARATORS[0])
    unused = F.when(~F.contains(text, first), first).otherwise(
        F.get(F.filter(F.array(*map(F.lit, SEPARATORS)), lambda c: ~F.contains(text, c)), F.lit(0))
    )
    return let(unused, lambda s: F.when(s.isNotNull(), cut(s)).otherwise(_gaps_and_matches(text, pattern)))


def _gaps_and_matches(text: Column, pattern: str) -> Column:
    """The same for a text that leaves no separator: one pass for gaps, one for matches."""

    def merged(gaps: Column, matches: Column) -> Column:
        # a match of nothing at the very start leaves no gap in front of it
        whole = F.when(F.size(gaps) == F.size(matches), F.concat(F.array(F.lit("")), gaps)).otherwise(gaps)
        pairs = F.transform(
            whole,
            lambda g, i: F.when(i < F.size(matches), F.array(g, F.get(matches, i))).otherwise(F.array(g)),
        )
        return F.flatten(pairs)

    return let(
        F.split(text, pattern, -1),
        lambda gaps: let(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: merged(gaps, matches)
        ),
    )


def _totals(values: Column, start: Column) -> Column:
    state = "struct<total:int,out:array<int>>"
    return F.aggregate(
        values,
        F.struct(start.alias("total"), F.array().alias("out")).cast(state),
        lambda acc, x: F.struct(
            (acc["total"] + x).alias("total"),
            F.concat(acc["out"], F.array(acc["total"] + x)).alias("out"),
        ).cast(state),
        lambda acc: acc["out"],
    )


def running_totals(values: Column) -> Column:
    """Inclusive running sums of an int array.

    Appending to an array copies it, so long inputs are summed in blocks of
    about the square root of their length.
    """

    def blocked(size: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.size(values) - 1, size),
            lambda i: F.slice(values, i + 1, size),
        )

        def joined(parts: Column) -> Column:
            sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
            return let(
                _totals(sums, F.lit(0)),
                lambda ends: F.flatten(
                    F.transform(
                        parts,
                        lambda p, i: _totals(p, F.when(i == 0, 0).otherwise(F.get(ends, i - 1))),
                    )
                ),
            )

        return let(blocks, joined)

    return F.when(F.size(values) <= DIRECT, _totals(values, F.lit(0))).otherwise(
        let(F.ceil(F.sqrt(F.size(values))).cast("int"), blocked)
    )


def find_ranges(text: Column, pattern: str) -> Column:
    """Half-open UTF-16 ranges of all matches, empty ones included."""

    def spans(ends: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), (F.size(ends) / 2).cast("int") - 1),
            lambda i: F.struct(
                F.get(ends, 2 * i).alias("start"), F.get(ends, 2 * i + 1).alias("end")
            ),
        )

    def single(lengths: Column) -> Column:
        gap, match = F.get(lengths, F.lit(0)), F.get(lengths, F.lit(1))
        return F.array(F.struct(gap.alias("start"), (gap + match).alias("end")))

    found = let(
        F.transform(pieces(text, pattern), utf16_length),
        lambda lengths: F.when(F.size(lengths) == 3, single(lengths)).otherwise(let(running_totals(lengths), spans)),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(RANGES)


def segments(text: Column, pattern: str) -> Column:
    """``text`` as ``array<struct<text, marked>>``; empty gaps are left out."""
    parts = F.transform(
        pieces(text, pattern),
        lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("marked")),
    )
    return F.filter(parts, lambda s: s["marked"] | (s["text"] != ""))
