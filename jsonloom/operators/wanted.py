"""Wanted paths as an automaton that each level of an expansion asks about its children.

A pattern is a list of segments below the root; ``*`` stands for any segment, and
everything under a pattern's end is wanted, too.  The patterns make a trie; where a
literal segment and ``*`` part, their subtrees are merged, so a node has exactly one
state, and a child's state follows from its parent's and its own segment.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY = "*"
#: States: not wanted, and at or under the end of a pattern.
NOWHERE, UNDER = -1, 0


class Wanted:
    """States are numbers: UNDER, or those of sets of places inside patterns."""

    def __init__(self, patterns: Iterable[Sequence[str]]):
        self.patterns = [tuple(map(str, p)) for p in patterns]
        if not self.patterns:
            raise ValueError("at least one path is wanted")
        places = frozenset((i, 0) for i in range(len(self.patterns)))
        self.numbers: dict[frozenset, int] = {}
        #: (state, segment) -> state, and state -> state for any other segment.
        self.edges: dict[int, dict[str, int]] = {}
        self.others: dict[int, int] = {}
        self.start = self._number(places)

    def _number(self, places: frozenset) -> int:
        if not places:
            return NOWHERE
        if any(k == len(self.patterns[i]) for i, k in places):
            return UNDER
        if places in self.numbers:
            return self.numbers[places]
        state = self.numbers[places] = len(self.numbers) + 1
        named = {self.patterns[i][k] for i, k in places} - {ANY}
        after = lambda *names: frozenset((i, k + 1) for i, k in places if self.patterns[i][k] in names)
        self.edges[state] = {name: self._number(after(name, ANY)) for name in sorted(named)}
        self.others[state] = self._number(after(ANY))
        return state

    @property
    def levels(self) -> int:
        """Segments of the longest pattern."""
        return max(map(len, self.patterns))

    def after(self, state: Column, segment: Column) -> Column:
        """A child's state."""
        found = F.when(state == UNDER, UNDER)
        for number, edges in self.edges.items():
            target = F.lit(self.others[number])
            for name, to in edges.items():
                target = F.when(segment == name, to).otherwise(target)
            found = found.when(state == number, target)
        return found.otherwise(NOWHERE)
