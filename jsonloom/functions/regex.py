"""JavaScript regular expressions as Java patterns.

The query's dialect is the one of patterns without the ``u`` flag.  A pattern is parsed
into a tree of alternatives, sequences, groups and atoms, and the tree is written in
Java's terms.  What no JavaScript engine would take raises :class:`Invalid`; what is a
pattern there and cannot be said in Java raises :class:`Unsupported`.

A back-reference to a group that has not taken part matches the empty text in JavaScript
and nothing in Java.  The tree tells which case a reference is: its group surely took part
(written as it is), surely did not (left out), or may have (``Unsupported``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# The characters of JavaScript's \\s and the line ends its dot leaves out.
SPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_END = r"\n\r\u2028\u2029"
QUANTIFIER = re.compile(r"\{([0-9]+)(,([0-9]*))?\}")
GROUP = re.compile(r"\((?:\?(?::|=|!|<=|<!|<(?P<name>[A-Za-z_$][\w$]*)>))?")
CONTROL = {"t": 9, "n": 10, "v": 11, "f": 12, "r": 13}


class Invalid(ValueError):
    """No regular expression in JavaScript."""


class Unsupported(ValueError):
    """A valid pattern that Java's expressions cannot say."""


@dataclass
class Node:
    """A piece of a pattern: ``text`` alone, or ``open``, alternatives of sequences and ``close``."""

    text: str = ""
    kind: str = "atom"  # atom, mark (matches no text), group, look, reference
    open: str = ""
    number: int = 0  # of a capturing group, or the one referred to
    alternatives: list[list[Node]] = field(default_factory=list)
    quantifier: str = ""
    least: int = 1


def _char(code: int) -> str:
    """A character of a Java pattern, inside and outside classes."""
    c = chr(code)
    return c if c.isalnum() and c.isascii() else f"\\x{{{code:x}}}"


class _Parser:
    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0
        self.groups, self.names, self.opened = *self._count(), 0

    def _count(self) -> tuple[int, dict[str, int]]:
        """Capturing groups and their names, which references may precede."""
        count, names, at, in_class = 0, {}, 0, False
        while at < len(self.pattern):
            c = self.pattern[at]
            if c == "\\":
                at += 1
            elif in_class:
                in_class = c != "]"
            elif c == "[":
                in_class = True
            elif c == "(":
                head = GROUP.match(self.pattern, at)
                name = head["name"]
                if name or (head[0] == "(" and self.pattern[at + 1 : at + 2] != "?"):
                    count += 1
                    if name in names:
                        raise Invalid("a group name twice")
                    if name:
                        names[name] = count
            at += 1
        return count, names

    def peek(self, size: int = 1) -> str:
        return self.pattern[self.at : self.at + size]

    def alternatives(self) -> list[list[Node]]:
        found: list[list[Node]] = [[]]
        while self.at < len(self.pattern) and self.peek() != ")":
            if self.peek() == "|":
                self.at += 1
                found.append([])
            else:
                found[-1].append(self.quantified())
        return found

    def quantified(self) -> Node:
        node = self.term()
        c = self.peek()
        counted = QUANTIFIER.match(self.pattern, self.at) if c == "{" else None
        if c not in ("*", "+", "?") and not counted:
            return node
        if node.kind == "mark" or (node.kind == "look" and node.open.startswith("(?<")):
            raise Invalid("nothing to repeat")
        if counted:
            node.least = int(counted[1])
            most = int(counted[3]) if counted[3] else node.least if counted[2] is None else None
            if most is not None and most < node.least:
                raise Invalid("a quantifier out of order")
        else:
            node.least = 1 if c == "+" else 0
        node.quantifier = counted[0] if counted else c
        self.at += len(node.quantifier)
        if self.peek() == "?":
            node.quantifier += "?"
            self.at += 1
        return node

    def term(self) -> Node:
        c = self.peek()
        if c == "(":
            return self.group()
        if c == "[":
            return Node(self.char_class())
        if c == "\\":
            return self.escape()
        if c in "*+?" or (c == "{" and QUANTIFIER.match(self.pattern, self.at)):
            raise Invalid("nothing to repeat")
        self.at += 1
        if c in "^$":
            return Node(c if c == "^" else r"\z", "mark")
        return Node(f"[^{LINE_END}]" if c == "." else "\\" + c if c in "{}]" else c)

    def group(self) -> Node:
        head = GROUP.match(self.pattern, self.at)
        if head[0] == "(" and self.pattern[self.at + 1 : self.at + 2] == "?":
            raise Invalid("an unknown group")
        self.at = head.end()
        node = Node(kind="look" if head[0] in ("(?=", "(?!", "(?<=", "(?<!") else "group", open=head[0])
        if head[0] == "(" or head["name"]:
            self.opened += 1
            node.open, node.number = "(", self.opened  # names only serve references, which go by number
        node.alternatives = self.alternatives()
        if self.peek() != ")":
            raise Invalid("a group does not end")
        self.at += 1
        return node

    def escape(self) -> Node:
        c = self.pattern[self.at + 1 : self.at + 2]
        if c in ("b", "B"):
            self.at += 2
            return Node("\\" + c, "mark")
        if c == "k" and self.names:
            named = re.compile(r"\\k<([^>]*)>").match(self.pattern, self.at)
            if not named or named[1] not in self.names:
                raise Invalid("a reference to no group")
            self.at = named.end()
            return Node(kind="reference", number=self.names[named[1]])
        if c in "123456789" and c:
            digits = re.compile(r"[0-9]+").match(self.pattern, self.at + 1)[0]
            if int(digits) <= self.groups:
                self.at += 1 + len(digits)
                return Node(kind="reference", number=int(digits))
        code, text = self.class_escape(False)
        return Node(_char(code) if text is None else text)

    def class_escape(self, in_class: bool) -> tuple[int, str | None]:
        """The code of an escaped character, or the Java text of an escaped set."""
        at = self.at + 1
        if at == len(self.pattern):
            raise Invalid("a backslash ends the pattern")
        c = self.pattern[at]
        self.at = at + 1
        if c in "dDwW":
            return 0, "\\" + c
        if c in "sS":
            if c == "S" and in_class:
                raise Unsupported("\\S inside a character class")
            return 0, SPACE if in_class else f"[{'^' if c == 'S' else ''}{SPACE}]"
        if c == "b" and in_class:
            return 8, None
        if c in CONTROL:
            return CONTROL[c], None
        for size, lead in ((2, "x"), (4, "u")):
            digits = self.pattern[at + 1 : at + 1 + size]
            if c == lead and re.fullmatch(f"[0-9a-fA-F]{{{size}}}", digits):
                self.at += size
                return int(digits, 16), None
        if c == "c":
            letter = self.pattern[at + 1 : at + 2]
            if re.fullmatch("[A-Za-z]" if not in_class else "[A-Za-z0-9_]", letter):
                self.at += 1
                return ord(letter) % 32, None
            self.at = at  # the backslash stands for itself
            return 0x5C, None
        octal = re.compile("[0-3][0-7]{0,2}|[4-7][0-7]?").match(self.pattern, at)
        if octal:
            self.at = octal.end()
            return int(octal[0], 8), None
        return ord(c), None

    def char_class(self) -> str:
        self.at += 1
        negated = self.peek() == "^"
        self.at += negated
        out: list[str] = []

        def member() -> tuple[int, str | None]:
            if self.at >= len(self.pattern):
                raise Invalid("a character class does not end")
            if self.peek() == "\\":
                return self.class_escape(True)
            self.at += 1
            return ord(self.pattern[self.at - 1]), None

        while self.peek() != "]":
            first, first_set = member()
            if self.peek() == "-" and self.peek(2) not in ("-]", "-"):
                self.at += 1
                last, last_set = member()
                if first_set is None and last_set is None:
                    if last < first:
                        raise Invalid("a range out of order")
                    out.append(f"{_char(first)}-{_char(last)}")
                else:  # a set has no range: the dash is a member
                    out += [first_set or _char(first), _char(0x2D), last_set or _char(last)]
            else:
                out.append(first_set if first_set is not None else _char(first))
        self.at += 1
        if not out:  # nothing, or anything
            return r"[\x00-\x{10ffff}]" if negated else "(?!)"
        return f"[{'^' if negated else ''}{''.join(out)}]"


@dataclass
class _Place:
    """Where a group ended: the sequences around it, from the outside in, and its index in each."""

    steps: list[tuple[int, int]]
    sure: list[bool]  # of each step: does reaching the end of that node mean that the group took part?


def _write(alternatives: list[list[Node]]) -> str:
    done: dict[int, _Place] = {}

    def resolve(number: int, steps: list[tuple[int, int]], backwards: bool) -> str:
        place = done.get(number)
        if place is None:
            if backwards:
                raise Unsupported("a reference inside a lookbehind")
            return ""  # the group comes later, or is the one that we are in: it is not set in this round
        if backwards:
            raise Unsupported("a reference inside a lookbehind")
        shared = 0
        while shared < min(len(steps), len(place.steps)) and steps[shared] == place.steps[shared]:
            shared += 1
        mine, other = steps[shared : shared + 1], place.steps[shared : shared + 1]
        if mine and other and mine[0][0] != other[0][0]:
            return ""  # another alternative of the same group
        if all(place.sure[shared:]):
            return f"(?:\\{number})"  # so that a digit that follows is not part of it
        raise Unsupported("a reference to a group that may not have taken part")

    def sequence(nodes: list[Node], steps: list[tuple[int, int]], sure: list[bool], which: int, backwards: bool) -> str:
        out = []
        for i, node in enumerate(nodes):
            here = [*steps, (which, i)]
            if node.kind == "reference":
                out.append((resolve(node.number, here, backwards) or "(?:)") + node.quantifier)
                continue
            if node.kind not in ("group", "look"):
                out.append(node.text + node.quantifier)
                continue
            certain = node.least > 0 and node.open not in ("(?!", "(?<!")
            single = certain and len(node.alternatives) == 1
            inside = "|".join(
                sequence(x, here, [*sure, single], k, backwards or node.open.startswith("(?<"))
                for k, x in enumerate(node.alternatives)
            )
            if node.number:
                done[node.number] = _Place(here, [*sure, certain])
            body = f"{node.open}{inside})"
            # Java takes no quantifier after a look-around.
            out.append(f"(?:{body}){node.quantifier}" if node.kind == "look" and node.quantifier else body + node.quantifier)
        return "".join(out)

    return "|".join(sequence(x, [], [], k, False) for k, x in enumerate(alternatives))


def to_java(pattern: str) -> str:
    """The Java pattern that matches like the JavaScript one."""
    parser = _Parser(pattern)
    tree = parser.alternatives()
    if parser.at < len(pattern):
        raise Invalid("a group ends that did not begin")
    return _write(tree)
