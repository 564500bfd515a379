"""Operator 2: SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut wherever its two neighbouring characters occur side by side in no piece
of the vocabulary: no merge can cross such a place, so the parts are independent.  Each
part is merged through an agenda, a heap of adjacent symbol pairs ordered by the score
of the merged piece and then from left to right; pairs that have changed meanwhile are
skipped.  Parts repeat, so every Python worker keeps a bounded memo of them.  In every
Arrow batch up to CHECKED_PARTS parts that are new to the memo are compared with the
sentencepiece library; a difference fails the job.

Null and empty texts have no ids and decode to the empty text.  Repeated rows are
encoded like any other; a text of any length is encoded whole.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from heapq import heapify, heappop, heappush
from itertools import chain, islice

from pyspark.sql import DataFrame

from jsonloom.llm.common import arrow_map

#: Parts, and stretches of parts, kept by a Python worker; beyond it a memo starts anew.
MEMO_PARTS = 450_000
#: New parts that are compared with the library in each Arrow batch (0: none).
CHECKED_PARTS = 2_000
SPACE_MARK = "▁"
#: Bytes that are no UTF-8 become one replacement character each, as in the library.
codecs.register_error("each byte", lambda e: ("\ufffd", e.start + 1))


class PieceCodec:
    """Encoder and decoder for one model file; its vocabulary is read through the library."""

    def __init__(self, path: str, check: int = CHECKED_PARTS):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unknown, self.check = sp.unk_id(), check
        scored: list[tuple[float, int, str]] = []
        self.bytes_of: list[bytes] = []
        byte_ids = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b" \xe2\x81\x87 " if sp.is_unknown(i) else b"")
            else:
                self.bytes_of.append(piece.replace(SPACE_MARK, " ").encode())
                if not sp.is_unused(i):
                    scored.append((-sp.get_score(i), i, piece))
        self.byte_ids = [byte_ids.get(b) for b in range(256)] if len(byte_ids) == 256 else None
        scored.sort()
        #: By score: the pieces, their ids, and the place of each piece in that order.
        self.pieces = [x[2] for x in scored]
        self.id_of_rank = [x[1] for x in scored]
        self.order = {x: k for k, x in enumerate(self.pieces)}
        self.raw = set(byte_ids.values())
        self.text_of_id = [str(i) for i in range(n)]
        #: Neighbours inside pieces; other neighbours are places to cut.
        self.neighbours = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        #: Where texts are cut at once, before looking at single places: in front of a space mark.
        self.marks_lead = not any(x[1] == SPACE_MARK != x[0] for x in self.neighbours)
        self.word = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+")
        #: Ids of stretches (a space mark and what follows it) and of the parts they are cut into.
        self.memo: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def merge(self, part: str) -> list[int]:
        """Ids of one part by the agenda.

        An entry is one number: the rank of the merged piece, then the left symbol's place.
        It is out of date if the two symbols there no longer make up that piece.
        """
        order, pieces = self.order, self.pieces
        n = len(part)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        symbols: list[str] = list(part)
        agenda = [
            r << bits | i for i in range(n - 1) if (r := order.get(part[i : i + 2])) is not None
        ]
        if agenda:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            symbols.append("")
            heapify(agenda)
            while agenda:
                entry = heappop(agenda)
                left = entry & mask
                right = after[left]
                merged = symbols[left] + symbols[right]
                if merged != pieces[entry >> bits] or not symbols[left] or right == n:
                    continue
                symbols[left], symbols[right] = merged, ""
                far = after[left] = after[right]
                if far < n:
                    before[far] = left
                    if (r := order.get(merged + symbols[far])) is not None:
                        heappush(agenda, r << bits | left)
                near = before[left]
                if near >= 0 and (r := order.get(symbols[near] + merged)) is not None:
                    heappush(agenda, r << bits | near)
        ids: list[int] = []
        for symbol in filter(None, symbols):
            found = order.get(symbol)
            if found is not None:
                ids.append(self.id_of_rank[found])
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in symbol.encode("utf-8", "replace"))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def cut(self, stretch: str) -> list[str]:
        """Parts of a stretch between which no piece can lie."""
        neighbours, parts, start = self.neighbours, [], 0
        for i in range(1, len(stretch)):
            if stretch[i - 1 : i + 1] not in neighbours:
                parts.append(stretch[start:i])
                start = i
        parts.append(stretch[start:])
        return parts

    def learn(self, stretches: set[str]) -> None:
        """Puts new stretches into the memo and checks some of them against the library."""
        for stretch in stretches:
            parts = self.cut(stretch) if self.byte_ids else [stretch]
            for part in parts:
                if part not in self.parts:
                    self.parts[part] = tuple(self.merge(part))
            self.memo[stretch] = tuple(chain.from_iterable(map(self.parts.__getitem__, parts)))
        if self.check and self.marks_lead and self.byte_ids:
            led = (x for x in stretches if x[0] == SPACE_MARK != x[-1])
            led = list(islice(led, self.check))
            # each starts with a mark, so a text of all of them has their ids in a row
            if self.library.encode("".join(led)[1:]) != [i for x in led for i in self.memo[x]]:
                raise ValueError("ids differ from the sentencepiece library's")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts."""
        for memo in (self.memo, self.parts):
            if len(memo) > MEMO_PARTS:
                memo.clear()
        if not self.marks_lead:  # a vocabulary with marks inside pieces: every text is one stretch
            cut = [[SPACE_MARK + x.replace(" ", SPACE_MARK)] if x else [] for x in texts]
        else:
            cut = [self.word.findall(SPACE_MARK + x.replace(" ", SPACE_MARK)) if x else [] for x in texts]
        fresh = set(chain.from_iterable(cut)).difference(self.memo)
        if fresh:
            self.learn(fresh)
        return [list(chain.from_iterable(map(self.memo.__getitem__, x))) for x in cut]

    def digest(self, ids: list[int]) -> str:
        joined = ",".join(map(self.text_of_id.__getitem__, ids))
        return hashlib.sha256(joined.encode()).hexdigest()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the mark that encoding puts in front of a text goes."""
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        if ids and out[:1] == b" " and ids[0] not in self.raw:
            out = out[1:]
        return out.decode("utf-8", "each byte")


_codecs: dict[tuple[str, int], PieceCodec] = {}


def codec(path: str, check: int = CHECKED_PARTS) -> PieceCodec:
    """One codec for each model and Python worker."""
    if (path, check) not in _codecs:
        _codecs[path, check] = PieceCodec(path, check)
    return _codecs[path, check]


def encode_decode(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check: int = CHECKED_PARTS
) -> DataFrame:
    """(id, ids array<int>, decoded string) per row, in one narrow pass."""

    def run(**columns):
        c = codec(model, check)
        texts = [x or "" for x in columns["text"].to_pylist()]
        ids = c.encode(texts)
        return [columns["id"], ids, [c.decode(x) for x in ids]]

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return arrow_map(picked, run, f"id {kind}, ids array<int>, decoded string")


def digests(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check: int = CHECKED_PARTS
) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, without sending ids to the JVM."""

    def run(**columns):
        c = codec(model, check)
        n, ids_sha, text_sha = [], [], []
        for ids in c.encode([x or "" for x in columns["text"].to_pylist()]):
            n.append(len(ids))
            ids_sha.append(c.digest(ids))
            text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return [columns["id"], n, ids_sha, text_sha]

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return arrow_map(
        picked, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
