"""Operator 5: language identification with spans.

Per-language log-probabilities of character triples are learned from labelled texts: the
TRAIN_DOCS with the smallest hash of their id, and the TRAIN_EACH such of each language,
so that rare languages are learned, too.  The script of a
word's first letter narrows its candidate languages to those that use the script; a
word's score in a language is the sum over its letters.  A Viterbi pass with a
SWITCH_PENALTY labels the words of a text, so mixed texts come apart into spans.  The
language of a document is the one that holds most of its letters; the score is the share
of letters it holds, words in scripts that no language uses counting against it.

Texts are read whole and stay in their task.  Inside a task texts are ordered by length
and stepped through side by side.

Null texts and texts without letters are `und` with score 0, and so is everything if
nothing can be learned.  A document with a null id is neither held out nor learned from.
Repeated rows are labelled alike; ties go to the alphabetically first language.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jsonloom.llm.common import arrow_map, numbered, row_groups, smallest

#: Most labelled documents that are learned from whatever their language.
TRAIN_DOCS = 4_000
#: Most languages that are learned, those with most labelled documents first.
MOST_LANGS = 500
#: Labelled documents of each language that are learned from beside them, and the parts in which they are ranked first.
TRAIN_EACH, RANK_PARTS = 50, 64
BUCKETS = 1 << 15
SMOOTHING = 0.05
#: Log-probability that a change of language between two words costs.
SWITCH_PENALTY = 12.0
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: Share of letters in the document's language from which a filter keeps it.
KEEP_FROM = 0.5
#: Characters handled side by side.
GROUP_CHARS = 2_000_000
#: Ends (exclusive) of ranges of letters and their scripts, in order.
SCRIPTS = (
    (0x0250, "latin"), (0x0370, "other"), (0x0400, "greek"), (0x0530, "cyrillic"),
    (0x0590, "armenian"), (0x0600, "hebrew"), (0x0780, "arabic"), (0x0900, "other"),
    (0x0980, "devanagari"), (0x0A00, "bengali"), (0x0B80, "other"), (0x0C00, "tamil"),
    (0x0E00, "other"), (0x0E80, "thai"), (0x10A0, "other"), (0x1100, "georgian"),
    (0x1200, "hangul"), (0x1380, "ethiopic"), (0x1E00, "other"), (0x1F00, "latin"),
    (0x2000, "greek"), (0x3040, "other"), (0x3100, "kana"), (0x3400, "other"),
    (0xA000, "han"), (0xAC00, "other"), (0xD7B0, "hangul"), (0xF900, "other"),
    (0xFB00, "han"), (0x20000, "other"), (0x32000, "han"), (0x110000, "other"),
)
SCRIPT_NAMES = tuple(sorted({name for _, name in SCRIPTS}))
NO_CANDIDATE = np.float32(-1e6)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, is it a letter or a mark, and its script."""
    letter, inside = np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=bool)
    script = np.zeros(0x110000, dtype=np.uint8)
    start = 0
    for end, name in SCRIPTS:
        script[start:end] = SCRIPT_NAMES.index(name)
        start = end
    for i in range(0x33000):  # no letters are assigned beyond
        kind = unicodedata.category(chr(i))[0]
        letter[i], inside[i] = kind == "L", kind in "LM"
    return letter, inside, script


class Words:
    """The words of several texts, in one array of code points: runs of letters and marks that hold a letter."""

    def __init__(self, texts: list[str]):
        joined = "\n" + "\n".join(texts) + "\n"
        code = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(code) != len(joined):  # lower-casing changed lengths somewhere
            lowered = [x.lower() for x in texts]
            joined = "\n" + "\n".join(lowered) + "\n"
            code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            texts = lowered
        letter, either, script = tables()
        inside = either[code]
        edge = inside[1:] != inside[:-1]
        starts = np.flatnonzero(edge & inside[1:]) + 1
        if len(starts):
            ends = np.flatnonzero(edge & inside[:-1]) + 1
            bare = np.flatnonzero(np.add.reduceat(letter[code], starts, dtype=np.int64) == 0)
            for a, b in zip(starts[bare].tolist(), ends[bare].tolist(), strict=True):
                inside[a:b] = False  # marks alone are no word
        at = np.flatnonzero(inside)
        edge = inside[1:] != inside[:-1]
        starts = np.flatnonzero(edge & inside[1:]) + 1
        ends = np.flatnonzero(edge & inside[:-1]) + 1
        self.lengths = ends - starts
        masked = np.where(inside, code, 32)
        h = masked[at - 1] * np.uint32(0x9E3779B1) + masked[at] * np.uint32(0x85EBCA77)
        h += masked[at + 1] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        self.grams = ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int32)
        #: First gram of each word, the script of each word, and the first word of each text.
        self.first = np.cumsum(self.lengths) - self.lengths
        self.script = script[code[starts]]
        text_ends = np.cumsum([len(x) + 1 for x in texts])
        self.bounds = np.concatenate([[0], np.searchsorted(starts, text_ends, side="right")])


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Log-probabilities (buckets x languages) and candidates (scripts x languages)."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        share = (grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
        self.scores = np.ascontiguousarray(np.log(share).T.astype(np.float32))
        letters = np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.candidate = (scripts / letters >= SCRIPT_SHARE).T.copy()

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) of texts; a span is (first word, end word, language)."""
        out: list = [(UNKNOWN, 0.0, [])] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for a, b in row_groups([len(texts[i]) + 1 for i in order], GROUP_CHARS):
            rows = order[a:b]
            words = Words([texts[i] for i in rows])
            labels = self.viterbi(words)
            known = self.candidate.any(axis=1)[words.script] if len(labels) else np.zeros(0, bool)
            for k, i in enumerate(rows):
                s, e = words.bounds[k], words.bounds[k + 1]
                if s == e:
                    continue
                held = np.bincount(
                    labels[s:e], weights=words.lengths[s:e] * known[s:e], minlength=len(self.langs)
                )
                best = int(held.argmax())
                cuts = np.flatnonzero(np.diff(labels[s:e])) + 1
                edges = [0, *cuts.tolist(), int(e - s)]
                spans = [
                    (x, y, self.langs[labels[s + x]]) for x, y in zip(edges, edges[1:], strict=False)
                ]
                out[i] = (self.langs[best], float(held[best] / words.lengths[s:e].sum()), spans)
        return out

    def viterbi(self, words: Words) -> np.ndarray:
        """A language for each word; texts step side by side, each on its own."""
        n, langs = len(words.lengths), len(self.langs)
        labels = np.zeros(n, dtype=np.uint16)
        if not n:
            return labels
        emit = np.add.reduceat(self.scores[words.grams], words.first, axis=0)
        candidate = self.candidate[words.script]
        emit = np.where(candidate, emit, NO_CANDIDATE)
        emit[~candidate.any(axis=1)] = 0
        counts = np.diff(words.bounds)
        order = np.argsort(-counts, kind="stable")
        counts, first = counts[order], words.bounds[:-1][order]
        active = np.searchsorted(-counts, -np.arange(counts[0]), side="left")  # texts with over t words
        switched = np.zeros((n, langs), dtype=bool)
        origin = np.zeros(n, dtype=np.uint16)
        value = np.zeros((len(counts), langs), dtype=np.float32)
        for t in range(counts[0]):
            k = active[t]
            at = first[:k] + t
            v = value[:k]
            if t:
                best = v.argmax(axis=1)
                moved = v[np.arange(k), best][:, None] - np.float32(SWITCH_PENALTY)
                switched[at] = moved > v
                origin[at] = best
                v = np.maximum(v, moved)
                v -= v.max(axis=1, keepdims=True)  # keeps single precision exact enough on long texts
            value[:k] = v + emit[at]
        state = value.argmax(axis=1).astype(np.uint16)
        for t in range(counts[0] - 1, -1, -1):
            k = active[t]
            at = first[:k] + t
            s = state[:k]
            labels[at] = s
            state[:k] = np.where(switched[at, s], origin[at], s)
        return labels


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """The model, from labelled documents that are not held out."""
    usable = docs.filter(
        F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).select("doc_id", "lang", "text")
    common = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    common = [r.lang for r in common.collect()]
    usable = usable.filter(F.col("lang").isin(common))
    ids = usable.select(F.col("doc_id").alias("chosen"), "lang")
    ranked = ids.withColumn("part", F.pmod(F.xxhash64("chosen", F.lit(1)), F.lit(RANK_PARTS)))
    for keys in (("lang", "part"), ("lang",)):  # no task ranks all of a common language
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("chosen"), "chosen"))
        ranked = ranked.withColumn("rank", rank).filter(F.col("rank") <= TRAIN_EACH).drop("rank")
    first = smallest(ids.select("chosen"), "chosen", train_docs)
    chosen = first.union(ranked.select("chosen")).distinct()
    # at most train_docs rows and TRAIN_EACH for each of MOST_LANGS languages
    sample = usable.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"))

    def count(**columns):
        out: tuple[list, list, list] = ([], [], [])
        for lang, text in zip(columns["lang"].to_pylist(), columns["text"].to_pylist(), strict=True):
            words = Words([text])
            grams, n = np.unique(words.grams, return_counts=True)
            scripts = np.bincount(words.script, weights=words.lengths, minlength=len(SCRIPT_NAMES))
            found = np.flatnonzero(scripts)
            out[0].extend([lang] * (len(grams) + len(found)))
            out[1].extend(grams.tolist() + (-1 - found).tolist())
            out[2].extend(n.tolist() + scripts[found].astype(int).tolist())
        return list(out)

    counts = arrow_map(sample.select("lang", "text"), count, "lang string, gram int, n bigint")
    rows = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets
    langs = sorted(set(rows["lang"].to_pylist()))
    if not langs:
        return None
    grams = np.zeros((len(langs), BUCKETS))
    scripts = np.zeros((len(langs), len(SCRIPT_NAMES)))
    place = np.array([langs.index(x) for x in rows["lang"].to_pylist()])
    gram, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
    inner = gram >= 0
    grams[place[inner], gram[inner]] = n[inner]
    scripts[place[~inner], -1 - gram[~inner]] = n[~inner]
    return Model(langs, grams, scripts)


SPANS = "array<struct<first: int, end: int, lang: string>>"


def with_language(
    docs: DataFrame, model: Model | None, spans: bool = True, text_col: str = "text"
) -> DataFrame:
    """The rows and `found`: struct(lang_pred, score, spans); spans count words from 0."""

    def run(**columns):
        texts = [x or "" for x in columns[text_col].to_pylist()]
        rows = model.label(texts) if model else [(UNKNOWN, 0.0, [])] * len(texts)
        found = [
            {
                "lang_pred": lang,
                "score": score,
                "spans": [dict(zip(("first", "end", "lang"), x, strict=True)) for x in parts] if spans else [],
            }
            for lang, score, parts in rows
        ]
        return [*columns.values(), found]

    added = F.lit(None).cast(f"struct<lang_pred: string, score: double, spans: {SPANS}>")
    return arrow_map(docs, run, docs.select("*", added.alias("found")).schema)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, spans."""
    found = with_language(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "found.*")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose language is clear: known and holding most letters.

    Where no language can be learned, all documents stay.
    """
    model = learn(docs)
    if model is None:
        return docs
    own, text, _ = numbered(docs)
    found = with_language(own, model, spans=False, text_col=text)
    clear = (F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= KEEP_FROM)
    return found.filter(clear).select(*own.columns).toDF(*docs.columns)
