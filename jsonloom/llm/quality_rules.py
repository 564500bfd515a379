"""Operator 4: quality rules with host verdicts.

Every document gets its base figures in one narrow pass over whole texts.  Failures of
the base rule are summed by host (the host part of `source`); the rates of hosts are shrunk towards the
corpus rate with a beta prior whose strength comes from the spread between hosts
(method of moments), and a host whose shrunk rate passes HOST_LIMIT rejects its
documents.  The per-document figures are written once, so texts are read once and are
never shuffled; only counts by host are.

Null and empty texts have no words and fail the base rule.  A document without a host
(null source) has no host verdict.  Repeated rows count once each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.common import arrow_map, site, stored

#: White space between words, and the symbols that are counted.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50
MOST_REPEATED = 0.5
#: A host is rejected if its shrunk rate of failures is above this.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength in documents.
STRENGTH = (1.0, 1e6)


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == n:
        return 0
    pairs = np.unique(ids[:-2] * len(seen) + ids[1:-1], return_inverse=True)[1]
    windows = pairs * len(seen) + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = counts[which] > 1
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= starts
    covered[1:-1] |= starts
    covered[2:] |= starts
    return int(covered.sum())


def figures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measure(docs: DataFrame) -> DataFrame:
    """Base figures and base_failed by document."""

    def run(**columns):
        rows = [figures(x) for x in columns["text"].to_pylist()]
        return [columns["doc_id"], columns["source"], *(zip(*rows, strict=True))]

    kinds = {n: docs.schema[n].dataType.simpleString() for n in ("doc_id", "source")}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = arrow_map(
        docs.select("doc_id", "source", "text"),
        run,
        f"doc_id {kinds['doc_id']}, source {kinds['source']}, " + ", ".join(f"{n} bigint" for n in names),
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (
        100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words")
    )
    return out.withColumn("base_failed", failed)


@dataclass
class BetaPrior:
    """Mean and strength (in rows) of a beta prior."""

    mean: float
    strength: float


def beta_prior(groups: DataFrame, n: str = "n", hits: str = "hits") -> BetaPrior:
    """Prior of the rates hits/n of groups, by moments; one aggregated row reaches the driver."""
    rate = F.col(hits) / F.col(n)
    row = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col(n).cast("double")).alias("n"),
        F.sum(F.col(hits).cast("double")).alias("hits"),
        F.sum(F.col(n).cast("double") * F.col(n)).alias("n2"),
        F.sum(rate * F.col(hits)).alias("rh"),
    ).first()
    if not row.k or not row.n:
        return BetaPrior(0.5, STRENGTH[0])
    mean = row.hits / row.n
    spread = row.rh - mean * row.hits  # sum of n * (rate - mean)^2
    noise = mean * (1 - mean)
    room = row.n - row.n2 / row.n - (row.k - 1)
    between = (spread - (row.k - 1) * noise) / room if room > 0 else 0.0
    strength = noise / between - 1 if between > 0 else STRENGTH[1]
    return BetaPrior(mean, min(max(strength, STRENGTH[0]), STRENGTH[1]))


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(host, n, hits, rate, host_rejected) of hosts; rate is the shrunk one."""
    hosts = stored(
        measured.filter(F.col("source").isNotNull())
        .groupBy(site(F.col("source"))[0].alias("host"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("hits")),
        "rule-hosts",
    )
    prior = beta_prior(hosts)
    rate = (F.col("hits") + prior.mean * prior.strength) / (F.col("n") + prior.strength)
    return hosts.withColumn("rate", rate).withColumn("host_rejected", rate > HOST_LIMIT)


def apply_rules(docs: DataFrame) -> DataFrame:
    """One row per document: figures, base_failed, host_rejected, kept."""
    measured = stored(measure(docs), "rule-figures")
    verdicts = host_verdicts(measured).select("host", "host_rejected")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return (
        measured.withColumn("host", F.when(F.col("source").isNotNull(), site(F.col("source"))[0]))
        .join(verdicts, "host", "left")
        .withColumn("host_rejected", rejected)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .drop("source", "host")
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
        regexp_extract(regexp_replace(source, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^[^/?#]*') AS source FROM documents),
w AS (SELECT r, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) x(o) WHERE c > 1 GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT doc_id, source, len(ws) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS hits FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT count(*) AS k, sum(n) AS n, sum(hits) / sum(n) AS mean, sum(n * n) AS n2,
             sum(hits * hits / n) - sum(hits) * sum(hits) / sum(n) AS spread FROM h),
p AS (SELECT mean, mean * (1 - mean) AS noise, n - n2 / n - (k - 1) AS room, spread - (k - 1) * mean * (1 - mean) AS extra FROM m),
s AS (SELECT mean, CASE WHEN room > 0 AND extra > 0 THEN least(greatest(noise * room / extra - 1, 1), 1e6) ELSE 1e6 END AS strength FROM p),
v AS (SELECT source, (hits + mean * strength) / (n + strength) > 0.5 AS host_rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(host_rejected, false) AS host_rejected, NOT base_failed AND NOT coalesce(host_rejected, false) AS kept
FROM b LEFT JOIN v USING (source)
"""
