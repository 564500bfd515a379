"""Operator 1: quality classifier by hierarchical empirical Bayes.

A linear classifier over character pairs and repetition figures gives every document a
log-odds of being good.  Its probabilities are summed by host and by (host, path); the
sums become posteriors of a chain of beta priors: paths shrink towards their host,
hosts towards the corpus, with strengths by the method of moments.  A document's final
log-odds are its own plus what its site adds to the corpus log-odds, where the site is
counted without the document itself.

The classifier is trained on at most TRAIN_ROWS labelled rows, those with the smallest
hash of their id; everything else covers all documents.  Host and path come from
`source`: what precedes the first slash after an optional scheme, and the segment after
it.  Texts are read once (twice in `keep_good`, which would otherwise shuffle them).

Null and empty texts hold no evidence: log-odds 0 plus the site's, so they follow their
site.  A null source is a site of its own.  Without labels of both kinds the classifier
gives the log-odds 0 and every document is kept.  Repeated rows count once each.
"""

from __future__ import annotations

import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.common import arrow_map, numbered, site, smallest, stored
from jsonloom.llm.quality_rules import BetaPrior, beta_prior

#: Most labelled rows that the classifier is trained on.
TRAIN_ROWS = 6_000
BUCKETS = 1_024
EXTRAS = 5
ROUNDS, RATE, DECAY = 400, 0.3, 1e-4
#: Documents whose final probability of being good is at least this are kept.
KEEP_FROM = 0.5
#: Log-odds of a document alone stay within these bounds.
BOUND = 12.0

_pair = np.arange(65536, dtype=np.uint64)
BUCKET_OF_PAIR = ((_pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)


def extras(words: list[bytes], raw: bytes) -> list[float]:
    """Shares of repeated words, of words equal to the one before and of repeated lines; lengths."""
    n = len(words)
    lines = raw.split(b"\n")
    return [
        1 - len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(n),
        np.log(len(raw) / n),
    ]


def pairs(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.int32)
    return b[:-1] * 256 + b[1:]


def features(text: str) -> np.ndarray | None:
    raw = b" " + text.encode("utf-8", "surrogatepass") + b" "
    words = raw.split()
    if not words:
        return None
    counts = np.bincount(BUCKET_OF_PAIR[pairs(raw)], minlength=BUCKETS)
    return np.concatenate([np.sqrt(counts / counts.sum()), extras(words, raw)]).astype(np.float32)


class Model:
    """Logistic regression on standardised features; the rows of x are standardised in place."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean = x.mean(axis=0)
        squares = np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x)
        self.scale = (np.sqrt(np.maximum(squares - self.mean.astype(float) ** 2, 0)) + 0.02).astype(np.float32)
        x -= self.mean
        x /= self.scale
        z = x
        w, b = np.zeros(z.shape[1], np.float32), float(np.log(y.mean() / (1 - y.mean())))
        speed, step = np.zeros_like(w), RATE / np.sqrt(z.shape[1])
        for _ in range(ROUNDS):
            error = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y
            speed = 0.9 * speed - step * (z.T @ error / len(y) + DECAY * w)
            w = w + speed
            b -= step * float(error.mean())
        self.w, self.b = w / self.scale, b - float((self.mean / self.scale) @ w)

    def __call__(self, text: str | None) -> float:
        found = features(text) if text else None
        return 0.0 if found is None else float(np.clip(found @ self.w + self.b, -BOUND, BOUND))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """The classifier, from at most `rows` labelled documents."""
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("good"))
        .select(F.col("doc_id").alias("labelled"), "good")
    )
    chosen = smallest(known, "labelled", rows)

    def run(**columns):
        found = [features(x) if x else None for x in columns["text"].to_pylist()]
        return [columns["labelled"], columns["good"], [None if f is None else f.tolist() for f in found]]

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    sample = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))  # at most `rows` rows
        .select("labelled", "good", "text")
    )
    got = arrow_map(sample, run, f"labelled {kinds['labelled']}, good int, found array<float>")
    got = got.filter(F.col("found").isNotNull()).dropDuplicates(["labelled"]).toArrow()
    good = np.array(got["good"].to_pylist(), dtype=np.float32)
    if not len(good) or good.min() == good.max():
        return None
    order = np.argsort(np.array(got["labelled"].to_pylist()), kind="stable")
    x = got["found"].combine_chunks().flatten().to_numpy().reshape(len(good), -1)[order]
    del got
    return Model(x, (good[order] > 0).astype(np.float32))


def with_evidence(
    docs: DataFrame, model: Model | None, text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The documents and `evidence` struct(host, path, odds): the classifier's log-odds."""

    def run(**columns):
        texts = columns[text_col].to_pylist()
        odds = [model(x) if model else 0.0 for x in texts]
        return [*columns.values(), odds]

    schema = docs.select("*", F.lit(0.0).alias("odds")).schema
    out = arrow_map(docs, run, schema)
    host, path = site(F.col(source_col))
    return out.select(
        *(F.col(c) for c in docs.columns),
        F.struct(host.alias("host"), path.alias("path"), F.col("odds").alias("odds")).alias("evidence"),
    )


def logistic(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def site_sums(evidence: DataFrame) -> tuple[DataFrame, BetaPrior, BetaPrior]:
    """Sums by (host, path) and host, written once, with the priors of hosts and of paths."""
    p = logistic(F.col("evidence.odds"))
    paths = stored(
        evidence.groupBy(F.col("evidence.host").alias("host"), F.col("evidence.path").alias("path")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(p).alias("hits")
        ),
        "quality-paths",
    )
    hosts = stored(
        paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("hits").alias("host_hits")),
        "quality-hosts",
    )
    sums = stored(paths.join(hosts, "host"), "quality-sites")
    return sums, beta_prior(hosts, "host_n", "host_hits"), beta_prior(paths)


def judge(evidence: DataFrame, sums: DataFrame, hosts: BetaPrior, paths: BetaPrior) -> DataFrame:
    """Replaces `evidence` by `verdict`: odds, host_rate, path_rate, score and kept."""
    keyed = sums.select(
        F.struct("host", "path").alias("site"), F.struct("n", "hits", "host_n", "host_hits").alias("sums")
    )
    joined = evidence.join(
        keyed, F.struct(F.col("evidence.host"), F.col("evidence.path")) == F.col("site")
    )
    own, s = logistic(F.col("evidence.odds")), lambda c: F.col(f"sums.{c}")
    mean = min(max(hosts.mean, 1e-6), 1 - 1e-6)
    host = (s("host_hits") - own + mean * hosts.strength) / (s("host_n") - 1 + hosts.strength)
    path = (s("hits") - own + host * paths.strength) / (s("n") - 1 + paths.strength)
    bounded = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path))
    shift = F.log(bounded / (1 - bounded)) - float(np.log(mean / (1 - mean)))
    score = logistic(F.col("evidence.odds") + shift)
    verdict = F.struct(
        F.col("evidence.odds").alias("odds"),
        host.alias("host_rate"),
        path.alias("path_rate"),
        score.alias("score"),
        (score >= KEEP_FROM).alias("kept"),
    )
    return joined.select(*(c for c in evidence.columns if c != "evidence"), verdict.alias("verdict"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, classifier log-odds, site posteriors, score, kept."""
    model = fit(docs, labels)
    evidence = with_evidence(docs.select("doc_id", "source", "text"), model)
    evidence = stored(evidence.select("doc_id", "evidence"), "quality-evidence")
    return judge(evidence, *site_sums(evidence)).select("doc_id", "verdict.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, without those that the classifier rejects."""
    model = fit(docs, labels)
    evidence = with_evidence(docs.select("source", "text"), model).select("evidence")
    # numbered columns cannot clash with the verdict's, and texts travel once
    own, text, source = numbered(docs)
    judged = judge(with_evidence(own, model, text, source), *site_sums(evidence))
    return judged.filter("verdict.kept").select(*own.columns).toDF(*docs.columns)
