import math

import numpy as np
from pyspark.sql import functions as F

from jsonloom.llm.common import smallest
from jsonloom.llm.quality_classifier import classify, judge, keep_good, site, site_sums
from jsonloom.llm.quality_rules import STRENGTH, apply_rules, beta_prior, figures, host_verdicts, measure

SF = "/root/testdata/sf0.01"


def brute_repeats(text):
    w = text.encode().split()
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    return len(covered)


def test_figures():
    texts = ["", "a b c", "a b c d a b c", "x x x x x", "é # $\n\nq\nq\n q\nq", "a b a b a b", " \t\n"]
    for text in texts:
        n, chars, symbols, lines, repeats = figures(text)
        assert n == len(text.encode().split())
        assert chars == sum(len(x) for x in text.encode().decode().split())
        assert symbols == sum(c in "#*$%&|<>" for c in text)
        assert repeats == brute_repeats(text), text
    assert figures("é # $\n\nq\nq\n q\nq")[3] == 2
    assert figures(None) == (0, 0, 0, 0, 0)


def test_host_verdicts(frame):
    good, bad = " ".join(f"u{k}" for k in range(60)), "short"
    rows = [(i, good, None, "fine", None) for i in range(40)]
    rows += [(100 + i, bad if i < 38 else good, None, "poor", None) for i in range(40)]
    rows += [(200, good, None, None, None), (201, None, None, "one", None)]
    df = frame(rows)
    got = {r.doc_id: r for r in apply_rules(df).collect()}
    assert all(got[i].kept for i in range(40)) and not any(got[100 + i].kept for i in range(40))
    assert not got[138].base_failed and got[138].host_rejected
    assert got[200].kept and got[201].base_failed
    assert apply_rules(df.limit(0)).count() == 0


def test_paths_of_a_host_are_pooled(frame):
    good, bad = " ".join(f"u{k}" for k in range(60)), "short"
    rows = [(i, good, None, f"https://fine.org/{i}", None) for i in range(40)]
    rows += [(100 + i, bad if i < 38 else good, None, f"http://poor.org/{i}?q", None) for i in range(40)]
    got = {r.doc_id: r for r in apply_rules(frame(rows)).collect()}
    assert all(got[i].kept for i in range(40)) and len(got) == len(rows)
    assert all(got[100 + i].host_rejected for i in range(40)) and not got[138].base_failed


def test_shrinkage(spark):
    rows = [("a", 1000, 900.0), ("b", 1000, 100.0), ("c", 1, 1.0)]
    groups = spark.createDataFrame(rows, "source string, n bigint, hits double")
    prior = beta_prior(groups)
    assert math.isclose(prior.mean, 1001 / 2001)
    assert 0.5 < (1 + prior.mean * prior.strength) / (1 + prior.strength) < 0.9
    same = spark.createDataFrame([("a", 100, 50.0), ("b", 100, 50.0)], "source string, n bigint, hits double")
    assert beta_prior(same).strength == 1e6


def test_classifier_on_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = classify(docs, labels.filter(~held)).join(labels.filter(held), "doc_id")
    wrong = got.filter(F.col("kept") != (F.col("quality") > 0)).count()
    assert wrong <= 0.03 * got.count()


def test_classifier_edges(spark, frame):
    good, bad = "the quiet river runs north of town and ", "BUY!! NOW!! $$$ ### "
    rows = [(i, good * 5 + str(i), None, f"good.org/a/{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, bad * 9 + str(i), None, "bad.org", 1) for i in range(60)]
    rows += [(300, None, None, None, None), (301, "", None, "bad.org", 1), (302, good, None, "https://good.org/b", 1), (302, good, None, "x", 1), (None, bad * 9, None, "", 1)]
    df = frame(rows)
    labels = spark.createDataFrame([(i, int(i < 100)) for i in [*range(40), *range(100, 140)]] + [(5, 1), (None, 1), (7, None)], "doc_id bigint, quality int")
    got = {}
    for r in classify(df, labels).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == df.count()
    assert all(got[i][0].kept for i in range(60)) and not any(got[100 + i][0].kept for i in range(60))
    assert got[300][0].odds == 0.0 and not got[None][0].kept and all(x.kept for x in got[302])
    kept = keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= set(range(60)) | {302}
    assert keep_good(df, labels.limit(0)).count() == df.count()
    assert classify(df.limit(0), labels).count() == 0
    parts = df.select(*site(F.col("source"))).toDF("host", "path").distinct().collect()
    assert ("good.org", "b") in map(tuple, parts) and ("good.org", "a") in map(tuple, parts)
    assert measure(df).count() == df.count() and host_verdicts(measure(df)).count() > 0


def test_posteriors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"h{int(rng.integers(0, 9)) ** 2 % 7}", f"p{int(rng.integers(0, 3))}", float(rng.normal(0, 3))) for i in range(400)]
    rows += [(900, "alone", "p", -2.0), (901, "", "", 1.5)]
    df = spark.createDataFrame(rows, "doc_id int, host string, path string, odds double").repartition(3)
    evidence = df.select("doc_id", F.struct("host", "path", "odds").alias("evidence"))
    got = {r.doc_id: r.verdict for r in judge(evidence, *site_sums(evidence)).collect()}

    def prior(groups):
        """By moments: mean of all rates, strength from the variance between groups beyond that of chance."""
        n, hits = (np.array(x) for x in zip(*groups, strict=True))
        mean = hits.sum() / n.sum()
        spread = (n * (hits / n - mean) ** 2).sum()
        noise = mean * (1 - mean)
        room = n.sum() - (n**2).sum() / n.sum() - (len(n) - 1)
        between = (spread - (len(n) - 1) * noise) / room
        strength = noise / between - 1 if between > 0 else STRENGTH[1]
        return mean, min(max(strength, STRENGTH[0]), STRENGTH[1])

    good = {i: 1 / (1 + np.exp(-o)) for i, _, _, o in rows}
    at = lambda key: [
        (len(x), sum(good[i] for i in x)) for x in ([r[0] for r in rows if key(r) == k] for k in {key(r) for r in rows})
    ]
    (mean, host_strength), (_, path_strength) = prior(at(lambda r: r[1])), prior(at(lambda r: r[1:3]))
    for i, host, path, odds in rows:
        others = [r for r in rows if r[0] != i and r[1] == host]  # each document is left out of its own site
        inner = [r for r in others if r[2] == path]
        host_rate = (sum(good[r[0]] for r in others) + mean * host_strength) / (len(others) + host_strength)
        path_rate = (sum(good[r[0]] for r in inner) + host_rate * path_strength) / (len(inner) + path_strength)
        score = 1 / (1 + np.exp(-(odds + np.log(path_rate / (1 - path_rate)) - np.log(mean / (1 - mean)))))
        assert np.allclose([got[i].host_rate, got[i].path_rate, got[i].score], [host_rate, path_rate, score], rtol=1e-6), i
        assert got[i].kept == (score >= 0.5)


def test_the_smallest_hashes(spark):
    for n, k in ((5000, 40), (30, 40), (5000, 5000)):
        df = spark.range(n).withColumnRenamed("id", "key").repartition(7)
        want = df.orderBy(F.xxhash64("key"), "key").limit(k).collect()
        assert sorted(smallest(df, "key", k).collect()) == sorted(want)
    same = spark.range(3000).select((F.col("id") % 2).alias("key"))  # the rows of one hash
    assert smallest(same, "key", 50).count() == 50
