import itertools

import numpy as np
from pyspark.sql import functions as F

from jsonloom.llm import language_id
from jsonloom.llm.language_id import SWITCH_PENALTY, UNKNOWN, Words, identify, keep_known, learn

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.count() > 100
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()
    assert got.filter("score < 0 or score > 1").count() == 0
    assert keep_known(docs).columns == docs.columns and keep_known(docs).count() >= 0.99 * docs.count()


ENGLISH = "the house of the men was there and with their children they walked"
GERMAN = "und der mann hat nicht gesehen dass die kinder schon gegangen sind"


def model_of(spark):
    rows = [(i, text, lang) for i in range(40) for text, lang in ((ENGLISH, "en"), (GERMAN, "de"), ("мир и дом был тут", "ru"))]
    return learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_spans_and_scripts(spark):
    model = model_of(spark)
    (lang, score, spans), *rest = model.label([ENGLISH + " " + GERMAN, "мир", "漢字", "12 !", "", ENGLISH * 200])
    assert [x[2] for x in spans] == ["en", "de"] and lang in ("en", "de") and 0.4 < score < 0.6
    assert rest[0][:2] == ("ru", 1.0) and rest[1][1] == 0.0
    assert rest[2][:2] == rest[3][:2] == (UNKNOWN, 0.0) and rest[4][:2] == ("en", 1.0)


def test_viterbi_is_the_best_path(spark):
    model = model_of(spark)
    words = Words(["the mann of und der house", "kinder walked"])
    emit = np.add.reduceat(model.scores[words.grams], words.first, axis=0)
    emit = np.where(model.candidate[words.script], emit, -1e6)
    labels = model.viterbi(words)
    for a, b in zip(words.bounds, words.bounds[1:], strict=False):
        def value(path, a=a):
            change = sum(x != y for x, y in zip(path, path[1:], strict=False))
            return sum(emit[a + i, x] for i, x in enumerate(path)) - SWITCH_PENALTY * change
        best = max(value(p) for p in itertools.product(range(3), repeat=int(b - a)))
        assert abs(value(labels[a:b].tolist()) - best) < 1e-2


def test_edges(frame):
    rows = [(i, ENGLISH, "en", None, None) for i in range(20)] + [(50 + i, GERMAN, "de", None, None) for i in range(20)]
    rows += [(90, None, "en", None, None), (91, "", None, None, None), (92, "7", None, None, None), (None, ENGLISH, "de", None, None), (93, ENGLISH, None, None, None), (93, ENGLISH, None, None, None)]
    df = frame(rows)
    got = {}
    for r in identify(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[90][0].lang_pred == got[91][0].lang_pred == got[92][0].lang_pred == UNKNOWN
    assert [r.lang_pred for r in got[93]] == ["en", "en"] and got[None][0].lang_pred == "en" and not got[None][0].held_out
    assert keep_known(df).filter(F.col("doc_id").isin(90, 91, 92)).count() == 0
    assert identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(df.filter("lang is null")).collect()} == {UNKNOWN}


def test_rare_languages_are_learned(frame, monkeypatch):
    monkeypatch.setattr(language_id.learn, "__defaults__", (40,))  # a sample that misses the rare language
    rows = [(i, ENGLISH, "en", None, None) for i in range(3000)] + [(5000 + i, "한국어 문서 입니다", "ko", None, None) for i in range(4)]
    df = frame(rows).repartition(3)
    assert {r.lang_pred for r in identify(df).filter("doc_id >= 5000").collect()} == {"ko"}
    assert keep_known(df).count() == len(rows)
    blank = df.withColumn("lang", F.lit(None).cast("string"))
    assert keep_known(blank).count() == len(rows)


def test_marks_alone_are_no_letters(spark):
    model = model_of(spark)
    marks = "\u0301"
    odd = chr(0x2FFFF)  # between ideographs, and not assigned
    found = model.label([marks, f"12 {marks}!", odd, f"{marks} {ENGLISH}", "e" + marks])
    assert [x[0] for x in found[:3]] == [UNKNOWN] * 3 and found[0][1:] == (0.0, [])
    assert found[3][:2] == ("en", 1.0) and found[4][0] != UNKNOWN
    assert len(Words([f"a{marks}b {marks} c"]).lengths) == 2  # inside a word they stay


def test_languages_beyond_the_bound(spark, monkeypatch):
    rows = [(i, ENGLISH, "en") for i in range(30)] + [(50 + i, GERMAN, "de") for i in range(30)] + [(90 + i, "мир", "ru") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert learn(docs).langs == ["de", "en", "ru"]
    monkeypatch.setattr(language_id, "MOST_LANGS", 2)
    assert learn(docs).langs == ["de", "en"]
