import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from jsonloom.llm.common import table
from test_jaccard_join import brute as groups_of
from test_suffix_dedup import brute as bytes_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage on what its predecessor kept, against brute force."""
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, SF).cache()
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    right = sum((doc in kept) == bool(q) for doc, q in labels.items())
    assert right >= 0.97 * len(labels) and good.columns == docs.columns
    known = stages["language_id"](spark, good, SF).cache()
    assert known.columns == docs.columns and known.count() >= 0.99 * good.count()
    one = stages["jaccard_join"](spark, known, SF).cache()
    before = {r.doc_id: r.text for r in known.collect()}
    assert {r.doc_id for r in one.collect()} == set(groups_of(before, 5, 80).values())
    assert one.columns == docs.columns
    cut = stages["suffix_array_dedup"](spark, one, SF).cache()
    want = bytes_of([(r.doc_id, r.text) for r in one.collect()])
    for r in cut.collect():
        raw, gone = want[r.doc_id]
        left = len(raw) - int(gone.sum())
        assert left <= len(r.text.encode()) <= left + 8 * len(raw) / 100
        assert r.n_chars == len(r.text)
    assert cut.columns == docs.columns and cut.count() == one.count()
    out = stages["best_fit_packing"](spark, cut, SF).toPandas()
    assert set(out.doc_id) == {r.doc_id for r in cut.collect()}
    used = out.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and len(used) <= np.ceil(out.length.sum() / 2048) + 1


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
