"""Held-out accuracy and odd inputs of the classifiers, and the pipeline against its stages' rules."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline
from binloom.llm.quality import score_quality
from binloom.llm.toxicity import score_toxicity, word_buckets

from .test_near_copies import brute

SF, MORE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
WINDOW = 200


@pytest.mark.parametrize("target,score,most", [("quality", score_quality, 0.03), ("toxic", score_toxicity, 0.03)])
def test_held_out(spark, target, score, most):
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r[target] for r in labels.collect()}
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count()
    cut = 0.3 if target == "quality" else 0.5
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= cut)
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(tested) > 500 and sum(r.predicted != truth[r.doc_id] for r in tested) <= most * len(tested)


@pytest.mark.parametrize("score,target,none", [(score_quality, "quality", 1.0), (score_toxicity, "toxic", 0.0)])
def test_odd_rows(spark, score, target, none):
    df = spark.createDataFrame([(None, "a b", "x", 1), (1, None, "x", 1), (2, "", "x", 1), (2, "", "x", 1), (3, "word é " * 120000, "x", 1)], "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(d, d % 2) for d in range(1, 4)] + [(None, 1), (3, None), (3, 1)], f"doc_id long, {target} int")
    rows = score(df, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert {r.score for r in score(df, labels.limit(0)).collect()} == {none}
    assert score(df.limit(0), labels).count() == 0


def test_words():
    import numpy as np

    found, starts = word_buckets(np.frombuffer("abc abcd, abcde é1 abc".encode(), np.uint8))
    assert starts.tolist() == [0, 4, 10, 16, 20]
    assert (found[0] == found[4]).all() and found[1, 1] == found[2, 1] and found[1, 0] != found[2, 0]


def windows(text):
    data = (text or "").encode()
    return [hash(data[i : i + WINDOW]) for i in range(len(data) - WINDOW + 1)]


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, reached = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        reached[name] = docs
        if name != "packing":
            assert docs.columns == columns and docs.schema == before.schema
    q, e, s, a, p = reached.values()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in q.collect()}
    assert sum(v == 1 and d not in left for d, v in truth.items()) == 0
    assert sum(v == 0 and d in left for d, v in truth.items()) <= 1
    texts = [r.text for r in q.collect()]
    assert sorted(r.text for r in e.collect()) == sorted(set(texts))
    assert {r.doc_id for r in s.collect()} == set(brute([(r.doc_id, r.text) for r in e.collect()]).values())
    rows, kept = s.collect(), {r.doc_id: r.text for r in a.collect()}
    seen = Counter(h for r in rows for h in windows(r.text))
    assert set(kept) == {r.doc_id for r in rows}
    for r in rows:
        data = (r.text or "").encode()
        gone = bytearray(len(data))
        for i, h in enumerate(windows(r.text)):
            if seen[h] > 1:
                gone[i : i + WINDOW] = b"\1" * WINDOW
        assert kept[r.doc_id] == bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
    assert {r.doc_id for r in p.select("doc_id").distinct().collect()} == {r.doc_id for r in a.collect()}
    assert all(r.n_chars == len(r.text) for r in a.collect())
