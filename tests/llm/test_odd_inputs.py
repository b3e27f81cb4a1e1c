"""Empty tables, very long texts and columns whose names clash, for operators and pipeline stages."""

import hashlib

import pytest

import corpus_pipeline
from binloom.llm.chat import format_chats
from binloom.llm.embedding_dedup import embedding_dedup
from binloom.llm.exact_dedup import exact_dedup
from binloom.llm.near_copies import near_copies, representatives
from binloom.llm.quality import score_quality
from binloom.llm.simhash import simhash_dedup
from binloom.llm.suffix_dedup import suffix_dedup
from binloom.llm.toxicity import score_toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")


def test_empty_tables(spark, labels, tmp_path):
    none = spark.createDataFrame([], DOCS)
    for run in (exact_dedup, near_copies, representatives, simhash_dedup, suffix_dedup):
        assert run(none).count() == 0
    for run in (score_quality, score_toxicity):
        assert run(none, labels).count() == run(none, labels.limit(0)).count() == 0
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert format_chats(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.schema == none.schema)


def test_megabytes(spark):
    rng = [hashlib.md5(str(k).encode()).hexdigest() for k in range(60000)]
    long = " ".join(rng)
    other = " ".join([*rng[:-1], "end"])
    rows = [(1, long), (2, long), (3, other), (4, " " * 1_500_000), (5, "x" * 1_500_000), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(df).collect()}
    assert kept == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (6, 1)}
    near = {r.doc_id: r.component_id for r in near_copies(df).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4}
    prints = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup(df).collect()}
    assert prints[1] == prints[2] and prints[4] == prints[6] == ("0" * 16, 4)
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup(df).collect()}
    assert gone[1] == gone[2] == (len(long), len(long)) and gone[3][1] > len(long) - 800 and gone[5] == gone[4] == (1_500_000, 1_500_000) and gone[6] == (0, 0)


def test_clashing_names_in_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi")]
    plain = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    clash = spark.createDataFrame([(*r, 7, 7, "x", 1, 2, "z", 0) for r in rows], "conv_id long, turn int, role string, text string, h1 int, h2 int, n string, stretch int, n_turns int, rendered string, size int")
    want = sorted(map(str, format_chats(plain).collect()))
    assert sorted(map(str, format_chats(clash).collect())) == want and len(want) == 2


def test_clashing_names_in_the_pipeline(spark, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    texts = ["one two three four five six seven", "one two three four five six seven", "other words " * 60, None, ""]
    extra = "key string, row int, node int, bits int, kept boolean, hash string, score double, predicted int, spans int, tail string, deal int, component int, first int, level int, name string, others int, raw int"
    docs = spark.createDataFrame([(k, x, "en", "s", len(x or ""), "a", 1, 2, 3, True, "h", 0.5, 1, 4, "t", 5, 6, 7, 8, "n", 9, 10) for k, x in enumerate(texts)], f"{DOCS}, {extra}")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() > 0
        if name != "packing":
            assert out.schema == docs.schema
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{name}")
    assert sorted(r.doc_id for r in docs.collect()) == [1, 4]  # 0 is a copy of 1, 2 is like the rejected label, 3 is as empty as 4
