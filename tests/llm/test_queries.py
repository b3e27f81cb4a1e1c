"""The registered queries over whole tables: those with SQL against it, the others against the library or brute force."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from binloom.llm import queries as q

from .test_dedup import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_bytes n_tokens over_limit", "op2": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op3": "vec_id n_links component_id kept", "op4": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5": "doc_id held_out score predicted", "op6": "conv_id turn role n_turns rendered", "op7": "doc_id n_bytes n_removed n_spans kept_sha256 kept_text", "op8": "doc_id keep_id group_size kept text_sha256", "op9": "doc_id held_out score predicted", "op10": "doc_id fingerprint component_id",
    "op11": "page_id url text n_chars", "op12": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley", "op13": "word form root n n_near form_n",
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return {i: t or "" for i, t in db.sql("SELECT doc_id, text FROM documents").fetchall()}


@pytest.fixture(scope="module")
def rows(spark):
    return {name: f(spark, SF).collect() for name, f in q.queries().items()}


def test_columns(rows):
    assert {n.split("_")[0]: " ".join(r[0].asDict()) for n, r in rows.items()} == COLUMNS


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(rows, db, name):
    want = db.sql(q.oracle_sql()[name])
    order = [want.columns.index(c) for c in COLUMNS[name.split("_")[0]].split()]
    assert sorted(map(str, map(tuple, rows[name]))) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


def test_tokens(rows, texts):
    t = Tokenizer.from_file(q.byte_bpe())
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows["op1_token_counts"]} == {i: (len(texts[i].encode()), len(x), len(x) > 512) for i, x in ids.items()}
    packed = lambda x: np.array(x, "<u4").tobytes()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert {tuple(r) for r in rows["op4_bpe_round_trip"]} == {(i, len(x), sha(packed(x)), sha(t.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items()}
    whole = dict.fromkeys(ids, 0)
    for r in rows["op2_packing"]:
        assert r.ids_crc32 == zlib.crc32(packed([*ids[r.doc_id], 0][r.start : r.start + r.length]))
        whole[r.doc_id] += r.length
    assert whole == {i: len(x) + 1 for i, x in ids.items()}


def test_fingerprints(rows, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    group, least = brute_components(prints.values()), {}
    for i, f in prints.items():
        least[group[f]] = min(i, least.get(group[f], i))
    assert {tuple(r) for r in rows["op10_simhash_dedup"]} == {(i, f"{f:016x}", least[group[f]]) for i, f in prints.items()}
