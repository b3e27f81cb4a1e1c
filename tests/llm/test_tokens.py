"""Token counts, BPE and packing against the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from binloom.llm.bpe import encode_and_decode
from binloom.llm.packing import first_fit_decreasing, pack, pack_documents
from binloom.llm.pretokens import split_plain
from binloom.llm.token_counts import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "The quick  brown fox's\n\n\n jumps", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "x" * 3000, "ab" * 2500,
    "<|endoftext|>", "one<|endoftext|> two <|endoftext|>", "naïve Öl ñandú – “quotes” … 漢字 かな 한국어 🙂🙂 ՘꟎\U00010940", "\t\r\n  tabs \x1c\x85  end ",
    "it's we'll THEY'D 'tis ''re x\u2019s a_b __ \u00b2\u00bd3 \u00aa\u00b5\u00ba \u02af\u0250 \u00d7\u00f7", "word " * 4000, "12345 67 ½ ² III", "same", "same",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en", "s", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, n_tokens string, tail int")


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(PATH)
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}, t


def test_split_is_the_librarys():
    from tokenizers import pre_tokenizers

    lib = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for cp in range(0x3000):
        s = f"a{chr(cp)}1 {chr(cp)}a"
        assert split_plain(s) == [s[a:b] for _, (a, b) in lib.pre_tokenize_str(s)], hex(cp)


def test_words_side_by_side_are_encoded_as_alone():
    from binloom.llm.pretokens import encoded

    rng = np.random.default_rng(3)
    words = [" " * int(rng.integers(0, 2)) + "".join(rng.choice(list("abcdeioußéñ'1 ."), rng.integers(1, 12))) for _ in range(5000)]
    words = list({w for x in words for w in split_plain(x)}) + ["<|endoftext|>"]
    t = Tokenizer.from_file(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoded(words, PATH)] == [t.encode(w, add_special_tokens=False).ids for w in words]
    assert encoded([], PATH) == []


def test_counts(docs, ids):
    rows = count_tokens(docs, PATH).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        i = 3 if r.doc_id is None else r.doc_id
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((TEXTS[i] or "").encode()), len(ids[0][i]), len(ids[0][i]) > 512)


def test_bpe(docs, ids):
    rows = encode_and_decode(docs, PATH, keep_ids=True).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        i = 3 if r.doc_id is None else r.doc_id
        assert list(r.ids) == ids[0][i] and r.n_tokens == len(ids[0][i])
        assert r.decoded == ids[1].decode(ids[0][i], skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids[0][i], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


@pytest.mark.parametrize("per_group", [3, 2048])
def test_packing(docs, ids, per_group):
    rows = pack_documents(docs, PATH, docs_per_group=per_group).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[3 if r.doc_id is None else r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for i, pieces in by_doc.items():
        want, at = [*ids[0][i], 0], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0  # no padding at powers of two


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "\u00e9 " * 700_000])
def test_megabytes(spark, text):
    """Counts, ids and packing of one long run agree with each other and with the library."""
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, PATH).collect()}[1] == len(want)
    raw = {r.doc_id: r.ids_sha256 for r in encode_and_decode(df, PATH).collect()}
    assert raw[1] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    pieces = sorted(tuple(r) for r in pack_documents(df, PATH).where("doc_id = 1").select("start", "length", "ids_crc32").collect())
    ids = np.array([*want, 0], "<u4")
    assert sum(n for _, n, _ in pieces) == len(ids) and all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in pieces)


def test_repeated_rows_are_dealt_apart(spark):
    from binloom.llm.packing import cut_documents

    rows = cut_documents(spark.createDataFrame([(7, "same")] * 50 + [(None, None)] * 50, "doc_id long, text string").coalesce(1), PATH, 1024, 0).collect()
    assert len({r.deal for r in rows}) == 100
    again = cut_documents(spark.createDataFrame([(None, None)] * 50 + [(7, "same")] * 50, "doc_id long, text string").coalesce(1), PATH, 1024, 0).collect()
    assert sorted((r.doc_id is None, r.deal) for r in rows) == sorted((r.doc_id is None, r.deal) for r in again)


def test_first_fit_decreasing():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 300).tolist()
    bins, want, room = first_fit_decreasing(sizes, 100), [], []
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        at = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
        if at is None:
            at = len(room)
            room.append(100)
            want.append([])
        room[at] -= sizes[i]
        want[at].append(i)
    assert bins == want
    assert sum(b - a for s in pack(sizes, 100) for _, a, b in s) == sum(sizes)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(none, PATH).count() == encode_and_decode(none, PATH).count() == pack_documents(none, PATH).count() == 0
