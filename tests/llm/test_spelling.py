"""Spelling variants against all pairs, wavelet trees against plain scans, and odd inputs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from binloom.llm.spelling import WaveletTree, near_words, spelling_variants

DOCS = "doc_id long, text string"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}
    form, near = {}, {}
    for w in n:
        mine = [x for x in n if one_edit(w, x)]
        near[w] = len(mine)
        best = min(mine, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], near[w], n.get(form[w])) for w in n}


def written(rng, words, docs):
    return [(k, rng.choice([" ", "-", "9"]).join(rng.choice(words) for _ in range(60))) for k in range(docs)]


@pytest.mark.parametrize(("letters", "shard"), [("ab", 200), ("ab", 1 << 21), ("abcdéÀ×", 500), ("a", 100)])
def test_all_pairs(spark, letters, shard):
    rng = random.Random(letters + str(shard))
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 11))) for _ in range(150)]
    words += [w[:4] + "q" + w[4:] for w in words[:30]] + [w.upper() for w in words[:20]] + words[:2] * 60
    docs = written(rng, words, 60) + [(None, " ".join(words)), (3, words[0]), (3, words[0]), (4, None), (5, "")]
    got = spelling_variants(spark.createDataFrame(docs, DOCS), shard=shard).collect()
    want = brute(docs)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_chains(spark):
    """Forms of forms lead to one root; the deepest chain needs several rounds."""
    chain = ["abcdefg" + "h" * k for k in range(6)]
    docs = [(k, " ".join([w] * (2 * 10**k))) for k, w in enumerate(chain[:5])]
    got = {r.word: r for r in spelling_variants(spark.createDataFrame(docs, DOCS), every=1 << 40).collect()}
    assert {r.root for r in got.values()} == {chain[4]} and [got[w].form for w in chain[:5]] == [*chain[1:5], None]


def test_long_words(spark):
    """Words of a hundred thousand letters, and a text without any break."""
    rng = random.Random(1)
    long = "".join(rng.choice("abc") for _ in range(100_000))
    other = long[:60_000] + "z" + long[60_001:]
    docs = [(1, f"{long} {long} {other} {other} {other[:-1]} {other[:-1]}"), (2, "x" * 1_500_000), (3, "x" * 1_500_000)]
    got = {r.word: (r.n, r.n_near) for r in spelling_variants(spark.createDataFrame(docs, DOCS), every=1 << 40).collect()}
    assert got == {long: (2, 1), other: (2, 2), other[:-1]: (2, 1), "x" * 1_500_000: (2, 0)}


def test_long_text(spark):
    docs = [(k, "vocabulary vocabulery, " * 80_000) for k in range(2)]
    assert {tuple(r) for r in spelling_variants(spark.createDataFrame(docs, DOCS), every=1 << 40).collect()} == {("vocabulary", None, "vocabulary", 160_000, 1, None), ("vocabulery", None, "vocabulery", 160_000, 1, None)}


def test_empty_and_clashing(spark):
    assert spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "letters letters", 3, "x", 1, True, "k")], f"{DOCS}, n int, word string, size int, member boolean, key string")
    assert {tuple(r) for r in spelling_variants(clash, every=1 << 40).collect()} == {("letters", None, "letters", 2, 0, None)}


def test_wavelet_tree():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 17, 64, 100):
        values = rng.permutation(n)
        lo, hi, least, end = rng.integers(0, n + 1, (4, 50))
        query, value = WaveletTree(values).report(lo, hi, least, end)
        want = {(q, v) for q in range(50) for v in values[lo[q] : hi[q]] if least[q] <= v < end[q]}
        assert len(query) == len(want) and set(zip(query.tolist(), value.tolist())) == want


def test_near_words():
    words = [b"banana", b"bandna", b"banan", b"anana", b"canana", b"banna"]
    member = np.array([True, True, False, False, True, False])
    a, b = near_words(6, range(6), words, member)
    assert {(words[x], words[y]) for x, y in zip(a, b)} == {(b"banana", b"bandna"), (b"bandna", b"banana"), (b"banana", b"canana"), (b"canana", b"banana"), (b"banan", b"banana"), (b"anana", b"banana"), (b"anana", b"canana"), (b"banna", b"banana"), (b"banna", b"bandna")} and len(a) == 9
