"""Suffix-array dedup and embedding dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from binloom.llm import suffix_dedup as sd
from binloom.llm.embedding_dedup import embedding_dedup


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone]) if len(d) else b""
        out.append((len(d), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return "".join(rng.choices("abcdeé ", k=n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    passages = [prose(rng, n) for n in (395, 399, 400, 401, 420, 700, 1500)]
    out = [None, "", "short", "a" * 399, "a" * 1200, "xy" * 700, ("line of text\n" * 70), prose(rng, 5000), prose(rng, 3000)]
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 900))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            parts += [p, prose(rng, rng.randint(0, 60))]
        out.append("".join(parts))
    return [*out, out[7], out[7], out[8][:450], out[8][1000:1380], out[20], out[7][100:900] + out[7][100:900]]


@pytest.mark.parametrize("window", [400, 200])
@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_suffix_dedup(spark, texts, window, coalesced):
    # without coalescing, the runs of one anchor are sorted in several tasks
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, kind int").repartition(4)
    before = spark.conf.get(name)
    spark.conf.set(name, coalesced)
    try:
        got = {r.doc_id: tuple(r[1:]) for r in sd.suffix_dedup(df, window).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == dict(enumerate(brute(texts, window)))


def test_hot_anchor(spark):
    """One passage, a little under and over the window, in hundreds of unlike contexts with few letters."""
    rng = random.Random(12)
    passages = [prose(rng, n) for n in (396, 399, 405)]
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 9))) + rng.choice(passages) + "".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r[1:]) for r in sd.suffix_dedup(df).collect()}
    assert got == dict(enumerate(brute(texts, 400)))


def test_decided():
    assert sd.decided([(300, 150), (200, 250)], 400) == ([(300, 150), (200, 250)], [201, 202, 203, 204, 205, 206, 207, 208, 209, 210, 211, 212, 213, 214, 215, 216, 217, 218, 219, 220, 221, 222, 223, 224, 225, 226, 227, 228, 229, 230, 231, 232, 233, 234, 235, 236, 237, 238, 239, 240, 241, 242, 243, 244, 245, 246, 247, 248, 249])
    assert sd.decided([(100, 200)], 400) == ([], [])
    assert sd.decided([(0, 400), (0, 20)], 400) == ([(0, 400)], [])


def test_suffix_odd_rows(spark):
    rng = random.Random(8)
    a = prose(rng, 600)
    df = spark.createDataFrame([(None, a), (None, None), (2, a[:500]), (2, a[:500]), (3, "é" + a)], "doc_id long, text string")
    got = sorted(tuple(r)[1:4] for r in sd.suffix_dedup(df, keep_text=True).collect())
    want = sorted(x[:3] for x in brute([a, None, a[:500], a[:500], "é" + a], 400))
    assert got == want
    assert sd.suffix_dedup(df.limit(0)).count() == 0


def test_segments(monkeypatch):
    rng = random.Random(9)
    text = prose(rng, 4000).encode()
    whole = [x for x in sd.anchored_runs(text, 400)]
    monkeypatch.setattr(sd, "SEGMENT", 700)
    starts = lambda runs: {p: (k, a) for k, a, lo, n in runs for p in range(lo, lo + n)}
    assert starts(whole) == starts(sd.anchored_runs(text, 400)) and len(starts(whole)) == len(text) - 399


def test_deep_shallow_order():
    rng = random.Random(1)
    stem = bytes(rng.choices(b"ab", k=300))
    strings = [stem[: rng.randint(0, 300)] + bytes(rng.choices(b"ab", k=rng.randint(0, 20))) for _ in range(400)] + [b"", b"", stem, stem]
    order = sd.deep_shallow_order(strings)
    assert sorted(order) == [*range(len(strings))] and [strings[i] for i in order] == sorted(strings)
    other = [bytes(rng.choices(b"ab", k=rng.randint(0, 5))) for _ in strings]
    order, shared = sd.neighbours(strings, other)
    assert [(strings[i], other[i]) for i in order] == sorted(zip(strings, other))
    for (i, j), (x, y) in zip(zip(order, order[1:]), shared):
        assert strings[i][:x] == strings[j][:x] and strings[i][x : x + 1] != strings[j][x : x + 1] or strings[i] == strings[j] and x == len(strings[i])
        assert other[i][:y] == other[j][:y] and (other[i][y : y + 1] != other[j][y : y + 1] or other[i] == other[j])


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            c = rng.standard_normal(16)
            for _ in range(rng.integers(1, 8)):
                rows.append((i, [float(np.float32(x)) for x in c + rng.standard_normal(16) * rng.choice([0.0, 0.15, 0.27, 0.35])], label))
                i += 1
    rows += [(i + k, v, 0) for k, v in enumerate([None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e30] * 16, [1e-30] * 16])]
    return rows + [(None, rows[0][1], 0), rows[0]]


def test_embedding_dedup(spark, vectors):
    df = spark.createDataFrame([(*r, 1) for r in vectors], "vec_id long, embedding array<float>, label int, node int").repartition(3)
    got = Counter(tuple(r) for r in embedding_dedup(df, recall=0.999999).collect())
    def sound(v, label, i):
        return i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ok = [k for k, (i, v, label) in enumerate(vectors) if sound(v, label, i)]
    root = list(range(len(vectors)))
    top = lambda x: x if root[x] == x else top(root[x])
    links = [0] * len(vectors)
    for x, a in enumerate(ok):
        for b in ok[:x]:
            u, v = (np.float32(vectors[k][1]).astype(np.float64) for k in (a, b))
            if vectors[a][2] == vectors[b][2] and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least = {}
    for k in range(len(vectors)):
        if vectors[k][0] is not None:
            least[top(k)] = min(vectors[k][0], least.get(top(k), 10**9))
    want = Counter((r[0], links[k], least.get(top(k)), r[0] is not None and r[0] == least.get(top(k))) for k, r in enumerate(vectors))
    assert got == want
    assert embedding_dedup(df.limit(0)).count() == 0


def test_split_buckets(spark, monkeypatch, vectors):
    from binloom.llm import embedding_dedup as ed

    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    before = sorted(map(str, embedding_dedup(df, recall=0.999999).collect()))
    monkeypatch.setattr(ed, "PART", 5)
    assert sorted(map(str, embedding_dedup(df, recall=0.999999).collect())) == before
