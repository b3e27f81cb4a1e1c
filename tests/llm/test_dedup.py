"""Exact dedup, SimHash dedup and chat formatting against SQL and brute force."""

import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest
import xxhash

from binloom.llm import chat, exact_dedup
from binloom.llm.components import connected_components
from binloom.llm.simhash import BKTree, near_links, simhash_dedup


def words(rng, n):
    return " ".join("".join(rng.choices("abcdef", k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, n) for n in (1, 2, 3, 5, 40, 300, 900, 3000)]
    out = [None, "", "   ", "\t\n", "é" * 3000, "é" * 3001, *base, *base[3:], *[base[4]] * 40]
    for t in base[4:]:
        for _ in range(12):
            w = t.split(" ")
            w[rng.randrange(len(w))] = "zz"
            out.append(" ".join(w))
        out.append(t.upper())
    return [(i, t, "en", "s") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, hash string, name string").repartition(5)


@pytest.mark.parametrize("block", [3, 64, 2048])
def test_exact(spark, docs, rows, block):
    got = {tuple(r) for r in exact_dedup.exact_dedup(docs, block).collect()}
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    assert got == {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_exact_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (2, "b"), (2, "b"), (2, "c"), (None, "d"), (None, "d")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()), key=str)
    assert got == sorted([(None, 1, 3, False)] * 2 + [(1, 1, 3, True), (2, 2, 2, True), (2, 2, 2, True), (2, 2, 1, True)] + [(None, None, 2, True)] * 2, key=str)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(values):
    root = {v: v for v in values}
    top = lambda x: x if root[x] == x else top(root[x])
    vs = sorted(root)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    return {v: top(v) for v in vs}


def test_simhash(docs, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t, *_ in rows}
    comp = brute_components(prints.values())
    least = {}
    for i, f in prints.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    assert got == {i: (f"{f:016x}", least[comp[f]]) for i, f in prints.items()}


def test_bk_tree_and_links(spark):
    rng = random.Random(2)
    centre = [rng.getrandbits(64) for _ in range(3)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(700)})
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values[::97]:
        assert sorted(tree.within(v, 2)) == [x for x in values if (x ^ v).bit_count() <= 2]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in values], "bits long")
    got = {r.node: r.component for r in connected_components(near_links(nodes)).collect()}
    want, classes = brute_components(values), {}
    for v in values:
        classes.setdefault(want[v], []).append(signed(v))
    for group in classes.values():
        assert {got.get(v, v) for v in group} == {min(group)}


def test_components_of_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(100, 400)] + [(7, i) for i in range(1000, 1500)] + [(5, 5), (7, 1000), (1000, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 401)} | {i: 7 for i in [7, *range(1000, 1500)]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "A b C"), (3, "A b C"), (None, None), (None, "")], "doc_id long, text string")
    got = sorted(map(str, (r.component_id for r in simhash_dedup(df).collect())))
    assert got == ["3", "3", "3", "None", "None"]
    assert simhash_dedup(df.limit(0)).count() == 0


def test_chat(spark):
    rng = random.Random(3)
    out = []
    for c in range(60):
        turns = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "no", None, "é"])) for t in range(rng.randint(1, 5))]
        out += turns
        if c % 3 == 0:  # snapshots, copies and repeated rows
            out += [(100 + c, *x[1:]) for x in turns[: rng.randint(1, len(turns))]] + turns[:1]
    out += [(900, t, "user", str(t)) for t in range(200)] + [(901, t, "user", str(t)) for t in range(130)] + [(902, None, "user", "x"), (902, 1, "user", "y"), (902, 1, "assistant", "z"), (903, None, "user", "x"), (None, 0, "user", "x")]
    df = spark.createDataFrame(out, "conv_id long, turn long, role string, text string").repartition(4)
    t = pa.table({k: [r[i] for r in out] for i, k in enumerate(["conv_id", "turn", "role", "text"])})
    con = duckdb.connect()
    con.register("conversations", t)
    want = con.sql(f"SELECT conv_id, turn, role, n_turns, rendered FROM ({chat.SQL})").fetchall()
    got = [tuple(r) for r in chat.format_chats(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not {901, 903} & {r[0] for r in got}
    assert chat.format_chats(df.limit(0)).count() == 0
