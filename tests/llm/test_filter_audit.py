"""Filter audits against a loop over documents and orders, and odd inputs."""

import re
from itertools import permutations

import pytest

from binloom.llm.filter_audit import audit_filters

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """One row per part, order and step by removing documents one by one."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for k, (doc, text, source) in enumerate(docs):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs),
        }
        rows.append((k, source or "", {f for f, bad in fails.items() if bad}, doc in good, doc in toxic))
    out = set()
    for part in {r[1] for r in rows}:
        mine, gone = [r for r in rows if r[1] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                out_now = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                gone[f] += len(out_now)
                failing = sum(f in r[2] for r in mine)
                steps.append((part, order, step, len(left), len(out_now), failing - len(out_now), sum(r[2] == {f} for r in mine), sum(r[3] for r in out_now), sum(r[4] for r in out_now)))
        out |= {(*s, gone[s[1][s[2] - 1]]) for s in steps}
    return out


def test_loop(spark):
    long, plain = " ".join(f"w{k}" for k in range(250)), "a b " * 150
    docs = [
        (1, long, "x"), (2, long, "y"), (3, long + " #", "x"), (4, plain, "x"), (5, plain, None), (6, "ABC", "y"), (7, None, "x"), (8, "", ""), (9, "\x0b    é", "y"),
        (2, long, "y"), (2, "other", "x"), (None, long, "x"), (None, long, "x"), (10, long.upper(), "x"), (11, "x y " * 99 + "x", "y"), (12, "x y " * 99 + "x y", "y"), (0, plain, "y"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, None, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1), (10, 1, None)]
    got = audit_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600 * 3 and {tuple(r) for r in got} == brute(docs, labels)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_empty_and_clashing(spark, labels):
    marks = spark.createDataFrame(labels, LABELS)
    assert audit_filters(spark.createDataFrame([], DOCS), marks).count() == 0
    plain = spark.createDataFrame([(1, "a", "s"), (2, "a", "s")], DOCS)
    clash = spark.createDataFrame([(1, "a", "s", 5, 6, "h", 1, True, "k"), (2, "a", "s", 5, 6, "h", 1, True, "k")], f"{DOCS}, n int, mask int, hash string, step int, good boolean, key string")
    assert sorted(map(str, audit_filters(clash, marks).collect())) == sorted(map(str, audit_filters(plain, marks).collect()))


def test_long_text(spark):
    docs = [(1, "word " * 300_000, "s"), (2, "x" * 2_000_000, "s")]
    got = audit_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)).collect()
    assert {tuple(r) for r in got} == brute(docs, [])
