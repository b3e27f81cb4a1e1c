"""Suffix-array dedup: bytes covered by a 400-byte string that also starts elsewhere are removed.

Sampling.  Each 400-byte window is filed under its anchor, the 32-byte string in it with the least
hash (the leftmost of equal ones).  Equal windows have equal anchors at equal places, so repeats are
found among the windows of one anchor, and neighbouring windows mostly share theirs: a stretch of
windows with one anchor is a run, and runs are all that is shuffled, never all suffixes.

Deciding.  Runs whose anchor is met nowhere else hold no repeat.  Runs with equal bytes are repeats as
they are.  What is left are runs with a common anchor and unlike bytes.  The suffixes that start at the
anchors are range-partitioned by anchor and bytes, and so are the reversed prefixes that end there; a task
sorts its own by multikey quicksort to a shallow depth, and by blind tries below it.  Neighbours in
either order, those across the ends of partitions too, are compared on both sides of the anchor.  The
longest prefix shared with a neighbour bounds what any other run can share, so a window beyond either
bound is met once; a window that some neighbour shares is a repeat.  The few windows between are
compared by a hash of their bytes.  Each run takes two rows however many others share its anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, runs

GRAM, SHALLOW = 32, 64
#: Bytes of a text whose anchors are found at a time; positions within fit in 24 bits.
SEGMENT = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, np.ndarray] = {}


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each GRAM-byte string."""
    size = 1
    total = data.astype(np.uint64) + np.uint64(1)
    power = _BASE
    while size < GRAM:  # polynomial hashes of 2, 4, ... bytes from those of half as many
        total = total[:-size] * power + total[size:]
        power, size = power * power, size * 2
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values, span = np.minimum(values[:-span], values[span:]), span * 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def anchored_runs(text: bytes, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor's hash, its position, first window, windows) of each run of the text, in order."""
    for lo in range(0, len(text) - window + 1, SEGMENT):
        data = np.frombuffer(text, np.uint8)[lo : lo + SEGMENT + window - 1]
        with np.errstate(over="ignore"):
            grams = gram_hashes(data)
        low = np.uint64((1 << 24) - 1)
        least = least_in_windows((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - GRAM + 1)
        starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        at = (least[starts] & low).astype(np.int64)
        keys = grams[at].view(np.int64).tolist()
        yield from zip(keys, (at + lo).tolist(), (starts + lo).tolist(), np.diff(np.append(starts, len(least))).tolist())


def content(data: bytes) -> int:
    """A hash of a run's bytes, as a signed long; with the anchor's it makes 128 bits."""
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


class BlindTrie:
    """Branches hold only their depth and first bytes; an insertion walks down without comparing, then compares once with the leaf it met."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # a leaf: [-1, items]; a branch: [depth, children by byte, -1 for an end]

    def insert(self, item: int) -> None:
        s = self.strings[item]
        if self.root is None:
            self.root = [-1, [item]]
            return
        node = self.root
        while node[0] >= 0:
            node = node[1].get(self._byte(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        same = common_prefix(s, other)
        if same == len(s) == len(other):
            node[1].append(item)
            return
        parent, node = None, self.root
        while node[0] >= 0 and node[0] < same:
            parent, node = node, node[1][self._byte(s, node[0])]
        if node[0] == same:
            node[1][self._byte(s, same)] = [-1, [item]]
            return
        branch = [same, {self._byte(other, same): node, self._byte(s, same): [-1, [item]]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][self._byte(s, parent[0])] = branch

    @staticmethod
    def _byte(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out += node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow_order(strings: list[bytes], letter: int = 8) -> list[int]:
    """Item numbers in the order of their strings; multikey quicksort by letters of several bytes, blind tries from depth SHALLOW."""
    out: list[int] = []
    stack = [([*range(len(strings))], 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) == 1 or depth and all(len(strings[i]) < depth for i in items):
            out += items
        elif depth >= SHALLOW:
            trie = BlindTrie(strings)
            for i in items:
                trie.insert(i)
            out += trie.ordered()
        else:
            letters = [strings[i][depth : depth + letter] for i in items]
            pivot = letters[len(letters) // 2]
            parts: tuple[list, list, list] = ([], [], [])
            for i, x in zip(items, letters):
                parts[(x > pivot) - (x < pivot) + 1].append(i)
            stack += [(p, depth + letter * (k == 1)) for k, p in ((2, parts[2]), (1, parts[1]), (0, parts[0])) if p]
    return out


def neighbours(a: list[bytes], b: list[bytes]) -> tuple[list[int], list[tuple[int, int]]]:
    """The items in the order of a, equal ones by b, and how many first bytes of a and of b each shares with the next."""
    order, lo = [], 0
    by_a = deep_shallow_order(a)
    while lo < len(by_a):
        hi = lo + 1
        while hi < len(by_a) and a[by_a[hi]] == a[by_a[lo]]:
            hi += 1
        same = by_a[lo:hi]
        order += [same[k] for k in deep_shallow_order([b[i] for i in same])] if hi - lo > 1 else same
        lo = hi
    return order, [(common_prefix(a[i], a[j]), common_prefix(b[i], b[j])) for i, j in zip(order, order[1:])]


def decided(pairs: list[tuple[int, int]], window: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Of one run: ranges (before, after) around its anchor that repeated windows cover, and the offsets of windows not decided.

    pairs: bytes before and from the anchor that it shares with others; among them are the longest on either side.
    A window's offset is how far before its anchor it starts.
    """
    sure = [(x, y) for x, y in pairs if x + y >= window]
    lo, hi = window - max(y for _, y in pairs), max(x for x, _ in pairs)
    known = {s for x, y in sure for s in range(window - y, x + 1)}
    return sure, [s for s in range(max(lo, 0), hi + 1) if s not in known]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def repeated_runs(texts: DataFrame, window: int) -> DataFrame:
    """t, text_id, first_id and, per text with runs to look at, what to do with each: lists of anchor, content, whether its bytes are repeated, and whether it is sorted among unlike ones."""
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, contents, counts = [], [], []
            for raw in batch.column("raw"):
                text, seen = raw.as_py(), {}
                for key, _, lo, n in anchored_runs(text, window):
                    pair = key, content(text[lo : lo + n + window - 1])
                    seen[pair] = seen.get(pair, 0) + 1
                keys.append([k for k, _ in seen])
                contents.append([c for _, c in seen])
                counts.append([*seen.values()])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, contents, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), *lists], ["doc_id", "text_id", "keys", "contents", "counts"])

    schema = "doc_id long, text_id string, keys array<long>, contents array<long>, counts array<long>"
    long_texts = texts.where(F.octet_length("text") >= window).select("doc_id", "text_id", F.col("text").cast("binary").alias("raw"))
    found = cut(long_texts.mapInArrow(scanned, schema), "scanned")
    copies = found.groupBy("text_id").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    copies = cut(copies.withColumn("t", F.monotonically_increasing_id()), "texts")
    same = found["doc_id"].eqNullSafe(copies["first_id"]) & (found["text_id"] == copies["text_id"])
    found = found.join(copies, same).select("t", "copies", F.explode(F.arrays_zip("keys", "contents", "counts")).alias("x"))
    found = found.select("t", F.col("x.keys").alias("key"), F.col("x.contents").alias("content"), (F.col("x.counts") * F.col("copies")).alias("n"))
    twice = cut(found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "keys")
    found = cut(found.join(twice, "key", "left_semi"), "runs")
    unlike = cut(found.groupBy("key", "content").agg(F.sum("n").alias("n"), F.min("t").alias("owner")), "contents")
    sorts = cut(unlike.groupBy("key").agg(F.count("*").alias("kinds")), "kinds")
    unlike = cut(unlike.join(sorts, "key").where("n > 1 OR kinds > 1"), "contents")
    sort = (F.col("kinds") > 1) & (F.col("owner") == F.col("t"))
    todo = found.join(unlike.withColumnRenamed("n", "total"), ["key", "content"]).select("t", "key", "content", (F.col("total") > 1).alias("repeated"), sort.alias("sort"))
    todo = todo.where("repeated OR sort").groupBy("t").agg(F.collect_list(F.struct("key", "content", "repeated", "sort")).alias("todo"))
    return cut(copies.join(cut(todo, "todo"), "t").select("t", "text_id", "first_id", "todo"), "todo")


SIDE = "side int, key long, t long, lo long, a binary, b binary"
FACTS = "t long, lo long, anchor long, before int, after int"
NEAR = FACTS + ", side int, key long, part int, at_end boolean, a binary, b binary"


def near_in_order(unlike: DataFrame) -> DataFrame:
    """FACTS: bytes shared with the neighbours in either order, for runs (key, t, lo, anchor, bytes) with unlike bytes."""
    def both_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, t, lo, anchor, data in zip(*[batch.column(c).to_pylist() for c in ("key", "t", "lo", "anchor", "bytes")]):
                before, after = data[:anchor][::-1], data[anchor:]
                rows += [(0, key, t, lo, after, before), (1, key, t, lo, before, after)]
            columns = [*zip(*rows)] or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])], ["side", "key", "t", "lo", "a", "b"])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        first = True
        for group in runs(batches, ["side", "key"]):
            side, key = group.column("side")[0].as_py(), group.column("key")[0].as_py()
            t, lo, a, b = (group.column(c).to_pylist() for c in ("t", "lo", "a", "b"))
            order, shared = neighbours(a, b)
            facts = [(order[k + d], x, y) for k, (x, y) in enumerate(shared) for d in (0, 1)]
            rows = [(t[i], lo[i], len(a[i] if side else b[i]), *((x, y) if side else (y, x)), side, key, part, None, None, None) for i, x, y in facts]
            # what stands at the partition's ends is compared with the next partition's later
            ends = [(i, at_end) for i, at_end in ((order[0], False), (order[-1], True))]
            ends = [(t[i], lo[i], len(a[i] if side else b[i]), None, None, side, key, part, at_end, a[i], b[i]) for i, at_end in ends]
            if first:
                rows.append(ends[0])
            first = False
            yield near_batch(rows)
            last = ends[1]
        if last:
            yield near_batch([last])

    sides = unlike.mapInArrow(both_sides, SIDE)
    near = sides.repartitionByRange("side", "key", "a", "b").sortWithinPartitions("side", "key").mapInArrow(ordered, NEAR)
    near = cut(near, "neighbours")
    # partition numbers alone come to the driver: one for each task
    parts = sorted(r.part for r in near.where("at_end").select("part").collect())
    if len(parts) < 2:
        return near.where("at_end IS NULL").select("t", "lo", "anchor", "before", "after")
    following = near.sparkSession.createDataFrame([*zip(parts, parts[1:])], "part int, next int")
    ends = near.where("at_end").join(F.broadcast(following), "part").select("side", "key", F.col("next").alias("part"), *[F.col(c).alias(f"{c}1") for c in ("t", "lo", "anchor", "a", "b")])
    starts = near.where("NOT at_end").select("side", "key", "part", "t", "lo", "anchor", "a", "b")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x, y = common_prefix(r["a"], r["a1"]), common_prefix(r["b"], r["b1"])
                shared = (x, y) if r["side"] else (y, x)
                out += [(r["t"], r["lo"], r["anchor"], *shared), (r["t1"], r["lo1"], r["anchor1"], *shared)]
            columns = [*zip(*out)] or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, [pa.int64()] * 3 + [pa.int32()] * 2)], ["t", "lo", "anchor", "before", "after"])

    met = starts.join(ends, ["side", "key", "part"]).mapInArrow(across, FACTS)
    return near.where("at_end IS NULL").select("t", "lo", "anchor", "before", "after").union(met)


def near_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    columns = [*zip(*rows)] or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], ["t", "lo", "anchor", "before", "after", "side", "key", "part", "at_end", "a", "b"])


def repeats_among(unlike: DataFrame, window: int) -> DataFrame:
    """t, lo and hi of repeated windows among runs (key, t, lo, anchor, bytes) with unlike bytes."""
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, lo, anchor, pairs in zip(*[batch.column(c).to_pylist() for c in ("t", "lo", "anchor", "pairs")]):
                sure, unsure = decided([(p["before"], p["after"]) for p in pairs], window)
                middle = lo + anchor
                out += [(t, lo, x, y, None) for x, y in merged([(middle - x, middle + y) for x, y in sure])]
                if unsure:
                    out.append((t, lo, None, None, unsure))
            columns = [*zip(*out)] or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, [pa.int64()] * 4 + [pa.list_(pa.int32())])], ["t", "run", "lo", "hi", "offsets"])

    facts = near_in_order(unlike)
    pairs = facts.groupBy("t", "lo", "anchor").agg(F.collect_list(F.struct("before", "after")).alias("pairs"))
    # a run whose bounds leave no room for a window holds no repeat
    room = F.array_max("pairs.before") + F.array_max("pairs.after") >= window
    found = cut(pairs.where(room).mapInArrow(judged, "t long, run long, lo long, hi long, offsets array<int>"), "judged")
    sure = found.where("offsets IS NULL").select("t", "lo", "hi")
    unsure = found.where("offsets IS NOT NULL").select("t", F.col("run").alias("lo"), "offsets")
    if unsure.isEmpty():
        return sure

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, t, lo, anchor, data, offsets in zip(*[batch.column(c).to_pylist() for c in ("key", "t", "lo", "anchor", "bytes", "offsets")]):
                out += [(key, s, xxhash.xxh3_128_digest(data[anchor - s : anchor - s + window]), t, lo + anchor - s) for s in offsets if s <= anchor and anchor - s + window <= len(data)]
            columns = [*zip(*out)] or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()])], ["key", "offset", "hash", "t", "lo"])

    wanted = unlike.select("key", "t", "lo").join(unsure, ["t", "lo"]).select("key", F.explode("offsets").alias("offset")).distinct().groupBy("key").agg(F.collect_list("offset").alias("offsets"))
    windows = unlike.join(cut(wanted, "wanted"), "key").mapInArrow(hashed, "key long, offset int, hash binary, t long, lo long")
    windows = cut(windows, "windows")
    same = ["key", "offset", "hash"]
    twice = cut(windows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*same), "twice")
    return sure.union(windows.join(twice, same, "left_semi").select("t", "lo", (F.col("lo") + window).alias("hi")))


def repeats(texts: DataFrame, window: int) -> DataFrame:
    """text_id and the repeated spans (lists of lo and hi) of every text that has some."""
    todo = repeated_runs(texts, window)

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "t", "lo", "anchor", "hi", "bytes"]
        types = [pa.int64()] * 5 + [pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, t, text, first_id, todo in zip(*[batch.column(c) for c in ("doc_id", "t", "raw", "first_id", "todo")]):
                if doc_id.as_py() != first_id.as_py():
                    continue
                text, t, spans = text.as_py(), t.as_py(), []
                do = {(x["key"], x["content"]): (x["repeated"], x["sort"]) for x in todo.as_py()}
                known = {k for k, _ in do}
                for key, anchor, lo, n in anchored_runs(text, window):
                    if key not in known:
                        continue
                    data = text[lo : lo + n + window - 1]
                    repeated, sort = do.get((key, content(data)), (False, False))
                    if repeated:
                        spans.append((lo, lo + n + window - 1))
                        do[key, content(data)] = (True, False)  # the first of equal ones speaks for them
                    if sort:
                        rows.append((key, t, lo, anchor - lo, None, data))
                rows += [(None, t, lo, None, hi, None) for lo, hi in merged(spans)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(types)], names)

    chosen = texts.join(todo.hint("shuffle_hash"), "text_id").select("doc_id", "t", F.col("text").cast("binary").alias("raw"), "first_id", "todo")
    chosen = chosen.mapInArrow(selected, "key long, t long, lo long, anchor long, hi long, bytes binary")
    chosen = cut(chosen, "chosen")
    unlike = chosen.where("key IS NOT NULL").select("key", "t", "lo", "anchor", "bytes")
    spans = chosen.where("key IS NULL").select("t", "lo", "hi").union(repeats_among(unlike, window))
    spans = cut(spans.groupBy("t").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    return cut(spans.join(todo.select("t", "text_id"), "t").select("text_id", "spans"), "spans")


def suffix_dedup(docs: DataFrame, window: int = 400, keep_text: bool = False, keep_columns: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also kept_text; with keep_columns all columns of docs instead, their text what is kept.

    Texts are UTF-8 bytes, null and empty ones without any; no match crosses documents; overlapping
    repeats count, and all are judged on the input.  Copies of a text are searched once and all lose
    their repeated bytes.  Bytes of a character that a cut went through stay in the digest and are
    left out of kept_text.  Null doc_ids stay null; repeated rows are copies of each other; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others")] if keep_columns else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_id"), text.alias("text"), *others, *[F.col("text").isNull().alias("no_text")] * keep_columns)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column("raw"), batch.column("spans")):
                data = text.as_py()
                gone = merged([(x["lo"], x["hi"]) for x in spans.as_py() or ()])
                edges = [0, *(e for span in gone for e in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64()] * 3 + [pa.string()] * 2)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            if keep_columns:
                yield pa.RecordBatch.from_arrays([columns[4], batch.column("others"), batch.column("no_text")], ["text", "others", "no_text"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns[: 4 + keep_text]], ["doc_id", *names[: 4 + keep_text]])

    found = texts.join(repeats(texts.select("doc_id", "text_id", "text"), window).hint("shuffle_hash"), "text_id", "left")
    if keep_columns:
        keep_text = True
        schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("others", found.schema["others"].dataType), T.StructField("no_text", T.BooleanType())])
        kept = found.select(F.col("text").cast("binary").alias("raw"), "spans", "others", "no_text").mapInArrow(removed, schema)
        return kept.select(*[F.when(~F.col("no_text"), F.col("text")).alias(c) if c == "text" else F.col("others").getField(c).alias(c) for c in docs.columns])
    return found.select("doc_id", F.col("text").cast("binary").alias("raw"), "spans").mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text)


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, f, substr(h, 2 * f + 1, 1398) AS h, least(300, n - 399 - f) AS m FROM (SELECT doc_id, h, n, unnest(range(0, n - 399, 300)) AS f FROM d WHERE n >= 400)),
w AS (SELECT doc_id, f + p AS p, md5(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT doc_id, f, h, unnest(range(0, m)) AS p FROM b)),
r AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
s AS (SELECT doc_id, min(p) AS lo, max(p) + 400 AS hi FROM (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY p) AS g
  FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS o FROM r)) GROUP BY doc_id, g),
e AS (SELECT doc_id, lo, hi FROM s UNION ALL SELECT doc_id, n, n FROM d),
k AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (lo - a)), '' ORDER BY lo, hi) AS kept FROM (SELECT e.*, d.h, coalesce(lag(hi) OVER (PARTITION BY e.doc_id ORDER BY lo, hi), 0) AS a FROM e JOIN d USING (doc_id)) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(c.removed, 0)::BIGINT AS n_removed, coalesce(c.spans, 0) AS n_spans, sha256(unhex(k.kept)) AS kept_sha256,
  decode(unhex(array_to_string(list_filter(regexp_extract_all(k.kept, '[0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].|..'), lambda x: len(x) > 2 OR x < '80'), ''))) AS kept_text
FROM d JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM s GROUP BY doc_id) AS c USING (doc_id)
"""
