"""SimHash near-dedup: fingerprints of word shingles, and links found in sharded BK-trees.

Two fingerprints that differ in at most two bits agree on one of three blocks of bits, and on one of
three parts of the remaining bits.  Each of the nine choices keys a shard, so every link lies in some
shard, and a shard's members agree on over half their bits.  Shards meet by shuffle: the distinct
fingerprints grow with the corpus, so their trees can't be broadcast.  A shard over SHARD members is
split into parts, and each pair of parts is searched as a task's own small tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .components import connected_components

RADIUS, SHARD = 2, 256
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """The shingles' XXH64, in chunks; the whole sequence is the shingle of a text with fewer words, and no words have none."""
    words = text.lower().split()
    if not words:
        return
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.append(0, ends)[:n].tolist()
    ends = (ends[-n:] - 1).tolist()
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        yield np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts[lo:hi], ends[lo:hi])), "<u8", hi - lo)


def majority(chunks: Iterable[np.ndarray]) -> int:
    """64 bits; a bit is set if more than half of the hashes have it."""
    n, counts = 0, np.zeros(64, np.int64)
    for found in chunks:
        n += len(found)
        counts += np.unpackbits(found.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, width: int) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and bits (long) of every document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t or b"", width) for t in batch.column("text").to_pylist()], "<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits)], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, bits long")


def shard_masks(blocks: int = 3) -> list[int]:
    """For each choice of a block of bits and a part of the others, the bits on which a shard agrees."""
    def parts(bits: list[int]) -> list[list[int]]:
        return [bits[len(bits) * k // blocks : len(bits) * (k + 1) // blocks] for k in range(blocks)]

    out = []
    for block in parts([*range(64)]):
        for part in parts([b for b in range(64) if b not in block]):
            out.append(sum(1 << b for b in [*block, *part]))
    return [m - (1 << 64) if m >> 63 else m for m in out]


class BKTree:
    """A child hangs on its parent by their integer Hamming distance; a search follows the edges within the radius."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[at] ^ value).bit_count()
            at, parent = self.children[at].get(d, -1), at
            if at < 0:
                self.children[parent][d] = new
                return

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(self.values[at])
            stack += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found


def spanning_links(tree_side: list[int], other_side: list[int] | None) -> list[tuple[int, int]]:
    """Links that join what the pairs within RADIUS join; without other_side, pairs within tree_side."""
    tree, root, out = BKTree(), {}, []

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def link(x: int) -> None:
        for y in tree.within(x, RADIUS):
            a, b = top(x), top(y)
            if a != b:
                root[a] = b
                out.append((x, y))

    for x in tree_side:
        if other_side is None:
            link(x)
        tree.add(x)
    for x in other_side or []:
        link(x)
    return out


def near_links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (bits); their components are those of all links within RADIUS."""
    masks = F.array(*[F.lit(m) for m in shard_masks()])
    keyed = cut(distinct.select("bits", F.posexplode(masks).alias("shard", "mask")).select("bits", "shard", F.col("bits").bitwiseAND(F.col("mask")).alias("agreed")), "shards")
    sizes = cut(keyed.groupBy("shard", "agreed").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / SHARD).cast("int")).drop("n"), "shard-sizes")
    mine = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
    rows = keyed.join(sizes, ["shard", "agreed"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("shard", "agreed", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "bits")
    by = ["shard", "agreed", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def links() -> list[tuple[int, int]]:
            return spanning_links(sides[0], None if at[2] == at[3] else sides[1])

        for batch in batches:
            found = []
            for *key, mine, bits in zip(*[batch.column(c).to_pylist() for c in (*by, "mine", "bits")]):
                if key != at:
                    if at:
                        found += links()
                    at, sides = key, ([], [])
                sides[mine != key[2]].append(bits & (2**64 - 1))
            yield edges(found)
        if at:
            yield edges(links())

    def edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(found, "<u8").reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def simhash_dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most two bits are linked; component_id is the smallest
    doc_id reachable.  Equal fingerprints are one node, so copies are never paired.  Null, empty and blank
    texts have fingerprint zero and are linked like any other; null doc_ids are never a component_id
    unless their component has no other id; repeated rows give a row each; other columns are not read.
    """
    prints = cut(fingerprints(docs, width), "fingerprints")
    classes = cut(prints.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "classes")
    nodes = cut(connected_components(near_links(classes.select("bits"))), "components")
    members = classes.join(nodes, F.col("bits") == F.col("node"), "left").select("bits", "first_id", F.coalesce("component", "bits").alias("component"))
    members = cut(members, "members")
    least = cut(members.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    members = cut(members.join(least, "component").select("bits", "component_id"), "members")
    return prints.join(members, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
