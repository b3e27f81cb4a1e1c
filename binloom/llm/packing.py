"""Packing documents into fixed-length sequences: first-fit decreasing on a tournament tree of bin capacities.

Documents are cut at every full sequence, which needs no search.  Their tails, shorter than a
sequence, are dealt into randomised groups, and each group is packed on its own.  A group's task
holds `docs_per_group` tails of under `length` ids, so its memory doesn't depend on the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices
from .pretokens import known_words, vocabulary

#: Distinct pre-tokens whose ids a worker remembers, and characters of text encoded at a time.
REMEMBERED, CHUNK = 700_000, 4 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CUT_SCHEMA = "doc_id long, doc_tokens long, full_crcs array<long>, tail binary, deal long"


class Capacities:
    """A tournament tree: each inner node has the larger free room of its two children, so the first bin with room is found in log steps."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Takes `size` from the first bin with that much room; its number."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers; the largest items go first, ties in input order."""
    tree, bins = Capacities(len(sizes), capacity), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.first_fit(sizes[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def pack(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, from, to).

    After first-fit decreasing, the emptiest bins are cut up to fill the gaps of the others, and the
    one that is left is cut at powers of two, which need no padding.
    """
    bins = [[(i, 0, sizes[i]) for i in b] for b in first_fit_decreasing(sizes, capacity)]
    fill = [sum(b - a for _, a, b in x) for x in bins]
    order = sorted(range(len(bins)), key=lambda b: -fill[b])
    lo, hi = 0, len(order) - 1
    while lo < hi:
        into, source = order[lo], order[hi]
        gap = capacity - fill[into]
        if not gap:
            lo += 1
            continue
        item, a, b = bins[source].pop()
        if b - a > gap:
            bins[source].append((item, a, b - gap))
            a = b - gap
        bins[into].append((item, a, b))
        fill[into] += b - a
        fill[source] -= b - a
        if not fill[source]:
            hi -= 1
    out = [bins[b] for b in order[: hi + 1] if fill[b] == capacity]
    for b in order[: hi + 1]:
        if 0 < fill[b] < capacity:
            rest, left = bins[b][::-1], fill[b]
            while left:
                room, sequence = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    item, x, y = rest.pop()
                    z = min(y, x + room)
                    if z < y:
                        rest.append((item, z, y))
                    sequence.append((item, x, z))
                    room -= z - x
                out.append(sequence)
    return out


def cut_documents(docs: DataFrame, path: str, length: int, end_id: int) -> DataFrame:
    """Per document its number of ids, the CRCs of its full sequences, and the ids of its tail as little-endian 32-bit integers; and a number to deal it by.

    The number is a hash of the id and the tail, and of which such row in the task it is: repeated rows are
    dealt apart, and a task that is run again deals as before, in whatever order it gets its rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known, width = vocabulary(path).split, known_words(path, REMEMBERED), 4 * length
        end, seen, part = end_id.to_bytes(4, "little"), {}, TaskContext.get().partitionId()
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            tokens, crcs, tails, deals = [], [], [], []
            for lo, hi in slices([len(t) for t in texts], CHUNK):
                words = [split(t) for t in texts[lo:hi]]
                known.meet(chain.from_iterable(words))
                for doc_id, each in zip(ids[lo:hi], words):
                    raw = b"".join(map(known.ids.__getitem__, each)) + end
                    full = len(raw) // width
                    tokens.append(len(raw) // 4)
                    crcs.append([zlib.crc32(raw[i * width : (i + 1) * width]) for i in range(full)])
                    tails.append(raw[full * width :])
                    row = xxhash.xxh64_intdigest(b"%r %d " % (doc_id, full) + tails[-1])
                    seen[row] = seen.get(row, 0) + 1
                    deals.append(xxhash.xxh64_intdigest(b"%d %d %d" % (row, part, seen[row])) >> 1)
            columns = [pa.array(c, x) for c, x in ((tokens, pa.int64()), (crcs, pa.list_(pa.int64())), (tails, pa.binary()), (deals, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "doc_tokens", "full_crcs", "tail", "deal"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, CUT_SCHEMA)


def pack_documents(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, docs_per_group: int = 2048, seed: int = 42) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of a document, the end id after its text included, lies in one piece.  Groups are drawn
    by hashes, rows with one id or none and repeated rows apart too.  Null and empty texts are the end
    id alone; a null doc_id stays null; repeated rows are packed each; other columns are not read.  A text
    of any length is encoded whole.
    """
    groups = max(1, -(-docs.count() // docs_per_group))
    tails = cut_documents(docs, path, length, end_id)
    spread = F.pmod(F.xxhash64(F.lit(seed), "deal"), F.lit(groups))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "doc_tokens", "tail"], kind="stable").reset_index(drop=True)
        group, n = int(key[0]), 0
        doc, total, out = rows["doc_id"].tolist(), rows["doc_tokens"].tolist(), []
        for i, crcs in enumerate(rows["full_crcs"]):
            for k, crc in enumerate(crcs):
                out.append((doc[i], k * length, length, crc, total[i], n, 0))
                n += 1
        tail = rows["tail"].tolist()
        items = [i for i, t in enumerate(tail) if t]
        for sequence in pack([len(tail[i]) // 4 for i in items], length):
            offset = 0
            for item, a, b in sequence:
                i = items[item]
                out.append((doc[i], total[i] - len(tail[i]) // 4 + a, b - a, zlib.crc32(tail[i][4 * a : 4 * b]), total[i], n, offset))
                offset += b - a
            n += 1
        found = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        found["sequence_id"] = found["sequence_id"].astype("int64") + (group << 32)
        found["doc_id"] = found["doc_id"].astype("Int64")
        return found

    return tails.groupBy(spread.alias("pack_group")).applyInPandas(run, SCHEMA)
