"""BPE encoding by a pair occurrence index, and decoding.

A partition's distinct pre-tokens lie in one flat array of symbols.  The index maps each adjacent
pair to all its positions.  Active ranks are applied in ascending order: a merge makes only pairs of
higher rank, so one pass over the ranks ends with the library's pieces.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices
from .pretokens import vocabulary

#: Distinct pre-tokens whose ids a worker remembers, and bytes of text handled at a time.
REMEMBERED, CHUNK = 300_000, 4 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_known: dict[str, dict[str, bytes]] = {}


class Merges:
    """Ranks and results of the merges by pair of ids, as sorted arrays."""

    def __init__(self, path: str):
        v = vocabulary(path)
        of = v.ids
        keys = np.array([(of[a] << 32) | of[b] for a, b in v.merges], np.int64)
        self.result = np.array([of[a + b] for a, b in v.merges], np.int64)
        self.byte = np.array([of[bytes([b])] for b in range(256)], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.left, self.right = keys >> 32, keys & 0xFFFFFFFF

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, -1 where they never merge."""
        pair = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank[at], -1)


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


def every_other(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of ascending positions of a pair of equal symbols, those that merge: from the left, without overlap."""
    linked = np.append(False, following[at[:-1]] == at[1:])  # the one before overlaps this one
    first = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - first) % 2 == 0]


def encode_words(words: list[bytes], m: Merges) -> list[np.ndarray]:
    """The ids of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = m.byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(flat)
    if not n:
        return [np.zeros(0, np.int64) for _ in words]
    ends = np.cumsum(sizes)
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    following[ends[sizes > 0] - 1] = n  # n: no symbol follows within the word
    before[(ends - sizes)[sizes > 0]] = -1
    alive = np.ones(n + 1, bool)
    alive[n] = False
    # the index: positions of each rank's pair, in lists of arrays
    index: dict[int, list[np.ndarray]] = {}

    def file(at: np.ndarray) -> None:
        ranks = m.ranks(flat[at], flat[following[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        starts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])) if len(at) else []
        for a, b in zip(starts, [*starts[1:], len(at)]):
            r = int(ranks[a])
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(at[a:b])

    active: list[int] = []
    everywhere = np.arange(n)
    file(everywhere[following < n])
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        left, right = m.left[r], m.right[r]
        # entries that other merges have changed since are stale
        nxt = following[at]
        fresh = alive[at] & (nxt < n)
        at, nxt = at[fresh], nxt[fresh]
        same = (flat[at] == left) & (flat[nxt] == right)
        at = at[same]
        if len(lists) > 1:
            at = np.unique(at)
        if left == right and len(at) > 1:
            at = every_other(at, following)
        if not len(at):
            continue
        nxt = following[at]
        after = following[nxt]
        flat[at] = m.result[r]
        alive[nxt] = False
        following[at] = after
        inner = after < n
        before[after[inner]] = at[inner]
        prior = before[at]
        file(np.unique(np.concatenate([at[inner], prior[prior >= 0]])))
    kept = alive[:n]
    counts = np.add.reduceat(kept.astype(np.int64), (ends - sizes)[sizes > 0])
    per_word = np.zeros(len(words), np.int64)
    per_word[sizes > 0] = counts
    return np.split(flat[kept], np.cumsum(per_word)[:-1])


def decode(ids: np.ndarray, bytes_of: list[bytes]) -> str:
    """The text of ids, special tokens included; broken UTF-8 becomes replacement characters."""
    return b"".join(map(bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_and_decode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids (array) and decoded (text).

    Null and empty texts have no ids and decode to the empty text; a null doc_id stays null; repeated
    rows give a row each; other columns are not read.  A text of any length is handled whole, a long
    pre-token too.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m, known = vocabulary(path), merges(path), _known.setdefault(path, {s: np.array([i], "<u4").tobytes() for s, i in vocabulary(path).special.items()})
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_tokens, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
            for lo, hi in slices([len(t) for t in texts], CHUNK):
                words = [v.split(t) for t in texts[lo:hi]]
                if len(known) > REMEMBERED:
                    known.clear()
                    known.update({s: np.array([i], "<u4").tobytes() for s, i in v.special.items()})
                new = list(set(chain.from_iterable(words)) - known.keys())
                known.update(zip(new, (x.astype("<u4").tobytes() for x in encode_words([w.encode() for w in new], m))))
                for each in words:
                    raw = b"".join(map(known.__getitem__, each))
                    ids = np.frombuffer(raw, "<u4")
                    text = decode(ids, v.bytes_of)
                    n_tokens.append(len(ids))
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        all_ids.append(ids.astype(np.int64))
                        decoded.append(text)
            columns = [batch.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, SCHEMA + ", ids array<long>, decoded string" * keep_ids)
