"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its hashed byte trigrams.  A truncated SVD of the labelled sample's weighted term
matrix gives the latent space; a few measures of style are appended.  The labelled vectors are
broadcast, each document is compared with all of them by exact blocked cosine products, and its
nearest neighbours vote with weights that grow with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, slices
from .labelled import sample

TERMS, LATENT, STYLE_WEIGHT, NEIGHBOURS, SHARPNESS = 2048, 48, 0.35, 15, 20.0
#: Bytes of text whose terms are counted at a time, and documents compared at a time.
CHUNK, BLOCK = 1 << 18, 256
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def byte_kinds() -> np.ndarray:
    """0 lower case, 1 upper case, 2 digits, 3 white space, 4 common punctuation, 5 other ASCII, 6 beyond ASCII."""
    kinds = np.full(256, 5)
    kinds[128:] = 6
    for k, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\n\r", b".,;:'\"-()?")):
        kinds[list(chars)] = k
    return kinds


KINDS = byte_kinds()


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram counts and byte-kind counts, a row for each text; a text of any length is counted in pieces."""
    terms, kinds = np.zeros((len(texts), TERMS), np.float32), np.zeros((len(texts), 7), np.float32)
    for lo, hi in slices([len(t) for t in texts], CHUNK):
        for start in range(0, max(1, max(map(len, texts[lo:hi]))), CHUNK):
            pieces = [t[start : start + CHUNK + 2] for t in texts[lo:hi]]
            data = np.frombuffer(b"".join(p + b"\0\0" for p in pieces), np.uint8)
            owner = np.repeat(np.arange(hi - lo), [len(p) + 2 for p in pieces])
            x = data.astype(np.uint32)
            gram = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(21)
            inside = (data[2:] != 0) & (data[1:-1] != 0) & (data[:-2] != 0)  # none that touches the zeros between texts
            cell = owner[:-2] * TERMS + gram
            terms[lo:hi] += np.bincount(cell[inside], minlength=(hi - lo) * TERMS).reshape(hi - lo, TERMS)
            size = [min(len(p), CHUNK) for p in pieces]
            first = np.concatenate([np.arange(s) + at for s, at in zip(size, np.cumsum([0] + [len(p) + 2 for p in pieces]))]) if pieces else []
            kinds[lo:hi] += np.bincount(owner[first] * 7 + KINDS[data[first]], minlength=(hi - lo) * 7).reshape(hi - lo, 7)
    return terms, kinds


def style(terms: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Shares of the kinds of bytes, how evenly the terms are spread, and the length's logarithm."""
    n = kinds.sum(1, keepdims=True)
    total = np.maximum(terms.sum(1, keepdims=True), 1)
    p = terms / total
    spread = -(p * np.log(np.maximum(p, 1e-12))).sum(1, keepdims=True)
    return np.hstack([kinds / np.maximum(n, 1), spread / np.log(np.minimum(total, TERMS) + 2), np.log1p(n) / 10])


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, of equal ones the first; in the order of columns."""
    edge = np.partition(cosines, -k, axis=1)[:, -k, None]
    above, at = cosines > edge, cosines == edge
    taken = above | at & (np.cumsum(at, 1) <= k - above.sum(1, keepdims=True))
    return np.nonzero(taken)[1].reshape(len(cosines), k)


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, terms: np.ndarray, kinds: np.ndarray, y: np.ndarray):
        self.prior = float(y.mean()) if len(y) else 1.0
        self.usable = len(np.unique(y)) == 2
        if not self.usable:
            return
        self.idf = (np.log((1 + len(y)) / (1 + (terms > 0).sum(0))) + 1).astype(np.float32)
        weighted = self.weigh(terms)
        # a randomised range finder, then the small SVD
        rng = np.random.default_rng(7)
        q = rng.standard_normal((TERMS, min(LATENT + 10, len(y)))).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(weighted.T @ (weighted @ q))
        _, _, vt = np.linalg.svd(weighted @ q, full_matrices=False)
        self.project = np.ascontiguousarray((q @ vt.T)[:, :LATENT]).astype(np.float64)
        s = style(terms, kinds)
        self.mean, self.scale = s.mean(0), s.std(0) + 1e-6
        self.vectors, self.y = self.embed(terms, kinds), y.astype(np.float32)
        # a rarer label's neighbours count for more, by the root of how much rarer it is
        self.votes = np.sqrt(0.5 / np.where(y == 1, self.prior, 1 - self.prior))

    def weigh(self, terms: np.ndarray) -> np.ndarray:
        x = np.log1p(terms) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def embed(self, terms: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Unit vectors."""
        z = np.clip((style(terms, kinds) - self.mean) / self.scale, -4, 4) * STYLE_WEIGHT
        # in double precision, so a text's score doesn't hang on the texts beside it
        x = np.hstack([self.weigh(terms).astype(np.float64) @ self.project, z])
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.usable:
            return np.full(len(texts), self.prior)
        out = np.zeros(len(texts))
        k = min(NEIGHBOURS, len(self.y))
        for lo in range(0, len(texts), BLOCK):
            cosines = np.round(self.embed(*term_counts(texts[lo : lo + BLOCK])) @ self.vectors.T, 9)
            near = nearest(cosines, k)
            weight = np.exp(SHARPNESS * np.take_along_axis(cosines, near, 1).astype(np.float64)) * self.votes[near]
            out[lo : lo + BLOCK] = (weight * self.y[near]).sum(1) / weight.sum(1)
        return np.round(np.clip(out, 0, 1), 9)


def fit(docs: DataFrame, labels: DataFrame, per_class: int) -> Model:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, kinds = term_counts([t.encode() for t in batch.column("text").to_pylist()])
            whole = np.hstack([terms, kinds])
            at = [np.flatnonzero(r) for r in whole]
            # counts of any size are whole numbers that doubles hold; places without a count aren't sent
            columns = [pa.array([x.astype("<u4").tobytes() for x in at], pa.binary()), pa.array([r[x].astype("<f8").tobytes() for r, x in zip(whole, at)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *columns], ["doc_id", "y", "places", "counts"])

    found: pd.DataFrame = sample(docs, labels, "quality", (per_class, per_class)).mapInArrow(counted, "doc_id long, y int, places binary, counts binary").toPandas()
    found = found.sort_values("doc_id")
    rows = np.zeros((len(found), TERMS + 7), np.float32)
    for row, at, counts in zip(rows, found["places"], found["counts"]):
        row[np.frombuffer(at, "<u4")] = np.frombuffer(counts, "<f8")
    return Model(rows[:, :TERMS], rows[:, TERMS:], found["y"].to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 2000, keep: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, score (higher: better), predicted (1 if score >= threshold); with keep instead the documents that are predicted 1, as they are.

    The model is fitted on at most per_class labelled documents of each label, never on held-out ones;
    scores read the text alone, whole.  Of labelled texts that are equally near (to nine digits) those of the
    smallest doc_ids vote.  Null texts are scored as empty; a null doc_id stays null and isn't
    held out; repeated rows are scored alike.  Without labels of both kinds each score is the share of
    label 1, or 1.0 without any.  Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
            good = scores >= threshold
            if keep:
                yield batch.filter(pa.array(good))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array(good.astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return plain.mapInArrow(run, SCHEMA)
