"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

A word's embedding is the sum of hashed embeddings of the word and of its first bytes, so unseen
endings of known stems still tell.  Filters of several widths run over the words, each keeps its
largest response over the whole text, and a logistic layer weighs them.  The language that picks the
threshold is the nearest of profiles that are learned from the sample's texts without labels: means of
hashed byte trigrams by spherical k-means.  It is told from the text alone, never from a column.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, slices
from .labelled import sample
from .quality import term_counts

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 8
#: First bytes that have an embedding beside the whole word's.
STEMS = (4, 6)
EPOCHS, BATCH, RATE = 9, 32, 0.01
#: Bytes of text hashed, and words pooled, at a time; longer texts go in blocks whose responses are carried on.
CHUNK, BLOCK_WORDS = 1 << 18, 1 << 15
#: Numbers of a language profile.
PROFILE = 256
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_BASE = 0x9E3779B97F4A7C15 | 1
_NO_WORD = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n, CHUNK + 4096) + 1
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_bytes(data: np.ndarray) -> np.ndarray:
    return (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))


def buckets_of(h: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of the sums of words (kind 0) or of stems."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(kind)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def word_buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words x (1 + stems)) of the words of lower-cased bytes, and where they start; words are letters, digits and bytes beyond ASCII."""
    in_word = word_bytes(data)
    change = np.diff(np.concatenate([[False], in_word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    power, inverse = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
        out = np.empty((len(starts), 1 + len(STEMS)), np.int64)
        for k, stem in enumerate((None, *STEMS)):
            to = ends if stem is None else np.minimum(starts + stem, ends)
            out[:, k] = buckets_of((total[to] - total[starts]) * inverse[starts], k)
    return out, starts


def long_word(word: bytes) -> np.ndarray:
    """The buckets of one lower-cased word of any length, CHUNK bytes at a time."""
    out, total = word_buckets(np.frombuffer(word[:CHUNK], np.uint8))[0], 0
    for lo in range(0, len(word), CHUNK):
        data = np.frombuffer(word[lo : lo + CHUNK], np.uint8)
        part = ((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)]).sum(dtype=np.uint64)
        total += int(part) * pow(_BASE, lo, 1 << 64)
    out[:, 0] = buckets_of(np.array([total % (1 << 64)], np.uint64), 0)
    return out


def word_blocks(text: bytes) -> Iterator[np.ndarray]:
    """The word buckets of a text, about CHUNK bytes at a time; no word is torn."""
    lo = 0
    while lo < len(text):
        part = text[lo : lo + CHUNK].lower()
        end = len(part)
        if lo + end < len(text):
            gaps = np.flatnonzero(~word_bytes(np.frombuffer(part, np.uint8)))
            if not len(gaps):
                after = _NO_WORD.search(text, lo + end)
                end = (after.start() if after else len(text)) - lo
                yield long_word(text[lo : lo + end].lower())
                lo += end
                continue
            end = int(gaps[-1]) + 1
        yield word_buckets(np.frombuffer(part[:end], np.uint8))[0]
        lo += end


def buckets_by_text(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets of all texts, and words per text; texts are at most CHUNK bytes."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    found, starts = word_buckets(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return found, np.diff(np.searchsorted(starts, ends), prepend=0)


def profiles(texts: list[bytes]) -> np.ndarray:
    """A row of unit length for each text: roots of its byte trigrams' shares, hashed to PROFILE places; zeros for a text without any."""
    counts = term_counts(texts)[0].astype(np.float64).reshape(len(texts), PROFILE, -1).sum(2)
    x = np.sqrt(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def language_profiles(x: np.ndarray, languages: int, seed: int = 3, rounds: int = 20) -> np.ndarray:
    """At most `languages` unit rows by spherical k-means; each first centre is the row that lies farthest from those before, a tenth of the rows being looked at."""
    x = x[x.any(1)]
    if not len(x):
        return np.zeros((0, PROFILE))
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None]
    for _ in range(1, min(languages, len(x))):
        some = x[rng.permutation(len(x))[: max(1, len(x) // 10)]]
        centres = np.vstack([centres, some[(some @ centres.T).max(1).argmin()]])
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def nearest_language(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest profile, -1 for rows without trigrams."""
    if not len(centres):
        return np.full(len(x), -1)
    return np.where(x.any(1), (x @ centres.T).argmax(1), -1)


class Network:
    """Embeddings, filters and the logistic layer."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {"embed": (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"filter{w}"] = (rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32)
            self.p[f"shift{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)
        self.centres = np.zeros((0, PROFILE))
        self.thresholds: dict[int, float] = {}

    def pooled(self, found: np.ndarray, sizes: np.ndarray, more: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Each filter's largest response in each text, where each text's rows start, and the responses of each width.

        A text is followed by rows of zeros, so a short one fits the widest filter.  With more, the last text
        goes on after these words, so what reaches beyond them isn't a response.
        """
        gap = max(WIDTHS)
        first = np.cumsum(sizes + gap) - sizes - gap
        x = np.zeros((int((sizes + gap).sum()), DIM), np.float32)
        at = np.arange(len(found)) + np.repeat(np.arange(len(sizes)) * gap, sizes)
        e = self.p["embed"]
        x[at] = e[found[:, 0]]
        for k in range(1, found.shape[1]):
            x[at] += e[found[:, k]]
        best, responses = [], []
        for w in WIDTHS:
            y = x @ self.p[f"filter{w}"][0]
            for j in range(1, w):
                y[:-j] += x[j:] @ self.p[f"filter{w}"][j]
            for j in range(1, w):  # windows from a text's last zeros on reach into the next text
                y[first + sizes + gap - j] = -np.inf
            if more:
                y[max(first[-1], first[-1] + sizes[-1] - w + 1) :] = -np.inf
            best.append(np.maximum.reduceat(y, first) + self.p[f"shift{w}"])
            responses.append(y)
        return np.hstack(best), first, responses

    def across(self, blocks: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response in one text whose words come in blocks, and the word at which its window starts."""
        keep, offset = max(WIDTHS) - 1, 0
        carried = np.zeros((0, 1 + len(STEMS)), np.int64)
        best, tops = np.full(FILTERS * len(WIDTHS), -np.inf, self.p["out"].dtype), np.zeros(FILTERS * len(WIDTHS), np.int64)
        for block in chain(blocks, [None]):
            words = carried if block is None else np.concatenate([carried, block])
            value, _, responses = self.pooled(words, np.array([len(words)]), block is not None)
            better = value[0] > best
            best = np.where(better, value[0], best)
            tops = np.where(better, offset + np.concatenate([y.argmax(0) for y in responses]), tops)
            carried = words[max(0, len(words) - keep) :]
            offset += len(words) - len(carried)
        return best, tops

    def peaks(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The same for several texts' word buckets, BLOCK_WORDS words or so at a time."""
        best, tops = [], []
        for lo, hi in slices([len(t) for t in texts], BLOCK_WORDS):
            if len(texts[lo]) > BLOCK_WORDS:
                value, top = self.across(texts[lo][k : k + BLOCK_WORDS] for k in range(0, len(texts[lo]), BLOCK_WORDS))
                value, top = value[None], top[None]
            else:
                value, first, responses = self.pooled(*together(texts[lo:hi]))
                ends = np.append(first[1:], len(responses[0]))
                top = np.array([np.concatenate([y[a:b].argmax(0) for y in responses]) for a, b in zip(first, ends)])
            best.append(value)
            tops.append(top)
        return np.vstack(best), np.vstack(tops)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.p["out"] + self.p["bias"]

    def train(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 5) -> None:
        """Adam on the logistic loss, classes weighed alike.  texts: word buckets of each."""
        rng, step = np.random.default_rng(seed), 0
        self.start(texts, y)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (1 - y).sum()))
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                ids = order[lo : lo + BATCH]
                gradient = self.gradient(*together([texts[i] for i in ids]), y[ids], weight[ids])
                step += 1
                for k, (at, g) in gradient.items():
                    m[k][at] = 0.9 * m[k][at] + 0.1 * g
                    v2[k][at] = 0.999 * v2[k][at] + 0.001 * g * g
                    self.p[k][at] -= RATE * (m[k][at] / (1 - 0.9**step)) / (np.sqrt(v2[k][at] / (1 - 0.999**step)) + 1e-6)

    def start(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """Buckets met in a single text stay at zero, else texts would be learned by heart; the first dimension starts at the others' shrunk log-odds."""
        counts = np.zeros((2, BUCKETS))
        for words, label in zip(texts, y):
            counts[int(label), np.unique(words)] += 1
        met = counts.sum(0)
        odds = np.log((counts[1] + 0.5) / (y.sum() + 1)) - np.log((counts[0] + 0.5) / ((1 - y).sum() + 1))
        self.p["embed"][:, 0] = odds * met / (met + 2) / 4
        self.learned = met > 1
        self.p["embed"][~self.learned] = 0
        self.p["filter1"][0, 0, : FILTERS // 2] = 1
        self.p["out"][: FILTERS // 2] = 1

    def gradient(self, found: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """By parameter: which rows, and their gradient.  Only the words under each filter's largest response have any."""
        pooled, tops = self.peaks(np.split(found, np.cumsum(sizes)[:-1]))
        probability = 1 / (1 + np.exp(-np.clip(self.logits(pooled), -30, 30)))
        d = ((probability - y) * weight / len(y)).astype(np.float32)
        out = {"out": (slice(None), np.maximum(pooled, 0).T @ d), "bias": (slice(None), d.sum(keepdims=True))}
        up = d[:, None] * self.p["out"] * (pooled > 0)
        start = (np.cumsum(sizes) - sizes)[:, None]
        cells, moves = [], []
        for k, w in enumerate(WIDTHS):
            u, top = (v[:, k * FILTERS : (k + 1) * FILTERS] for v in (up, tops))
            g = np.zeros_like(self.p[f"filter{w}"])
            for j in range(w):
                inside = (u != 0) & (top + j < sizes[:, None])
                filters, strength = np.nonzero(inside)[1], u[inside][:, None]
                words = found[(start + top + j)[inside]]
                np.add.at(g[j].T, filters, self.p["embed"][words].sum(1) * strength)
                cells.append(words)
                moves.append(strength * self.p[f"filter{w}"][j].T[filters])
            out[f"filter{w}"] = (slice(None), g)
            out[f"shift{w}"] = (slice(None), u.sum(0))
        cells = np.concatenate(cells)
        moves, cells = np.repeat(np.concatenate(moves), cells.shape[1], axis=0), cells.ravel()
        rows, inverse = np.unique(cells[self.learned[cells]], return_inverse=True)
        g = np.zeros((len(rows), DIM), np.float32)
        np.add.at(g, inverse, moves[self.learned[cells]])
        out["embed"] = (rows, g)
        return out

    def probabilities(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, and its language's number, -1 for want of trigrams."""
        best = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        short = [i for i, t in enumerate(texts) if len(t) <= CHUNK]
        for lo, hi in slices([len(texts[i]) for i in short], CHUNK):
            best[short[lo:hi]] = self.pooled(*buckets_by_text([texts[i] for i in short[lo:hi]]))[0]
        for i, text in enumerate(texts):
            if len(text) > CHUNK:
                best[i] = self.across(word_blocks(text))[0]
        language = np.concatenate([nearest_language(profiles(texts[lo:hi]), self.centres) for lo, hi in slices([1] * len(texts), 256)] or [np.zeros(0, int)])
        return 1 / (1 + np.exp(-np.clip(self.logits(best).astype(np.float64), -30, 30))), language

    def calibrate(self, probability: np.ndarray, language: np.ndarray, y: np.ndarray, least: int = 20) -> None:
        """Per language the threshold of the best F1, as near one half as the best gap of logits allows with a margin; of all texts for languages with few labels."""
        def best(mask: np.ndarray, least: int = least) -> float | None:
            p, t = probability[mask], y[mask]
            if min((t == 1).sum(), (t == 0).sum()) < least:
                return None
            p = np.clip(p.astype(np.float64), 1e-9, 1 - 1e-9)
            odds = np.unique(np.log(p / (1 - p)))
            cuts = np.clip((odds[1:] + odds[:-1]) / 2, -4, 4) if len(odds) > 1 else np.zeros(1)
            p = np.log(p / (1 - p))
            f1 = np.array([2 * (p[t == 1] >= c).sum() / ((p >= c).sum() + (t == 1).sum()) for c in cuts])
            top = np.flatnonzero(f1 >= f1.max() - 1e-12)
            lo, hi = cuts[top[0]], cuts[top[-1]]
            return float(1 / (1 + np.exp(-np.clip(0.0, lo + 0.15 * (hi - lo), hi - 0.15 * (hi - lo)))))

        overall = best(np.ones(len(y), bool), 4) or 0.5
        self.thresholds = {k: best(language == k) or overall for k in range(-1, len(self.centres))}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities stretched so that each language's threshold lies at one half."""
        p, language = self.probabilities(texts)
        t = np.array([self.thresholds.get(k, 0.5) for k in range(-1, len(self.centres))])[language + 1]
        return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t))


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int], languages: int) -> Network | float:
    """The trained network; the share of label 1 if only one label is known, 0.0 without any."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            words = [np.concatenate([np.zeros((0, 1 + len(STEMS)), np.int64), *word_blocks(t)]).astype("<u2").tobytes() for t in texts]
            shapes = [r.astype("<f2").tobytes() for r in profiles(texts)] if texts else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(words, pa.binary()), pa.array(shapes, pa.binary())], ["doc_id", "y", "words", "profile"])

    rows: pd.DataFrame = sample(docs, labels, "toxic", per_class).mapInArrow(hashed, "doc_id long, y int, words binary, profile binary").toPandas().sort_values("doc_id")
    shapes = np.frombuffer(b"".join(rows["profile"]), "<f2").astype(np.float64).reshape(-1, PROFILE)
    return train(rows["words"].tolist(), shapes, rows["y"].to_numpy(), languages)


def together(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The word buckets of several texts in one array, and words per text."""
    return np.concatenate(texts), np.array([len(t) for t in texts])


def train(words: list[bytes], shapes: np.ndarray, y: np.ndarray, languages: int) -> Network | float:
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 0.0
    texts = [np.frombuffer(w, "<u2").reshape(-1, 1 + len(STEMS)) for w in words]
    # empty texts are clean; a fifth of all is left for calibration
    blank = 5 + len(y) // 50
    texts, y, shapes = [*texts, *[texts[0][:0]] * blank], np.append(y, np.zeros(blank, y.dtype)), np.vstack([shapes, np.zeros((blank, PROFILE))])
    network, apart = Network(), np.arange(len(y)) % 5 == 0
    network.train([t for t, a in zip(texts, apart) if not a], y[~apart].astype(np.float32))
    network.centres = language_profiles(shapes, languages)
    logits = [network.logits(network.peaks([texts[i]])[0])[0] for i in np.flatnonzero(apart)]
    network.calibrate(1 / (1 + np.exp(-np.clip(np.array(logits, np.float64), -30, 30))), nearest_language(shapes[apart], network.centres), y[apart])
    return network


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (4000, 2000), languages: int = 8) -> DataFrame:
    """One row per document: doc_id, held_out, score (higher: more toxic), predicted (1 if score >= 0.5).

    The network is fitted on at most per_class labelled documents of label 0 and of label 1, never on held-out
    ones; their texts are fitted whole, six bytes a word on the driver.  At most `languages` profiles
    are learned.  Scores read the text alone, whole.  Null texts are scored as empty; a null
    doc_id stays null and isn't held out; repeated rows are scored alike.  Without labels of both kinds
    each score is the share of label 1, or 0.0 without any.  Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, per_class, languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            scores = np.full(len(texts), model) if isinstance(model, float) else model.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores.astype(np.float64)), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return plain.mapInArrow(run, SCHEMA)
