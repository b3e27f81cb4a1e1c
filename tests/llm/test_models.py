"""The classifiers' parts against plain loops, scans of all choices and finite differences."""

import numpy as np
import pytest

from binloom.llm import quality as q
from binloom.llm import toxicity as t

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(2)
    return [" ".join(rng.choice(WORDS, rng.integers(3, 40))).encode() for _ in range(120)] + [b"", b"a", b"!!!! ????"]


def test_neighbour_vote_is_a_loop_over_all_labelled_vectors(texts):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, len(texts))
    terms, kinds = q.term_counts(texts)
    model = q.Model(terms, kinds, y)
    asked = [*texts[:40], b"beta beta beta", b"nothing like it", b""]
    got = model.scores(asked)
    for text, score in zip(asked, got):
        v = model.embed(*q.term_counts([text]))[0]
        cosines = []
        for w in model.vectors:
            n = float(np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))
            cosines.append(float((v * w).sum()) / n if n > 1e-12 else 0.0)
        near = sorted(range(len(y)), key=lambda k: -round(cosines[k], 9))[: q.NEIGHBOURS]
        weight = [np.exp(q.SHARPNESS * cosines[k]) * model.votes[k] for k in near]
        assert abs(score - sum(w * y[k] for w, k in zip(weight, near)) / sum(weight)) < 1e-6


def test_ties_go_to_the_first(texts):
    rng = np.random.default_rng(9)
    cosines = rng.integers(0, 4, (200, 50)) / 4
    for k in (1, 7, 50):
        want = [sorted(sorted(range(50), key=lambda j: -row[j])[:k]) for row in cosines]
        assert q.nearest(cosines, k).tolist() == want
    # copies with unlike labels: the smallest ids vote
    many = [b"alpha beta gamma"] * 60 + texts[:20]
    y = np.arange(80) % 2
    model = q.Model(*q.term_counts(many), y)
    assert abs(model.scores([b"alpha beta gamma"])[0] - (model.votes[: q.NEIGHBOURS] * y[: q.NEIGHBOURS]).sum() / model.votes[: q.NEIGHBOURS].sum()) < 1e-6


def test_counts_of_long_labelled_texts_are_whole(spark, monkeypatch):
    long = "alpha beta " * 100_000
    docs = spark.createDataFrame([(k, long if k == 1 else f"gamma {k}") for k in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(q, "Model", lambda terms, kinds, y: seen.append((terms, kinds)))
    q.fit(docs, labels, 10)
    terms, kinds = q.term_counts([long.encode()])
    assert (seen[0][0][0] == terms[0]).all() and (seen[0][1][0] == kinds[0]).all() and kinds.max() > 65504


def test_term_counts_are_a_loop(texts):
    terms, kinds = q.term_counts([b"abcabc", b"", b"ab"])
    assert terms.sum(1).tolist() == [4, 0, 0] and sorted(terms[0][terms[0] > 0].tolist()) == [1, 1, 2]
    assert kinds.sum(1).tolist() == [6, 0, 2]


def test_pooling_is_a_loop(texts):
    network = t.Network()
    found, sizes = t.buckets_by_text(texts[:20] + [b"", b"alpha"])
    pooled = network.pooled(found, sizes)[0]
    lo = 0
    for row, n in enumerate(sizes):
        x = np.vstack([network.p["embed"][found[lo + i]].sum(0) for i in range(n)] + [np.zeros(t.DIM)] * max(t.WIDTHS)).astype(np.float64)
        lo += n
        column = 0
        for w in t.WIDTHS:
            f = network.p[f"filter{w}"].astype(np.float64)
            # windows may hang over the end into zeros
            best = np.max([sum(x[i + j] @ f[j] for j in range(w) if i + j < len(x)) for i in range(len(x))], axis=0)
            assert np.allclose(pooled[row, column : column + t.FILTERS], best + network.p[f"shift{w}"], atol=1e-4)
            column += t.FILTERS


def test_gradient_is_the_slope(texts):
    network = t.Network()
    found, sizes = t.buckets_by_text(texts[:12])
    network.learned = np.ones(t.BUCKETS, bool)
    rng = np.random.default_rng(1)
    y, weight = rng.integers(0, 2, 12).astype(np.float32), rng.uniform(0.5, 2, 12)
    # double precision, so small steps show
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}

    def loss():
        p = 1 / (1 + np.exp(-network.logits(network.pooled(found, sizes)[0].astype(np.float64))))
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * weight).mean())

    gradient = network.gradient(found, sizes, y, weight)
    for name in ("out", "bias", "shift2", "filter1", "filter3", "embed"):
        rows, g = gradient[name]
        p = network.p[name]
        whole = np.zeros_like(p)
        whole[rows] = g
        places = [np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(whole), axis=None)[:4]]
        for at in places:
            before = p[at]
            slope = []
            for step in (1e-3, -1e-3):
                p[at] = before + step
                slope.append(loss())
            p[at] = before
            assert abs((slope[0] - slope[1]) / 2e-3 - whole[at]) < 2e-2 * max(abs(whole[at]), 1e-2), (name, at)


def test_calibration_takes_the_best_of_all_cuts():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    p = np.clip(0.5 + 0.2 * (y - 0.5) + rng.normal(0, 0.15, 300), 0.01, 0.99)
    language = np.repeat([0, 1, 2], [150, 140, 10])
    network = t.Network()
    network.centres = np.eye(3, t.PROFILE)
    network.calibrate(p, language, y)

    def f1(mask, cut):
        hit = p[mask] >= cut
        return 2 * (hit & (y[mask] == 1)).sum() / (hit.sum() + (y[mask] == 1).sum())

    for k in (0, 1):
        mask = language == k
        assert f1(mask, network.thresholds[k]) >= max(f1(mask, c) for c in np.unique(p[mask])) - 1e-9
    everything = np.ones(300, bool)
    assert network.thresholds[2] == network.thresholds[-1] and f1(everything, network.thresholds[2]) >= max(f1(everything, c) for c in np.unique(p)) - 1e-9


def test_languages_are_told_apart():
    rng = np.random.default_rng(6)
    kinds = ["the of and to in that is for it was with".split(), "der die und das nicht ist ein eine mit von zu".split(), "el los las de que en un una por con para".split()]
    texts = [" ".join(rng.choice(k, 60)).encode() for k in kinds for _ in range(40)]
    x = t.profiles([*texts, b""])
    centres = t.language_profiles(x, 3)
    found = t.nearest_language(x, centres)
    assert found[-1] == -1 and len(centres) == 3
    assert all(len(set(found[k * 40 : (k + 1) * 40])) == 1 for k in range(3)) and len(set(found[:-1].tolist())) == 3
    assert len(t.language_profiles(np.zeros((4, t.PROFILE)), 3)) == 0 and (t.nearest_language(x, np.zeros((0, t.PROFILE))) == -1).all()


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000])
def test_no_word_is_torn(texts, chunk, monkeypatch):
    """Texts in blocks give the words of the whole text, words longer than several blocks too."""
    long = [b" ".join(texts), b"a" * 500, b"!" * 200, b"x " + b"Wort" * 100 + b"! y", b"" , "éß ".encode() * 90, b"ab" * 60 + b" "]
    whole = [t.word_buckets(np.frombuffer(text.lower(), np.uint8))[0] for text in long]
    monkeypatch.setattr(t, "CHUNK", chunk)
    for text, expected in zip(long, whole):
        got = np.concatenate([np.zeros((0, 1 + len(t.STEMS)), np.int64), *t.word_blocks(text)])
        # a stem of a word cut below its stems' length needs blocks of at least those
        assert got.shape == expected.shape and (got[:, 0] == expected[:, 0]).all() and (chunk < max(t.STEMS) or (got == expected).all())


@pytest.mark.parametrize("words", [1, 2, 3, 10, 1000])
def test_pooling_in_blocks_is_pooling_the_whole(texts, words, monkeypatch):
    network = t.Network()
    found, sizes = t.buckets_by_text(texts)
    value, first, responses = network.pooled(found, sizes)
    ends = np.append(first[1:], len(responses[0]))
    tops = [np.concatenate([y[a:b].argmax(0) for y in responses]) for a, b in zip(first, ends)]
    monkeypatch.setattr(t, "BLOCK_WORDS", words)
    got, at = network.peaks(np.split(found, np.cumsum(sizes)[:-1]))
    assert np.allclose(got, value, atol=1e-6)
    # equal responses of repeated words are told apart by rounding only
    picked = np.array([[responses[c // t.FILTERS][first[i] + at[i, c], c % t.FILTERS] for c in range(at.shape[1])] for i in range(len(at))])
    best = np.array([[responses[c // t.FILTERS][first[i] + tops[i][c], c % t.FILTERS] for c in range(at.shape[1])] for i in range(len(at))])
    assert np.allclose(picked, best, atol=1e-6)


def test_long_labelled_texts_are_fitted_whole(spark, monkeypatch):
    long = "alpha beta " * 100_000 + "omega"
    docs = spark.createDataFrame([(k, long if k == 1 else f"gamma {k}") for k in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(t, "train", lambda words, shapes, y, languages: seen.append(words))
    t.fit(docs, labels, (10, 10), 8)
    assert (np.frombuffer(seen[0][0], "<u2").reshape(-1, 3) == t.word_buckets(np.frombuffer(long.encode(), np.uint8))[0]).all()


def test_one_word_of_a_very_long_text_tells(spark):
    """A toxic word at the far end of a text of a megabyte, labelled or not, is found."""
    rng = np.random.default_rng(8)
    mild = lambda n: " ".join(rng.choice(WORDS, n))
    rows = [(k, f"{mild(150_000 if k % 60 == 0 else 30)} {'vile' if k % 2 else 'kind'} {mild(3)}", k % 2) for k in range(400)]
    rows += [(1000, f"{mild(150_000)} vile", 1), (1001, f"{mild(150_000)} kind", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.predicted for r in t.score_toxicity(docs.drop("toxic"), docs.where("doc_id < 1000").select("doc_id", "toxic")).collect()}
    assert got[1000] == 1 and got[1001] == 0 and sum(got[k] != y for k, _, y in rows) <= 4
