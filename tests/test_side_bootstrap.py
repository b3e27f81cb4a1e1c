"""z_boot, zero pairs and the bootstrap of delta and SRD against a plain restatement."""

import math

import numpy as np

from binloom.operators import resample


def srd(y, e, yr, er):
    if y + yr == 0:
        return 0.0
    rate = (y + yr) / (e + er)
    part = lambda v, n: v * math.log(v / (n * rate)) if v else 0.0
    return float(np.sign(y / e - yr / er)) * math.sqrt(max(2 * (part(y, e) + part(yr, er)), 0.0))


def test_side_summary(spark):
    rng = np.random.default_rng(2)
    reps, n = 30, [4, 7, 5, 6, 3, 8]
    x = rng.integers(1, 9, (6, 6)).astype(float)
    x[:, 3:5] = 0  # a zero pair
    x[1:, 0] = 0  # often zero in a replicate
    drawn = rng.integers(0, 6, (reps, 6))
    weights = [("s", k + 1, c, int((d == c).sum())) for k, d in enumerate(drawn) for c in range(6) if (d == c).any()]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    sums = frame([("s", c, 1, s, float(x[c, s])) for c in range(6) for s in range(6) if x[c, s]], "source string, cell long, chrom int, seg long, x double")
    rows = resample.side_replicates(sums, frame([("s", 1, s, v) for s, v in enumerate(n)], "source string, chrom int, seg long, n long"), frame([("s", c) for c in range(6)], "source string, cell long"), frame(weights, "source string, rep int, cell long, w long"), reps)
    got = {(r.seg, r.side): r for r in resample.side_summary(rows).collect()}
    ys = [x.mean(0), *(x[d].mean(0) for d in drawn)]
    assert len(got) == 12
    for (s, side), r in got.items():
        o = s + (1 if side == "right" else -1)
        if not 0 <= o < 6:
            assert r.withheld == "terminal_flank_missing" and r.z_boot is None and r.srd is None
            continue
        delta = [math.log2(y[s] / n[s] / (y[o] / n[o])) if y[s] > 0 and y[o] > 0 else None for y in ys]
        found, scores = [v for v in delta[1:] if v is not None], [srd(y[s], n[s], y[o], n[o]) for y in ys]
        assert r.zero_pair == (ys[0][s] == 0 and ys[0][o] == 0) and r.n_missing == reps - len(found)
        assert np.allclose([r.srd, r.se_srd, r.low_srd, r.high_srd], [scores[0], np.std(scores[1:], ddof=1), *np.percentile(scores[1:], [2.5, 97.5])])
        assert abs(r.agree_srd - np.mean(np.sign(scores[1:]) == np.sign(scores[0]))) < 1e-9
        if len(found) == reps:
            assert r.withheld == "" and abs(r.z_boot - delta[0] / np.std(found, ddof=1)) < 1e-9
        else:
            assert r.withheld == "nonfinite_replicates" and r.z_boot is None and r.se is None
    assert got[3, "right"].zero_pair and {r.withheld for r in got.values()} == {"", "terminal_flank_missing", "nonfinite_replicates"}
