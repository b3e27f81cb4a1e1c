"""Tables read, checked, written and compared; places in sorted order; greedy steps against plain loops."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.functions import shared
from binloom.operators import allelic, cohort, kernels, ordering, recall, segments
from binloom.plans.rules import FlankRule, RuleSet, evaluate
from binloom.sources import tables


def test_csv_and_registry(spark, tmp_path):
    spark.createDataFrame([("c1", 5, "low", 3, 1.5, 0.1, 0.2, 0.7)], tables.CELLS).write.csv(f"{tmp_path}/cells", header=True)
    assert tables.read_csv(spark, f"{tmp_path}/cells", tables.CELLS).first().tercile == "low"
    spark.range(2).write.parquet(f"{tmp_path}/a.parquet")
    found, said = tables.registry(spark, str(tmp_path), ["a", "b"], ["c"])
    assert [*found] == ["a"] and found["a"].count() == 2 and said == [("b", "problem"), ("c", "note")]
    (tmp_path / "bad.csv").write_text("seq,start,end,bin_in_chrom\n1,x,2,3\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parse|CAST"):
        tables.read_csv(spark, f"{tmp_path}/bad.csv", tables.BINS).collect()


def test_levels_and_codes(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate((0.0, 0.5, 1.0, 1.5, 2.0, 0.7, float("nan"), None))], "g int, cn double")
    assert sorted(r.g for r in tables.bad_levels(df).collect()) == [5, 6, 7]
    assert [r.code for r in tables.level_codes(df.where("g < 5")).orderBy("g").collect()] == [0, 1, 2, 3, 4]
    codes = spark.createDataFrame([("a", g, c) for g, c in ((2, 255), (0, 4), (1, 0))], "cell string, g int, code int")
    assert bytes(tables.packed_codes(codes).first().codes) == bytes([4, 0, 255])


def test_wide_matrices(spark, tmp_path):
    rng = np.random.default_rng(2)
    ha, hb = rng.poisson(6, (2, 10, 4)).astype(float)
    wide = lambda m: spark.createDataFrame([("1", i, i + 9, *map(float, row)) for i, row in enumerate(m)], "chr string, start int, end int, `c.3` double, c1 double, c0 double, c2 double")
    order = ["c.3", "c1", "c0", "c2"]
    members = spark.createDataFrame([("a", "c0"), ("a", "c1"), ("b", "c.3"), ("all", "c0"), ("all", "c1"), ("all", "c2"), ("all", "c.3")], "source string, cell string")
    wide(ha).write.parquet(f"{tmp_path}/ha")
    got = {(r.source, r.start): r.total for r in tables.sum_by_source(spark, f"{tmp_path}/ha", members, columns=2, rows=3).collect()}
    for source, cells in {"a": ["c0", "c1"], "b": ["c.3"], "all": order}.items():
        assert all(got[source, i] == sum(ha[i][order.index(c)] for c in cells) for i in range(10))
    assert tables.sums_agree(wide(ha + hb), wide(ha), wide(hb), order).count() == 0
    off = ha + hb
    off[3, 1] += 1
    assert [(r.start, r.cell) for r in tables.sums_agree(wide(off), wide(ha), wide(hb), order).collect()] == [(3, "c1")]
    bins = wide(ha).select("chr", "start", "end")
    cells = members.where("source = 'all'").select("cell")
    assert tables.input_problems(wide(ha), bins, cells, "HA").count() == 0
    moved = tables.input_problems(wide(ha).withColumn("start", F.col("start") + 1).drop("c2"), bins, cells, "HA")
    assert {(r.problem, r.n) for r in moved.collect()} == {("bins_missing", 10), ("bins_extra", 10), ("barcodes_missing", 1)}


def test_clusters_and_files(spark, tmp_path):
    cells = spark.createDataFrame([(1,), (2,)], "cell long")
    clusters = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "cell long, cluster string")
    assert {(r.cell, r.cluster) for r in tables.with_cluster(cells, clusters).collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(Exception, match="cell without a cluster: 2"):
        tables.with_cluster(cells, clusters.where("cell <> 2")).collect()
    rows = spark.createDataFrame([("s", 1, 5)], "source string, chrom int, bin long")
    tables.write_segmentation(rows, rows.union(rows), f"{tmp_path}/out", str(tmp_path), {"k": 6})
    assert tables.read_csv(spark, f"{tmp_path}/out/candidate_audit", rows.schema.simpleString()[7:-1].replace(":", " "), "\t").count() == 2
    run = spark.read.json(f"{tmp_path}/out/run").first()
    assert (run.n_breakpoints, run.n_audit_rows, run.k) == (1, 2, 6)
    with pytest.raises(ValueError):
        tables.write_segmentation(rows, rows, f"{tmp_path}/", str(tmp_path), {})


def test_comparing_tables(spark):
    schema = "k int, n long, x double, s string"
    a = spark.createDataFrame([(1, 1, 1.0, "a"), (2, 2, float("nan"), None), (3, 3, 3.0, "c"), (4, 4, None, "d")], schema)
    b = spark.createDataFrame([(1, 1, 1.0 + 1e-13, "a"), (2, 2, float("nan"), None), (3, 4, 3.1, "c"), (5, 5, 5.0, "e")], schema)
    got = {(r.k, r.column, r.a, r.b) for r in tables.mismatches(a, b, ["k"]).collect()}
    assert got == {(3, "n", "3", "4"), (3, "x", "3.0", "3.1"), (4, None, "row", None), (5, None, None, "row")}
    with pytest.raises(ValueError):
        tables.mismatches(a, b.drop("s"), ["k"])
    assert tables.reproduced(a.where("k = 1"), b.where("k = 1"), ["k"], "x").first().status == "ok"
    assert tables.reproduced(a, b, ["k"], "x").first().status == "segments_differ"
    assert tables.reproduced(a.where("k = 3"), b.where("k = 3"), ["k"], "x").first().status == "values_differ"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before:
        assert shared.folder(spark).startswith(before.rstrip("/"))
        return
    assert shared.folder(spark).startswith("/tmp/")
    monkeypatch.setattr(type(spark.sparkContext), "master", property(lambda self: "spark://host:7077"))
    with pytest.raises(ValueError):
        shared.folder(spark)


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_places_in_order(spark, coalesced):
    rng = random.Random(5)
    rows = [("all" if k % 3 else "few", k, float(rng.randrange(8))) for k in range(400)] + [("one", 0, 2.0)]
    df = spark.createDataFrame(rows, "key string, id int, x double").repartition(5)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, coalesced)
    try:
        placed = {(r.key, r.id): r.before for r in ordering.running_total(df, ["key"], ["x", "id"]).collect()}
        whole = {r.id: r.before for r in ordering.running_total(df.where("key <> 'one'"), [], [F.desc("x"), "id"]).collect()}
        ranks = {(r.key, r.id): r.r for r in ordering.with_average_rank(df, ["key"], "x", "r").collect()}
        medians = {r.key: r.v for r in ordering.upper_medians(df, ["key"], "x").collect()}
        third = ordering.value_at(df, [], "x", {"t": F.floor(F.col("total") / 3)}).first().t
    finally:
        spark.conf.set(name, before)
    for key in ("all", "few", "one"):
        own = sorted((x, k) for s, k, x in rows if s == key)
        assert [placed[key, k] for _, k in own] == [*range(len(own))]
        assert medians[key] == own[len(own) // 2][0]
        for x, k in own:
            assert ranks[key, k] == sum(y < x for y, _ in own) + (sum(y == x for y, _ in own) + 1) / 2
    assert [whole[k] for _, k in sorted((-x, k) for s, k, x in rows if s != "one")] == [*range(400)]
    assert third == sorted(x for _, _, x in rows)[401 // 3]
    assert ordering.value_at(df.limit(0), [], "x", {"t": F.floor(F.col("total") / 3)}).first().t is None


def test_nearest_boundary(spark):
    starts = [101, 201, 501, 2001, 2101]
    bins = spark.createDataFrame([(1, i, s, s + 99) for i, s in enumerate(starts)] + [(2, 0, 50, 149)], "chrom int, i long, start long, end long")
    asked = [(k, 1, p) for k, p in enumerate([5, 101, 150, 151, 152, 260, 1999, 2000, 2001, 2151, 2152, 99999])] + [(50, 2, 1), (51, 2, 120)]
    got = {r.id: r.boundary for r in cohort.nearest_boundary(spark.createDataFrame(asked, "id long, chrom int, bp long"), bins, 300).collect()}
    for k, chrom, p in asked:
        own = [s for s in (starts if chrom == 1 else [50]) if s <= p]
        want = 0 if not own else len(own) - 1 + (p > (own[-1] + own[-1] + 99) / 2)
        assert got[k] == want, (k, p)


def test_greedy_matching_and_agreement(spark):
    rng = random.Random(3)
    a, b = ({("s" if rng.random() < 0.5 else "t", 1, rng.randrange(300)) for _ in range(70)} for _ in range(2))
    frame = lambda rows: spark.createDataFrame([*rows], "source string, chrom int, bin long")
    pairs = kernels.match_one_to_one(frame(a), frame(b), 3)
    want = set()
    for source in ("s", "t"):
        near = sorted((abs(x - y), x, y) for s, _, x in a if s == source for t, _, y in b if t == source and abs(x - y) <= 3)
        used_a, used_b = set(), set()
        for _, x, y in near:
            if x not in used_a and y not in used_b:
                want.add((source, x, y))
                used_a.add(x)
                used_b.add(y)
    assert {(r.source, r.a_bin, r.b_bin) for r in pairs.collect()} == want
    for r in allelic.agreement(frame(a), frame(b), pairs).collect():
        mine = [(x, y) for s, x, y in want if s == r.source]
        assert (r.n_matched, r.a_only, r.b_only) == (len(mine), sum(s == r.source for s, _, _ in a) - len(mine), sum(s == r.source for s, _, _ in b) - len(mine))
        assert r.median_offset == np.median([y - x for x, y in mine])
    gaps = spark.createDataFrame([("s", 1, 20, 10, 20)], "source string, chrom int, bin long, gap_start long, gap_end long")
    asked = spark.createDataFrame([("s", 1, x, 20) for x in (5, 8, 12, 20, 22, 29)], "source string, chrom int, a_bin long, b_bin long")
    assert {r.a_bin: r.distance for r in allelic.matched_distance(asked, gaps, 5).collect()} == {5: 5, 8: 2, 12: 0, 20: 0, 22: 2}


def test_greedy_peaks_and_split_tests(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 30, 200).astype(float)
    curve = spark.createDataFrame([("s", 1, k + 1, float(v)) for k, v in enumerate(y)], "source string, chrom int, cut long, ad double")
    got = [(r.position, r.value) for r in kernels.greedy_peaks(curve, apart=20, most=5).orderBy("rank").collect()]
    tops = [k for k in range(200) if (k == 0 or y[k] >= y[k - 1]) and (k == 199 or y[k] > y[k + 1])]
    want = []
    for k in sorted(tops, key=lambda k: (-y[k], k)):
        if all(abs(k + 1 - p) >= 20 for p, _ in want) and len(want) < 5:
            want.append((k + 1, y[k]))
    assert got == want
    x = np.concatenate([rng.normal(0, 1, 60), rng.normal(3, 1, 60)])
    profile = spark.createDataFrame([("s", 1, k, float(v)) for k, v in enumerate(x)], "source string, chrom int, i long, x double")
    rows = {r.cut: r for r in kernels.split_tests(profile, spark.createDataFrame([("s", 1, c) for c in (60, 20)], "source string, chrom int, cut long"), 99).collect()}
    ad = kernels.ad_statistics(x)
    assert abs(rows[60].ad - ad[59]) < 1e-9 and rows[60].p_local == rows[60].p_global == 0.01 and abs(rows[20].ad - ad[19]) < 1e-9
    again = {r.cut: r.p_local for r in kernels.split_tests(profile.repartition(3), spark.createDataFrame([("s", 1, c) for c in (20, 60)], "source string, chrom int, cut long"), 99).collect()}
    assert again == {c: r.p_local for c, r in rows.items()}


def test_trimmed_means_and_spliced_ids(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 100.0, float("nan"), float("inf"), None)] + [("b", None)], "k string, x double")
    assert {r.k: r.level for r in segments.trimmed_means(rows, ["k"]).collect()} == {"a": 2.0, "b": None}
    ids = spark.createDataFrame([("s", c, i, c) for c in (1, 2) for i in range(6)], "source string, chrom int, i long, id int")
    assert [r.id for r in segments.spliced_ids(ids, 1, [4, 2, 2]).orderBy("chrom", "i").collect()] == [3, 3, 4, 4, 5, 5] + [2] * 6


def test_fit_status(spark):
    """Each of the three wants has its own name; a value's number of times counts."""
    units = {"ok": ([3.0, 4.0, 5.0, 4.0], 4.0, 2.0), "base": ([0.0] * 9 + [5.0], 4.0, 2.0), "median": ([1.0, 2.0], 0.0, 2.0), "scale": ([1.0, 2.0], 4.0, None), "none": ([-1.0, -2.0], None, 1.0)}
    counted = [(u, x, v.count(x)) for u, (v, _, _) in units.items() for x in set(v)]
    values = spark.createDataFrame(counted, "unit string, x double, times long")
    segs = spark.createDataFrame([(u, 1, k, 10 - k, m + k) for u, (_, m, _) in units.items() if m is not None for k in (0, 1)], "unit string, chrom int, seg long, n long, mean double")
    fits = spark.createDataFrame([(u, s) for u, (_, _, s) in units.items()], "unit string, best_s double")
    got = {r.unit: (r.baseline, r.median, r.status) for r in recall.fit_status(values, segs, fits, ["unit"]).collect()}
    assert got == {"ok": (4.0, 4.0, "ok"), "base": (0.0, 4.0, "undefined_baseline"), "median": (1.5, 0.0, "undefined_median"), "scale": (1.5, 4.0, "undefined_scale"), "none": (None, None, "undefined_baseline")}


def test_merging_across_gaps(spark):
    """A gap blocks a merge unless gaps may be crossed; a row's claim and the columns agree."""
    x = [v + i % 2 for i, v in enumerate([10.0] * 30 + [10.2] * 10 + [10.1] * 30 + [20.0] * 30)]
    profile = spark.createDataFrame([("s", 1, i, i, i * 10 + 1 + 5 * (i >= 30) + 5 * (i >= 40), i * 10 + 10 + 5 * (i >= 30) + 5 * (i >= 40), v) for i, v in enumerate(x)], "source string, chrom int, g long, i long, start long, end long, x double")
    cuts = spark.createDataFrame([("s", 1, b) for b in (30, 40, 70)], "source string, chrom int, bin long")
    rules = RuleSet(FlankRule(tau=0.5, srd_ref=100.0, max_bins=40))
    assert kernels.merged_boundaries(profile, cuts, rules).count() == 3
    across = replace(rules, cross_gaps=True)
    assert [r.bin for r in kernels.merged_boundaries(profile, cuts, across).collect()] == [30, 70] and across.digest() != rules.digest()
    claims = evaluate(segments.flank_scores(segments.labelled(profile, cuts)), rules).collect()
    free = evaluate(segments.flank_scores(segments.labelled(profile, cuts)), across).collect()
    assert "gap" in {r.blocked for r in claims} and {r.blocked for r in free} == {None}
