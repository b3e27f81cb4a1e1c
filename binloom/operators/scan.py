"""Scans of chromosomes for breakpoints: candidates and their tests, gaps, segment statistics, an index of first events.

A track is a table source, chrom, i, x, kept of every bin.  A scan goes level by level: the nodes of a level
are rows, their best splits one array each, and their permutations blocks of replicates that all tasks
share (permute.py); what follows the candidates is joins and windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binloom.functions.shared import written

from .kernels import ad_statistics, draws, geometry_reasons, permutation_p, spread
from .permute import permutation_ps
from .segments import PLACE, labelled

AUDIT = (
    "source string, chrom int, depth int, node_start long, node_end long, rank int, cut long, bin long, ad double, left_bins long, right_bins long, "
    "valid boolean, reasons string, tested boolean, p_local double, p_global double, accepted boolean"
)
TREE = "source string, chrom int, side string, depth int, start long, end long, cut long, ad double, p_local double, p_global double, hypothetical boolean, accepted boolean"
EVENTS = "cell long, chrom int, node string, bin long, ad double, accepted boolean, parent_accepted boolean, n_left long, n_right long"


@dataclass(frozen=True)
class Settings:
    """How deep a scan goes, its permutations and cutoff, and the least bins of a child and of one at a chromosome's end."""

    depths: int = 6
    permutations: int = 1000
    alpha: float = 0.001
    min_child: int = 20
    min_terminal: int = 50
    seed: int = 42


def best_first(ad: np.ndarray) -> np.ndarray:
    """Cuts from the largest statistic down, the lower one of equals first; the last digits, which hang on the order of sums, don't count."""
    return np.argsort(-np.round(ad, 9), kind="stable") + 1


def chromosomes(track: DataFrame) -> DataFrame:
    """A row a chromosome: its kept bins and values in order."""
    rows = track.where("kept").groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("node"))
    return rows.select(*PLACE, F.col("node.i").alias("i"), F.col("node.x").alias("x"))


def pools(track: DataFrame, pool: str) -> tuple[DataFrame, list[str]]:
    """What the global test samples from, and the columns it goes by: the kept values, sorted, of all its source's chromosomes (genome) or of its own (chromosome)."""
    if pool not in ("genome", "chromosome"):
        raise ValueError(f"no such pool: {pool}")
    by = PLACE if pool == "chromosome" else ["source"]
    return track.where("kept").groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("pool")), by


def looked_at(x: np.ndarray, start: int, end: int, n: int, s: Settings) -> Iterator[tuple]:
    """The candidates of a node of n kept bins' chromosome, best first, up to the first of valid geometry: rank to reasons of AUDIT, without bin."""
    ad = ad_statistics(x)
    for rank, local in enumerate(best_first(ad).tolist(), 1):
        reasons = geometry_reasons(start, end, start + local, n, s.min_child, s.min_terminal)
        yield rank, start + local, float(ad[local - 1]), local, end - start - local, not reasons, ";".join(reasons)
        if not reasons:
            return
    yield None, None, None, None, None, False, "no_valid_candidate"


def _seen(nodes: DataFrame, s: Settings) -> DataFrame:
    """The rows of looked_at for nodes (PLACE, depth, node_start, node_end, i, x of the whole chromosome)."""
    columns = [f for f in AUDIT.split(", ") if f.split()[0] not in ("tested", "p_local", "p_global", "accepted")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for source, chrom, depth, start, end, i, x in zip(*(rows[c] for c in (*PLACE, "depth", "node_start", "node_end", "i", "x"))):
                for r in looked_at(np.asarray(x)[start:end], start, end, len(x), s):
                    out.append((source, chrom, depth, start, end, *r[:2], None if r[1] is None else int(i[r[1]]), *r[2:]))
            whole = {c: "Int64" for c in ("rank", "cut", "bin", "left_bins", "right_bins")}
            yield pd.DataFrame(out, columns=[f.split()[0] for f in columns]).astype(whole)

    return spread(nodes, [*PLACE, "node_start"]).mapInPandas(run, ", ".join(columns))


def node_name(seed: int, start: str = "node_start", end: str = "node_end") -> Column:
    """A node's name, which its permutations hang on."""
    return F.concat_ws(":", F.lit(str(seed)), "source", F.col("chrom").cast("string"), F.col(start).cast("string"), F.col(end).cast("string"))


def tested(nodes: DataFrame, chroms: DataFrame, pool: DataFrame, by: list[str], permutations: int, below: float, start: str = "node_start", end: str = "node_end") -> DataFrame:
    """nodes with name, p_local and, where that is under `below`, p_global.

    nodes: PLACE, name, the columns start and end, cut, ad; chroms and pool: of chromosomes() and pools().
    """
    one = [(F.col(end) - F.col(start)).alias("size"), (F.col("cut") - F.col(start)).alias("cut"), F.col("ad").alias("observed")]
    inner = F.slice("x", F.col(start) + 1, F.col(end) - F.col(start)).alias("x")
    local = permutation_ps(nodes.join(chroms, PLACE).select("name", inner, *one), permutations).withColumnRenamed("p", "p_local")
    nodes = written(nodes.join(local, "name"))
    left = nodes.where(F.col("p_local") < below).join(pool, by).select(F.concat("name", F.lit(":pool")).alias("name"), F.col("pool").alias("x"), *one)
    whole = permutation_ps(left, permutations).select(F.regexp_replace("name", ":pool$", "").alias("name"), F.col("p").alias("p_global"))
    return nodes.join(whole, "name", "left")


def candidates(track: DataFrame, pool: str = "genome", settings: Settings = Settings()) -> DataFrame:
    """AUDIT: a row for each candidate looked at, or for a node without a valid one.  Chromosomes of no or one kept bin have none.

    In each node the first candidate of valid geometry is tested, within the node and then against the pool;
    whether it fails or passes, the node's other candidates aren't looked at.  All nodes of a level are
    tested together; the next level's are the children of the accepted ones.
    """
    s, names = settings, [f.split()[0] for f in AUDIT.split(", ")]
    values, by = pools(track, pool)
    chroms, values = written(chromosomes(track)), written(values)
    nodes = chroms.select(*PLACE, F.lit(0).alias("depth"), F.lit(0).cast("long").alias("node_start"), F.size("x").cast("long").alias("node_end"))
    done = None
    for _ in range(s.depths):
        found = written(_seen(nodes.where("node_end - node_start >= 2").join(chroms, PLACE), s).withColumn("name", node_name(s.seed)))
        ps = tested(found.where("valid").select(*PLACE, "name", "node_start", "node_end", "cut", "ad"), chroms, values, by, s.permutations, s.alpha)
        ps = ps.select("name", F.lit(True).alias("tested"), "p_local", "p_global", F.coalesce(F.col("p_global") < s.alpha, F.lit(False)).alias("accepted"))
        rows = found.where("valid").join(ps, "name").unionByName(found.where("NOT valid").withColumns({"tested": F.lit(False), "accepted": F.lit(False)}), allowMissingColumns=True)
        rows = written(rows.select(*names))
        done = rows if done is None else done.union(rows)
        taken = rows.where("accepted")
        if taken.isEmpty():
            break
        sides = F.array(F.struct(F.col("node_start").alias("a"), F.col("cut").alias("b")), F.struct(F.col("cut").alias("a"), F.col("node_end").alias("b")))
        nodes = taken.select(*PLACE, (F.col("depth") + 1).alias("depth"), F.explode(sides).alias("side")).select(*PLACE, "depth", F.col("side.a").alias("node_start"), F.col("side.b").alias("node_end"))
    return done


def breakpoints(found: DataFrame, track: DataFrame) -> DataFrame:
    """The accepted candidates: source, chrom, bin, gap_start, gap_end (the skipped bins before it and the bin itself), depth, ad, p_local, p_global."""
    before = track.where("kept").select(*PLACE, F.col("i").alias("bin"), F.lag("i").over(W.partitionBy(*PLACE).orderBy("i")).alias("previous"))
    gap = F.col("bin") - F.col("previous") > 1
    rows = found.where("accepted").join(before, [*PLACE, "bin"])
    return rows.select(*PLACE, "bin", F.when(gap, F.col("previous") + 1).alias("gap_start"), F.when(gap, F.col("bin")).alias("gap_end"), "depth", "ad", "p_local", "p_global")


def scanned_segments(track: DataFrame, cuts: DataFrame, sums: tuple[str, ...] = ()) -> DataFrame:
    """Segments of whole chromosomes between cuts (source, chrom, bin): bounds and bins, and of the kept bins the number, mean, median and sums of other columns."""
    own = {c: F.when(F.col("kept"), F.col(c)) for c in ("x", *sums)}
    stats = [F.min("i").alias("bin_start"), F.max("i").alias("bin_end"), F.count("*").alias("n_bins"), F.count_if("kept").alias("kept_bins")]
    stats += [F.avg(own["x"]).alias("mean"), F.percentile(own["x"], F.lit(0.5)).alias("median"), *[F.sum(own[c]).alias(f"{c}_sum") for c in sums]]
    return labelled(track, cuts).groupBy(*PLACE, "seg").agg(*stats)


def rejection_reason(cutoff: float = 0.001) -> Column:
    """Why a candidate wasn't taken: its geometry, or the test that it failed; NULL for accepted and untested ones."""
    said = lambda name: F.concat(F.lit(f"{name} permutation p = "), F.round(f"p_{name}", 6).cast("string"), F.lit(f" >= {cutoff}"))
    failed = F.when(F.col("p_local") >= cutoff, said("local")).when(F.col("p_global") >= cutoff, said("global")).otherwise("not accepted")
    return F.when(F.col("reasons") != "", F.col("reasons")).when(F.col("tested") & ~F.col("accepted"), failed)


def inspected(x: np.ndarray, pool: np.ndarray, name: str, depths: int, permutations: int, alpha: float, seed: int) -> list[tuple]:
    """The nodes of a tree of best splits as TREE's columns from side on: without geometry, both tests in each.

    Accepted splits are followed to `depths` levels; below a rejected root its two children are shown as
    hypothetical, never deeper.
    """
    if not 1 <= depths <= 10:
        raise ValueError("a tree has 1 to 10 levels")
    out, stack = [], [(0, len(x), "root", True, 0)]
    while stack:
        start, end, side, parent, depth = stack.pop()
        if end - start < 2:
            out.append((side, depth, start, end, None, None, None, None, not parent, False))
            continue
        ad = ad_statistics(x[start:end])
        local = int(best_first(ad)[0])
        cut, observed = start + local, float(ad[local - 1])
        rng = draws(seed, f"{name}:{start}:{end}", permutations)
        p = [permutation_p(x[start:cut], x[cut:end], observed, permutations, rng, values) for values in (None, pool)]
        accepted = parent and max(p) < alpha
        out.append((side, depth, start, end, cut, observed, *p, not parent, accepted))
        if depth + 1 < depths and (accepted or depth == 0):
            under = "" if side == "root" else f"{side}."
            stack += [(cut, end, f"{under}right", accepted, depth + 1), (start, cut, f"{under}left", accepted, depth + 1)]
    return out


def split_trees(track: DataFrame, depths: int = 2, permutations: int = 1000, alpha: float = 0.001, seed: int = 42) -> DataFrame:
    """TREE: the nodes of each chromosome's tree of best splits, positions counted among kept bins; the global test samples the source's genome.

    Without geometry, both tests in each node.  Accepted splits are followed to `depths` levels; below a
    rejected root its two children are shown as hypothetical, never deeper.
    """
    if not 1 <= depths <= 10:
        raise ValueError("a tree has 1 to 10 levels")
    names = [f.split()[0] for f in TREE.split(", ")]
    values, by = pools(track, "genome")
    chroms, values = written(chromosomes(track)), written(values)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ads = [ad_statistics(np.asarray(x)[a:b]) for x, a, b in zip(rows["x"], rows["start"], rows["end"])]
            at = [int(best_first(ad)[0]) if len(ad) else None for ad in ads]
            cut = pd.array([None if k is None else a + k for k, a in zip(at, rows["start"])], dtype="Int64")
            yield rows.drop(columns=["x", "i"]).assign(cut=cut, ad=[None if k is None else float(ad[k - 1]) for k, ad in zip(at, ads)])

    nodes = chroms.select(*PLACE, F.lit("root").alias("side"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("start"), F.size("x").cast("long").alias("end"), F.lit(True).alias("parent"))
    done = None
    for depth in range(depths):
        shown = spread(nodes.join(chroms, PLACE), [*PLACE, "start"])
        found = written(shown.mapInPandas(best, "source string, chrom int, side string, depth int, start long, end long, parent boolean, cut long, ad double").withColumn("name", node_name(seed, "start", "end")))
        ps = tested(found.where("cut IS NOT NULL").select(*PLACE, "name", "start", "end", "cut", "ad"), chroms, values, by, permutations, 2.0, "start", "end")
        rows = found.join(ps.select("name", "p_local", "p_global"), "name", "left")
        accepted = F.coalesce(F.col("parent") & (F.greatest("p_local", "p_global") < alpha), F.lit(False))
        rows = written(rows.select("*", (~F.col("parent")).alias("hypothetical"), accepted.alias("accepted")).select(*names))
        done = rows if done is None else done.union(rows)
        split = rows.where("cut IS NOT NULL AND (accepted OR depth = 0)")
        if depth + 1 == depths or split.isEmpty():
            break
        under = F.when(F.col("side") == "root", "").otherwise(F.concat("side", F.lit(".")))
        sides = F.array(*(F.struct(F.concat(under, F.lit(k)).alias("side"), F.col(a).alias("a"), F.col(b).alias("b")) for k, a, b in (("left", "start", "cut"), ("right", "cut", "end"))))
        nodes = split.select(*PLACE, (F.col("depth") + 1).alias("depth"), "accepted", F.explode(sides).alias("of")).select(*PLACE, "of.side", "depth", F.col("of.a").alias("start"), F.col("of.b").alias("end"), F.col("accepted").alias("parent"))
    return done


def first_events(x: np.ndarray, accepted: set[int]) -> list[tuple]:
    """A chromosome's best split and those of both sides: node, bin, ad, accepted, parent_accepted, n_left, n_right.

    accepted: the breakpoints that count; a side's split counts only if the first one does.
    """
    if len(x) < 2:
        return []

    def best(node: str, start: int, end: int, parent: bool) -> tuple:
        ad = ad_statistics(x[start:end])
        local = int(best_first(ad)[0])
        return node, start + local, float(ad[local - 1]), parent and start + local in accepted, parent, local, end - start - local

    root = best("root", 0, len(x), True)
    sides = [("left", 0, root[1]), ("right", root[1], len(x))]
    return [root, *(best(*side, root[3]) for side in sides if side[2] - side[1] >= 2)]


def event_index(signal: DataFrame, bins: DataFrame, cuts: DataFrame) -> DataFrame:
    """EVENTS: for each cell and chromosome the best split and those of its sides, by its own values, zeros included.

    signal: cell, g, x without zeros; bins: g, chrom, i; cuts: cell, chrom, bin, the cells' breakpoints.  A row holds
    one cell's genome; the chromosomes' places, one each, are told to every task.
    """
    places = [(r.chrom, r.first, r.n) for r in bins.groupBy("chrom").agg(F.min("g").alias("first"), F.count("*").alias("n")).orderBy("chrom").collect()]
    vectors = signal.groupBy("cell").agg(F.collect_list("g").alias("g"), F.collect_list("x").alias("x"))
    known = cuts.groupBy("cell").agg(F.collect_set(F.struct("chrom", "bin")).alias("cuts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in EVENTS.split(", ")]
        size = max((first + n for _, first, n in places), default=0)
        for rows in batches:
            out = []
            for cell, g, x, own in zip(*(rows[c] for c in ("cell", "g", "x", "cuts"))):
                genome = np.zeros(size)
                genome[np.asarray(g)] = x
                accepted: dict[int, set] = {}
                for cut in own if own is not None else ():
                    accepted.setdefault(cut["chrom"], set()).add(cut["bin"])
                out += [(cell, chrom, *r) for chrom, first, n in places for r in first_events(genome[first : first + n], accepted.get(chrom, set()))]
            yield pd.DataFrame(out, columns=names)

    return spread(vectors.join(known, "cell", "left"), ["cell"]).mapInPandas(run, EVENTS)


def event_rule(events: DataFrame, bins: DataFrame, node: str, lo: int, hi: int, accepted: bool | None = None) -> DataFrame:
    """The cells of which a split of the node (root, left, right or any) lies at a bin that starts within [lo, hi], accepted or not if asked."""
    rows = events if node == "any" else events.where(F.col("node") == node)
    if accepted is not None:
        rows = rows.where(F.col("accepted") == accepted)
    inside = bins.where(F.col("start").between(lo, hi)).select("chrom", F.col("i").alias("bin"))
    return rows.join(inside, ["chrom", "bin"], "left_semi").select("cell").distinct()
