"""Experiments as queries: one request for each source and chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.operators import experiments
from binloom.operators.segments import PLACE
from binloom.sources.genome import Genome

from .catalog import labelled, query
from .catalog_recall import fit_sql

LO, HI = 50, 80


def requests(g: Genome, operation: str, **more: object) -> DataFrame:
    """The operation on bins [LO, HI) of every source and chromosome."""
    values = {"operation": operation, "value": None, "length": None, "direction": "right", "state": None, "preserve_total": False, "seed": 42, "depths": 2} | more
    places = g.profile.select(*PLACE).distinct()
    rows = places.withColumns({"id": F.concat_ws(":", "source", "chrom"), "start": F.lit(LO), "end": F.lit(HI), **{k: F.lit(v) for k, v in values.items()}})
    return rows.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in experiments.REQUEST.split(", ")])


def _run(g: Genome, rows: DataFrame, permutations: int = 1000) -> DataFrame:
    return experiments.run_experiments(g.profile, labelled(g), rows, permutations)


def _scenarios(df: DataFrame) -> DataFrame:
    return df.select("id", "status", F.explode("scenarios").alias("x")).select("id", "x.*")


_COLUMNS = "id scenario status best_s:r n_segments:i changed_bins:i changed_elsewhere:i"


def _fits(rows: str) -> str:
    return fit_sql(rows, "id", "id, chrom, seg")


_CALLED = f"""WITH req AS (SELECT DISTINCT source, chrom AS rc, source || ':' || chrom AS id FROM st), ed AS (SELECT r.id, rc, l.chrom, l.i, l.x AS x0, CASE WHEN l.chrom = rc AND l.i >= {LO} AND l.i < {HI} THEN l.x * 1.5::DOUBLE ELSE l.x END AS x, l.seg, l.seg * 10 + CASE WHEN l.chrom = rc THEN (l.i >= {LO})::INT + (l.i >= {HI})::INT ELSE 0 END AS seg2 FROM req AS r JOIN lab AS l USING (source)),
 r0 AS (SELECT id, chrom, seg, count(*) AS n, avg(x0) AS mean FROM ed GROUP BY ALL), r1 AS (SELECT id, chrom, seg, count(*) AS n, avg(x) AS mean FROM ed GROUP BY ALL), r2 AS (SELECT id, chrom, seg2 AS seg, count(*) AS n, avg(x) AS mean FROM ed GROUP BY ALL),
 f0 AS ({_fits("r0")}), f1 AS ({_fits("r1")}), f2 AS ({_fits("r2")}),
 bins3 AS (SELECT ed.id, ed.chrom = rc AS here, f0.state AS s0, f1.state AS s1, f2.state AS s2, f0.best_s AS b0, f1.best_s AS b1, f2.best_s AS b2, ed.chrom, ed.seg, ed.seg2 FROM ed JOIN f0 ON f0.id = ed.id AND f0.chrom = ed.chrom AND f0.seg = ed.seg JOIN f1 ON f1.id = ed.id AND f1.chrom = ed.chrom AND f1.seg = ed.seg JOIN f2 ON f2.id = ed.id AND f2.chrom = ed.chrom AND f2.seg = ed.seg2),
 every AS (SELECT id, 'original' AS scenario, here, s0 AS a, s0 AS b, b0 AS best_s, chrom, seg AS k FROM bins3 UNION ALL SELECT id, 'fixed', here, s0, s1, b1, chrom, seg FROM bins3 UNION ALL SELECT id, 'event_isolated', here, s0, s2, b2, chrom, seg2 FROM bins3)
 SELECT id, scenario, 'ok' AS status, any_value(best_s) AS best_s, count(DISTINCT (chrom, k)) AS n_segments, count(*) FILTER (here AND a <> b) AS changed_bins, count(*) FILTER (NOT here AND a <> b) AS changed_elsewhere FROM every GROUP BY id, scenario"""
query("e3_scenarios", _COLUMNS, _CALLED)(lambda g: _scenarios(_run(g, requests(g, "multiply", value=1.5), 10)).where("scenario <> 'resegmented'"))  # none of these hangs on permutations
query("e3_resegmented", _COLUMNS)(lambda g: _scenarios(_run(g, requests(g, "multiply", value=1.5))).where("scenario = 'resegmented'"))
query("e3_edges", "id edge bin:i chromosome_edge accepted side rank:i winner ad:r p_local:r p_global:r")(lambda g: _run(g, requests(g, "add", value=3.0)).select("id", F.explode("edges").alias("x")).select("id", "x.*"))
query("e3_trees", "id tree side start:i end:i cut:i ad:r p_local:r p_global:r accepted")(lambda g: _run(g, requests(g, "set", value=0.0)).select("id", F.explode("nodes").alias("x")).select("id", "x.*"))
query("e2_simulate", "id status donors:i changed_bins:i factor:r")(lambda g: _run(g, requests(g, "simulate", state="base", preserve_total=True)))


@query("e5_experiments_by_width", "id scenario changed_bins:i changed_elsewhere:i gains:i")
def e5(g: Genome) -> DataFrame:
    """A series for each source, around one region of chromosome 1995."""
    n = g.bins.where("chrom = 1995").count()
    return _scenarios(_run(g, experiments.width_series(requests(g, "multiply", value=2.0).where("chrom = 1995"), n)))
