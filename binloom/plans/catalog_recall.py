"""Calls by scale fit, of sources and of every cell, and what changes when boundaries go, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.functions import stats
from binloom.operators import calls, recall, segments
from binloom.operators.segments import PLACE
from binloom.sources.genome import Genome

from .catalog import TAU, labelled, query


def fit_sql(rows: str, key: str, columns: str) -> str:
    """copy_numbers in SQL: between the points at which a rounded copy number rises, the misfit is a parabola in the scale's inverse."""
    return f"""SELECT {columns}, best_s, continuous, whole, CASE WHEN best_s IS NULL THEN 'undefined' ELSE 'ok' END AS status, CASE WHEN r = b THEN r::DOUBLE WHEN r = 0 AND b = 1 THEN 0.5 WHEN r = 2 AND b = 1 THEN 1.5 WHEN best_s IS NOT NULL THEN -1 END AS state
 FROM (SELECT *, CASE WHEN best_s IS NOT NULL THEN greatest(1, least(3, whole)) - 1 END AS r, CASE WHEN continuous <= 1 THEN 0 WHEN continuous >= 3 THEN 2 WHEN continuous IS NOT NULL THEN 1 END AS b
 FROM (SELECT f.*, best_s, mean / best_s AS continuous, round_even(mean / best_s, 0)::BIGINT AS whole FROM {rows} AS f LEFT JOIN (
 WITH med AS (SELECT {key}, min(mean) AS med FROM (SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY mean, chrom, seg) AS c, sum(n) OVER (PARTITION BY {key}) AS t FROM {rows}) WHERE c >= t / 2 GROUP BY {key} HAVING min(mean) > 0),
 near AS (SELECT {key}, n::DOUBLE AS n, mean, 1 / (0.75::DOUBLE * med) AS lo, 1 / (0.35::DOUBLE * med) AS hi FROM {rows} JOIN med USING ({key})),
 risen AS (SELECT {key}, n, mean, unnest(range((floor(mean * lo - 0.5::DOUBLE) + 1)::BIGINT, ceil(mean * hi - 0.5::DOUBLE)::BIGINT)) AS h FROM near),
 points AS (SELECT {key}, any_value(lo) AS u, sum(n * mean * round_even(mean * lo, 0)) AS b, sum(n * power(round_even(mean * lo, 0), 2)) AS d FROM near GROUP BY {key} UNION ALL SELECT {key}, (h + 0.5::DOUBLE) / mean, n * mean, n * (2 * h + 1) FROM risen),
 sums AS (SELECT {key}, u, lead(u) OVER w AS next, sum(b) OVER (w ROWS UNBOUNDED PRECEDING) AS b, sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS d FROM points WINDOW w AS (PARTITION BY {key} ORDER BY u, b, d)),
 tops AS (SELECT {key}, a, b, d, least(greatest(b / a, u), coalesce(next, hi)) AS x FROM sums JOIN (SELECT {key}, sum(n * mean * mean) AS a, any_value(hi) AS hi FROM near GROUP BY {key}) USING ({key})),
 fits AS (SELECT {key}, x, round(a * x * x - 2 * b * x + d, 7) AS misfit FROM tops)
 SELECT {key}, 1 / arg_min(x, struct_pack(m := misfit, less := -x)) AS best_s FROM fits GROUP BY {key}) USING ({key})))"""


def kept_boundaries(g: Genome) -> DataFrame:
    """The boundaries between unlike segments: those whose medians differ by TAU or more, in log2, or can't be compared."""
    rows = segments.with_flanks(segments.segment_summaries(labelled(g)), ["median"]).where("seg > 0")
    near = F.coalesce(F.abs(stats.log2_ratio(F.col("median"), F.col("median_left"))) < TAU, F.lit(False))
    return rows.where(~near).select(*PLACE, F.col("s").alias("bin"))


def _both(g: Genome) -> tuple[DataFrame, DataFrame]:
    return tuple(segments.labelled(g.profile, b).select(*PLACE, "i", "seg", "x") for b in (g.boundaries, kept_boundaries(g)))


def _of_sources(labels: DataFrame) -> DataFrame:
    rows = labels.groupBy(*PLACE, "seg").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    return calls.copy_numbers(rows, ["source"]).withColumn("code", calls.encode_states(F.col("state")))


def _own(g: Genome) -> DataFrame:
    return g.membership.where("source <> 'all'")


def _cell_pieces(g: Genome) -> DataFrame:
    a, b = _both(g)
    calls_ = [recall.call_cells(g.signal, _own(g), x) for x in (a, b)]
    return recall.piece_calls(*calls_, recall.overlay(a, b), ["cell"])


def _source_pieces(g: Genome) -> DataFrame:
    a, b = _both(g)
    return recall.piece_calls(_of_sources(a), _of_sources(b), recall.overlay(a, b), ["source"])


_CODE = "coalesce(round_even(state * 2, 0), 255)::INT AS code"
_SOURCE_ROWS = "(SELECT source, chrom, seg, count(*) AS n, avg(x) AS mean FROM {0} GROUP BY ALL)"
_LAB2 = f"""lab2 AS (SELECT p.*, sum(CASE WHEN b.bin IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.source, p.chrom ORDER BY p.i)::BIGINT AS seg FROM profile AS p
 LEFT JOIN (SELECT source, chrom, s AS bin FROM (SELECT *, lag(median) OVER (PARTITION BY source, chrom ORDER BY seg) AS p FROM st) WHERE seg > 0 AND NOT coalesce(abs(CASE WHEN median > 0 AND p > 0 THEN log2(median / p) END) < {TAU}, false)) AS b
 ON b.source = p.source AND b.chrom = p.chrom AND b.bin = p.i)"""
_CELL_ROWS = """(SELECT m.cell, w.source, w.chrom, w.seg, w.n, coalesce(t.total, 0) / w.n AS mean FROM (SELECT * FROM membership WHERE source <> 'all') AS m JOIN (SELECT source, chrom, seg, count(*) AS n FROM {0} GROUP BY ALL) AS w USING (source)
 LEFT JOIN (SELECT s.cell, l.chrom, l.seg, sum(s.x) AS total FROM signal AS s JOIN {0} AS l ON l.source = 'cluster' || (s.cell % 5) AND l.g = s.g GROUP BY ALL) AS t ON t.cell = m.cell AND t.chrom = w.chrom AND t.seg = w.seg)"""
_PIECES = "(SELECT a.source, a.chrom, a.seg AS before_seg, b.seg AS after_seg, count(*) AS n_bins FROM lab AS a JOIN lab2 AS b ON b.source = a.source AND b.g = a.g GROUP BY ALL)"


def _pieces_sql(rows: str, key: str) -> str:
    """CTEs up to pieces: key, source, chrom, n_bins, before, after, before_s, after_s."""
    a, b = rows.format("lab"), rows.format("lab2")
    columns = ", ".join(dict.fromkeys([key, "source", "chrom", "seg"]))
    return f"""WITH {_LAB2}, ra AS {a}, rb AS {b}, ca AS (SELECT *, {_CODE} FROM ({fit_sql("ra", key, columns)})), cb AS (SELECT *, {_CODE} FROM ({fit_sql("rb", key, columns)})),
 pieces AS (SELECT ca.{key} AS unit, ca.source, ca.chrom, p.n_bins, ca.code AS before, cb.code AS after, ca.best_s AS before_s, cb.best_s AS after_s FROM ca JOIN {_PIECES} AS p ON p.source = ca.source AND p.chrom = ca.chrom AND p.before_seg = ca.seg
 JOIN cb ON cb.{key} = ca.{key} AND cb.source = ca.source AND cb.chrom = ca.chrom AND cb.seg = p.after_seg)"""


_CHANGES = """SELECT *, after_s - before_s AS s_change, coalesce(100::DOUBLE * bins_changed / nullif(bins_called, 0), 0) AS pct_changed FROM (SELECT {0}, sum(n_bins) FILTER (before <> 255) AS bins_called, coalesce(sum(n_bins) FILTER (before <> after), 0) AS bins_changed, any_value(before_s) AS before_s, any_value(after_s) AS after_s FROM pieces GROUP BY {0})"""
_FIT = "status best_s:r continuous:r whole:i state:r"

query("c1_copy_numbers", f"source chrom:i seg:i {_FIT}", f"WITH r AS {_SOURCE_ROWS.format('lab')} {fit_sql('r', 'source', 'source, chrom, seg')}")(lambda g: _of_sources(labelled(g)))
query("c7_cell_fits", f"cell:i source chrom:i seg:i mean:r {_FIT}", f"WITH r AS {_CELL_ROWS.format('lab')} {fit_sql('r', 'cell', 'cell, source, chrom, seg, mean')}")(lambda g: recall.call_cells(g.signal, _own(g), labelled(g)))


@query("c10_source_changes", "source segments_before:i segments_after:i merges:i before_s:r after_s:r bins_called:i bins_changed:i pct_changed:r", f"""{_pieces_sql(_SOURCE_ROWS, "source")}
 SELECT c.* REPLACE (round_even(pct_changed, 3) AS pct_changed), unit AS source, x.k AS segments_before, y.k AS segments_after, x.k - y.k AS merges FROM ({_CHANGES.format("unit")}) AS c
 JOIN (SELECT source AS unit, count(*) AS k FROM ra GROUP BY source) AS x USING (unit) JOIN (SELECT source AS unit, count(*) AS k FROM rb GROUP BY source) AS y USING (unit)""")
def c10(g: Genome) -> DataFrame:
    return recall.source_changes(recall.changes(_source_pieces(g), ["source"]), *_both(g))


query("c11_cell_changes", "cell:i bins_called:i bins_changed:i pct_changed:r before_s:r after_s:r s_change:r", f"{_pieces_sql(_CELL_ROWS, 'cell')} SELECT *, unit AS cell FROM ({_CHANGES.format('unit')})")(
    lambda g: recall.changes(_cell_pieces(g), ["cell"])
)
query("c11_summary", "n_cells:i n_changed_cells:i median_pct:r median_s_change:r least_s_change:r largest_s_change:r", f"{_pieces_sql(_CELL_ROWS, 'cell')} SELECT count(*) AS n_cells, count(*) FILTER (bins_changed > 0) AS n_changed_cells, round_even(median(pct_changed), 3) AS median_pct, median(s_change) AS median_s_change, min(s_change) AS least_s_change, max(s_change) AS largest_s_change FROM ({_CHANGES.format('unit')})")(
    lambda g: recall.cell_changes_summary(recall.changes(_cell_pieces(g), ["cell"]))
)
query("c11_cell_transitions", "before:i after:i bins:i", f"{_pieces_sql(_CELL_ROWS, 'cell')} SELECT before, after, sum(n_bins) AS bins FROM pieces WHERE before <> after GROUP BY ALL")(lambda g: recall.transitions(_cell_pieces(g)))


def _manual(g: Genome) -> DataFrame:
    """Boundaries with those of chromosome 1995 set by hand."""
    own = g.membership.select("source").distinct().select("source", F.lit(1995).alias("chrom"), F.explode(F.array(*[F.lit(b).cast("long") for b in (60, 150, 240)])).alias("bin"))
    return g.boundaries.where("chrom <> 1995").union(own)


_MANUAL = _pieces_sql(_SOURCE_ROWS, "source").replace(_LAB2, """lab2 AS (SELECT p.*, sum(CASE WHEN b.bin IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.source, p.chrom ORDER BY p.i)::BIGINT AS seg FROM profile AS p
 LEFT JOIN (SELECT * FROM boundaries WHERE chrom <> 1995 UNION ALL SELECT source, 1995, unnest([60, 150, 240]) FROM n_cells) AS b ON b.source = p.source AND b.chrom = p.chrom AND b.bin = p.i)""")


@query("c4_manual_changes", "source chrom:i bins_called:i bins_changed:i before_s:r after_s:r edited", f"{_MANUAL} SELECT *, unit AS source, chrom = 1995 AS edited FROM ({_CHANGES.format('unit, chrom')})")
def c4(g: Genome) -> DataFrame:
    """What boundaries set by hand in one chromosome change there and, through the scale, elsewhere, against the production's."""
    a, b = (segments.labelled(g.profile, x).select(*PLACE, "i", "seg", "x") for x in (g.boundaries, _manual(g)))
    pieces = recall.piece_calls(_of_sources(a), _of_sources(b), recall.overlay(a, b), ["source"])
    return recall.changes(pieces, PLACE).withColumn("edited", F.col("chrom") == 1995)


def _status_sql(values: str, rows: str, key: str) -> str:
    """fit_status in SQL: values (key, x, times) are expanded, rows are the key's segments."""
    columns = ", ".join(dict.fromkeys([key, "source", "chrom", "seg"]))
    return f"""WITH r AS {rows}, v AS (SELECT {key}, x FROM {values}), q AS (SELECT {key}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY {key}),
 b AS (SELECT {key}, avg(x) AS baseline FROM v JOIN q USING ({key}) WHERE x >= 0 AND round(x - q3 - 1.5::DOUBLE * (q3 - q1), 9) <= 0 GROUP BY {key}),
 m AS (SELECT {key}, min(mean) FILTER (c >= t / 2) AS median FROM (SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY mean, chrom, seg) AS c, sum(n) OVER (PARTITION BY {key}) AS t FROM r) GROUP BY {key}),
 f AS (SELECT {key}, max(best_s) AS best_s FROM ({fit_sql("r", key, columns)}) GROUP BY {key})
 SELECT {key}, baseline, median, best_s, CASE WHEN NOT coalesce(baseline > 0, false) THEN 'undefined_baseline' WHEN NOT coalesce(median > 0, false) THEN 'undefined_median' WHEN NOT coalesce(best_s > 0, false) THEN 'undefined_scale' ELSE 'ok' END AS status FROM q LEFT JOIN b USING ({key}) LEFT JOIN m USING ({key}) LEFT JOIN f USING ({key})"""


@query("c5_source_status", "source baseline:r median:r best_s:r status", _status_sql("profile", _SOURCE_ROWS.format("lab"), "source"))
def c5_sources(g: Genome) -> DataFrame:
    rows = labelled(g).groupBy(*PLACE, "seg").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    fits = _of_sources(labelled(g)).groupBy("source").agg(F.max("best_s").alias("best_s"))
    return recall.fit_status(g.profile.select("source", "x", F.lit(1).alias("times")), rows, fits, ["source"])


_DENSE = "(SELECT c.cell, coalesce(s.x, 0)::DOUBLE AS x FROM cells AS c CROSS JOIN bins AS b LEFT JOIN signal AS s ON s.cell = c.cell AND s.g = b.g)"


@query("c5_cell_status", "cell:i baseline:r median:r best_s:r status", _status_sql(_DENSE, _CELL_ROWS.format("lab"), "cell"))
def c5_cells(g: Genome) -> DataFrame:
    """Cells have signal in few of their bins, so that of most the upper fence is 0 and so is the baseline; zeros are one row with their number."""
    fits = recall.call_cells(g.signal, _own(g), labelled(g))
    n = g.bins.count()
    zeros = g.signal.groupBy("cell").agg(F.count("*").alias("seen")).select("cell", F.lit(0.0).alias("x"), (n - F.col("seen")).alias("times"))
    values = g.signal.select("cell", "x", F.lit(1).cast("long").alias("times")).union(zeros.where("times > 0"))
    return recall.fit_status(values, fits.select("cell", "chrom", "seg", "n", "mean"), fits.groupBy("cell").agg(F.max("best_s").alias("best_s")), ["cell"])
