"""Reading, checking, writing and comparing tables, and small helpers, as queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binloom.functions import stats
from binloom.operators import calls, diffusion, segments
from binloom.operators.segments import PLACE
from binloom.functions.shared import folder
from binloom.sources import matrix, tables
from binloom.sources.genome import Genome

from .catalog import labelled, query, states


def _place(g: Genome) -> str:
    return f"{folder(g.spark)}/table-{uuid.uuid4().hex}"


@query("s8_registry", "name status rows:i", "SELECT 'nation' AS name, 'found' AS status, count(*) AS rows FROM nation UNION ALL SELECT 'supplier', 'found', count(*) FROM supplier UNION ALL SELECT 'breakpoints', 'problem', NULL UNION ALL SELECT 'graph', 'note', NULL")
def s8(g: Genome) -> DataFrame:
    """Which tables of the input folder are there; a missing one is a problem if it is needed, else a note."""
    found, said = tables.registry(g.spark, g.dir, ["nation", "breakpoints"], ["supplier", "graph"])
    rows = [df.agg(F.lit(name).alias("name"), F.lit("found").alias("status"), F.count("*").alias("rows")) for name, df in found.items()]
    return reduce(DataFrame.union, rows, g.spark.createDataFrame([(*x, None) for x in said], "name string, status string, rows long"))


@query("s1_csv_bins", "seq start:i end:i bin_in_chrom:i", 'SELECT chrom::VARCHAR AS seq, "start", "end", i AS bin_in_chrom FROM bins')
def s1(g: Genome) -> DataFrame:
    """The bins as a CSV table, written and read by schema."""
    path = _place(g)
    g.bins.select(F.col("chrom").cast("string").alias("seq"), "start", "end", F.col("i").alias("bin_in_chrom")).write.csv(path, header=True)
    return tables.read_csv(g.spark, path, tables.BINS)


query("s2_level_codes", "source chrom:i seg:i cn:r code:i", "SELECT source, chrom, seg, state AS cn, round_even(state * 2, 0) AS code FROM states")(lambda g: tables.level_codes(states(g).withColumnRenamed("state", "cn")))
query("s2_bad_levels", "source chrom:i seg:i cn:r", "SELECT source, chrom, seg, mean AS cn FROM states WHERE NOT mean IN (0, 0.5, 1, 1.5, 2)")(lambda g: tables.bad_levels(states(g).withColumnRenamed("mean", "cn")))


#: The columns of the wide table: the nations, whose number is fixed.
NATIONS = 25


def _wide(g: Genome) -> DataFrame:
    """Bins by nations, a column a nation: what its suppliers shipped."""
    supplier = g.read("supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("nation"))
    rows = g.signal.join(supplier, "cell").join(g.bins.select("g", "start", "end"), "g")
    sums = [F.sum(F.when(F.col("nation") == k, F.col("x")).otherwise(0.0)).alias(f"n{k}") for k in range(NATIONS)]
    return rows.groupBy(F.col("chrom").cast("string").alias("chr"), "start", "end").agg(*sums)


@query("s12_wide_sums", "source chr start:i total:r", """SELECT source, chrom::VARCHAR AS chr, "start", sum(CASE WHEN source IN (r, 'all') THEN x ELSE 0::DOUBLE END) AS total FROM (SELECT unnest(list_append(list(r_name), 'all')) AS source FROM region) CROSS JOIN
 (SELECT signal.chrom, "start", signal.x, r_name AS r FROM signal JOIN bins USING (g) JOIN supplier ON s_suppkey = cell JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey) GROUP BY ALL""")
def s12(g: Genome) -> DataFrame:
    """A stored wide table summed by region and over all."""
    path = _place(g)
    _wide(g).write.parquet(path)
    nations = g.read("nation").join(g.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    members = nations.select(F.explode(F.array("r_name", F.lit("all"))).alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("cell"))
    return tables.sum_by_source(g.spark, path, members)


@query("l2_input_problems", "name problem n:i", "SELECT 'HA' AS name, 'barcodes_missing' AS problem, count(*) AS n FROM cells WHERE cell % 10 = 3 HAVING count(*) > 0")
def l2(g: Genome) -> DataFrame:
    """What the matrix of all cells lacks without every tenth; its barcodes are rows, as no plan has a column a cell."""
    rows = g.signal.join(g.bins.select("g", "start", "end"), "g").withColumn("chr", F.col("chrom").cast("string"))
    own = rows.where("cell % 10 <> 3").select("cell").distinct()
    return tables.axis_problems(rows.select("chr", "start", "end").distinct(), own, g.bins.withColumn("chr", F.col("chrom").cast("string")), g.membership.where("source = 'all'").select("cell"), "HA")


def _matrix(g: Genome, rows: DataFrame, kind: str) -> DataFrame:
    path = _place(g)
    matrix.write_matrix(rows, path, kind)
    return matrix.read_matrix(g.spark, path, kind)


def _signal_rows(g: Genome) -> DataFrame:
    return matrix.sparse_rows(g.signal, "cell", "g", "x")


@query("s2_dense_levels", "source:i g:i cn:r code:i", "SELECT number AS source, g, state AS cn, round_even(state * 2, 0) AS code FROM lab JOIN states USING (source, chrom, seg) JOIN (SELECT source, row_number() OVER (ORDER BY source) - 1 AS number FROM n_cells) USING (source)")
def s2_dense(g: Genome) -> DataFrame:
    """Levels as a dense matrix of sources by bins, written in blocks of rows, read again, checked and coded."""
    number = F.array_position(F.array(*map(F.lit, sorted(g.sources))), F.col("source")) - 1
    cells = labelled(g).join(states(g).select(*PLACE, "seg", "state"), [*PLACE, "seg"]).select(number.alias("row"), "g", F.coalesce("state", F.lit(float("nan"))).alias("state"))
    read = _matrix(g, matrix.sparse_rows(cells, "row", "g", "state").select("row", "values"), "dense")
    long = read.select(F.col("row").alias("source"), F.posexplode("values").alias("g", "x")).withColumn("cn", F.when(~F.isnan("x"), F.col("x")))
    return tables.level_codes(long)


query("s3_row_pointers", "row:i n:i", "SELECT cell AS row, count(*) AS n FROM signal GROUP BY cell")(
    lambda g: matrix.read_matrix(g.spark, _written_signal(g), "pointers")
)
query("s5_sparse_blocks", "cell:i g:i x:r", "SELECT cell, g, x FROM signal")(lambda g: matrix.entries(matrix.read_matrix(g.spark, _written_signal(g), "sparse")).toDF("cell", "g", "x"))
query("s4_dense_row", "g:i x:r", "SELECT b.g, coalesce(s.x, 0) AS x FROM bins AS b LEFT JOIN (SELECT * FROM signal WHERE cell = 7) AS s USING (g)")(
    lambda g: matrix.dense_row(matrix.read_matrix(g.spark, _written_signal(g), "sparse"), 7, g.bins.count())
)


def _written_signal(g: Genome) -> str:
    path = _place(g)
    matrix.write_matrix(_signal_rows(g), path, "sparse")
    return path


_SHARED = "SELECT a.l_suppkey AS source, b.l_suppkey AS target, count(*) AS weight FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL"


#: Lines of one task; an order has four on average, so four times as many pairs.
LINES = 1 << 18


def _tasks(g: Genome) -> int:
    return max(1, -(-g.read("lineitem").count() // LINES))


def _order_pairs(g: Genome) -> DataFrame:
    """source, target for any two lines of one order, which has few lines; lines are dealt to tasks by their number, and the join says how it is made, as pruned lines look small enough to be broadcast."""
    lines = g.read("lineitem").select("l_orderkey", "l_suppkey").repartition(_tasks(g), "l_orderkey")
    other = lines.select("l_orderkey", F.col("l_suppkey").alias("target")).hint("merge")
    return lines.withColumnRenamed("l_suppkey", "source").join(other, "l_orderkey").select("source", "target")


def shared_orders(g: Genome) -> DataFrame:
    """source, target, weight of a graph of suppliers: how often two of them have lines of one order. Pairs are dealt to tasks by their number."""
    pairs = _order_pairs(g).where("source <> target")
    return pairs.repartition(_tasks(g), "source", "target").groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))


def _graph_rows(g: Genome) -> DataFrame:
    return matrix.sparse_rows(shared_orders(g).repartition(_tasks(g), "source"), "source", "target", "weight")


query("s9_graph_edges", "source:i target:i weight:r", _SHARED)(lambda g: matrix.entries(_matrix(g, _graph_rows(g), "sparse")).toDF("source", "target", "weight"))


@query("x7_diffusion_component", "node:i value:r note")
def x7(g: Genome) -> DataFrame:
    """The component of shared_orders' graph: its edges weigh the same both ways, so each pair of lines comes one way and counts for two."""
    return diffusion.diffusion_component(_order_pairs(g).where("source < target").withColumn("weight", F.lit(2.0)), tasks=_tasks(g))


@query("s13_packed_codes", "source n:i digest", "SELECT source, count(*) AS n, md5(string_agg(code, '' ORDER BY g)) AS digest FROM (SELECT lab.source, lab.g, printf('%02X', coalesce(round_even(state * 2, 0), 255)::INT) AS code FROM lab JOIN states USING (source, chrom, seg)) GROUP BY source")
def s13(g: Genome) -> DataFrame:
    """A byte a bin for each source, written as a binary column and read again."""
    rows = labelled(g).join(states(g).select(*PLACE, "seg", calls.encode_states(F.col("state")).alias("code")), [*PLACE, "seg"])
    path = _place(g)
    tables.packed_codes(rows, "source").write.parquet(path)
    return g.spark.read.parquet(path).select("source", F.octet_length("codes").alias("n"), F.md5(F.hex("codes")).alias("digest"))


@query("s14_segmentation_files", "source chrom:i bin:i", "SELECT source, chrom, bin FROM boundaries")
def s14(g: Genome) -> DataFrame:
    path = _place(g)
    tables.write_segmentation(g.boundaries, g.boundaries.withColumn("accepted", F.lit(True)), path, g.dir, {"permutations": 1000})
    return tables.read_csv(g.spark, f"{path}/accepted_breakpoints", "source string, chrom int, bin long", "\t")


query("z20_cell_clusters", "cell:i cluster", "SELECT cell, 'cluster' || (cell % 5) AS cluster FROM cells")(
    lambda g: tables.with_cluster(g.membership.where("source = 'all'").select("cell"), g.membership.where("source <> 'all'").select("cell", F.col("source").alias("cluster")))
)


@query("z21_table_differences", "source chrom:i seg:i column a b", "SELECT source, chrom, seg, CASE WHEN seg % 7 = 3 THEN NULL ELSE 'n' END AS \"column\", CASE WHEN seg % 7 = 3 THEN 'row' ELSE n::VARCHAR END AS a, CASE WHEN seg % 7 = 3 THEN NULL ELSE (n + 1)::VARCHAR END AS b FROM st WHERE seg % 7 IN (3, 5)")
def z21(g: Genome) -> DataFrame:
    """The segments against a copy that lacks some rows, counts others differently and is off by 1e-13 elsewhere."""
    a = segments.segment_summaries(labelled(g)).select(*PLACE, "seg", "n", "mean")
    b = a.where("seg % 7 <> 3").withColumns({"n": F.when(F.col("seg") % 7 == 5, F.col("n") + 1).otherwise(F.col("n")), "mean": F.col("mean") * (1 + 1e-13)})
    return tables.mismatches(a, b, [*PLACE, "seg"])


query("z18_reproduction", "status n_rows:i n_match:i", "SELECT 'values_differ' AS status, count(*) AS n_rows, count(*) FILTER (seg % 9 <> 4) AS n_match FROM st")(
    lambda g: (lambda s: tables.reproduced(s, s.withColumn("median", F.col("median") + F.when(F.col("seg") % 9 == 4, 1e-3).otherwise(1e-6)), [*PLACE, "seg"], "median"))(segments.segment_summaries(labelled(g)))
)
query("g5_spliced_ids", "source g:i id:i", """SELECT source, g, CASE WHEN chrom = 1996 THEN top + CASE WHEN i >= 200 THEN 3 WHEN i >= 40 THEN 2 ELSE 1 END ELSE id END AS id FROM (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY chrom, seg) AS id FROM lab) JOIN (SELECT source, count(DISTINCT (chrom, seg)) AS top FROM lab GROUP BY source) USING (source)""")(
    lambda g: segments.spliced_ids(labelled(g).withColumn("id", F.dense_rank().over(W.partitionBy("source").orderBy("chrom", "seg"))), 1996, [40, 200])
)
query("z13_exposures", "source chrom:i seg:i exposure:i", "SELECT source, chrom, seg, count(*) FILTER (x > 0) AS exposure FROM lab GROUP BY ALL")(lambda g: segments.exposures(labelled(g).withColumn("usable", F.col("x") > 0)))
query("z17_trimmed_means", "source chrom:i seg:i level:r", "SELECT st.source, st.chrom, st.seg, coalesce(iqr_mean, mean) AS level FROM st LEFT JOIN it USING (source, chrom, seg)")(lambda g: segments.trimmed_means(labelled(g), [*PLACE, "seg"]))
query("m3_srd_status", "source chrom:i seg:i srd_left:r zero_pair", "SELECT source, chrom, seg, srd_left, \"sum\" + sl = 0 AS zero_pair FROM sd")(
    lambda g: segments.with_flanks(segments.segment_summaries(labelled(g)), ["sum", "n"]).where("n_left IS NOT NULL AND n_right IS NOT NULL")
    .withColumns({"srd_left": stats.signed_srd(F.col("sum"), F.col("n"), F.col("sum_left"), F.col("n_left")), "zero_pair": stats.zero_pair(F.col("sum"), F.col("sum_left"))})
)
query("c14_pixel_codes", "source chrom:i i:i pixel:i label", """SELECT source, chrom, i, CASE WHEN code = lag_code AND code <> 255 THEN 254 ELSE code END AS pixel, CASE WHEN code = 255 THEN 'not called' ELSE CASE code WHEN 0 THEN '0.0 (loss)' WHEN 1 THEN '0.5 (loss)' WHEN 2 THEN '1.0 (base)' WHEN 3 THEN '1.5 (gain)' ELSE '2.0 (gain)' END END AS label
 FROM (SELECT *, lag(code) OVER (PARTITION BY source, chrom ORDER BY i) AS lag_code FROM (SELECT lab.source, lab.chrom, lab.i, coalesce(round_even(state * 2, 0), 255)::INT AS code FROM lab JOIN states USING (source, chrom, seg)))""")(
    lambda g: labelled(g).join(states(g).select(*PLACE, "seg", calls.encode_states(F.col("state")).alias("code")), [*PLACE, "seg"])
    .withColumn("before", F.lag("code").over(W.partitionBy(*PLACE).orderBy("i"))).withColumns({"pixel": calls.pixel_code(F.col("code"), F.col("before")), "label": calls.state_label(F.col("code"))})
)
query("u5_distinct_selections", "chrom:i s:i e:i", "SELECT DISTINCT chrom, s, e FROM st")(lambda g: segments.segment_summaries(labelled(g)).select("chrom", "s", "e").dropDuplicates())


@query("n5_noise_by_round", "source measure round0:r round1:r", """SELECT source, measure, max(v) FILTER (r = 0) AS round0, max(v) FILTER (r = 1) AS round1 FROM (SELECT source, r, unnest(['n_called', 'n_zigzag']) AS measure, unnest([a, b]) AS v FROM (SELECT source, r, count(*) AS a, count(*) FILTER (p = q AND state <> p) AS b FROM (SELECT *, lag(state) OVER w AS p, lead(state) OVER w AS q
 FROM (SELECT 0 AS r, source, chrom, seg, state FROM states WHERE state IS NOT NULL UNION ALL SELECT 1, source, chrom, seg, state FROM states WHERE state IS NOT NULL AND seg % 2 = 0) WINDOW w AS (PARTITION BY r, source, chrom ORDER BY seg)) GROUP BY ALL)) GROUP BY ALL""")
def n5(g: Genome) -> DataFrame:
    """The noise of two rounds' calls side by side; the second round's segments are every other one."""
    rounds = [calls.sequence_noise(s, PLACE).groupBy("source").agg(F.sum("n_called").alias("n_called"), F.sum("n_zigzag").alias("n_zigzag")) for s in (states(g), states(g).where("seg % 2 = 0"))]
    return calls.noise_by_round(rounds, ["n_called", "n_zigzag"])
