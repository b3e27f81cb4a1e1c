"""Filter interaction audit: which documents each order of five filters removes, from counts by failure mask.

Each document has a mask of the filters it fails.  A part's counts by mask, 32 numbers, go through a
subset-zeta transform, which gives for every set of filters the documents that fail no other; survivors
of a set of filters are those of its complement, and what a step of an order removes is the difference
of two neighbouring sets.  Documents are read once; everything after the counts is 32 numbers a part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LETTERS = "ABCDE"
SETS = 1 << len(LETTERS)
#: What is counted for each mask: documents, those of good quality, toxic ones.
MEASURES = ["n", "good", "toxic"]


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: fails A (under 200 words), B (under half of the words distinct), C (over 2 in 100 capitals), D (a sign of markup)."""
    words = F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")
    total, unlike = F.size(words), F.size(F.array_distinct(words))
    fails = [total < 200, 100 * unlike.cast("long") < 50 * total.cast("long"), 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.char_length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def _labelled(labels: DataFrame) -> DataFrame:
    marks = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))]
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(*marks)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the mask of all five filters.

    A copy is a document whose text some smaller doc_id has.  Rows are first counted by text, part, mask
    and labels, so a text with very many copies is a few rows when its texts meet.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("hash"), text_mask(text).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "hash", "mask").agg(F.count("*").alias("c"))
    # rows without id are dealt out by their text, as nulls would all meet
    rows = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("hash", "part")))
    found = rows.join(_labelled(labels), (F.col("key") == F.col("labelled")) & F.col("doc_id").isNotNull(), "left")
    marked = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    found = found.select("doc_id", "part", "hash", "mask", "c", *marked, F.col("doc_id").isNull().alias("nameless"))
    groups = found.groupBy("hash", "part", "mask", "good", "toxic", "nameless").agg(F.sum("c").alias("n"), F.min(F.struct("doc_id", "c")).alias("first"))
    least = F.min(F.when(~F.col("nameless"), F.col("first.doc_id"))).over(W.partitionBy("hash"))
    groups = groups.withColumn("least", least)
    copies = F.when(F.col("nameless"), 0).when(F.col("first.doc_id") == F.col("least"), F.col("n") - F.col("first.c")).otherwise(F.col("n"))
    groups = groups.withColumn("copies", copies)
    both = F.explode(F.array(F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("copies").alias("n")))).alias("x")
    each = groups.select("part", "good", "toxic", both).select("part", "x.mask", "x.n", "good", "toxic")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def subset_zeta(counts: DataFrame, measures: list[str]) -> DataFrame:
    """part and an array for each measure: at s, the sum over the masks inside the set s."""
    wide = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures)))).alias("of"))
    at = F.sequence(F.lit(0), F.lit(SETS - 1))

    def counted(measure: str) -> Column:
        return F.transform(at, lambda s: F.coalesce(F.col("of")[s][measure], F.lit(0).cast("long"))).alias(measure)

    def summed(measure: str, bit: int) -> Column:
        return F.transform(measure, lambda x, s: x + F.when(s.bitwiseAND(bit) != 0, F.get(measure, s.bitwiseXOR(F.lit(bit)))).otherwise(0)).alias(measure)

    wide = wide.select("part", *map(counted, measures))
    for k in range(len(LETTERS)):
        wide = wide.select("part", *(summed(m, 1 << k) for m in measures))
    return wide


def _shapley(k: int) -> Column:
    """What filter k removes, summed over all orders: each set of filters before it counts as often as it can come before."""
    bit, others = 1 << k, len(LETTERS) - 1
    before = [s for s in range(SETS) if not s & bit]
    ways = {s: factorial(s.bit_count()) * factorial(others - s.bit_count()) for s in before}
    left = lambda s: F.get("n", F.lit(SETS - 1 - s))
    return sum(((left(s) - left(s | bit)) * ways[s] for s in before), F.lit(0).cast("long"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts and sources are empty.  Rows repeated with their id count each, and none of them is a copy
    of the other, as no id is smaller; a row without id is neither a copy nor an original, and has no
    labels.  A document with unlike labels is good (toxic) if any of its labels says so.  Texts are the
    same if their SHA-256 is.  An empty table has no parts; other columns are not read.
    """
    sets = subset_zeta(mask_counts(docs, labels), MEASURES)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(LETTERS)))
    steps = sets.withColumn("shapleys", F.array(*map(_shapley, range(len(LETTERS))))).withColumn("filter_order", F.explode(orders))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    before = sum((F.when(F.instr(earlier, c) > 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(LETTERS)), F.lit(0))
    steps = steps.withColumns({"k": F.instr(F.lit(LETTERS), letter) - 1, "before": before})
    steps = steps.withColumn("bit", F.expr("shiftleft(1, k)"))
    whole = F.lit(SETS - 1)
    left = lambda m, s: F.get(m, whole - s)
    removed = {m: left(m, F.col("before")) - left(m, F.col("before") + F.col("bit")) for m in MEASURES}
    failing = left("n", F.lit(0)) - left("n", F.col("bit"))
    return steps.select(
        "part", "filter_order", "step", left("n", F.col("before") + F.col("bit")).alias("kept"), removed["n"].alias("removed"), (failing - removed["n"]).alias("redundant"),
        (F.get("n", F.col("bit")) - F.get("n", F.lit(0))).alias("unique_fails"), removed["good"].alias("good_lost"), removed["toxic"].alias("toxic_lost"), F.get("shapleys", F.col("k")).alias("shapley"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, doc_id > min(doc_id) OVER (PARTITION BY t) AS copy FROM d),
f AS (SELECT part, coalesce(q.good, false) AS good, coalesce(q.toxic, false) AS toxic,
  CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN coalesce(copy, false) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id) AS q USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l AS a, l AS b, l AS c, l AS d, l AS e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM o),
x AS (SELECT c.*, filter_order, step, filter_order[step] AS letter, contains(fails, filter_order[step]) AS failing,
  len(list_filter(string_split(fails, ''), lambda y: y <> '' AND instr(filter_order, y) < step)) = 0 AS reached FROM c CROSS JOIN s),
g AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (reached AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (reached AND failing), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (failing AND NOT reached), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (reached AND failing), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (reached AND failing), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g
"""
