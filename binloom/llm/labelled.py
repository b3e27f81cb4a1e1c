"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def sample(docs: DataFrame, labels: DataFrame, target: str, per_class: tuple[int, int]) -> DataFrame:
    """doc_id, y and text of at most per_class documents of label 0 and of label 1, none of them held out.

    The rows with the smallest hashes of their ids are taken, so the sample is the same on every run
    and doesn't depend on how the tables are split.  An id gives one row, of its unlike texts the one with the
    least hash.  Null ids and labels aren't sampled.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(target).cast("int")).alias("y"))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[y]) for y in (0, 1)]
    # at most sum(per_class) rows of two numbers: a proven bound
    chosen = F.broadcast(chosen[0].union(chosen[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    # of unlike texts of one id the one with the least hash, whatever order rows come in
    return rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")).select("doc_id", "y", "least.text")
