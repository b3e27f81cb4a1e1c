"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines in each bucket, connected components.

Equal vectors are one node.  A bucket of over PART nodes is split into parts, and each pair of parts is
compared on its own, so a task holds two parts whatever the bucket's size.  A pair is counted in the
first table in which its signatures agree, so nothing has to be counted twice or made distinct later.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, runs
from .components import connected_components

PART = 512
BY = ["place", "dim", "turn", "signature", "i", "j"]


def table_sizes(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits a signature, and tables, for n vectors of one label: about 64 vectors a bucket, and a pair at the threshold is met in some table with the recall's probability."""
    bits = min(20, max(4, math.ceil(math.log2(max(1, n) / 64)))) if n > 64 else 4
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One integer for each row of x and table."""
    if not x.shape[1]:
        return np.zeros((len(x), tables), np.int64)
    return (x @ planes(x.shape[1], bits, tables, seed) >= 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest item reachable from each of n items by the links a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999, seed: int = 42) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal labels are linked if their cosine in double precision is at least the threshold; no
    link is below it.  Null labels and ids, and vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of unlike sizes.  Rows repeated with their id
    are vectors of their own that link with each other.  A row without id has no component and isn't
    kept; other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("place"), x.cast("array<double>").alias("embedding"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    sound = F.coalesce(sound, F.lit(False)) & F.col("place").isNotNull() & F.col("vec_id").isNotNull()
    nodes = rows.where(sound).groupBy("place", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    largest = nodes.groupBy("place").count().agg(F.max("count")).first()[0] or 0
    bits, tables = table_sizes(largest, threshold, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            found = np.zeros((len(sizes), tables), np.int64)
            for dim in np.unique(sizes):  # one, as a rule
                found[sizes == dim] = signatures(vectors_of(batch.column("embedding").filter(pa.array(sizes == dim))), bits, tables, seed)
            signed = pa.ListArray.from_arrays(np.arange(0, found.size + 1, tables, dtype=np.int32), found.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, signed], [*batch.schema.names, "signatures"])

    place = F.xxhash64("place")  # labels of any type; ones that share a hash are told apart below
    plain = nodes.select("node", place.alias("place"), F.col("place").cast("string").alias("label"), F.size("embedding").alias("dim"), "copies", "embedding")
    schema = "node long, place long, label string, dim int, copies long, embedding array<double>, signatures array<long>"
    spread = plain.mapInArrow(hashed, schema).select("node", "place", "label", "dim", "copies", "embedding", F.posexplode("signatures").alias("turn", "signature"))
    bucket = ["place", "dim", "turn", "signature"]
    sizes = cut(spread.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).drop("n"), "buckets")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    blocks = spread.join(sizes, bucket).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).select(*BY, "mine", "node", "label", "copies", "embedding")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, BY):
            turn, i, j = (block.column(c)[0].as_py() for c in ("turn", "i", "j"))
            mine, node, copies = (block.column(c).to_numpy() for c in ("mine", "node", "copies"))
            _, label = np.unique(np.array(block.column("label").to_pylist()), return_inverse=True)
            v = vectors_of(block.column("embedding"))
            # dividing by the largest component first keeps squares finite
            unit = v / np.abs(v).max(1, keepdims=True)
            norm = np.sqrt((unit * unit).sum(1))
            left = np.flatnonzero(mine == i)
            right = left if i == j else np.flatnonzero(mine == j)
            close = (unit[left] @ unit[right].T) / norm[left][:, None] / norm[right] >= threshold
            if i == j:
                close = np.triu(close, 1)
            a, b = np.nonzero(close)
            a, b = left[a], right[b]
            before = signatures(v, bits, tables, seed)[:, :turn]
            new = (label[a] == label[b]) & ~(before[a] == before[b]).any(1)
            a, b = a[new], b[new]
            links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
            to = least_labels(len(node), a, b)
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(node[to[some]])], ["node", "links", "to"])

    found = cut(blocks.repartition(*BY).sortWithinPartitions(*BY).mapInArrow(compared, "node long, links long, to long"), "links")
    joined = cut(connected_components(found.select(F.col("node").alias("a"), F.col("to").alias("b"))), "components")
    links = cut(found.groupBy("node").agg(F.sum("links").alias("links")), "link-counts")
    nodes = nodes.join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = cut(nodes, "nodes")
    least = cut(nodes.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    nodes = cut(nodes.join(least, "component").select("place", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "nodes")
    linked = rows.where(sound).join(nodes, ["place", "embedding"]).select("vec_id", "n_links", "component_id")
    lonely = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(lonely).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93::DOUBLE),
r AS (SELECT DISTINCT a, a AS seen FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT a, min(seen) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), false) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
