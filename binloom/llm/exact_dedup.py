"""Exact dedup by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of bytes.  The distinct blocks are sorted and numbered;
then adjacent numbers of a document are paired, the distinct pairs sorted and numbered, and so on until
one number is left.  Equal numbers at equal levels mean equal texts; nothing rests on a hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KEY = ["doc_id", "n_bytes", "hash"]


def _named(distinct: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The distinct rows with their numbers in sorted order.  The table is written, so a number never changes.

    The order is by a hash, then by the whole value: rows whose hashes meet still get numbers of their
    own, and what Spark samples to find the ranges is a number, not a block.
    """
    placed = distinct.withColumn("place", F.xxhash64(*columns)).repartitionByRange("place").sortWithinPartitions("place", *columns)
    return cut(placed.select(*columns, F.monotonically_increasing_id().alias("name")), name)


def block_names(texts: DataFrame, block_bytes: int) -> DataFrame:
    """KEY, level and name for each row of texts (KEY, text): equal level and name mean equal texts."""
    last = F.greatest(F.ceil(F.col("n_bytes") / block_bytes) - 1, F.lit(0)).cast("int")
    at = F.explode(F.sequence(F.lit(0), last)).alias("at")
    block = F.substring(F.col("text").cast("binary"), F.col("at") * block_bytes + 1, F.lit(block_bytes))
    blocks = cut(texts.select(*KEY, "text", at).select(*KEY, "at", block.alias("block")), "blocks")
    names = _named(blocks.select("block").distinct(), ["block"], "block-names")
    found = cut(blocks.join(names, "block").select(*KEY, "at", "name"), "level")
    levels = blocks.agg(F.max("at")).first()[0] or 0
    done, level = [], 0
    while True:
        left = F.ceil(F.greatest(F.col("n_bytes"), F.lit(1)) / (block_bytes << level))
        done.append(found.where(left == 1).select(*KEY, F.lit(level).alias("level"), "name"))
        if not levels >> level:
            break
        even = F.col("at") % 2 == 0
        pairs = found.where(left > 1).groupBy(*KEY, F.shiftright("at", 1).alias("at")).agg(F.max(F.when(even, F.col("name"))).alias("first"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("second"))
        pairs = cut(pairs, "pairs")
        names = _named(pairs.select("first", "second").distinct(), ["first", "second"], "pair-names")
        found, level = cut(pairs.join(names, ["first", "second"]).select(*KEY, "at", "name"), "level"), level + 1
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found.distinct()


def exact_dedup(docs: DataFrame, block_bytes: int = 2048) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays.  Texts whose length or 64-bit hash no other
    text has differ from all others, so only the rest are named.  Null counts as the empty text; null
    doc_ids are kept only in groups that have no other id; rows repeated with their id count each and
    are kept alike; rows of one id with unlike texts are told apart; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("hash"), "text")
    seen = cut(base.select(*KEY, F.sha2("text", 256).alias("text_sha256")), "seen")
    shared = cut(seen.groupBy("n_bytes", "hash").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes", "hash"), "shared")
    named = block_names(base.join(shared, ["n_bytes", "hash"], "left_semi"), block_bytes)
    named = cut(named.select(F.col("doc_id").alias("id"), F.col("n_bytes").alias("bytes"), F.col("hash").alias("h"), "level", "name"), "named")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("n_bytes") == F.col("bytes")) & (F.col("hash") == F.col("h"))
    alone = seen.join(shared, ["n_bytes", "hash"], "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    twins = cut(seen.join(named, same).select("doc_id", "text_sha256", "level", "name"), "twins")
    groups = cut(twins.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    twins = twins.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.union(twins)


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""
