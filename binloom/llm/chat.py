"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A logged conversation is often the first turns of a longer one.  A rolling hash over each
conversation's turns gives every prefix an identity; a conversation whose whole identity is another's
proper prefix is dropped by an anti-join, equal ones leave the smallest conv_id, and the turns of the
maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Turn numbers handled in one window; a conversation of any length is spread over as many windows as it needs.
STRETCH = 64
HASHES = ["n", "h1", "h2"]


def _value(c: str) -> list[Column]:
    return [F.col(c).isNull(), F.coalesce(F.col(c), F.lit(""))]


def rendered(role: Column, text: Column) -> Column:
    """A turn between start and end marks, its role on a line of its own."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """turns with `stretch` and, per turn, the rolling n, h1, h2 and n_chars of the conversation up to and including it.

    The sums run within stretches of turn numbers; what earlier stretches add is summed over one row a stretch.
    """
    hashed = [F.xxhash64(F.lit(seed), "turn", *_value("role"), *_value("text")).cast("decimal(20,0)") for seed in (1, 2)]
    size = F.char_length(rendered(F.col("role"), F.col("text"))).cast("long")
    rows = turns.withColumns({"stretch": F.floor(F.col("turn") / STRETCH), "g1": hashed[0], "g2": hashed[1], "size": size})
    within = W.partitionBy("conv_id", "stretch").orderBy("turn").rangeBetween(W.unboundedPreceding, 0)
    total = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("n0"), F.sum("g1").alias("s1"), F.sum("g2").alias("s2"), F.sum("size").alias("c0"))
    earlier = W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("decimal(38,0)")
    total = total.select("conv_id", "stretch", F.coalesce(F.sum("n0").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("s1").over(earlier).cast("decimal(38,0)"), none).alias("s1"), F.coalesce(F.sum("s2").over(earlier).cast("decimal(38,0)"), none).alias("s2"), F.coalesce(F.sum("c0").over(earlier), F.lit(0)).alias("c0"))
    rolling = {"n": F.count("*").over(within), "h1": F.sum("g1").over(within), "h2": F.sum("g2").over(within), "n_chars": F.sum("size").over(within)}
    rows = rows.withColumns(rolling).join(total, ["conv_id", "stretch"])
    return rows.select("conv_id", "turn", "role", "text", "size", (F.col("n") + F.col("n0")).alias("n"), (F.col("h1") + F.col("s1")).cast("decimal(38,0)").alias("h1"), (F.col("h2") + F.col("s2")).cast("decimal(38,0)").alias("h2"), (F.col("n_chars") + F.col("c0")).alias("n_chars"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn of each maximal conversation: conv_id, turn, role, n_turns, rendered.

    The rendered turns of a conversation, in the order of turn, role and text, are its chat text; a
    conversation of any length is thus never gathered into one row.  Turns are compared by turn number,
    role and text.  A turn logged twice counts once; null roles render as user and null texts as empty,
    though as turns they differ from those; a null turn number is turn -1; rows without conv_id belong to
    no conversation and are left out; other columns are not read.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "role", "text").distinct()
    rows = cut(turn_prefixes(turns), "turn-prefixes")
    ends = rows.groupBy("conv_id").agg(F.max("n").alias("n_turns"))
    # one row for each prefix; the turns of a tie end together
    prefixes = rows.select("conv_id", *HASHES).distinct().join(cut(ends, "ends"), "conv_id")
    prefixes = cut(prefixes, "prefixes")
    inner = cut(prefixes.where("n < n_turns").select(*HASHES).distinct(), "inner-prefixes")
    whole = prefixes.where("n = n_turns").groupBy(*HASHES).agg(F.min("conv_id").alias("conv_id"))
    maximal = cut(whole.join(inner, HASHES, "left_anti").select("conv_id", F.col("n").alias("n_turns")), "maximal")
    return rows.join(maximal, "conv_id").select("conv_id", "turn", "role", "n_turns", rendered(F.col("role"), F.col("text")).alias("rendered"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, turn, count(*) OVER w AS n, list({'turn': turn, 'role': role, 'text': text}) OVER w AS said
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
e AS (SELECT conv_id, turn, max(n) AS n FROM p GROUP BY conv_id, turn),
x AS (SELECT p.conv_id, p.n, p.said::VARCHAR AS said, p.n = max(p.n) OVER (PARTITION BY p.conv_id) AS whole FROM p JOIN e USING (conv_id, turn, n)),
k AS (SELECT min(conv_id) AS conv_id, n AS n_turns FROM x AS a WHERE whole AND NOT EXISTS (SELECT 1 FROM x AS b WHERE NOT b.whole AND b.n = a.n AND b.said = a.said) GROUP BY said, n)
SELECT conv_id, turn, role, n_turns, '<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered FROM t JOIN k USING (conv_id)
"""
