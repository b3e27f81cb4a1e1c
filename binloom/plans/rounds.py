"""Rounds of merging: each starts from the boundaries that the last one left, on the original profile."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.functions.shared import written
from binloom.operators.kernels import greedy_merge
from binloom.operators.segments import PLACE
from binloom.plans.rules import RuleSet


def rounds_digest(rounds: list[RuleSet]) -> str:
    """A name for a list of rounds; equal settings in equal order have equal digests."""
    return hashlib.sha256("".join(r.digest() for r in rounds).encode()).hexdigest()


def fold(profile: DataFrame, boundaries: DataFrame, rounds: list[RuleSet]) -> DataFrame:
    """The merges of all rounds, with their round's number."""
    profile, done = written(profile), []
    for number, rules in enumerate(rounds, 1):
        steps = written(greedy_merge(profile, boundaries, rules).withColumn("round", F.lit(number)))
        done.append(steps)
        boundaries = written(boundaries.join(steps.select(*PLACE, F.col("removed").alias("bin")), [*PLACE, "bin"], "left_anti"))
    return reduce(DataFrame.union, done)
