"""Merge rules: small declarations, checked on the driver and compiled to Columns over flank scores."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.operators.segments import ambiguity, sign_mismatch, smaller_side

CRITERIA = ("srd_phi", "delta_mean", "delta_median", "delta_iqr_mean")
METRICS = ("srd", *CRITERIA)


@dataclass(frozen=True)
class FlankRule:
    """A segment is merged if its smaller score by all (any) criteria lies below that criterion's threshold."""

    criteria: tuple[str, ...] = ("delta_mean", "srd_phi")
    combine: str = "all"
    tau: float = 0.2
    srd_ref: float = 3.3
    max_bins: int = 100
    merge_sign_mismatch: bool = False
    merge_signs_only: bool = False
    id: str = "rule0"

    def __post_init__(self):
        if not self.criteria or set(self.criteria) - set(CRITERIA) or len(set(self.criteria)) < len(self.criteria):
            raise ValueError(f"criteria must be distinct ones of {CRITERIA}")
        if self.combine not in ("all", "any") or min(self.tau, self.srd_ref) <= 0 or self.max_bins < 1:
            raise ValueError("combine is all or any; thresholds and max_bins are positive")

    def threshold(self, criterion: str) -> float:
        return self.srd_ref if criterion == "srd_phi" else self.tau


    def claim(self, row: dict) -> dict | None:
        if row["e"] - row["s"] > self.max_bins:
            return None
        checks = [(v / self.threshold(c), right) for c in self.criteria for v, right in [_smaller(row, c)] if v is not None]
        passing = [c for c in checks if c[0] < 1]
        passed = len(passing) == len(self.criteria) if self.combine == "all" else bool(passing)
        mismatch = _opposite(row, "srd_phi")
        if passed and mismatch and not self.merge_sign_mismatch or not passed and not (mismatch and self.merge_signs_only):
            return None
        fraction, right = min(passing if passed else checks, default=(None, None))
        if right is None:
            return {"phase": 2, "side": None, "score": None, "blocked": "nonfinite"}
        score = max(passing)[0] if passed and self.combine == "all" else fraction
        side = "right" if right else "left"
        return {"phase": 1 if passed else 2, "side": side, "score": score, "blocked": "gap" if row[f"gap_{side}"] else None}


def _value(row: dict, name: str) -> float | None:
    v = row[name]
    return None if v is None or v != v else abs(v)


def _smaller(row: dict, metric: str) -> tuple[float | None, int | None]:
    """The smaller absolute score and whether it is the right one; a missing side loses, a tie goes left."""
    return min(((v, k) for k, side in enumerate(("left", "right")) if (v := _value(row, f"{metric}_{side}")) is not None), default=(None, None))


def _opposite(row: dict, metric: str) -> bool:
    return row[f"{metric}_left"] * row[f"{metric}_right"] < 0


@dataclass(frozen=True)
class Condition:
    """kind: weak_flank, sign_mismatch, ambiguous (metric against other) or max_size."""

    kind: str
    metric: str = "delta_mean"
    threshold: float = 0.0
    other: str = "srd_phi"
    max_bins: int = 0

    def __post_init__(self):
        if self.kind not in ("weak_flank", "sign_mismatch", "ambiguous", "max_size") or {self.metric, self.other} - set(METRICS):
            raise ValueError(f"unusable condition {self}")

    def holds(self) -> Column:
        left, right = F.col(f"{self.metric}_left"), F.col(f"{self.metric}_right")
        if self.kind == "max_size":
            return F.col("e") - F.col("s") <= self.max_bins
        if self.kind == "sign_mismatch":
            return sign_mismatch(left, right)
        if self.kind == "ambiguous":
            return ambiguity((F.col(f"{self.other}_left"), F.col(f"{self.other}_right")), (left, right)) == "ambiguous"
        both = left.isNotNull() & right.isNotNull()
        return F.coalesce(both & (F.least(F.abs(left), F.abs(right)) < self.threshold), F.lit(False))


    def true_of(self, row: dict) -> bool:
        if self.kind == "max_size":
            return row["e"] - row["s"] <= self.max_bins
        if self.kind == "sign_mismatch":
            return _opposite(row, self.metric)
        sides = {m: (_value(row, f"{m}_left"), _value(row, f"{m}_right")) for m in (self.metric, self.other)}
        if self.kind == "weak_flank":
            return None not in sides[self.metric] and min(sides[self.metric]) < self.threshold
        if None in (*sides[self.metric], *sides[self.other]) or any(a == b for a, b in sides.values()):
            return False
        return len({a < b for a, b in sides.values()}) == 2


@dataclass(frozen=True)
class ConditionRule:
    """All conditions hold; the segment goes to the side of the smaller score of merge_into."""

    id: str
    conditions: tuple[Condition, ...]
    merge_into: str = "delta_mean"
    enabled: bool = True

    def claim(self, row: dict) -> dict | None:
        if not all(c.true_of(row) for c in self.conditions):
            return None
        if None in (_value(row, f"{self.merge_into}_left"), _value(row, f"{self.merge_into}_right")):
            return {"phase": 1, "side": None, "score": None, "blocked": "nonfinite"}
        score, right = _smaller(row, self.merge_into)
        side = "right" if right else "left"
        return {"phase": 1, "side": side, "score": score, "blocked": "gap" if row[f"gap_{side}"] else None}


@dataclass(frozen=True)
class RuleSet:
    """The first rule, the user's rules in order, and whether segments may merge across gaps; otherwise a gap blocks a merge."""

    rule0: FlankRule | None = field(default_factory=FlankRule)
    user: tuple[ConditionRule | FlankRule, ...] = ()
    cross_gaps: bool = False

    def __post_init__(self):
        ids = [r.id for r in self.enabled]
        if len(set(ids)) < len(ids):
            raise ValueError("rule ids must differ")

    @property
    def enabled(self) -> list:
        return [*([self.rule0] if self.rule0 else []), *(r for r in self.user if getattr(r, "enabled", True) is True)]

    def claim(self, row: dict) -> dict | None:
        """What `evaluate` says of one row, for steps that follow one another; None without a claim."""
        late = None
        for k, rule in enumerate(self.enabled):
            found = rule.claim(row)
            if not found:
                continue
            found |= {"claimed_by": rule.id, "rule_order": k, "s": row["s"], "e": row["e"]}
            if self.cross_gaps and found["blocked"] == "gap":
                found["blocked"] = None
            if found["phase"] == 1:
                return found
            if rule is self.rule0:
                late = found
        return late

    def digest(self) -> str:
        """A name for caches and rounds: equal settings have equal digests."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _criterion(rule: FlankRule, c: str) -> Column:
    left, right = F.col(f"{c}_left"), F.col(f"{c}_right")
    side = smaller_side(left, right)
    fraction = F.least(F.abs(left), F.abs(right)) / rule.threshold(c)  # least() passes over NULLs
    return F.struct(fraction.alias("fraction"), F.when(side == "left", 0).when(side == "right", 1).alias("right"))


def flank_rule(scores: DataFrame, rule: FlankRule) -> DataFrame:
    """scores with the rule's outcome, side, score, blocked, flank_conflict and n_passed.

    The direction is the side of the smallest fraction (score over threshold), left on ties.  Each
    intermediate is a column of its own, so that no expression is repeated in the plan.
    """
    every = F.array(*[_criterion(rule, c) for c in rule.criteria])
    df = scores.withColumn("_every", every)
    df = df.withColumn("_passing", F.filter("_every", lambda c: F.coalesce(c.fraction < 1, F.lit(False))))
    considered = F.col("e") - F.col("s") <= rule.max_bins
    enough = F.size("_passing") == len(rule.criteria) if rule.combine == "all" else F.size("_passing") > 0
    df = df.withColumns({"_passed": considered & enough, "_mismatch": sign_mismatch(F.col("srd_phi_left"), F.col("srd_phi_right"))})
    failing = F.when(F.col("_mismatch"), "signs_merge" if rule.merge_signs_only else "signs_only").otherwise("none")
    holding = F.when(F.col("_mismatch") & F.lit(not rule.merge_sign_mismatch), "held_back").otherwise("would_merge")
    df = df.withColumn("outcome", F.when(~considered, "none").when(F.col("_passed"), holding).otherwise(failing))
    best = F.when(F.col("_passed"), F.array_min("_passing")).when(F.col("outcome") == "signs_merge", F.array_min(F.filter("_every", lambda c: c.fraction.isNotNull())))
    worst = F.array_max("_passing").getField("fraction")
    df = df.withColumn("_best", best).withColumn("side", F.when(F.col("_best.right") == 0, "left").when(F.col("_best.right") == 1, "right"))
    acting = F.col("outcome").isin("would_merge", "signs_merge")
    gap = F.when(F.col("side") == "left", F.col("gap_left")).otherwise(F.col("gap_right"))
    df = df.withColumns({
        "score": F.when(F.col("_passed") & F.lit(rule.combine == "all"), worst).otherwise(F.col("_best.fraction")),
        "blocked": F.when(acting & F.col("side").isNull(), "nonfinite").when(acting & gap, "gap"),
        "flank_conflict": F.col("_passed") & (F.size(F.array_distinct(F.transform("_passing", lambda c: c.right))) > 1),
        "n_passed": F.when(considered, F.size("_passing")).otherwise(0),
    })
    return df.drop("_every", "_passing", "_passed", "_mismatch", "_best")


CLAIM = ["claimed_by", "rule_order", "phase", "side", "score", "blocked"]


def evaluate(scores: DataFrame, rules: RuleSet) -> DataFrame:
    """Which rule claims each segment, in which phase and direction, and what blocks it.

    The first rule claims what it would merge, then the user's rules in order; what only the first
    rule's signs would merge comes in phase 2.
    """
    df, columns, claims, late = scores, scores.columns, [], []
    for k, rule in enumerate(rules.enabled):
        if isinstance(rule, FlankRule):
            df = flank_rule(df, rule)
            claim = F.struct(F.lit(rule.id).alias("claimed_by"), F.lit(k).alias("rule_order"), F.when(F.col("outcome") == "signs_merge", 2).otherwise(1).alias("phase"), "side", "score", "blocked")
            df = df.withColumns({f"_claim{k}": F.when(F.col("outcome") == "would_merge", claim), f"_late{k}": F.when(F.col("outcome") == "signs_merge", claim)})
            df = df.drop("outcome", "side", "score", "blocked", "flank_conflict", "n_passed")
            if rule is rules.rule0:
                late.append(f"_late{k}")
        else:
            left, right = F.col(f"{rule.merge_into}_left"), F.col(f"{rule.merge_into}_right")
            both = left.isNotNull() & right.isNotNull()
            df = df.withColumn("side", F.when(both, smaller_side(left, right)))
            gap = F.when(F.col("side") == "left", F.col("gap_left")).otherwise(F.col("gap_right"))
            holds = F.lit(True)
            for c in rule.conditions:
                holds = holds & c.holds()
            blocked = F.when(~both, "nonfinite").when(gap, "gap")
            claim = F.struct(F.lit(rule.id).alias("claimed_by"), F.lit(k).alias("rule_order"), F.lit(1).alias("phase"), "side", F.when(both, F.least(F.abs(left), F.abs(right))).alias("score"), blocked.alias("blocked"))
            df = df.withColumn(f"_claim{k}", F.when(holds, claim)).drop("side")
        claims.append(f"_claim{k}")
    df = df.withColumn("_claim", F.coalesce(*claims, *late))
    said = {c: F.col(f"_claim.{c}") for c in CLAIM}
    if rules.cross_gaps:
        said["blocked"] = F.nullif(said["blocked"], F.lit("gap"))
    return df.select(*columns, *[c.alias(name) for name, c in said.items()])
