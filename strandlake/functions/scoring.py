"""Risk components of mismatched sites, their weighted score, and annealing temperatures by chemistry. Scores are uncalibrated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import masks
from .dna import ColumnLike, col

COMPONENTS = ("similarity", "three_prime", "exact_run", "last3", "last5", "last8", "last12", "retention")


def risk_components(mask: ColumnLike, length: ColumnLike, delta_tm: Column, scale: float) -> Column:
    """struct of COMPONENTS in [0, 1], 1 for a perfect site: shares of matching bases, and what of the Tm is kept over scale."""
    if scale <= 0:
        raise ValueError("the scale of Tm differences must be positive")
    m, n = col(mask), col(length)
    intact = lambda k: 1.0 - masks.in_last(m, n, k) / F.least(n, F.lit(k))
    kept = 1.0 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), delta_tm) / scale)
    values = (1.0 - F.bit_count(m) / n, 1.0 - masks.positional_burden(m, n), masks.exact_three_prime_run(m, n) / n, intact(3), intact(5), intact(8), intact(12), kept)
    return F.struct(*[v.cast("double").alias(name) for name, v in zip(COMPONENTS, values, strict=True)])


def risk_score(components: Column, weights: dict[str, float]) -> Column:
    """The weighted mean of the components; weights have no defaults and must not all be zero."""
    unknown = set(weights) - set(COMPONENTS)
    total = sum(weights.values())
    if unknown or total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be known, not negative, and not all zero")
    return sum((components[k] * (w / total) for k, w in weights.items()), F.lit(0.0))


def pair_score(one: Column, two: Column, weight_of_min: float) -> Column:
    if not 0 <= weight_of_min <= 1:
        raise ValueError("the weight of the lower score lies between 0 and 1")
    return weight_of_min * F.least(one, two) + (1.0 - weight_of_min) * (one + two) / 2.0


@dataclass(frozen=True)
class Chemistry:
    """plus: degrees on the lower Tm; length_aware: only for primers over 20 bases, under it the Tm itself."""

    plus: float
    own_tm: bool = False
    length_aware: bool = False


# By enzyme.
CHEMISTRIES = {"taq": Chemistry(-5.0), "q5": Chemistry(3.0, own_tm=True), "phusion": Chemistry(3.0, own_tm=True, length_aware=True)}


def annealing_temperature(chemistry: str, lower_tm: ColumnLike, length: ColumnLike, own_tm: bool = False) -> Column:
    """Recommended, from the Tm and length of the primer that melts first.

    own_tm: the Tm was computed for this chemistry, which some ask for. Exactly 20 bases have no rule where the length counts:
    the row is an error.
    """
    rule = CHEMISTRIES[chemistry]
    if rule.own_tm and not own_tm:
        raise ValueError(f"{chemistry} needs a Tm of its own chemistry")
    t, n = col(lower_tm), col(length)
    if not rule.length_aware:
        return t + rule.plus
    return F.when(n > 20, t + rule.plus).when(n < 20, t).otherwise(F.raise_error(F.lit("no rule for a primer of exactly 20 bases")).cast("double"))
