"""Column expressions that score a pixel against its background."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_VARIANCE = 1e-12


def finite_or_null(x: Column) -> Column:
    """NULL for NaN and infinities: what the output tables hold."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def excess(adu: Column, mean: Column) -> Column:
    return adu - mean


def z_score(adu: Column, mean: Column, var: Column) -> Column:
    return (adu - mean) / F.sqrt(F.greatest(var, F.lit(LEAST_VARIANCE)))


def log_bayes_factor(z: Column, kappa: float = 10.0) -> Column:
    """A broad against a unit normal; 0 on pixels that are not above the background."""
    gain = 0.5 * (1.0 - kappa**-2)
    return F.when(z > 0, F.lit(-math.log(kappa)) + F.lit(gain) * z * z).otherwise(F.lit(0.0))


def prior_log_odds(prior: float = 1e-3) -> float:
    return math.log(prior / (1.0 - prior))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def flux_variance(level: Column, var0: Column, local_var: Column, read_var: float, gain: float, floor: float = 0.15) -> Column:
    """Variance of a pixel whose level differs from that at which its variance was learned."""
    photons = F.lit(read_var) + F.lit(gain) * F.greatest(level, F.lit(0.0))
    return F.greatest(photons, F.lit(floor) * var0, F.lit(LEAST_VARIANCE), local_var)


def blend(terms: dict[str, tuple[float, Column]]) -> Column:
    """Weighted mean of the background sources with a positive weight; others are not read at all."""
    used = [(w, c) for w, c in terms.values() if w > 0]
    if not used:
        raise ValueError("no source has a positive weight")
    total = sum(w for w, _ in used)
    out = None
    for w, c in used:
        part = F.lit(w / total) * c
        out = part if out is None else out + part
    return out


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def poisson_tail(k: Column, mean: Column) -> Column:
    """P(X >= k) of a Poisson number; 1 for k = 0, 0 for a mean not above 0, NULL for a NULL.

    Above the mean the terms from k on are summed, so that a chance far below 1e-16 is still told from a
    smaller one; otherwise 1 less the terms below k. The first term is taken from its logarithm, each
    other one from the one before.
    """
    k = k.cast("int")
    log_factorial = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    at_k = F.exp(k * F.log(mean) - mean - log_factorial)
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    add = lambda ratio: lambda s, i: F.struct((s["term"] * ratio(i)).alias("term"), (s["sum"] + s["term"] * ratio(i)).alias("sum"))
    reach = (F.lit(60) + F.ceil(F.lit(10.0) * F.sqrt(mean))).cast("int")  # terms until they fade
    upper = at_k * F.aggregate(F.sequence(F.lit(1), reach), state, add(lambda i: mean / (k + i)), lambda s: s["sum"])
    # Below k: the terms k - 1, k - 2, … 0, the first of them k / mean times that at k.
    lower = at_k * k / mean * F.aggregate(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), state, add(lambda i: F.greatest((k - i) / mean, F.lit(0.0))), lambda s: s["sum"])
    tail = F.when(k > mean, upper).otherwise(F.lit(1.0) - lower)
    return F.when(k.isNull() | mean.isNull(), F.lit(None).cast("double")).when(k <= 0, F.lit(1.0)).when(mean <= 0, F.lit(0.0)).otherwise(F.least(F.greatest(F.lit(0.0), tail), F.lit(1.0)))
