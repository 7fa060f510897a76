"""Statistical Column builders: scoring rules, posteriors, bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddsmith import constants as K
from oddsmith.functions.columns import clamp, col


def brier(p, y) -> Column:
    return F.pow(col(p) - col(y), F.lit(2.0))


def log_loss(p, y) -> Column:
    q = clamp(p, K.LOG_LOSS_EPS, 1.0 - K.LOG_LOSS_EPS)
    return -(col(y) * F.log(q) + (1 - col(y)) * F.log(1.0 - q))


def equal_width_bin(p, n_bins: int = 10) -> Column:
    """0-based bin: the number of interior edges at or below ``p`` (1.0 lands in the last bin).

    Edges are the doubles ``i * (1/n)``, so 0.3 belongs to bin 2 because the third edge is
    a hair above it.
    """
    step = 1.0 / n_bins
    out = F.lit(0)
    for i in range(1, n_bins):
        out = out + (col(p) >= F.lit(i * step)).cast("int")
    return out


def beta_mean(n, s) -> Column:
    return (1.0 + col(s)) / (2.0 + col(n))


def beta_variance(n, s) -> Column:
    a, b, t = 1.0 + col(s), 1.0 + col(n) - col(s), 2.0 + col(n)
    return (a * b) / (t * t * (t + 1.0))


def bernoulli_variance(n, s) -> Column:
    """Expected outcome variance under the Beta(1,1) posterior."""
    a, b, t = 1.0 + col(s), 1.0 + col(n) - col(s), 2.0 + col(n)
    return (a * b) / (t * (t + 1.0))


def sample_variance(n, variance) -> Column:
    """var_samp with the single-row case pinned to zero."""
    return F.when(col(n) == 1, F.lit(0.0)).otherwise(col(variance))


def wilson_lower(successes, total, z: float = K.Z_95_ONE_SIDED) -> Column:
    s, n = col(successes).cast("double"), col(total).cast("double")
    p, z2 = s / n, z * z
    radius = z * F.sqrt((p * (1.0 - p) + z2 / (4.0 * n)) / n)
    bound = F.greatest(F.lit(0.0), (p + z2 / (2.0 * n) - radius) / (1.0 + z2 / n))
    return F.when(n <= 0, F.lit(0.0)).otherwise(bound)


def rate(numerator: Column, denominator: Column) -> Column:
    """Undefined (NULL), not zero, when the denominator is empty."""
    return F.when(denominator > 0, numerator / denominator)


#: Odd numbers of the series below, largest first; enough of them for arguments up to ``CDF_END``, where the function is one.
CDF_TERMS, CDF_END = tuple(float(2 * k + 1) for k in range(160, 0, -1)), 8.5


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF of ``x >= 0``: a half plus the density times ``x + x^3/3 + x^5/(3*5) + ...``, from the smallest term on."""
    z = F.least(x, F.lit(CDF_END))
    series = F.aggregate(F.array(*[F.lit(m) for m in CDF_TERMS]), F.lit(1.0), lambda h, m: 1.0 + z * z / m * h)
    return 0.5 + F.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi) * z * series
