"""Tail probabilities, asked of the math library that ships with Spark.

Each is evaluated on fact rows (one per column or pair), never on data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_BETA = "org.apache.commons.math3.special.Beta"
_GAMMA = "org.apache.commons.math3.special.Gamma"
_ERF = "org.apache.commons.math3.special.Erf"
# Beyond this many degrees of freedom the t and normal tails agree to 1e-9.
_NORMAL_FROM = 1e9


def _call(cls: str, method: str, *args: Column) -> Column:
    return F.call_function("java_method", F.lit(cls), F.lit(method), *args).cast("double")


def student_tail(t: Column, df: Column) -> Column:
    """Two-sided tail probability of |t|; null where it is not defined."""
    t2 = t * t
    beta = _call(_BETA, "regularizedBeta", df / (df + t2), df / 2, F.lit(0.5))
    normal = _call(_ERF, "erfc", F.abs(t) / F.sqrt(F.lit(2.0)))
    return F.when(df > _NORMAL_FROM, normal).when((df > 0) & t.isNotNull(), beta)


def student_cdf(t: Column, df: Column) -> Column:
    half = student_tail(t, df) / 2
    return F.when(t >= 0, 1 - half).otherwise(half)


def student_critical(df: Column, confidence: float = 0.95) -> Column:
    """The t with two-sided tail ``1 - confidence``, by halving a bracket that holds it."""
    def halve(at, _):
        mid = (at.lo + at.hi) / 2
        outside = student_tail(mid, at.df) > 1 - confidence
        return F.struct(
            F.when(outside, mid).otherwise(at.lo).alias("lo"),
            F.when(outside, at.hi).otherwise(mid).alias("hi"),
            at.df.alias("df"),
        )

    start = F.struct(
        F.lit(0.0).alias("lo"), F.lit(float(1 << 24)).alias("hi"), df.cast("double").alias("df")
    )
    found = F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, halve, lambda at: (at.lo + at.hi) / 2)
    return F.when(df > 0, found)


def chi_square_tail(chi2: Column, df: Column) -> Column:
    q = _call(_GAMMA, "regularizedGammaQ", df.cast("double") / 2, chi2 / 2)
    return F.when(chi2 <= 0, F.lit(1.0)).when(df > 0, q)


def ks_tail(statistic: Column, n_a: Column, n_b: Column) -> Column:
    """Asymptotic two-sample tail, summed term by term as an alternating series."""
    root = F.sqrt(n_a * n_b / (n_a + n_b))
    lam = (root + 0.12 + F.lit(0.11) / root) * statistic
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(statistic == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms)))
