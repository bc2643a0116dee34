"""Per-group models and tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import share
from .ordered import weighted_sample
from .relational import left_join, with_group_stats


# -- linear model on a factor ----------------------------------------------------------------

def factor_model(df: DataFrame, keys: Sequence[str], factor: str, y: str) -> DataFrame:
    """Least squares of ``y`` on a factor, per key: ``(keys…, term, estimate, std_error)``.

    Closed form: the intercept is the mean at the first level, every other coefficient the
    difference of means. The standard error is NULL without residual degrees of freedom.
    """
    yv = F.col(y).cast("double")
    level = df.where(yv.isNotNull()).groupBy(*keys, factor).agg(
        F.count(F.lit(1)).alias("n"), F.avg(yv).alias("m"), (F.var_pop(yv) * F.count(F.lit(1))).alias("ss"))
    fit = level.groupBy(*keys).agg(
        F.min_by("m", factor).alias("m0"), F.min_by("n", factor).alias("n0"), F.min(factor).alias("f0"),
        F.sum("ss").alias("rss"), (F.sum("n") - F.count(F.lit(1))).alias("df"))
    rows = left_join(level, fit, keys)
    first = F.col(factor) == F.col("f0")
    s2 = F.when(F.col("df") > 0, F.try_divide("rss", "df"))
    se = F.when(first, F.sqrt(s2 / F.col("n0"))).otherwise(F.sqrt(s2 * (1 / F.col("n") + 1 / F.col("n0"))))
    return rows.select(*keys, F.when(first, F.lit("(Intercept)")).otherwise(
        F.concat(F.lit(factor), F.col(factor).cast("string"))).alias("term"),
        F.when(first, F.col("m0")).otherwise(F.col("m") - F.col("m0")).alias("estimate"), se.alias("std_error"))


# -- normality -------------------------------------------------------------------------------

# fixed values: polynomial coefficients of Royston (1995), Algorithm AS R94, lowest order first
C1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
C3 = (0.5440, -0.39978, 0.025054, -0.0006714)
C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
C6 = (-0.4803, -0.082676, 0.0030302)
G = (-2.273, 0.459)


def _poly(coef: Sequence[float], x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coef))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p-value; (nan, nan) outside 3..5000 values or for constant input."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 3 or n > 5000 or x[-1] - x[0] <= 0:
        return math.nan, math.nan
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        mm, u = float(m @ m), 1 / math.sqrt(n)
        a = m.copy()
        last = _poly(C1, u) + m[-1] / math.sqrt(mm)
        if n > 5:
            second = _poly(C2, u) + m[-2] / math.sqrt(mm)
            scale = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last ** 2 - 2 * second ** 2)
            a /= math.sqrt(scale)
            a[-2], a[1] = second, -second
        else:
            a /= math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last ** 2))
        a[-1], a[0] = last, -last
    w = min(float((a @ x) ** 2 / np.sum((x - x.mean()) ** 2)), 1.0)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    if w >= 1.0:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        gamma = _poly(G, n)
        if y >= gamma:
            return w, 0.0
        y, mu, sigma = -math.log(gamma - y), _poly(C3, n), math.exp(_poly(C4, n))
    else:
        mu, sigma = _poly(C5, math.log(n)), math.exp(_poly(C6, math.log(n)))
    return w, 1 - normal.cdf((y - mu) / sigma)


def normality_test(df: DataFrame, key: str, value: str, id_cols: Sequence[str], n: int = 5000, seed: int = 1234) -> DataFrame:
    """``(key, w, p_value)`` of the Shapiro-Wilk test on at most ``n`` rows per key, drawn with
    probability by value. Groups that cannot be tested give NULL.

    The draw happens in Spark, so a Python task sees at most ``n`` numbers of a group.
    """
    drawn = weighted_sample(df, n, value, id_cols, [key], seed).select(key, F.col(value).cast("double").alias("v"))
    kind = dict(df.dtypes)[key]

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            w, p = shapiro_wilk(pdf["v"].to_numpy())
        except Exception:  # a group that fails is NULL, not a failed job
            w = p = math.nan
        clean = [None if math.isnan(v) else v for v in (w, p)]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "w": [clean[0]], "p_value": [clean[1]]})

    tested = drawn.groupBy(key).applyInPandas(test, f"`{key}` {kind}, w double, p_value double")
    every = df.select(key).distinct()
    out = left_join(every, tested, [key])
    return out.select(key, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("w", "p_value")])


def sd_coverage(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of rows within one and two sd of the mean, against .68 and .95, for all groups."""
    rows = with_group_stats(df.select(key, F.col(value).cast("double").alias("v")), [key],
                            F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))

    def within(k):
        return F.bround(share(F.col("v").between(F.col("mean") - k * F.col("sd"), F.col("mean") + k * F.col("sd"))), 4)

    out = rows.groupBy(key).agg(F.first("mean").alias("mean"), F.first("sd").alias("sd"),
                                within(1).alias("within_1sd"), within(2).alias("within_2sd"))
    return out.withColumn("rule_68", F.col("within_1sd") >= 0.68).withColumn("rule_95", F.col("within_2sd") >= 0.95)


# -- local regression ------------------------------------------------------------------------

def loess(df: DataFrame, x: str, y: str, span: float = 0.1, keys: Sequence[str] = (), points: int = 80) -> DataFrame:
    """``(keys…, x, fit)``: local quadratic regression with tricube weights at ``points`` places
    from min to max.

    Rows are first reduced to one per distinct x (count and sum of y), so the work grows with
    distinct x times ``points``, not with rows or with pairs of rows. The bandwidth at a place
    is the distance of its q-th nearest row, q = floor(n · span); a running count over distances
    gives it. The fit is the intercept of the 3 × 3 weighted normal equations.
    """
    keys = list(keys)
    rows = (df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
            .where(F.col("x").isNotNull() & F.col("y").isNotNull())
            .groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("sy")))
    stats = [F.sum("c").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    rows = with_group_stats(rows, keys, *stats)
    places = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    places = places.withColumn("x0", F.col("lo") + F.col("g") * (F.col("hi") - F.col("lo")) / (points - 1))
    places = places.withColumn("d", F.abs(F.col("x") - F.col("x0")))
    q = F.greatest(F.floor(F.col("n") * F.lit(span) + 1e-5), F.lit(1))
    group = [*keys, "g"]
    upto = F.sum("c").over(Window.partitionBy(*group).orderBy("d", "x").rowsBetween(Window.unboundedPreceding, 0))
    counted = places.withColumn("upto", upto)
    # rows past the q-th nearest carry no weight; keep those before it and the q-th itself
    near = counted.where(F.col("upto") - F.col("c") < q)
    h = F.max("d").over(Window.partitionBy(*group))
    u = F.try_divide("d", "h")
    w = F.when(u < 1, F.pow(1 - F.pow(u, F.lit(3)), F.lit(3))).otherwise(0.0)
    w = F.when(F.col("h") == 0, F.lit(1.0)).otherwise(w)
    t = F.coalesce(F.try_divide(F.col("x") - F.col("x0"), F.col("h")), F.lit(0.0))
    near = near.withColumn("h", h).withColumn("w", w).withColumn("t", t)
    moments = [F.sum(F.col("w") * F.col("c") * F.pow("t", F.lit(k))).alias(f"s{k}") for k in range(5)]
    loads = [F.sum(F.col("w") * F.col("sy") * F.pow("t", F.lit(k))).alias(f"b{k}") for k in range(3)]
    m = near.groupBy(*group).agg(F.first("x0").alias("x"), *moments, *loads)
    s0, s1, s2, s3, s4 = (F.col(f"s{k}") for k in range(5))
    b0, b1, b2 = (F.col(f"b{k}") for k in range(3))
    det3 = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    num3 = b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - b2 * s3) + s2 * (b1 * s3 - b2 * s2)
    det2, num2 = s0 * s2 - s1 * s1, b0 * s2 - b1 * s1
    fit = (F.when(F.abs(det3) > 1e-12, num3 / det3).when(F.abs(det2) > 1e-12, num2 / det2)
           .otherwise(F.try_divide(b0, s0)))
    return m.select(*keys, "x", fit.alias("fit"))
