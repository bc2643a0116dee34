"""Counts, profiles, histograms, box summaries and kernel densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .relational import left_join, with_group_stats


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Row counts per key, largest first, ties by key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), *keys)


def two_level_mean(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str, name: str,
                   digits: int | None = None) -> DataFrame:
    """Sum per (outer, inner), then the mean of those sums per outer."""
    sums = df.groupBy(*outer, *inner).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("__s"))
    mean = F.avg("__s")
    return sums.groupBy(*outer).agg((mean if digits is None else F.bround(mean, digits)).alias(name))


def share(pred: Column) -> Column:
    """Proportion of rows for which a predicate holds."""
    return F.avg(pred.cast("int"))


def rank_by_frequency(df: DataFrame, name: str, rank: str = "rank") -> DataFrame:
    """Adds the rank of each value by how often it occurs (1 = most often, ties by value)."""
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("__n"))
    from .ordered import row_number

    ranked = row_number(counts, [F.col("__n").desc(), F.col(name)], rank).select(name, rank)
    return left_join(df, ranked, [name])


def rank_by_summary(df: DataFrame, name: str, agg: Column, rank: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """Adds the ascending rank of each value by a summary of another column."""
    from .ordered import row_number

    summary = df.groupBy(*keys, name).agg(agg.alias("__a"))
    ranked = row_number(summary, ["__a", name], rank, keys).select(*keys, name, rank)
    return left_join(df, ranked, [*keys, name])


def histogram(df: DataFrame, value: str, bins: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys…, bin, lower, upper, n)``: equal bins from the group's minimum to its maximum, the
    last one closed. Empty bins have no row. A constant group falls into bin 1."""
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    rows = with_group_stats(rows, keys, F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    # LEAST skips NULL, so the constant group is settled before it
    at = F.coalesce(F.floor(F.try_divide(F.col("__v") - F.col("__lo"), width)), F.lit(0))
    bin_ = F.least(at, F.lit(bins - 1))
    out = rows.groupBy(*keys, (bin_ + 1).cast("int").alias("bin"), "__lo", width.alias("__w")).agg(
        F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "bin", (F.col("__lo") + (F.col("bin") - 1) * F.col("__w")).alias("lower"),
                      (F.col("__lo") + F.col("bin") * F.col("__w")).alias("upper"), "n")


def box_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last points within 1.5 IQR, and the number of outliers."""
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    rows = left_join(df.select(*keys, F.col(value).cast("double").alias("__v")), q, keys)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("__v").between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.where(F.col("__v").isNotNull()).groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("__v"))).alias("low"), F.max(F.when(inside, F.col("__v"))).alias("high"),
        F.count(F.when(~inside, 1)).alias("outliers"))


def box_outliers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The rows outside the whiskers."""
    q = exact_quantiles(df, keys, value, {"__q1": 0.25, "__q3": 0.75})
    reach = 1.5 * (F.col("__q3") - F.col("__q1"))
    return left_join(df, q, keys).where(
        ~F.col(value).between(F.col("__q1") - reach, F.col("__q3") + reach)).drop("__q1", "__q3")


# -- kernel densities ------------------------------------------------------------------------

def _spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, sd, IQR, min and max per group."""
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"),
                                 F.min(value).alias("lo"), F.max(value).alias("hi"))
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    if keys:
        return left_join(base, q, keys).withColumn("iqr", F.col("q3") - F.col("q1")).drop("q1", "q3")
    iqr = q.select(F.col("q3") - F.col("q1")).scalar()
    return base.withColumn("iqr", iqr)


def _narrow(sd: Column, iqr: Column) -> Column:
    """min(sd, IQR/1.34), whichever of the two is positive, else 1."""
    scaled = iqr / 1.34
    low = F.least(sd, F.when(scaled > 0, scaled))
    return F.when(low > 0, low).when(sd > 0, sd).otherwise(F.lit(1.0))


def density_1d(df: DataFrame, value: str, keys: Sequence[str] = (), points: int = 512, nodes: int = 512) -> DataFrame:
    """``(keys…, x, density)``: Gaussian kernel density at ``points`` places from min to max.

    Bandwidth 0.9 · min(sd, IQR/1.34) · n^(-1/5). Each row's mass is first split linearly between
    the two nearest of ``nodes`` nodes, so what meets the kernel is ``nodes`` rows per group,
    whatever its size.
    """
    keys = list(keys)
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*keys, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    s = _spread(rows, keys, "v").select(
        *keys, "n", "lo", "hi", (0.9 * _narrow(F.col("sd"), F.col("iqr")) * F.pow(F.col("n"), F.lit(-0.2))).alias("bw"))
    if keys:
        rows = left_join(rows, s, keys)
    else:
        rows = rows.withColumn("__s", s.select(F.struct("*")).scalar()).select("v", "__s.*")
    step = (F.col("hi") - F.col("lo")) / (nodes - 1)
    at = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), step), F.lit(0.0))
    left = F.least(F.floor(at), F.lit(nodes - 2))
    parts = F.explode(F.array(
        F.struct(left.alias("node"), (1 - (at - left)).alias("w")),
        F.struct((left + 1).alias("node"), (at - left).alias("w"))))
    mass = (rows.select(*keys, "n", "lo", "hi", "bw", parts.alias("p")).groupBy(*keys, "n", "lo", "hi", "bw", "p.node")
            .agg(F.sum("p.w").alias("w")))
    mass = mass.withColumn("c", F.col("lo") + F.col("node") * (F.col("hi") - F.col("lo")) / (nodes - 1))
    grid = mass.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + F.col("g") * (F.col("hi") - F.col("lo")) / (points - 1)
    kernel = F.exp(-0.5 * F.pow((x - F.col("c")) / F.col("bw"), F.lit(2))) / (F.col("bw") * math.sqrt(2 * math.pi))
    return grid.groupBy(*keys, "g", x.alias("x")).agg(
        (F.sum(F.col("w") * kernel) / F.first("n")).alias("density")).drop("g")


def density_2d(df: DataFrame, x: str, y: str, points: int = 25, nodes: int = 128) -> DataFrame:
    """``(x, y, density)`` on a ``points`` × ``points`` grid over the data range.

    Normal kernel per axis with h = 1.06 · min(sd, IQR/1.34) · n^(-1/5). Points are first spread
    bilinearly over ``nodes`` × ``nodes`` nodes; the kernel is separable, so the sum runs over one
    axis and then the other and never forms point × grid rows.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())

    def axis(name):
        """n, range and bandwidth of one axis: four numbers, looked up first and used as constants."""
        s = _spread(rows, [], name)
        h = 1.06 * _narrow(F.col("sd"), F.col("iqr")) * F.pow(F.col("n"), F.lit(-0.2))
        found = s.select("n", "lo", "hi", h.alias("h")).first()
        return {c: F.lit(found[c]) for c in ("n", "lo", "hi", "h")}

    ax, ay = axis("x"), axis("y")

    def split(v, a):
        at = F.coalesce(F.try_divide(v - a["lo"], (a["hi"] - a["lo"]) / (nodes - 1)), F.lit(0.0))
        left = F.least(F.floor(at), F.lit(nodes - 2))
        return F.array(F.struct(left.alias("i"), (1 - (at - left)).alias("w")),
                       F.struct((left + 1).alias("i"), (at - left).alias("w")))

    mass = (rows.select(split(F.col("x"), ax).alias("px"), split(F.col("y"), ay).alias("py"))
            .select(F.explode("px").alias("px"), "py")
            .select("px", F.explode("py").alias("py"))
            .groupBy(F.col("px.i").alias("i"), F.col("py.i").alias("j"))
            .agg(F.sum(F.col("px.w") * F.col("py.w")).alias("w")))

    def kernel(a, node, g):
        centre = a["lo"] + node * (a["hi"] - a["lo"]) / (nodes - 1)
        place = a["lo"] + g * (a["hi"] - a["lo"]) / (points - 1)
        return F.exp(-0.5 * F.pow((place - centre) / a["h"], F.lit(2))) / (a["h"] * math.sqrt(2 * math.pi))

    steps = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    by_x = (mass.withColumn("gx", steps).groupBy("gx", "j")
            .agg(F.sum(F.col("w") * kernel(ax, F.col("i"), F.col("gx"))).alias("s")))
    by_xy = (by_x.withColumn("gy", steps).groupBy("gx", "gy")
             .agg(F.sum(F.col("s") * kernel(ay, F.col("j"), F.col("gy"))).alias("s")))

    def place(a, g):
        return a["lo"] + g * (a["hi"] - a["lo"]) / (points - 1)

    return by_xy.select(place(ax, F.col("gx")).alias("x"), place(ay, F.col("gy")).alias("y"),
                        (F.col("s") / ax["n"]).alias("density"))


def screen_grid(df: DataFrame, lon: str, lat: str, weight: str, cell: float) -> DataFrame:
    """Weight summed per square of ``cell`` degrees."""
    return df.groupBy(F.floor(F.col(lon) / cell).alias("gx"), F.floor(F.col(lat) / cell).alias("gy")).agg(
        F.sum(weight).alias("weight"))
