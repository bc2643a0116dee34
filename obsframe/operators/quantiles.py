"""Exact order statistics and quantiles by radix selection.

The 64-bit pattern of a double, turned so that it sorts as the value does, is read in four digits of 16 bits. A pass counts the
values per key and digit, combined map-side, and finds the digit each wanted rank falls on; the next pass counts the next digit of the
values that begin alike. Four passes give the value whatever the distribution; no values of a key are gathered or sorted, only at most 65,536
counts per key and prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import cut_lineage, drop_steps

DIGIT = 16


@F.pandas_udf(LongType())
def _ordered_bits(v: pd.Series) -> pd.Series:
    bits = v.to_numpy(dtype=np.float64).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def _ranked_values(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                   ranks: Sequence[Sequence[Column]]) -> DataFrame:
    """Per key and target ``i``: ``n`` and the values at the 1-based ranks ``ranks[i]`` (columns
    ``v0, v1 …``; rank expressions refer to ``n``). NULL and NaN are no values; a NULL key is a key."""
    keys = list(keys)
    width = max(len(r) for r in ranks)
    v = F.col(f"`{value}`").cast("double") + F.lit(0.0)  # one zero
    key = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(0).alias("__all"))
    rows = df.select(key.alias("k"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = cut_lineage(rows.withColumn("u", _ordered_bits("v")))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), rank.cast("long").alias("rank"))
                       for i, rk in enumerate(ranks) for j, rank in enumerate(rk)])
    state = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k", "n", F.explode(wanted).alias("w")).select(
        "k", "n", "w.*", F.lit(0).cast("long").alias("prefix"))
    state = cut_lineage(state)
    for shift in range(64 - DIGIT, -1, -DIGIT):
        before = F.shiftright("u", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")
        near = rows.select("k", "v", before.alias("prefix"), F.shiftright("u", shift).alias("at"))
        if shift + DIGIT < 64:
            near = near.join(state.select("k", "prefix").distinct(), ["k", "prefix"], "left_semi")
        counted = near.groupBy("k", "prefix", "at").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("v"))
        upto = F.sum("c").over(Window.partitionBy("k", "prefix").orderBy("at"))
        counted = counted.withColumn("upto", upto)
        inside = (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c"))
        last = state
        state = cut_lineage(last.drop("v").join(counted, ["k", "prefix"]).where(inside).select(
            "k", "n", "i", "j", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("at").alias("prefix"), "v"))
        drop_steps(last)
    drop_steps(rows)
    picks = [F.max(F.when(F.col("j") == j, F.col("v"))).alias(f"v{j}") for j in range(width)]
    out = state.groupBy("k", "i").agg(F.first("n").alias("n"), *picks)
    return out.select(*[F.col(f"k.`{k}`").alias(k) for k in keys], "i", "n", *[f"v{j}" for j in range(width)])


def _case(by_target: Sequence[Column]) -> Column:
    out = None
    for i, c in enumerate(by_target):
        out = F.when(F.col("i") == i, c) if out is None else out.when(F.col("i") == i, c)
    return out


def order_statistic(df: DataFrame, value: str, near: float, rank: Column) -> DataFrame:
    """One row ``(n, value)``: the value at an ascending 1-based ``rank`` (an expression over
    ``n``) that lies near the quantile ``near``."""
    rank = F.greatest(rank.cast("long"), F.lit(1))
    return _ranked_values(df, [], value, [near], [[rank]]).select("n", F.col("v0").alias("value"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One column per named probability: the linearly interpolated quantile (type 7)."""
    names, ps = list(probs), [float(p) for p in probs.values()]
    ranks = []
    for p in ps:
        low = F.floor((F.col("n") - 1) * F.lit(p)) + 1
        ranks.append([low.cast("long"), F.least(low + 1, F.col("n")).cast("long")])
    rows = _ranked_values(df, keys, value, ps, ranks)
    share = _case([(F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p)) for p in ps])
    q = F.col("v0") + share * (F.col("v1") - F.col("v0"))
    rows = rows.withColumn("__q", q)
    picks = [F.max(F.when(F.col("i") == i, F.col("__q"))).alias(name) for i, name in enumerate(names)]
    return rows.groupBy(*keys).agg(*picks)
