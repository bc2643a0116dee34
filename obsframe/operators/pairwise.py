"""Pairs of items that share features: weighted counts and phi correlation.

Rows are first reduced to one per (item, feature) and written once. Pairs are formed by an
equi-join on the feature and summed inside the join stage, so what is shuffled afterwards is at
most one row per item pair and task. A feature that holds very many items would still make one task form all its
pairs; such features are cut into blocks of items, and each pair of blocks is its own join key.
Every pair is formed exactly once and none is dropped. A missing stratum is a stratum like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import row_number_by
from .relational import anti_join, inner_join, left_join

BLOCK = 2000


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key by an explicit order; cut map-side before the shuffle."""
    return row_number_by(df, keys, order, "__rn").where(F.col("__rn") == 1).drop("__rn")


def _self_join(rows: DataFrame, keys: Sequence[str], item: str, payload: Sequence[str]) -> DataFrame:
    left = rows.select(*keys, F.col(item).alias("item1"), *[F.col(p).alias(f"{p}1") for p in payload])
    right = rows.select(*keys, F.col(item).alias("item2"), *[F.col(p).alias(f"{p}2") for p in payload])
    return inner_join(left, right, list(keys)).where(F.col("item1") < F.col("item2"))


def _blocked_self_join(rows: DataFrame, keys: Sequence[str], item: str, payload: Sequence[str],
                       size: str, block: int) -> DataFrame:
    """Self-join of big groups over pairs of item blocks. ``size`` holds the group's row count."""
    n_blocks = F.ceil(F.col(size) / F.lit(float(block))).cast("int")
    rows = rows.withColumn("__nb", n_blocks).withColumn("__b", F.pmod(F.xxhash64(item), F.col("__nb")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("__nb") - 1))
    left = rows.withColumn("__o", others).select(
        *keys, F.col("__b").alias("__l"), F.col("__o").alias("__r"), F.col(item).alias("item1"),
        *[F.col(p).alias(f"{p}1") for p in payload])
    right = rows.withColumn("__o", others).select(
        *keys, F.col("__o").alias("__l"), F.col("__b").alias("__r"), F.col(item).alias("item2"),
        *[F.col(p).alias(f"{p}2") for p in payload])
    return inner_join(left, right, [*keys, "__l", "__r"]).where(F.col("item1") < F.col("item2")).drop("__l", "__r")


def pairs_within(rows: DataFrame, keys: Sequence[str], item: str, payload: Sequence[str] = (),
                 block: int = BLOCK) -> DataFrame:
    """Unordered item pairs (``item1 < item2``) inside each group.

    ``rows`` is a written table, distinct on (keys, item). Its largest group is looked up first;
    only when some group exceeds ``block`` items does the plan get the blocked branch for those.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    largest = sizes.agg(F.max("__size")).first()[0] or 0
    if largest <= block:
        return _self_join(rows, keys, item, payload)
    big = sizes.where(F.col("__size") > block)
    light = _self_join(anti_join(rows, big, keys), keys, item, payload)
    return light.unionByName(_blocked_self_join(inner_join(rows, big, keys), keys, item, payload, "__size", block))


def pairwise_count(df: DataFrame, item: str, feature: str, weight: str | None = None,
                   order: Sequence[str | Column] = (), strata: Sequence[str] = (), upper: bool = True,
                   null_weight: str = "null", block: int = BLOCK) -> DataFrame:
    """``(strata…, item1, item2, n)``: for each pair of items the sum of item1's weight over the
    features that hold both (and where item2's weight is positive); without a weight, the number
    of shared features.

    ``order`` says which row is kept per (item, feature). ``upper=False`` keeps only
    ``item1 < item2``. A missing weight makes the pair's sum NULL (``null_weight="skip"``
    leaves that row out of the sum instead). The count is not symmetric when weighted.
    """
    strata = list(strata)
    keys = [*strata, feature]
    df = df.where(F.col(item).isNotNull() & F.col(feature).isNotNull())
    if weight is None:
        rows = cut_lineage(df.select(*keys, item).distinct())
        pairs = pairs_within(rows, keys, item, (), block)
        out = pairs.groupBy(*strata, "item1", "item2").agg(F.count(F.lit(1)).cast("double").alias("n"))
        if not upper:
            return out
        return out.unionByName(out.select(*strata, F.col("item2").alias("item1"), F.col("item1").alias("item2"), "n"))
    kept = first_per(df, [*keys, item], order or [weight])
    rows = cut_lineage(kept.select(*keys, item, F.col(weight).cast("double").alias("w")))
    pairs = pairs_within(rows, keys, item, ["w"], block)
    unknown = F.col("w1").isNull() | F.col("w2").isNull()
    if null_weight == "skip":
        pairs = pairs.where(~unknown)
    forward = F.sum(F.when(F.col("w2") > 0, F.col("w1")).otherwise(0.0))
    backward = F.sum(F.when(F.col("w1") > 0, F.col("w2")).otherwise(0.0))
    known = ~F.max(unknown)
    sums = pairs.groupBy(*strata, "item1", "item2").agg(
        F.when(known, forward).alias("__f"), F.when(known, backward).alias("__b"))
    if not upper:
        return sums.select(*strata, "item1", "item2", F.col("__f").alias("n"))
    both = F.explode(F.array(
        F.struct(F.col("item1").alias("item1"), F.col("item2").alias("item2"), F.col("__f").alias("n")),
        F.struct(F.col("item2").alias("item1"), F.col("item1").alias("item2"), F.col("__b").alias("n")),
    ))
    return sums.select(*strata, both.alias("p")).select(*strata, "p.*")


def pairwise_phi(df: DataFrame, item: str, feature: str, strata: Sequence[str] = (), upper: bool = True,
                 block: int = BLOCK) -> DataFrame:
    """``(strata…, item1, item2, correlation)``: phi over presence/absence of items in features.

    Every pair of items of a stratum has a row, also pairs that never meet; NULL where an item
    occurs in every feature. With several strata all of them are computed in one pass.
    """
    strata = list(strata)
    rows = cut_lineage(df.where(F.col(item).isNotNull() & F.col(feature).isNotNull())
                       .select(*strata, feature, item).distinct())
    together = pairs_within(rows, [*strata, feature], item, (), block).groupBy(*strata, "item1", "item2").agg(
        F.count(F.lit(1)).alias("n11"))
    singles = rows.groupBy(*strata, F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("cnt"))
    n_features = rows.select(*strata, feature).distinct()
    if strata:
        totals = n_features.groupBy(*strata).agg(F.count(F.lit(1)).alias("total"))
        universe = inner_join(singles, totals, strata)
    else:
        universe = singles.withColumn("total", F.lit(n_features.count())).withColumn("__all", F.lit(0))
    # one row per item from here on
    pairs = pairs_within(cut_lineage(universe), strata or ["__all"], "item", ["cnt", "total"], block).select(
        *strata, "item1", "item2", "cnt1", "cnt2", F.col("total1").alias("total"))
    pairs = left_join(pairs, together, [*strata, "item1", "item2"])
    n1, n2, n_all = (F.col(c).cast("double") for c in ("cnt1", "cnt2", "total"))
    n11 = F.coalesce(F.col("n11"), F.lit(0)).cast("double")
    phi = F.try_divide(n_all * n11 - n1 * n2, F.sqrt(n1 * (n_all - n1) * n2 * (n_all - n2)))
    out = pairs.select(*strata, "item1", "item2", phi.alias("correlation"))
    if not upper:
        return out
    both = F.explode(F.array(F.struct("item1", "item2"),
                             F.struct(F.col("item2").alias("item1"), F.col("item1").alias("item2"))))
    return out.select(*strata, both.alias("p"), "correlation").select(*strata, "p.*", "correlation")


def correlation_gap(corr: DataFrame, item_a: str, item_b: str) -> DataFrame:
    """``(item2, corr_a, corr_b, corr_diff)`` for two target items."""
    wide = corr.where(F.col("item1").isin(item_a, item_b)).groupBy("item2").pivot("item1", [item_a, item_b]).agg(
        F.first("correlation"))
    wide = wide.toDF("item2", "corr_a", "corr_b")
    return wide.withColumn("corr_diff", F.abs(F.col("corr_a") - F.col("corr_b")))
