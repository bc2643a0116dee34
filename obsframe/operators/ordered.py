"""Ordered operators: numbering, running totals, rolling means, top-k and sampling.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. The operators below that
may meet one very large key (or have no key at all) work in two levels instead: rows are cut
into contiguous segments, each segment is scanned on its own, and the small table of segment
totals supplies the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import uniform_from_md5
from ..session import cut_lineage


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]


def _eq(left: str, right: str) -> Column:
    return F.col(f"`{left}`").eqNullSafe(F.col(f"`{right}`"))


def segments(df: DataFrame, order: Sequence[str | Column], name: str = "__seg") -> DataFrame:
    """Cut the table into contiguous ranges of its sort order.

    Range boundaries come from a sample, so the ranges are written once (reliable checkpoint)
    and every later step reads the same cut, also after a lost executor.
    """
    ranged = df.repartitionByRange(*_cols(order)).withColumn(name, F.spark_partition_id())
    return cut_lineage(ranged)


def _offsets(cut: DataFrame, keys: Sequence[str], seg: str, total: Column) -> DataFrame:
    """Per (keys, segment): the total of all earlier segments of the key.

    One row per key and segment, so this window stays small however many rows a key has.
    """
    totals = cut.groupBy(*keys, seg).agg(total.alias("__t"))
    w = Window.partitionBy(*keys).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("__before", F.coalesce(F.sum("__t").over(w), F.lit(0))).drop("__t")
    return before.withColumnsRenamed({c: f"__o_{c}" for c in [*keys, seg]})


def _with_offsets(cut: DataFrame, keys: Sequence[str], seg: str, total: Column) -> DataFrame:
    off = _offsets(cut, keys, seg, total)
    on = None
    for c in [*keys, seg]:
        e = _eq(c, f"__o_{c}")
        on = e if on is None else on & e
    return cut.join(off, on, "inner").drop(*[f"__o_{c}" for c in [*keys, seg]])


def row_number(df: DataFrame, order: Sequence[str | Column], name: str = "row", keys: Sequence[str] = ()) -> DataFrame:
    """1..n over the whole table (or per key) without a single-task window."""
    keys = list(keys)
    cut = segments(df, [*keys, *order])
    local = F.row_number().over(Window.partitionBy(*keys, "__seg").orderBy(*_cols(order)))
    out = _with_offsets(cut, keys, "__seg", F.count(F.lit(1)))
    return out.withColumn(name, (F.col("__before") + local).cast("long")).drop("__before", "__seg")


def row_number_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "row") -> DataFrame:
    """Per-key numbering for keys of ordinary size; followed by ``<= k`` it is cut map-side."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn(name, F.row_number().over(w))


def running_sum(df: DataFrame, order: Sequence[str | Column], value: str, name: str,
                keys: Sequence[str] = (), segment: Column | None = None) -> DataFrame:
    """Running sum along ``order`` per key (or over the whole table).

    ``segment`` may give a natural cut, an expression that never falls along the order, such
    as the year of a date; without it the ranges of ``segments`` are used. ``order`` must be
    unique within a key.
    """
    keys = list(keys)
    cut = df.withColumn("__seg", segment) if segment is not None else segments(df, [*keys, *order])
    w = (Window.partitionBy(*keys, "__seg").orderBy(*_cols(order))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = _with_offsets(cut, keys, "__seg", F.coalesce(F.sum(value), F.lit(0)))
    return out.withColumn(name, F.col("__before") + F.sum(value).over(w)).drop("__before", "__seg")


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int,
                 name: str, block: int = 4096) -> DataFrame:
    """Trailing mean over ``width`` rows, NULL until ``width`` rows exist; NULL values ignored.

    Rows are numbered per key and handled in blocks of ``block`` rows; the last ``width - 1``
    rows of a block are also given to the next one, so a long series uses many tasks.
    """
    if width > block:
        block = width
    numbered = row_number(df, order, "__pos", keys)
    home = F.floor((F.col("__pos") - 1) / block)
    tail = (F.col("__pos") - 1) % block >= block - width + 1
    spread = numbered.withColumn("__home", home).withColumn(
        "__blk", F.explode(F.when(tail, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home")))
    )
    w = Window.partitionBy(*keys, "__blk").orderBy("__pos").rowsBetween(-(width - 1), Window.currentRow)
    return (
        spread.withColumn(name, F.avg(value).over(w))
        .where(F.col("__home") == F.col("__blk"))
        .withColumn(name, F.when(F.col("__pos") >= width, F.col(name)))
        .drop("__pos", "__home", "__blk")
    )


def lag_change(df: DataFrame, order: str, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(x - previous x) / x`` along a consecutive integer ``order`` column (a sweep of k).

    The previous row is found by joining on ``order + 1``, so there is no single-task window.
    """
    prev = df.select(*[F.col(k).alias(f"__p_{k}") for k in keys],
                     (F.col(order) + 1).alias("__p_order"), F.col(value).alias("__prev"))
    on = F.col(order) == F.col("__p_order")
    for k in keys:
        on = on & _eq(k, f"__p_{k}")
    out = df.join(prev, on, "left")
    change = F.try_divide(F.col(value) - F.col("__prev"), F.col(value))
    return out.withColumn(name, change).drop("__prev", "__p_order", *[f"__p_{k}" for k in keys])


def fill_down(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Carry the last known value forward within a key."""
    cut = segments(df, [*keys, *order])
    w = Window.partitionBy(*keys, "__seg").orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    position = F.struct(*order)
    ends = cut.where(F.col(name).isNotNull()).groupBy(*keys, "__seg").agg(F.max_by(name, position).alias("__end"))
    every = cut.select(*keys, "__seg").distinct()
    on = None
    ends = ends.withColumnsRenamed({c: f"__e_{c}" for c in [*keys, "__seg"]})
    for c in [*keys, "__seg"]:
        e = _eq(c, f"__e_{c}")
        on = e if on is None else on & e
    before = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = (every.join(ends, on, "left").drop(*[f"__e_{c}" for c in [*keys, "__seg"]])
             .withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).drop("__end")
             .withColumnsRenamed({c: f"__c_{c}" for c in [*keys, "__seg"]}))
    on = None
    for c in [*keys, "__seg"]:
        e = _eq(c, f"__c_{c}")
        on = e if on is None else on & e
    out = cut.join(carry, on, "left").drop(*[f"__c_{c}" for c in [*keys, "__seg"]])
    return out.withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(w), "__carry")).drop("__carry", "__seg")


# -- top-k -----------------------------------------------------------------------------------

def top_k(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    """First k rows of a total order; give tie-breaking columns in ``order``."""
    return df.orderBy(*_cols(order)).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int,
                    rank: str | None = None) -> DataFrame:
    """First k rows per group. Small k is cut before the shuffle by the engine; for large k the
    groups are first cut inside 32 slices each, so a hot group never meets in one task whole."""
    if k > 1000:
        rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
        sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*rest), F.lit(32)))
        df = row_number_by(sliced, [*keys, "__slice"], order, "__rn").where(F.col("__rn") <= k).drop("__slice", "__rn")
    out = row_number_by(df, keys, order, "__rn").where(F.col("__rn") <= k)
    return out.withColumnRenamed("__rn", rank) if rank else out.drop("__rn")


def top_n_with_ties(df: DataFrame, value: str, n: int) -> DataFrame:
    """Rows whose value is among the n largest, ties at the cut kept."""
    cut = df.where(F.col(value).isNotNull()).orderBy(F.col(value).desc()).limit(n).agg(F.min(value)).scalar()
    return df.where(F.col(value) >= cut)


def top_frac_with_ties(df: DataFrame, value: str, frac: float) -> DataFrame:
    """Rows whose descending rank is at most ``frac`` of the row count, ties kept."""
    from .quantiles import order_statistic

    kept = F.floor(F.col("n") * F.lit(float(frac)))
    cut = order_statistic(df, value, 1.0 - frac, F.col("n") - kept + 1).where(F.col("n") * frac >= 1)
    return df.where(F.col(value) >= cut.select("value").scalar())


# -- sampling --------------------------------------------------------------------------------

def _draw(id_cols: Sequence[str], seed: int) -> Column:
    known = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in id_cols]  # a missing part has its own place
    return uniform_from_md5(F.concat_ws("|", *known), seed)


def sample_rows(df: DataFrame, n: int, id_cols: Sequence[str], seed: int = 1234) -> DataFrame:
    """n rows without replacement, the same rows on every run and partitioning."""
    return (df.withColumn("__u", _draw(id_cols, seed)).orderBy("__u", *id_cols).limit(n).drop("__u"))


def sample_rows_per_group(df: DataFrame, keys: Sequence[str], n: int, id_cols: Sequence[str], seed: int = 1234) -> DataFrame:
    drawn = df.withColumn("__u", _draw(id_cols, seed))
    return top_k_per_group(drawn, keys, ["__u", *id_cols], n).drop("__u")


def weighted_sample(df: DataFrame, n: int, weight: str, id_cols: Sequence[str], keys: Sequence[str] = (),
                    seed: int = 1234) -> DataFrame:
    """n rows without replacement with probability by weight: the n smallest ``-ln(u)/w``
    (Efraimidis & Spirakis 2006). Rows without a positive weight are never drawn."""
    drawn = df.where(F.col(weight) > 0).withColumn("__k", -F.ln(_draw(id_cols, seed)) / F.col(weight))
    if keys:
        return top_k_per_group(drawn, keys, ["__k", *id_cols], n).drop("__k")
    return drawn.orderBy("__k", *id_cols).limit(n).drop("__k")
