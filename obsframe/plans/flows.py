"""The end-to-end analyses, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import log10_finite, since_year
from ..operators.aggregates import two_level_mean
from ..operators.ordered import top_k_per_group
from ..operators.pairwise import pairwise_phi
from ..operators.relational import complete_grid, semi_join, with_group_stats
from ..session import cut_lineage

SINCE = 1996


def best_partners(clean: DataFrame, protocols: DataFrame, targets: list[str], k: int = 10) -> DataFrame:
    """Lifecycle of the co-occurrence analysis: top protocols, phi, the k best partners of each target."""
    rows = semi_join(clean, protocols, ["protocol_type"])
    phi = pairwise_phi(rows, "common_name", "observation_event_id")
    mine = phi.where(F.col("item1").isin(targets) & F.col("correlation").isNotNull())
    return top_k_per_group(mine, ["item1"], [F.col("correlation").desc(), F.col("item2")], k, rank="rank")


def seasonality(rows: DataFrame, since: int = SINCE) -> DataFrame:
    """``(common_name, month_no, value)``: mean yearly count per month, months without a sighting
    0, on the log10 scale. The means are written once; the grid's names and months are those of the means, so ``rows`` is evaluated once."""
    rows = rows.where(since_year("observation_date", since)).select(
        "common_name", F.year("observation_date").alias("year"), F.month("observation_date").alias("month_no"),
        "observation_count")
    mean = cut_lineage(two_level_mean(rows, ["common_name", "month_no"], ["year"], "observation_count", "count_mean", 1))
    full = complete_grid(mean, "common_name", mean.select("month_no"), "month_no", {"count_mean": 0.0})
    return full.select("common_name", "month_no", log10_finite("count_mean").alias("value"))


def scaled_tiles(tiles: DataFrame) -> DataFrame:
    """Per-species z-score, min-max to [0, 1] (a constant species is 0.5) and its log."""
    v = F.col("rel_abundance")
    rows = with_group_stats(tiles, ["species_name"], F.avg(v).alias("m"), F.stddev_samp(v).alias("sd"),
                            F.min(v).alias("lo"), F.max(v).alias("hi"))
    unit = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise((v - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return rows.select("species_name", "x", "y", "rel_abundance", F.try_divide(v - F.col("m"), "sd").alias("scaled"),
                       unit.alias("rescaled"), F.log10(unit + 1).alias("rescaled_log10"))


def wide_tiles(tiles: DataFrame, species: list[str]) -> DataFrame:
    """One row per tile, one column per species."""
    return scaled_tiles(tiles).groupBy("x", "y").pivot("species_name", species).agg(F.first("rescaled_log10"))


def top_sightings(sightings: DataFrame, k: int = 10) -> DataFrame:
    """Species with the highest counts in the region, their last date and a page link."""
    from ..functions.values import date_in_text, sum_strict

    grouped = sightings.groupBy("com_name", "species_code").agg(
        sum_strict("how_many").alias("n"), F.max("obs_dt").alias("last_seen"))
    top = grouped.orderBy(F.col("n").desc_nulls_last(), "com_name", "species_code").limit(k)
    return top.withColumn("last_seen", date_in_text("last_seen")).withColumn(
        "link", F.concat(F.lit("https://example.org/species/"), F.col("species_code")))
