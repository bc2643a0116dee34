"""Observation records: cleaning, bulk filters, roll-ups and feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import count_or_null, date_in_text, join_text, null_to_text, sum_strict
from ..operators.pairwise import first_per

EVENT_PARTS = ("observer_id", "locality", "observation_date", "time_observations_started")


def clean_observations(df: DataFrame, sep: str = "-", missing_text: str | None = "NA",
                       complete_only: bool = True) -> DataFrame:
    """Counts as numbers, an event id from observer, place, date and time, complete lists only.

    A missing part of the event id is written as ``missing_text``; with None the whole id is NULL.
    """
    parts = [null_to_text(c, missing_text) if missing_text is not None else F.col(c) for c in EVENT_PARTS]
    out = df.withColumn("observation_count", count_or_null("observation_count")).withColumn(
        "observation_event_id", join_text(*parts, sep=sep))
    return out.where(F.col("all_species_reported") == 1) if complete_only else out


def filter_observations(df: DataFrame, species: Sequence[str] | None = None, country: Sequence[str] | None = None,
                        species_col: str = "common_name", country_col: str = "country") -> DataFrame:
    """The bulk filter: only the given species and countries."""
    if species:
        df = df.where(F.col(species_col).isin(list(species)))
    if country:
        df = df.where(F.col(country_col).isin(list(country)))
    return df


def unique_group_checklists(df: DataFrame, species: str, group: str, order: Sequence[str | Column]) -> DataFrame:
    """One row per (species, shared checklist group); rows without a group are all kept."""
    grouped = first_per(df.where(F.col(group).isNotNull()), [species, group], order)
    return grouped.unionByName(df.where(F.col(group).isNull()))


def roll_up_taxa(df: DataFrame, taxa: DataFrame, name: str, checklist: str, count: str) -> DataFrame:
    """Subspecies counted under their species, other taxa dropped: ``(checklist, species, count)``.

    ``taxa`` maps ``name`` to ``species`` (NULL for taxa that are no species). An unknown count
    makes the species' count unknown.
    """
    joined = df.join(taxa.where(F.col("species").isNotNull()), name)
    return joined.groupBy(checklist, "species").agg(sum_strict(count).alias(count))


def recent(df: DataFrame, date: Column, as_of: Column, days: int = 30) -> DataFrame:
    """Sightings within a look-back window."""
    return df.where((date >= F.date_sub(as_of, days)) & (date <= as_of))


def sighting_dates(df: DataFrame, name: str = "obs_dt") -> DataFrame:
    return df.withColumn("obs_date", date_in_text(name))


def frequency_table(df: DataFrame, species: str, event: str, date: str) -> DataFrame:
    """Share of checklists that report a species, per month and quarter of the month:
    ``(species, month_qt, sample_size, frequency)`` with ``month_qt`` like ``January-2``."""
    d = F.col(date)
    quarter = F.least(F.floor((F.dayofmonth(d) - 1) / 8) + 1, F.lit(4)).cast("int")
    period = F.concat(F.date_format(d, "MMMM"), F.lit("-"), quarter.cast("string"))
    rows = df.select(F.col(species).alias("species"), F.col(event).alias("e"), period.alias("month_qt")).distinct()
    total = rows.select("month_qt", "e").distinct().groupBy("month_qt").agg(F.count(F.lit(1)).alias("total"))
    seen = rows.groupBy("species", "month_qt").agg(F.count(F.lit(1)).alias("seen"))
    return seen.join(total, "month_qt").select(
        F.col("species").alias(species), "month_qt", F.col("total").cast("double").alias("sample_size"),
        (F.col("seen") / F.col("total")).alias("frequency"))


def monthly_frequency(freq: DataFrame, species: str, weighted: bool = False) -> DataFrame:
    """Mean weekly frequency per month (optionally weighted by sample size) and checklists summed."""
    month = F.split("month_qt", "[^A-Za-z0-9]+")[0]
    mean = F.try_divide(F.sum(F.col("frequency") * F.col("sample_size")), F.sum("sample_size")) if weighted else F.avg("frequency")
    return freq.withColumn("month", month).groupBy(species, "month").agg(
        F.sum("sample_size").alias("sample_size"), mean.alias("frequency_mean"))
