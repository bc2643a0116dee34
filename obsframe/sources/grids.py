"""Raster products stored as partitioned cell tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("product", "resolution")


def write_cells(cells: DataFrame, path: str) -> str:
    """Cell table partitioned by product and resolution, sorted by species and cell in its files
    so that species and range filters skip row groups."""
    cells.sortWithinPartitions("species_name").write.mode("overwrite").partitionBy(*PARTS).parquet(path)
    return path


def read_cells(spark: SparkSession, path: str, product: str, resolution: str, species: Sequence[str] | None = None) -> DataFrame:
    """One product at one resolution: whole partitions are skipped, species are pushed down.
    Several species are one scan, not a loop."""
    df = spark.read.parquet(path).where((F.col("product") == product) & (F.col("resolution") == resolution))
    if species:
        df = df.where(F.col("species_name").isin(list(species)))
    return df.drop(*PARTS)


def layers_to_long(wide: DataFrame, ids: Sequence[str], name: str = "layer", value: str = "value") -> DataFrame:
    """One row per cell and layer from one column per layer."""
    return wide.unpivot(list(ids), [c for c in wide.columns if c not in ids], name, value)
