"""Long/wide reshaping, column selection by rule, nesting."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import row_number
from .relational import inner_join


def select_matching(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose name contains ``text`` (any case), after the listed ones."""
    names = [c for c in df.columns if text.lower() in c.lower() and c not in keep]
    return df.select(*[F.col(f"`{c}`") for c in [*keep, *names]])


def map_columns(df: DataFrame, names: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in names})


def longer(df: DataFrame, keep: Sequence[str], name: str = "name", value: str = "value",
           columns: Sequence[str] | None = None) -> DataFrame:
    """Wide to long over the given columns, or over everything but ``keep``."""
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in keep]
    return df.unpivot(list(keep), columns, name, value)


def distinct_values(df: DataFrame, name: str) -> list:
    """The sorted distinct values of a column that becomes column headers. A wide table's header lives on the driver; for names
    without bound stay in long form."""
    return [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).collect()]


def wider(df: DataFrame, keys: Sequence[str], names_from: str, values_from: str,
          values: Sequence | None = None, prefix: str = "") -> DataFrame:
    """Long to wide; combinations that do not occur are NULL, of several values in one cell the smallest stays."""
    values = list(values) if values is not None else distinct_values(df, names_from)
    out = df.groupBy(*keys).pivot(names_from, values).agg(F.min(values_from))
    return out.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values}) if prefix else out


def wider_by_rank(df: DataFrame, names_from: str, value: str, order: Sequence[Column],
                  values: Sequence | None = None) -> DataFrame:
    """One column per group, rows aligned by rank inside the group."""
    ranked = row_number(df, order, "rank", [names_from])
    return wider(ranked, ["rank"], names_from, value, values)


def separate(df: DataFrame, name: str, into: Sequence[str], pattern: str = "[^A-Za-z0-9]+") -> DataFrame:
    """Split one text column into several; missing pieces are NULL."""
    parts = F.split(F.col(name), pattern)
    return df.withColumns({c: F.try_element_at(parts, F.lit(i + 1)) for i, c in enumerate(into)}).drop(
        *([name] if name not in into else [])
    )


def nest(df: DataFrame, keys: Sequence[str], into: str = "data", cell_rows: int = 10_000,
         spread_on: Column | None = None) -> DataFrame:
    """Group rows into list cells.

    A group becomes as many cells (numbered by ``part``) as it needs for a cell to hold about
    ``cell_rows`` rows, so a hot group is spread over many tasks and no cell grows with it.
    """
    rest = [c for c in df.columns if c not in keys]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    spread = spread_on if spread_on is not None else F.xxhash64(*[F.col(f"`{c}`") for c in rest])
    parts = F.ceil(F.col("__n") / F.lit(float(cell_rows)))
    return (
        inner_join(df, sizes, list(keys))
        .withColumn("part", F.pmod(spread, parts).cast("int"))
        .groupBy(*keys, "part")
        .agg(F.collect_list(F.struct(*rest)).alias(into))
    )


def unnest(df: DataFrame, name: str = "data") -> DataFrame:
    rest = [c for c in df.columns if c not in (name, "part")]
    return df.select(*rest, F.explode(name).alias("__r")).select(*rest, "__r.*")
