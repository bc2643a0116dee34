"""Column expressions for missing values, numbers, text and dates.

All of them are plain built-in expressions, so they stay inside whole-stage codegen.
They are written for ANSI mode: bad input gives NULL instead of an error.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- numbers ---------------------------------------------------------------------------------

def count_or_null(c, sentinel: str = "X") -> Column:
    """Text count to DOUBLE; the "present, not counted" code and other non-numbers are NULL."""
    c = col(c)
    return F.when(~c.contains(sentinel), c).try_cast("double")


def parse_number(c) -> Column:
    """First number inside a text, with grouping commas removed."""
    return F.replace(F.regexp_substr(col(c), F.lit(r"-?[0-9][0-9,]*\.?[0-9]*")), F.lit(","), F.lit("")).try_cast("double")


def log10_finite(c) -> Column:
    """log10 with log10(0) read as 0; NULL for negative input."""
    c = col(c).cast("double")
    return F.when(c > 0, F.log10(c)).when(c == 0, F.lit(0.0))


def round_even(c, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def is_infinite(c) -> Column:
    return F.abs(col(c)) == F.lit(float("inf"))


# -- aggregates with explicit treatment of NULL -----------------------------------------------

def sum_strict(c) -> Column:
    """NULL as soon as one input is NULL."""
    c = col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def mean_strict(c) -> Column:
    c = col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))


def sum_or_zero(c) -> Column:
    """NULL-ignoring sum that is 0 when nothing is left."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


# -- text ------------------------------------------------------------------------------------

def null_to_text(c, text: str = "NA") -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(text))


def join_text(*cols, sep: str = "") -> Column:
    """Concatenate; NULL if any part is NULL (unlike ``concat_ws``, which skips NULLs)."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i and sep:
            parts.append(F.lit(sep))
        parts.append(col(c).cast("string"))
    return F.concat(*parts)


def remove_pattern(c, pattern: str) -> Column:
    return F.regexp_replace(col(c), pattern, "")


def extract_pattern(c, pattern: str) -> Column:
    """First match or NULL."""
    return F.regexp_substr(col(c), F.lit(pattern))


def markdown_link(text, url) -> Column:
    return F.concat(F.lit("["), col(text), F.lit("]("), col(url), F.lit(")"))


# -- dates -----------------------------------------------------------------------------------

def parse_date(c, fmt: str | None = None) -> Column:
    c = col(c)
    return F.try_to_date(c, fmt) if fmt else F.try_to_date(c)


def date_in_text(c) -> Column:
    """The first ISO date inside a text."""
    return parse_date(extract_pattern(c, r"\d{4}-\d{2}-\d{2}"))


def layer_date(c) -> Column:
    """Layer names such as ``X2018.01.04`` to dates."""
    return parse_date(F.regexp_replace(remove_pattern(c, "^X"), r"\.", "-"))


def date_from_month_name(month, year) -> Column:
    return F.try_to_date(F.concat(col(year).cast("string"), F.lit("-"), col(month), F.lit("-01")), "yyyy-MMMM-dd")


def month_label(c) -> Column:
    """Three-letter month name; sort by ``F.month`` of the same date."""
    return F.monthname(col(c))


def since_year(c, year: int) -> Column:
    """``year(c) >= year`` as a range on the date itself, so that it reaches the scan."""
    return col(c) >= F.lit(f"{year:04d}-01-01").cast("date")


# -- predicates ------------------------------------------------------------------------------

def not_in_keep_null(c, values: Iterable) -> Column:
    """Non-membership that keeps NULL rows."""
    return ~F.coalesce(col(c).isin(list(values)), F.lit(False))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def drop_missing(df: DataFrame, *names: str) -> DataFrame:
    """Drop rows with a missing value (NULL or NaN) in the listed columns, or in any column."""
    for name in names or df.columns:
        df = df.where(~is_missing(df, name))
    return df


def uniform_from_md5(key: Column, seed: int) -> Column:
    """A number in (0, 1) of 52 random bits from a row key: the same on every run, engine and partitioning."""
    digest = F.md5(F.concat(F.lit(str(seed)), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(4503599627370496.0)
