"""Running totals, rolling means, numbering, lags and fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import ordered as O
from ..operators.relational import semi_join, with_group_stats
from ..operators.reshape import longer
from .registry import R, big, query, r, text

DAILY = """d AS (SELECT common_name, observation_date AS day, COALESCE(SUM(observation_count), 0) AS total FROM clean
  WHERE common_name IN (SELECT common_name FROM clean GROUP BY 1 ORDER BY COALESCE(SUM(observation_count), 0) DESC, common_name LIMIT 10)
  GROUP BY 1, 2)"""


def daily_of_top(t):
    best = t.clean.groupBy("common_name").agg(V.sum_or_zero("observation_count").alias("n"))
    best = O.top_k(best, [F.col("n").desc(), "common_name"], 10)
    rows = semi_join(t.clean, best, ["common_name"])
    return rows.groupBy("common_name", F.col("observation_date").alias("day")).agg(V.sum_or_zero("observation_count").alias("total"))


@query("w01_running_sum", ("clean",), f"""
WITH {DAILY} SELECT common_name, CAST(day AS STRING) AS day, total, SUM(total) OVER (PARTITION BY common_name ORDER BY day) AS so_far FROM d""")
def _(t):
    d = O.running_sum(daily_of_top(t), ["day"], "total", "so_far", ["common_name"], F.year("day"))
    return d.withColumn("day", text("day"))


@query("w01_running_sum_ranges", ("clean",), f"""
WITH {DAILY} SELECT common_name, CAST(day AS STRING) AS day, SUM(total) OVER (PARTITION BY common_name ORDER BY day) AS so_far FROM d""")
def _(t):
    d = O.running_sum(daily_of_top(t), ["day"], "total", "so_far", ["common_name"])
    return d.select("common_name", text("day").alias("day"), "so_far")


@query("w02_running_sum_of_all", ("clean",), """
SELECT year, yday, n, CAST(SUM(n) OVER (ORDER BY year, yday) AS BIGINT) AS so_far FROM (
  SELECT year(observation_date) AS year, dayofyear(observation_date) AS yday, COUNT(*) AS n FROM clean GROUP BY 1, 2)""")
def _(t):
    d = t.clean.groupBy(big(F.year("observation_date")).alias("year"), big(F.dayofyear("observation_date")).alias("yday")).agg(
        F.count(F.lit(1)).alias("n"))
    return O.running_sum(d, ["year", "yday"], "n", "so_far", segment=F.col("year"))


@query("w03_rolling_mean", ("clean",), f"""
WITH {DAILY} SELECT common_name, CAST(day AS STRING) AS day, CASE WHEN row_number() OVER w >= 21 THEN {R('AVG(total) OVER (PARTITION BY common_name ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)')} END AS mean_21
FROM d WINDOW w AS (PARTITION BY common_name ORDER BY day)""")
def _(t):
    d = O.rolling_mean(daily_of_top(t), ["common_name"], ["day"], "total", 21, "mean_21", block=512)
    return d.select("common_name", text("day").alias("day"), r("mean_21").alias("mean_21"))


@query("w04_row_number", ("taxonomy",), "SELECT com_name, row_number() OVER (ORDER BY ord, com_name) AS row FROM taxonomy")
def _(t):
    return O.row_number(t.taxonomy, ["ord", "com_name"], "row").select("com_name", "row")


@query("w04_row_number_per_group", ("taxonomy",), "SELECT ord, com_name, row_number() OVER (PARTITION BY ord ORDER BY com_name) AS row FROM taxonomy")
def _(t):
    return O.row_number(t.taxonomy, ["com_name"], "row", ["ord"]).select("ord", "com_name", "row")


@query("w05_lag_change", (), f"""
SELECT k, {R('(n - lag(n) OVER (ORDER BY k)) / CAST(n AS DOUBLE)')} AS diff FROM (
  SELECT (year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS k, COUNT(*) AS n FROM orders GROUP BY 1)""")
def _(t):
    k = big((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate"))
    n = t.orders.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return O.lag_change(n, "k", "n", "diff").select("k", r("diff").alias("diff"))


@query("w06_group_mean_on_rows", ("cells",), f"""
SELECT cell, CAST(week AS STRING) AS week, {R('AVG(abundance) OVER (PARTITION BY week)')} AS mean_value FROM cells""")
def _(t):
    d = with_group_stats(t.cells, ["week"], F.avg("abundance").alias("mean_value"))
    return d.select("cell", text("week").alias("week"), r("mean_value").alias("mean_value"))


@query("w06_f11_peak_week", ("cells",), f"""
SELECT cell % 5 AS species, CAST(week AS STRING) AS week, {R('m')} AS mean_value, COUNT(*) AS n FROM (
  SELECT *, MAX(m) OVER (PARTITION BY cell % 5) AS best FROM (SELECT *, round(AVG(abundance) OVER (PARTITION BY cell % 5, week), 9) AS m FROM cells))
WHERE m = best GROUP BY 1, 2, 3""")
def _(t):
    from ..operators.relational import keep_group_extreme

    rows = t.cells.withColumn("species", F.col("cell") % 5)
    rows = with_group_stats(rows, ["species", "week"], F.round(F.avg("abundance"), 9).alias("m"))
    peak = keep_group_extreme(rows, ["species"], "m")
    return peak.groupBy("species", text("week").alias("week"), r("m").alias("mean_value")).agg(F.count(F.lit(1)).alias("n"))


@query("w07_label_last", ("clean",), """
SELECT year, yday, CASE WHEN yday = MAX(yday) OVER (PARTITION BY year) THEN CAST(year AS STRING) END AS year_label FROM (
  SELECT DISTINCT year(observation_date) AS year, dayofyear(observation_date) AS yday FROM clean)""")
def _(t):
    d = t.clean.select(big(F.year("observation_date")).alias("year"), big(F.dayofyear("observation_date")).alias("yday")).distinct()
    d = with_group_stats(d, ["year"], F.max("yday").alias("last"))
    return d.select("year", "yday", F.when(F.col("yday") == F.col("last"), text("year")).alias("year_label"))


@query("w08_fill_down", ("sightings",), """
SELECT species_code, obs_dt, last_value(seen IGNORE NULLS) OVER (PARTITION BY species_code ORDER BY obs_dt
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM (
  SELECT species_code, obs_dt, MAX(CASE WHEN how_many > 60 THEN how_many END) AS seen FROM sightings GROUP BY 1, 2)""")
def _(t):
    d = t.sightings.groupBy("species_code", "obs_dt").agg(F.max(F.when(F.col("how_many") > 60, F.col("how_many"))).alias("seen"))
    return O.fill_down(d, ["species_code"], ["obs_dt"], "seen")


@query("w09_one_column_against_the_rest", ("seasonal",), f"""
SELECT a.common_name, a.month_no, {R('a.value')} AS value, {R('b.value')} AS january FROM seasonal a JOIN seasonal b
  ON a.common_name = b.common_name AND b.month_no = 1 WHERE a.month_no <> 1""")
def _(t):
    wide = t.seasonal.groupBy("common_name").pivot("month_no", list(range(1, 13))).agg(F.first("value"))
    long = longer(wide.withColumnRenamed("1", "january"), ["common_name", "january"], "month_no")
    return long.select("common_name", big("month_no").alias("month_no"), r("value").alias("value"), r("january").alias("january"))


@query("w13_first_last", ("clean",), """
SELECT common_name, arg_min(observation_count, checklist_id * 1000000 + line_part * 100 + line_no) AS first_count,
  CAST(MAX(observation_date) + 240 AS STRING) AS after_last FROM clean WHERE observation_count IS NOT NULL GROUP BY 1""")
def _(t):
    order = F.col("checklist_id") * 1000000 + F.col("line_part") * 100 + F.col("line_no")
    return t.clean.where(F.col("observation_count").isNotNull()).groupBy("common_name").agg(
        F.min_by("observation_count", order).alias("first_count"), text(F.date_add(F.max("observation_date"), 240)).alias("after_last"))
