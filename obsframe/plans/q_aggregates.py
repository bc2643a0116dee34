"""Grouped aggregates, histograms, densities and pairwise measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import aggregates as A
from ..operators import pairwise as P
from ..operators.quantiles import exact_quantiles
from .flows import best_partners
from .lenses import KEEP_ORDER
from .registry import R, big, query, r, text


@query("a01_count", ("clean",), "SELECT protocol_type, COUNT(*) AS n FROM clean GROUP BY 1")
def _(t):
    return A.count_by(t.clean, "protocol_type")


@query("a02_sum_ignoring_null", ("clean",), """
SELECT common_name, CAST(observation_date AS STRING) AS day, COALESCE(SUM(observation_count), 0) AS total FROM clean GROUP BY 1, 2""")
def _(t):
    return t.clean.groupBy("common_name", text("observation_date").alias("day")).agg(V.sum_or_zero("observation_count").alias("total"))


@query("a03_sum_mean_strict", ("sightings",), f"""
SELECT species_code, com_name, CAST(CASE WHEN COUNT(*) = COUNT(how_many) THEN SUM(how_many) END AS BIGINT) AS total,
  {R('CASE WHEN COUNT(*) = COUNT(how_many) THEN AVG(how_many) END')} AS mean FROM sightings GROUP BY 1, 2""")
def _(t):
    return t.sightings.groupBy("species_code", "com_name").agg(
        big(V.sum_strict("how_many")).alias("total"), r(V.mean_strict("how_many")).alias("mean"))


@query("a04_mean_ignoring_null", ("sightings",), f"SELECT com_name, {R('AVG(how_many)')} AS mean FROM sightings GROUP BY 1")
def _(t):
    return t.sightings.groupBy("com_name").agg(r(F.avg("how_many")).alias("mean"))


@query("a05_two_level_mean", ("clean",), """
SELECT common_name, month_no, CAST(round_even(AVG(s), 1) AS DOUBLE) AS count_mean FROM (
  SELECT common_name, year(observation_date) AS y, month(observation_date) AS month_no, COALESCE(SUM(observation_count), 0) AS s
  FROM clean GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    rows = t.clean.select("common_name", F.year("observation_date").alias("y"), big(F.month("observation_date")).alias("month_no"),
                          "observation_count")
    return A.two_level_mean(rows, ["common_name", "month_no"], ["y"], "observation_count", "count_mean", 1)


@query("a06_share", ("tiles",), f"SELECT species_name, {R('AVG(CASE WHEN rel_abundance = 0 THEN 1.0 ELSE 0.0 END)')} AS zero_pct FROM tiles GROUP BY 1")
def _(t):
    return t.tiles.groupBy("species_name").agg(r(A.share(F.col("rel_abundance") == 0)).alias("zero_pct"))


@query("a07_min_max", ("effort",), """
SELECT country, CAST(MAX(observation_date) AS STRING) AS date_max, CAST(MIN(observation_date) AS STRING) AS date_min,
  MAX(observer_id) AS text_max FROM effort GROUP BY 1""")
def _(t):
    return t.effort.groupBy("country").agg(text(F.max("observation_date")).alias("date_max"),
                                           text(F.min("observation_date")).alias("date_min"), F.max("observer_id").alias("text_max"))


@query("a08_mean_sd", ("tiles",), f"""
SELECT species_name, {R('AVG(rel_abundance)')} AS mean, {R('stddev_samp(rel_abundance)')} AS sd FROM tiles GROUP BY 1""")
def _(t):
    return t.tiles.groupBy("species_name").agg(r(F.avg("rel_abundance")).alias("mean"), r(F.stddev_samp("rel_abundance")).alias("sd"))


@query("a09_a10_quantiles", ("tiles",), f"""
SELECT species_name, {R('quantile_cont(rel_abundance, 0.5)', 9)} AS median, {R('quantile_cont(rel_abundance, 0.95)', 9)} AS pct_95,
  {R('quantile_cont(rel_abundance, 0.99)', 9)} AS pct_99 FROM tiles GROUP BY 1""")
def _(t):
    d = exact_quantiles(t.tiles, ["species_name"], "rel_abundance", {"median": 0.5, "pct_95": 0.95, "pct_99": 0.99})
    return d.select("species_name", *[r(c, 9).alias(c) for c in ("median", "pct_95", "pct_99")])


@query("a10_quantiles_of_all", (), f"""
SELECT {R('quantile_cont(l_extendedprice, 0.25)', 9)} AS q25, {R('quantile_cont(l_extendedprice, 0.5)', 9)} AS q50,
  {R('quantile_cont(l_extendedprice, 0.999)', 9)} AS q999 FROM lineitem""")
def _(t):
    d = exact_quantiles(t.lineitem, [], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q999": 0.999})
    return d.select(*[r(c, 9).alias(c) for c in ("q25", "q50", "q999")])


@query("a11_distinct", ("effort",), "SELECT DISTINCT country, state FROM effort")
def _(t):
    return t.effort.select("country", "state").distinct()


@query("a12_grouping_per_call", ("tiles",), f"""
SELECT t.species_name, t.x, {R('t.m')} AS by_column, {R('s.m')} AS by_species FROM (
  SELECT species_name, x, AVG(rel_abundance) AS m FROM tiles GROUP BY 1, 2) t
JOIN (SELECT species_name, AVG(rel_abundance) AS m FROM tiles GROUP BY 1) s USING (species_name)""")
def _(t):
    a = t.tiles.groupBy("species_name", "x").agg(r(F.avg("rel_abundance")).alias("by_column"))
    b = t.tiles.groupBy("species_name").agg(r(F.avg("rel_abundance")).alias("by_species"))
    return a.join(b, "species_name")


@query("a13_profile", (), f"""
SELECT label, 'e' || i AS name, {R('AVG(embedding[i])', 5)} AS value FROM embeddings, range(1, 65) v(i) GROUP BY 1, 2""")
def _(t):
    from ..operators.cluster import cluster_profile

    from .q_models import FEATURES, vectors_wide

    return cluster_profile(vectors_wide(t).drop("vec_id"), "label", FEATURES).withColumn("value", r("value", 5))


@query("a15_histogram", ("tiles",), f"""
SELECT species_name, CAST(LEAST(FLOOR(COALESCE((v - lo) / NULLIF((hi - lo) / 30, 0), 0)), 29) AS BIGINT) + 1 AS bin, COUNT(*) AS n,
  {R('ANY_VALUE(lo + CAST(LEAST(FLOOR(COALESCE((v - lo) / NULLIF((hi - lo) / 30, 0), 0)), 29) AS BIGINT) * ((hi - lo) / 30))')} AS lower
FROM (SELECT species_name, rel_abundance AS v, MIN(rel_abundance) OVER w AS lo, MAX(rel_abundance) OVER w AS hi
  FROM tiles WINDOW w AS (PARTITION BY species_name)) GROUP BY 1, 2""")
def _(t):
    d = A.histogram(t.tiles, "rel_abundance", 30, ["species_name"])
    return d.select("species_name", big("bin").alias("bin"), "n", r("lower").alias("lower"))


@query("a15_histogram_of_all", (), """
SELECT CAST(LEAST(FLOOR((v - lo) / ((hi - lo) / 30)), 29) AS BIGINT) + 1 AS bin, COUNT(*) AS n FROM (
  SELECT value AS v, MIN(value) OVER () AS lo, MAX(value) OVER () AS hi FROM events) GROUP BY 1""")
def _(t):
    return A.histogram(t.events, "value").select(big("bin").alias("bin"), "n")


@query("a16_box_summary", ("seasonal",), f"""
WITH q AS (SELECT month_no, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q3 FROM seasonal GROUP BY 1)
SELECT s.month_no, {R('ANY_VALUE(q1)', 9)} AS q1, {R('ANY_VALUE(md)', 9)} AS median, {R('ANY_VALUE(q3)', 9)} AS q3,
  {R('MIN(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END)', 9)} AS low,
  {R('MAX(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END)', 9)} AS high,
  COUNT(CASE WHEN NOT (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) THEN 1 END) AS outliers
FROM seasonal s JOIN q USING (month_no) GROUP BY 1""")
def _(t):
    d = A.box_summary(t.seasonal, ["month_no"], "value")
    return d.select(big("month_no").alias("month_no"), *[r(c, 9).alias(c) for c in ("q1", "median", "q3", "low", "high")], "outliers")


@query("a16_box_outliers", (), """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT e.event_type, event_id, value FROM events e JOIN q USING (event_type)
WHERE NOT (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))""")
def _(t):
    return A.box_outliers(t.events.select("event_type", "event_id", "value"), ["event_type"], "value")


BW = "CASE WHEN LEAST(sd, CASE WHEN iqr / 1.34 > 0 THEN iqr / 1.34 END) > 0 THEN LEAST(sd, CASE WHEN iqr / 1.34 > 0 THEN iqr / 1.34 END) WHEN sd > 0 THEN sd ELSE 1.0 END"


@query("a17_density", ("tiles_ok",), f"""
WITH s AS (SELECT species_name, n, lo, hi, 0.9 * ({BW}) * pow(n, -0.2) AS bw FROM (
    SELECT species_name, COUNT(*) AS n, MIN(rel_abundance) AS lo, MAX(rel_abundance) AS hi, stddev_samp(rel_abundance) AS sd,
      quantile_cont(rel_abundance, 0.75) - quantile_cont(rel_abundance, 0.25) AS iqr FROM tiles_ok GROUP BY 1)),
places AS (SELECT t.species_name, n, lo, hi, bw, COALESCE((rel_abundance - lo) / NULLIF((hi - lo) / 511, 0), 0) AS p FROM tiles_ok t JOIN s USING (species_name)),
halves AS (SELECT *, LEAST(FLOOR(p), 510) AS lft FROM places),
mass AS (SELECT species_name, n, lo, hi, bw, lft AS node, 1 - (p - lft) AS w FROM halves
  UNION ALL SELECT species_name, n, lo, hi, bw, lft + 1, p - lft FROM halves),
nodes AS (SELECT species_name, n, lo, hi, bw, node, SUM(w) AS w FROM mass GROUP BY ALL)
SELECT species_name, {R('lo + g * (hi - lo) / 511')} AS x, {R('SUM(SUM(w * exp(-0.5 * pow((lo + g * (hi - lo) / 511 - (lo + node * (hi - lo) / 511)) / bw, 2)) / (bw * sqrt(2 * pi()))) / ANY_VALUE(n)) OVER (PARTITION BY species_name, g)')} AS density
FROM nodes, range(0, 512) v(g) GROUP BY species_name, g, lo, hi""")
def _(t):
    d = A.density_1d(t.tiles_ok, "rel_abundance", ["species_name"])
    return d.select("species_name", r("x").alias("x"), r("density").alias("density"))


def _axis(c):
    return f"""(SELECT n, lo, hi, 1.06 * ({BW}) * pow(n, -0.2) AS h FROM (SELECT COUNT({c}) AS n, MIN({c}) AS lo, MAX({c}) AS hi,
    stddev_samp({c}) AS sd, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM sightings))"""


def _node(axis, c, m):
    return f"COALESCE(({c} - {axis}.lo) / NULLIF(({axis}.hi - {axis}.lo) / {m}, 0), 0)"


@query("a18_density_2d", ("sightings",), f"""
WITH ax AS {_axis('lng')}, ay AS {_axis('lat')},
p AS (SELECT {_node('ax', 'lng', 127)} AS px, {_node('ay', 'lat', 127)} AS py FROM sightings, ax, ay),
f AS (SELECT px, py, LEAST(FLOOR(px), 126) AS i, LEAST(FLOOR(py), 126) AS j FROM p),
mass AS (SELECT i + di.d AS i, j + dj.d AS j, SUM((CASE WHEN di.d = 0 THEN 1 - (px - i) ELSE px - i END) *
    (CASE WHEN dj.d = 0 THEN 1 - (py - j) ELSE py - j END)) AS w FROM f, range(0, 2) di(d), range(0, 2) dj(d) GROUP BY 1, 2)
SELECT {R('ax.lo + gx * (ax.hi - ax.lo) / 24')} AS x, {R('ay.lo + gy * (ay.hi - ay.lo) / 24')} AS y, {R('''SUM(w *
  exp(-0.5 * pow((ax.lo + gx * (ax.hi - ax.lo) / 24 - (ax.lo + i * (ax.hi - ax.lo) / 127)) / ax.h, 2)) / (ax.h * sqrt(2 * pi())) *
  exp(-0.5 * pow((ay.lo + gy * (ay.hi - ay.lo) / 24 - (ay.lo + j * (ay.hi - ay.lo) / 127)) / ay.h, 2)) / (ay.h * sqrt(2 * pi()))) / ANY_VALUE(ax.n)''')} AS density
FROM mass, ax, ay, range(0, 25) v(gx), range(0, 25) u(gy) GROUP BY gx, gy, ax.lo, ax.hi, ay.lo, ay.hi""")
def _(t):
    d = A.density_2d(t.sightings, "lng", "lat")
    return d.select(*[r(c).alias(c) for c in ("x", "y", "density")])


@query("a19_screen_grid", ("sightings",), """
SELECT CAST(FLOOR(lng / CAST(0.1 AS DOUBLE)) AS BIGINT) AS gx, CAST(FLOOR(lat / CAST(0.1 AS DOUBLE)) AS BIGINT) AS gy,
  CAST(SUM(how_many) AS BIGINT) AS weight FROM sightings GROUP BY 1, 2""")
def _(t):
    return A.screen_grid(t.sightings, "lng", "lat", "how_many", 0.1).select(big("gx").alias("gx"), big("gy").alias("gy"), big("weight").alias("weight"))


# -- pairs -----------------------------------------------------------------------------------

@query("a30_weighted_pairs", ("first_rows",), """
WITH f AS (SELECT *, strftime(observation_date, '%Y-%m') AS ym FROM first_rows)
SELECT a.ym, a.common_name AS item1, b.common_name AS item2,
  CASE WHEN COUNT(*) = COUNT(a.w + b.w) THEN SUM(CASE WHEN b.w > 0 THEN a.w ELSE 0 END) END AS n
FROM f a JOIN f b ON a.ym = b.ym AND a.observation_event_id = b.observation_event_id AND a.common_name < b.common_name GROUP BY 1, 2, 3""")
def _(t):
    rows = t.top2.withColumn("ym", F.date_format("observation_date", "yyyy-MM"))
    return P.pairwise_count(rows, "common_name", "observation_event_id", "observation_count", KEEP_ORDER, ["ym"], upper=False)


@query("a30_weighted_pairs_both_ways", ("first_rows",), """
SELECT a.common_name AS item1, b.common_name AS item2, SUM(CASE WHEN b.w > 0 THEN a.w ELSE 0 END) AS n
FROM first_rows a JOIN first_rows b ON a.observation_event_id = b.observation_event_id AND a.common_name <> b.common_name
WHERE a.w IS NOT NULL AND b.w IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return P.pairwise_count(t.top2, "common_name", "observation_event_id", "observation_count", KEEP_ORDER, null_weight="skip")


@query("a31_pair_count", ("first_rows",), """
SELECT a.common_name AS item1, b.common_name AS item2, CAST(COUNT(*) AS DOUBLE) AS n
FROM first_rows a JOIN first_rows b ON a.observation_event_id = b.observation_event_id AND a.common_name < b.common_name GROUP BY 1, 2""")
def _(t):
    return P.pairwise_count(t.top2, "common_name", "observation_event_id", upper=False)


@query("a32_phi", ("phi",), f"SELECT item1, item2, {R('correlation')} AS correlation FROM phi")
def _(t):
    return t.phi.withColumn("correlation", r("correlation"))


@query("a32_best_partners", ("phi",), f"""
SELECT item1, item2, {R('correlation')} AS correlation, rn AS "rank" FROM (SELECT *, row_number() OVER (
  PARTITION BY item1 ORDER BY correlation DESC, item2) AS rn FROM phi WHERE correlation IS NOT NULL AND item1 IN ('Brand#4', 'Brand#7'))
WHERE rn <= 10""")
def _(t):
    d = best_partners(t.clean, t.protocols, ["Brand#4", "Brand#7"])
    return d.select("item1", "item2", r("correlation").alias("correlation"), big("rank").alias("rank"))


@query("a33_phi_per_stratum", ("clean",), f"""
WITH r AS (SELECT DISTINCT protocol_type AS p, common_name AS c, observation_event_id AS e FROM clean),
s AS (SELECT p, c, COUNT(*) AS k FROM r GROUP BY 1, 2), nn AS (SELECT p, COUNT(DISTINCT e) AS tot FROM r GROUP BY 1),
j AS (SELECT a.p, a.c AS i1, b.c AS i2, COUNT(*) AS n11 FROM r a JOIN r b ON a.p = b.p AND a.e = b.e AND a.c < b.c GROUP BY 1, 2, 3)
SELECT a.p AS protocol_type, a.c AS item1, b.c AS item2, {R('''CASE WHEN a.k = tot OR b.k = tot THEN NULL ELSE (tot * COALESCE(n11, 0) - a.k * b.k) /
  sqrt(CAST(a.k AS DOUBLE) * (tot - a.k) * b.k * (tot - b.k)) END''')} AS correlation
FROM s a JOIN s b ON a.p = b.p AND a.c < b.c JOIN nn ON nn.p = a.p LEFT JOIN j ON j.p = a.p AND j.i1 = a.c AND j.i2 = b.c""")
def _(t):
    d = P.pairwise_phi(t.clean, "common_name", "observation_event_id", ["protocol_type"], upper=False)
    return d.withColumn("correlation", r("correlation"))


@query("a34_correlation_gap", ("phi",), f"""
SELECT item2, {R("MAX(CASE WHEN item1 = 'Brand#4' THEN correlation END)")} AS corr_a, {R("MAX(CASE WHEN item1 = 'Brand#7' THEN correlation END)")} AS corr_b,
  {R("abs(MAX(CASE WHEN item1 = 'Brand#4' THEN correlation END) - MAX(CASE WHEN item1 = 'Brand#7' THEN correlation END))")} AS corr_diff
FROM phi WHERE item1 IN ('Brand#4', 'Brand#7') GROUP BY 1""")
def _(t):
    d = P.correlation_gap(t.phi, "Brand#4", "Brand#7")
    return d.select("item2", *[r(c).alias(c) for c in ("corr_a", "corr_b", "corr_diff")])
