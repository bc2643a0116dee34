"""Filters, joins, set operations, sorts, limits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import ordered as O
from ..operators import relational as J
from ..operators import spatial as X
from ..operators.pairwise import pairwise_count
from .registry import R, big, query, r, text

U01 = "(CAST(('0x' || substr(md5('{seed}' || {key}), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0"


def u_sql(key: str, seed: int = 1234) -> str:
    return U01.format(seed=seed, key=f"CAST({key} AS STRING)")


# -- filters ---------------------------------------------------------------------------------

@query("f01_equality", ("obs",), """
SELECT checklist_id, line_no, line_part FROM obs WHERE all_species_reported = 1 AND protocol_type = '2-HIGH'""")
def _(t):
    return t.obs.where((F.col("all_species_reported") == 1) & (F.col("protocol_type") == "2-HIGH")).select(
        "checklist_id", "line_no", "line_part")


@query("f02_membership", ("obs",), "SELECT checklist_id, line_no, line_part FROM obs WHERE common_name IN ('Brand#4', 'Brand#7', 'Brand#9')")
def _(t):
    return t.obs.where(F.col("common_name").isin("Brand#4", "Brand#7", "Brand#9")).select("checklist_id", "line_no", "line_part")


@query("f03_not_in_keep_null", ("obs",), """
SELECT checklist_id, line_no, line_part, time_observations_started AS started FROM obs
WHERE time_observations_started IS NULL OR time_observations_started NOT IN ('1', '2', '3')""")
def _(t):
    return t.obs.where(V.not_in_keep_null("time_observations_started", ["1", "2", "3"])).select(
        "checklist_id", "line_no", "line_part", F.col("time_observations_started").alias("started"))


@query("f04_regex_match", (), "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'red|blue') AND NOT regexp_matches(p_name, 'ring')")
def _(t):
    return t.part.where(F.col("p_name").rlike("red|blue") & ~F.col("p_name").rlike("ring")).select("p_partkey", "p_name")


@query("f05_either_column", ("phi",), f"""
SELECT item1, item2, {R('correlation')} AS correlation FROM phi
WHERE item1 < item2 AND (item1 IN ('Brand#4', 'Brand#7') OR item2 IN ('Brand#4', 'Brand#7'))""")
def _(t):
    s = ["Brand#4", "Brand#7"]
    return t.phi.where((F.col("item1") < F.col("item2")) & (F.col("item1").isin(s) | F.col("item2").isin(s))).select(
        "item1", "item2", r("correlation").alias("correlation"))


@query("f06_date_range", ("effort",), """
SELECT checklist_id, country FROM effort WHERE observation_date >= DATE '1997-01-01' AND country = (SELECT MIN(n_name) FROM nation)
  AND year(observation_date) >= 1998""")
def _(t):
    first = t.nation.agg(F.min("n_name")).scalar()
    return t.effort.where((F.col("observation_date") >= F.lit("1997-01-01").cast("date")) & (F.col("country") == first)
                          & V.since_year("observation_date", 1998)).select("checklist_id", "country")


@query("f07_null_test", ("effort",), "SELECT checklist_id FROM effort WHERE time_observations_started IS NULL")
def _(t):
    return t.effort.where(F.col("time_observations_started").isNull()).select("checklist_id")


@query("f08_drop_missing", ("effort",), """
SELECT checklist_id, observer_id FROM effort WHERE observer_id IS NOT NULL AND time_observations_started IS NOT NULL""")
def _(t):
    return V.drop_missing(t.effort, "observer_id", "time_observations_started").select("checklist_id", "observer_id")


@query("f09_threshold", ("phi",), f"SELECT item1, item2, {R('correlation')} AS correlation FROM phi WHERE abs(correlation) > 0.005")
def _(t):
    return t.phi.where(F.abs("correlation") > 0.005).select("item1", "item2", r("correlation").alias("correlation"))


@query("f10_group_size", ("tiles",), f"""
SELECT species_name, x, y, {R('rel_abundance')} AS rel_abundance FROM (
  SELECT *, COUNT(*) OVER (PARTITION BY species_name, x, y) AS n FROM tiles) WHERE n > 1""")
def _(t):
    d = J.group_size_filter(t.tiles, ["species_name", "x", "y"], 2)
    return d.withColumn("rel_abundance", r("rel_abundance"))


@query("f11_group_maximum", ("cells",), f"""
SELECT cell, CAST(week AS STRING) AS week, {R('abundance')} AS abundance FROM (
  SELECT *, MAX(abundance) OVER (PARTITION BY cell) AS m FROM cells) WHERE abundance = m""")
def _(t):
    d = J.keep_group_extreme(t.cells, ["cell"], "abundance")
    return d.select("cell", text("week").alias("week"), r("abundance").alias("abundance"))


@query("f12_global_extreme", ("tiles",), f"""
SELECT species_name, x, y, {R('rel_abundance')} AS v FROM tiles
WHERE rel_abundance = (SELECT MAX(rel_abundance) FROM tiles) OR rel_abundance = (SELECT MIN(rel_abundance) FROM tiles)""")
def _(t):
    return J.keep_global_extreme(t.tiles, "rel_abundance").unionByName(
        J.keep_global_extreme(t.tiles, "rel_abundance", smallest=True)).select("species_name", "x", "y", r("rel_abundance").alias("v"))


@query("f13_last_of_group", ("clean",), """
SELECT common_name, checklist_id, line_no, line_part FROM (
  SELECT *, MAX(observation_date) OVER (PARTITION BY common_name) AS m FROM clean) WHERE observation_date = m""")
def _(t):
    return J.keep_last(t.clean, ["common_name"], "observation_date").select("common_name", "checklist_id", "line_no", "line_part")


@query("f14_between", ("tiles_ok",), f"""
SELECT species_name, x, y, {R('rel_abundance')} AS v FROM (SELECT *, AVG(rel_abundance) OVER w AS m, stddev_samp(rel_abundance) OVER w AS sd
  FROM tiles_ok WINDOW w AS (PARTITION BY species_name)) WHERE rel_abundance BETWEEN m - sd AND m + sd AND sd > 0""")
def _(t):
    d = J.with_group_stats(t.tiles_ok, ["species_name"], F.avg("rel_abundance").alias("m"), F.stddev_samp("rel_abundance").alias("sd"))
    return d.where(F.col("rel_abundance").between(F.col("m") - F.col("sd"), F.col("m") + F.col("sd")) & (F.col("sd") > 0)).select(
        "species_name", "x", "y", r("rel_abundance").alias("v"))


@query("f15_no_nan", (), "SELECT COUNT(*) AS rows_read, COUNT(CASE WHEN isnan(value) THEN 1 END) = 0 AS no_nan FROM events")
def _(t):
    return t.events.agg(F.count(F.lit(1)).alias("rows_read"), (F.count(F.when(F.isnan("value"), 1)) == 0).alias("no_nan"))


# -- joins -----------------------------------------------------------------------------------

TOP2 = "SELECT protocol_type FROM clean GROUP BY 1 ORDER BY COUNT(*) DESC, protocol_type LIMIT 2"


@query("j01_semi_join", ("clean",), f"SELECT common_name, COUNT(*) AS species_count FROM clean WHERE protocol_type IN ({TOP2}) GROUP BY 1")
def _(t):
    return J.semi_join(t.clean, t.protocols, ["protocol_type"]).groupBy("common_name").agg(F.count(F.lit(1)).alias("species_count"))


@query("j02_semi_join_key", ("clean",), """
SELECT checklist_id, line_no, line_part, common_name FROM clean WHERE common_name IN (
  SELECT common_name FROM clean GROUP BY 1 ORDER BY COALESCE(SUM(observation_count), 0) DESC, common_name LIMIT 10)""")
def _(t):
    best = t.clean.groupBy("common_name").agg(V.sum_or_zero("observation_count").alias("n"))
    best = O.top_k(best, [F.col("n").desc(), "common_name"], 10)
    return J.semi_join(t.clean, best, ["common_name"]).select("checklist_id", "line_no", "line_part", "common_name")


@query("j03_anti_join", ("tiles",), f"""
SELECT species_name, x, y, {R('rel_abundance')} AS v FROM tiles WHERE species_name NOT IN (
  SELECT species_name FROM tiles GROUP BY species_name, x, y HAVING COUNT(*) > 1)""")
def _(t):
    twice = J.group_size_filter(t.tiles, ["species_name", "x", "y"]).select("species_name").distinct()
    return J.anti_join(t.tiles, twice, ["species_name"]).select("species_name", "x", "y", r("rel_abundance").alias("v"))


@query("j04_inner_join_cells", ("cells",), f"""
SELECT c.cell, CAST(c.week AS STRING) AS week, {R('c.abundance')} AS abundance, {R('b.m')} AS mean_abundance FROM cells c JOIN (
  SELECT cell, AVG(abundance) AS m FROM cells GROUP BY 1 ORDER BY round(AVG(abundance), 6) DESC, cell LIMIT 100) b USING (cell)""")
def _(t):
    best = t.cells.groupBy("cell").agg(F.avg("abundance").alias("mean_abundance"))
    best = O.top_k(best, [F.round("mean_abundance", 6).desc(), "cell"], 100)
    return J.inner_join(t.cells, best, ["cell"]).select("cell", text("week").alias("week"), r("abundance").alias("abundance"),
                                                        r("mean_abundance").alias("mean_abundance"))


@query("j05_left_join", ("tiles",), f"""
SELECT t.species_name, t.x, t.y, {R('s.m')} AS m FROM tiles t LEFT JOIN (
  SELECT species_name, AVG(rel_abundance) AS m FROM tiles GROUP BY 1 HAVING AVG(rel_abundance) > 5.2) s USING (species_name)""")
def _(t):
    s = t.tiles.groupBy("species_name").agg(F.avg("rel_abundance").alias("m")).where("m > 5.2")
    return J.left_join(t.tiles, s, ["species_name"]).select("species_name", "x", "y", r("m").alias("m"))


@query("j06_left_join_two_names", ("strong", "clean"), """
SELECT n.name, COUNT(c.common_name) AS species_count FROM (SELECT src AS name FROM strong UNION SELECT dst FROM strong) n
LEFT JOIN clean c ON n.name = c.common_name GROUP BY 1""")
def _(t):
    from ..operators.graph import endpoints

    counts = t.clean.groupBy("common_name").agg(F.count(F.lit(1)).alias("species_count"))
    n = endpoints(t.strong)
    return n.join(counts, F.col("name") == F.col("common_name"), "left").select("name", F.coalesce("species_count", F.lit(0)).alias("species_count"))


@query("j07_two_columns_one_key", ("pairs",), """
SELECT p.item1, p.item2, t.name FROM (SELECT item1, item2 FROM pairs UNION ALL SELECT DISTINCT item1, item1 FROM pairs) p
LEFT JOIN (SELECT DISTINCT item1 AS name FROM pairs WHERE item1 < 'Brand#2') t ON p.item1 = t.name AND p.item2 = t.name""")
def _(t):
    p = t.pairs.select("item1", "item2")
    p = p.unionByName(p.select("item1", F.col("item1").alias("item2")).distinct())
    flagged = t.pairs.where(F.col("item1") < "Brand#2").select(F.col("item1").alias("name")).distinct()
    return p.join(flagged, (F.col("item1") == F.col("name")) & (F.col("item2") == F.col("name")), "left")


CROSS = "(e.y1 > s.lat) <> (e.y2 > s.lat) AND s.lng < (e.x2 - e.x1) * (s.lat - e.y1) / (e.y2 - e.y1) + e.x1"


@query("j08_points_within", ("sightings", "edges"), f"""
WITH spots AS (SELECT DISTINCT lng, lat FROM sightings),
inside AS (SELECT DISTINCT lng, lat FROM (SELECT s.lng, s.lat, e.name FROM spots s JOIN edges e ON {CROSS}
  GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1))
SELECT com_name, COUNT(*) AS n, CAST(SUM(how_many) AS BIGINT) AS total FROM sightings JOIN inside USING (lng, lat) GROUP BY 1""")
def _(t):
    return X.points_in(t.sightings, t.regions, "lng", "lat").groupBy("com_name").agg(
        F.count(F.lit(1)).alias("n"), big(F.sum("how_many")).alias("total"))


@query("j09_points_intersect", ("sightings", "edges"), f"""
WITH spots AS (SELECT DISTINCT lng, lat FROM sightings),
inside AS (SELECT s.lng, s.lat, e.name FROM spots s JOIN edges e ON {CROSS} GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1)
SELECT i.name, COUNT(*) AS n FROM sightings JOIN inside i USING (lng, lat) GROUP BY 1""")
def _(t):
    d = X.with_polygons(t.sightings, t.regions, "lng", "lat", boundary=True)
    return d.select(F.explode("inside").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("j10_complete", ("sightings",), """
SELECT s.species_code, e.com_name, COUNT(x.com_name) AS n FROM (SELECT DISTINCT species_code FROM sightings) s
CROSS JOIN (SELECT DISTINCT com_name FROM sightings) e
LEFT JOIN sightings x ON x.species_code = s.species_code AND x.com_name = e.com_name GROUP BY 1, 2""")
def _(t):
    n = t.sightings.groupBy("species_code", "com_name").agg(F.count(F.lit(1)).alias("n"))
    return J.complete_grid(n, "species_code", n.select("com_name"), "com_name", {"n": 0})


@query("j11_bind_by_key", ("cells",), f"""
SELECT a.cell, {R('a.mean_abundance')} AS mean_abundance, b.weeks FROM (SELECT cell, AVG(abundance) AS mean_abundance FROM cells GROUP BY 1) a
JOIN (SELECT cell, COUNT(*) AS weeks FROM cells GROUP BY 1) b USING (cell)""")
def _(t):
    a = t.cells.groupBy("cell").agg(r(F.avg("abundance")).alias("mean_abundance"))
    b = t.cells.groupBy("cell").agg(F.count(F.lit(1)).alias("weeks"))
    return J.bind_by_key(a, b, ["cell"])


@query("j12_self_join_on_feature", ("obs",), """
SELECT a.common_name AS item1, b.common_name AS item2, CAST(COUNT(*) AS DOUBLE) AS n
FROM (SELECT DISTINCT common_name, locality FROM obs) a JOIN (SELECT DISTINCT common_name, locality FROM obs) b
  ON a.locality = b.locality AND a.common_name < b.common_name GROUP BY 1, 2""")
def _(t):
    return pairwise_count(t.obs, "common_name", "locality", upper=False)


# -- set operations --------------------------------------------------------------------------

@query("u01_bind_rows", (), """
SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""")
def _(t):
    a = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
                          F.col("c_mktsegment").alias("segment"))
    return J.bind_rows(a, b)


@query("u02_many_species_one_scan", ("tiles",), f"""
SELECT species_name, x, y, {R('rel_abundance')} AS v FROM tiles WHERE species_name IN ('Brand#4', 'Brand#7', 'Brand#9')""")
def _(t):
    return t.tiles.where(F.col("species_name").isin("Brand#4", "Brand#7", "Brand#9")).select(
        "species_name", "x", "y", r("rel_abundance").alias("v"))


@query("u03_fill_null", ("sightings",), "SELECT com_name, species_code, obs_dt, COALESCE(how_many, 0) AS how_many FROM sightings")
def _(t):
    return t.sightings.fillna({"how_many": 0}).select("com_name", "species_code", "obs_dt", "how_many")


# -- sorts and limits ------------------------------------------------------------------------

@query("l01_sort", ("obs",), """
SELECT checklist_id, line_no, line_part, time_observations_started AS started FROM obs
ORDER BY protocol_type, observation_date DESC, time_observations_started NULLS LAST""")
def _(t):
    return t.obs.orderBy(F.col("protocol_type").asc_nulls_last(), F.col("observation_date").desc_nulls_last(),
                         F.col("time_observations_started").asc_nulls_last()).select(
        "checklist_id", "line_no", "line_part", F.col("time_observations_started").alias("started"))


@query("l02_top_k", ("clean",), """
SELECT common_name, COALESCE(SUM(observation_count), 0) AS n FROM clean GROUP BY 1 ORDER BY n DESC, common_name LIMIT 10""")
def _(t):
    n = t.clean.groupBy("common_name").agg(V.sum_or_zero("observation_count").alias("n"))
    return O.top_k(n, [F.col("n").desc(), "common_name"], 10)


@query("l03_top_k_per_group", ("phi",), f"""
SELECT item1, item2, {R('correlation')} AS correlation FROM (SELECT *, row_number() OVER (
  PARTITION BY item1 ORDER BY round(correlation, 9) DESC, item2) AS rn FROM phi WHERE correlation IS NOT NULL) WHERE rn <= 10""")
def _(t):
    d = O.top_k_per_group(t.phi.where(F.col("correlation").isNotNull()), ["item1"], [F.round("correlation", 9).desc(), "item2"], 10)
    return d.withColumn("correlation", r("correlation"))


@query("l04_first_n_in_order", ("cells",), f"""
SELECT cell, CAST(week AS STRING) AS week, {R('abundance')} AS abundance FROM (
  SELECT *, row_number() OVER (PARTITION BY cell ORDER BY week) AS rn FROM cells) WHERE rn <= 2""")
def _(t):
    d = O.top_k_per_group(t.cells, ["cell"], ["week"], 2)
    return d.select("cell", text("week").alias("week"), r("abundance").alias("abundance"))


@query("l05_top_n_ties", (), """
SELECT p_brand, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS k FROM part) WHERE k <= 5""")
def _(t):
    return O.top_n_with_ties(t.part.select("p_brand", "p_size"), "p_size", 5)


@query("l06_top_frac_ties", (), """
SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS k, COUNT(*) OVER () AS n FROM part) WHERE k <= 0.5 * n""")
def _(t):
    return O.top_frac_with_ties(t.part.select("p_partkey", "p_size"), "p_size", 0.5)


@query("l07_head", ("effort",), """
SELECT observer_id, CAST(observation_date AS STRING) AS day, time_observations_started AS started, COUNT(*) AS n FROM effort
WHERE time_observations_started IS NOT NULL GROUP BY 1, 2, 3 ORDER BY n DESC, observer_id, day, started LIMIT 100""")
def _(t):
    d = V.drop_missing(t.effort, "observer_id", "observation_date", "time_observations_started")
    n = d.groupBy("observer_id", text("observation_date").alias("day"), F.col("time_observations_started").alias("started")).agg(
        F.count(F.lit(1)).alias("n"))
    return O.top_k(n, [F.col("n").desc(), "observer_id", "day", "started"], 100)


# -- samples ---------------------------------------------------------------------------------

@query("n01_sample", ("effort",), f"SELECT checklist_id, country FROM effort ORDER BY {u_sql('checklist_id')}, checklist_id LIMIT 5000")
def _(t):
    return O.sample_rows(t.effort.select("checklist_id", "country"), 5000, ["checklist_id"])


@query("n02_sample_per_group", ("effort",), f"""
SELECT country, checklist_id FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY {u_sql('checklist_id')}, checklist_id) AS rn
  FROM effort) WHERE rn <= 10""")
def _(t):
    return O.sample_rows_per_group(t.effort.select("country", "checklist_id"), ["country"], 10, ["checklist_id"])


@query("n03_weighted_sample", (), f"""
SELECT o_orderkey FROM orders WHERE o_totalprice > 0 ORDER BY -ln({u_sql('o_orderkey')}) / o_totalprice, o_orderkey LIMIT 1000""")
def _(t):
    return O.weighted_sample(t.orders.select("o_orderkey", "o_totalprice"), 1000, "o_totalprice", ["o_orderkey"]).select("o_orderkey")


@query("n03_weighted_sample_per_group", ("tiles",), f"""
SELECT species_name, x, y FROM (SELECT *, row_number() OVER (PARTITION BY species_name
  ORDER BY -ln({u_sql("species_name || '|' || CAST(x AS STRING) || '|' || CAST(y AS STRING)")}) / rel_abundance, x, y) AS rn
  FROM tiles WHERE rel_abundance > 0) WHERE rn <= 20""")
def _(t):
    return O.weighted_sample(t.tiles, 20, "rel_abundance", ["species_name", "x", "y"], ["species_name"]).select("species_name", "x", "y")
