"""Column selection, reshaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.names import clean_names
from ..operators import reshape as S
from ..operators.aggregates import rank_by_frequency, rank_by_summary
from ..operators.relational import semi_join, with_group_stats
from .flows import scaled_tiles
from .registry import R, big, query, r, text

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


@query("p01_select", ("obs",), "SELECT common_name, checklist_id, protocol_type FROM obs")
def _(t):
    return t.obs.select("common_name", "checklist_id", "protocol_type")


@query("p02_drop", (), "SELECT * EXCLUDE (l_shipdate, l_returnflag, l_linestatus) FROM lineitem")
def _(t):
    return t.lineitem.drop("l_shipdate", "l_returnflag", "l_linestatus")


@query("p03_select_contains", ("obs",), """
SELECT checklist_id, observer_id, CAST(observation_date AS STRING) AS observation_date, time_observations_started, observation_count
FROM obs""")
def _(t):
    d = S.select_matching(t.obs, "obs", ["checklist_id"])
    return d.withColumn("observation_date", text("observation_date"))


@query("p04_select_from_names", ("tiles_ok",), f"""
SELECT x, y, species_name AS name, {R('rel_abundance')} AS value FROM tiles_ok
WHERE species_name IN (SELECT species_name FROM tiles_ok GROUP BY 1 HAVING AVG(rel_abundance) > 5.0)""")
def _(t):
    mean = t.tiles_ok.groupBy("species_name").agg(F.avg("rel_abundance").alias("m"))
    wanted = S.distinct_values(mean.where("m > 5.0"), "species_name")
    wide = S.wider(t.tiles_ok, ["x", "y"], "species_name", "rel_abundance")
    wide = wide.select("x", "y", *[F.col(f"`{c}`") for c in wanted])
    return S.longer(wide, ["x", "y"]).where(F.col("value").isNotNull()).withColumn("value", r("value"))


@query("p05_rename", (), "SELECT n_nationkey AS id, n_name AS \"from\", n_regionkey AS \"to\" FROM nation")
def _(t):
    by_name = t.nation.withColumnsRenamed({"n_nationkey": "id"})
    return by_name.toDF("id", "from", "to")


@query("p06_clean_names", ("obs",), """
SELECT common_name, checklist_id AS sampling_event_identifier, protocol_type AS com_name, locality AS cluster, line_no AS cluster_2 FROM obs""")
def _(t):
    raw = t.obs.select("common_name", "checklist_id", "protocol_type", "locality", "line_no").toDF(
        "COMMON NAME", "Sampling Event Identifier", "comName", ".cluster", "Cluster")
    return clean_names(raw)


@query("p07_sentence_names", ("sightings",), """
SELECT com_name AS "Common name", CAST(SUM(how_many) AS BIGINT) AS "Observation count" FROM sightings GROUP BY 1""")
def _(t):
    d = t.sightings.groupBy(F.col("com_name").alias("common_name")).agg(big(F.sum("how_many")).alias("observation_count"))
    return clean_names(d, case="sentence")


@query("p08_mutate", ("obs",), """
SELECT checklist_id, common_name, line_no, line_part, line_qty * 2 AS twice, line_qty * 2 + 1 AS more FROM obs""")
def _(t):
    d = t.obs.select("checklist_id", "common_name", "line_no", "line_part", "line_qty")
    return d.withColumn("twice", F.col("line_qty") * 2).withColumn("more", F.col("twice") + 1).drop("line_qty")


@query("p09_map_columns", ("obs",), """
SELECT checklist_id, line_no, line_part, COALESCE(time_observations_started, 'NA') AS time_observations_started,
  COALESCE(observer_id, 'NA') AS observer_id, COALESCE(locality, 'NA') AS locality FROM obs""")
def _(t):
    names = ["observer_id", "locality", "time_observations_started"]
    return S.map_columns(t.obs.select("checklist_id", "line_no", "line_part", *names), names, V.null_to_text)


@query("p10_constant", (), "SELECT c_custkey, c_name, 'PA' AS state FROM customer")
def _(t):
    return t.customer.select("c_custkey", "c_name", F.lit("PA").alias("state"))


@query("p11_longer", (), """
SELECT l_orderkey, l_linenumber, l_partkey, name, value FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM lineitem)
UNPIVOT INCLUDE NULLS (value FOR name IN (l_quantity, l_discount, l_tax))""")
def _(t):
    keep = ["l_orderkey", "l_linenumber", "l_partkey"]
    return S.longer(t.lineitem.select(*keep, "l_quantity", "l_discount", "l_tax"), keep)


@query("p12_wider_prefix", ("seasonal",), "SELECT common_name, " + ", ".join(
    f"{R(f'MAX(CASE WHEN month_no = {i + 1} THEN value END)')} AS month_{m}" for i, m in enumerate(MONTHS))
    + " FROM seasonal GROUP BY 1")
def _(t):
    label = F.lower(F.monthname(F.make_date(F.lit(2020), F.col("month_no"), F.lit(1))))
    long = t.seasonal.select("common_name", label.alias("month"), r("value").alias("value"))
    return S.wider(long, ["common_name"], "month", "value", MONTHS, prefix="month_")


@query("p13_wider_by_rank", ("clean",), """
WITH ranked AS (SELECT protocol_type, common_name, row_number() OVER (PARTITION BY protocol_type ORDER BY COUNT(*) DESC, common_name) AS rn
  FROM clean GROUP BY 1, 2)
SELECT rn AS "rank", MAX(CASE WHEN protocol_type = '1-URGENT' THEN common_name END) AS "1-URGENT",
  MAX(CASE WHEN protocol_type = '2-HIGH' THEN common_name END) AS "2-HIGH",
  MAX(CASE WHEN protocol_type = '5-LOW' THEN common_name END) AS "5-LOW" FROM ranked
WHERE protocol_type IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1""")
def _(t):
    n = t.clean.groupBy("protocol_type", "common_name").agg(F.count(F.lit(1)).alias("n"))
    keep = ["1-URGENT", "2-HIGH", "5-LOW"]
    d = S.wider_by_rank(n.where(F.col("protocol_type").isin(keep)), "protocol_type", "common_name",
                        [F.col("n").desc(), F.col("common_name")], keep)
    return d.withColumn("rank", big("rank"))


@query("p14_separate", (), """
SELECT o_orderkey, regexp_split_to_array(o_orderpriority, '[^A-Za-z0-9]+')[1] AS month,
  regexp_split_to_array(o_orderpriority, '[^A-Za-z0-9]+')[2] AS week,
  regexp_split_to_array(o_orderpriority, '[^A-Za-z0-9]+')[3] AS rest FROM orders""")
def _(t):
    return S.separate(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["month", "week", "rest"])


@query("p15_nest_unnest", ("tiles",), f"""
SELECT species_name, COUNT(*) AS n, {R('SUM(rel_abundance)')} AS total, MIN(x) AS x0, MAX(y) AS y1 FROM tiles GROUP BY 1""")
def _(t):
    back = S.unnest(S.nest(t.tiles, ["species_name"], cell_rows=64))
    return back.groupBy("species_name").agg(F.count(F.lit(1)).alias("n"), r(F.sum("rel_abundance")).alias("total"),
                                            F.min("x").alias("x0"), F.max("y").alias("y1"))


@query("p16_pull", ("sightings",), """
SELECT species_code, com_name, obs_dt, how_many FROM sightings
WHERE species_code IN (SELECT species_code FROM sightings WHERE how_many > 100)""")
def _(t):
    pulled = t.sightings.where("how_many > 100").select("species_code").distinct()
    return semi_join(t.sightings, pulled, ["species_code"]).select("species_code", "com_name", "obs_dt", "how_many")


# -- scalar functions ------------------------------------------------------------------------

@query("c01_sentinel_to_null", ("obs",), """
SELECT checklist_id, line_no, line_part, CASE WHEN contains(observation_count, 'X') THEN NULL
  ELSE TRY_CAST(observation_count AS DOUBLE) END AS observation_count FROM obs""")
def _(t):
    return t.obs.select("checklist_id", "line_no", "line_part", V.count_or_null("observation_count").alias("observation_count"))


@query("c02_join_text", ("obs",), """
SELECT checklist_id, line_no, line_part, observer_id || locality || CAST(observation_date AS STRING) || time_observations_started AS plain,
  observer_id || '-' || locality || '-' || COALESCE(time_observations_started, 'NA') AS dashed FROM obs""")
def _(t):
    return t.obs.select(
        "checklist_id", "line_no", "line_part",
        V.join_text("observer_id", "locality", "observation_date", "time_observations_started").alias("plain"),
        V.join_text("observer_id", "locality", V.null_to_text("time_observations_started"), sep="-").alias("dashed"))


@query("c03_null_to_text", ("obs",), """
SELECT checklist_id, line_no, line_part, COALESCE(time_observations_started, 'NA') AS started FROM obs""")
def _(t):
    return t.obs.select("checklist_id", "line_no", "line_part", V.null_to_text("time_observations_started").alias("started"))


@query("c04_regex_replace", (), """
SELECT o_orderkey, regexp_replace(regexp_replace('X' || strftime(o_orderdate, '%Y.%m.%d'), '^X', ''), '\\.', '-', 'g') AS day FROM orders""")
def _(t):
    raw = F.concat(F.lit("X"), F.date_format("o_orderdate", "yyyy.MM.dd"))
    return t.orders.select("o_orderkey", F.regexp_replace(V.remove_pattern(raw, "^X"), r"\.", "-").alias("day"))


@query("c05_regex_extract", (), """
SELECT event_id, NULLIF(regexp_extract(props, '[0-9]{2}', 0), '') AS two_digits FROM events""")
def _(t):
    return t.events.select("event_id", V.extract_pattern("props", "[0-9]{2}").alias("two_digits"))


@query("c06_parse_number", (), """
SELECT event_id, TRY_CAST(NULLIF(regexp_extract(props, '-?[0-9][0-9,]*\\.?[0-9]*', 0), '') AS DOUBLE) AS k FROM events""")
def _(t):
    return t.events.select("event_id", V.parse_number("props").alias("k"))


@query("c07_parse_date", ("sightings",), """
SELECT species_code, com_name, how_many, CAST(TRY_CAST(CASE WHEN how_many IS NULL THEN 'never' ELSE obs_dt END AS DATE) AS STRING) AS day FROM sightings""")
def _(t):
    raw = F.when(F.col("how_many").isNull(), F.lit("never")).otherwise(F.col("obs_dt"))
    return t.sightings.select("species_code", "com_name", "how_many", text(V.parse_date(raw)).alias("day"))


@query("c08_date_from_month", (), """
SELECT o_orderkey, CAST(make_date(2019, month(o_orderdate), 1) AS STRING) AS first_day FROM orders""")
def _(t):
    name = F.date_format("o_orderdate", "MMMM")
    return t.orders.select("o_orderkey", text(V.date_from_month_name(name, F.lit(2019))).alias("first_day"))


@query("c09_c11_c12_date_parts", (), """
SELECT o_orderkey, year(o_orderdate) AS year, dayofyear(o_orderdate) AS yday, weekofyear(o_orderdate) AS isoweek FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", big(F.year("o_orderdate")).alias("year"), big(F.dayofyear("o_orderdate")).alias("yday"),
                           big(F.weekofyear("o_orderdate")).alias("isoweek"))


@query("c10_month_label", (), """
SELECT strftime(o_orderdate, '%b') AS label, month(o_orderdate) AS month_no, COUNT(*) AS n FROM orders GROUP BY 1, 2""")
def _(t):
    return t.orders.groupBy(V.month_label("o_orderdate").alias("label"), big(F.month("o_orderdate")).alias("month_no")).agg(
        F.count(F.lit(1)).alias("n"))


@query("c13_conditional", ("sightings",), """
SELECT species_code, obs_dt, CASE WHEN how_many IS NULL THEN 'unknown' WHEN how_many >= 50 THEN 'many' ELSE 'few' END AS size,
  CASE WHEN com_name = 'click' THEN com_name END AS only_click FROM sightings""")
def _(t):
    n = F.col("how_many")
    return t.sightings.select("species_code", "obs_dt",
                              F.when(n.isNull(), "unknown").when(n >= 50, "many").otherwise("few").alias("size"),
                              F.when(F.col("com_name") == "click", F.col("com_name")).alias("only_click"))


@query("c14_log_abs_round", (), f"""
SELECT s_suppkey, {R('log10(abs(s_acctbal) + 1)')} AS size, CAST(round_even(s_acctbal, 1) AS DOUBLE) AS tenth FROM supplier""")
def _(t):
    b = F.col("s_acctbal")
    return t.supplier.select("s_suppkey", r(F.log10(F.abs(b) + 1)).alias("size"), V.round_even(b, 1).alias("tenth"))


@query("c15_nan_infinite", (), """
SELECT event_id, value = 0 AS nan, value > 100 AS infinite, CASE WHEN value > 0 THEN round(log10(value), 6) + 0.0 WHEN value = 0 THEN 0 END AS finite FROM events""")
def _(t):
    v = F.col("value")
    odd = F.when(v == 0, F.lit(float("nan"))).when(v > 100, F.lit(float("inf"))).otherwise(v)
    return t.events.select("event_id", F.isnan(odd).alias("nan"), V.is_infinite(odd).alias("infinite"),
                           r(V.log10_finite("value")).alias("finite"))


@query("c16_flag", ("obs",), """
SELECT checklist_id, line_no, line_part, year(observation_date) >= 1998 AS recent, common_name IN ('Brand#4', 'Brand#7') AS target FROM obs""")
def _(t):
    return t.obs.select("checklist_id", "line_no", "line_part", V.since_year("observation_date", 1998).alias("recent"),
                        F.col("common_name").isin("Brand#4", "Brand#7").alias("target"))


@query("c17_rank_by_frequency", ("clean",), """
SELECT checklist_id, line_no, line_part, c.protocol_type, k.rn AS "rank" FROM clean c JOIN (
  SELECT protocol_type, row_number() OVER (ORDER BY COUNT(*) DESC, protocol_type) AS rn FROM clean GROUP BY 1) k USING (protocol_type)""")
def _(t):
    return rank_by_frequency(t.clean.select("checklist_id", "line_no", "line_part", "protocol_type"), "protocol_type")


@query("c18_rank_by_summary", ("cells",), """
SELECT c.cell, CAST(c.week AS STRING) AS week, k.rn AS "rank" FROM cells c JOIN (
  SELECT cell, row_number() OVER (ORDER BY round(AVG(abundance), 9), cell) AS rn FROM cells GROUP BY 1) k USING (cell)""")
def _(t):
    d = rank_by_summary(t.cells, "cell", F.round(F.avg("abundance"), 9))
    return d.select("cell", text("week").alias("week"), "rank")


@query("c19_order_of_appearance", ("clean",), """
SELECT common_name, row_number() OVER (ORDER BY MIN(checklist_id * 1000000 + line_part), common_name) AS "rank",
  CASE common_name WHEN 'Brand#5' THEN 1 WHEN 'Brand#2' THEN 2 ELSE 3 END AS listed FROM clean GROUP BY 1""")
def _(t):
    place = F.col("checklist_id") * 1000000 + F.col("line_part")
    d = rank_by_summary(t.clean.select("common_name", place.alias("place")), "common_name", F.min("place"))
    listed = F.when(F.col("common_name") == "Brand#5", 1).when(F.col("common_name") == "Brand#2", 2).otherwise(3)
    return d.select("common_name", "rank", listed.alias("listed")).distinct()


@query("c20_links", ("sightings",), """
SELECT DISTINCT species_code, 'https://example.org/species/' || species_code AS link,
  '[' || com_name || '](' || 'https://example.org/species/' || species_code || ')' AS hyperlink FROM sightings""")
def _(t):
    link = F.concat(F.lit("https://example.org/species/"), F.col("species_code"))
    return t.sightings.select("species_code", link.alias("link"), V.markdown_link("com_name", link).alias("hyperlink")).distinct()


@query("c21_as_text", (), "SELECT CAST(o_orderkey AS STRING) AS id, CAST(year(o_orderdate) AS STRING) AS year FROM orders")
def _(t):
    return t.orders.select(text("o_orderkey").alias("id"), text(F.year("o_orderdate")).alias("year"))


@query("w10_w12_scalings", ("tiles_ok",), f"""
SELECT species_name, x, y,
  {R('CASE WHEN sd > 0 THEN (rel_abundance - m) / sd END')} AS scaled, {R('u')} AS rescaled, {R('log10(u + 1)')} AS rescaled_log10
FROM (SELECT *, CASE WHEN hi = lo THEN 0.5 ELSE (rel_abundance - lo) / (hi - lo) END AS u FROM (
  SELECT *, AVG(rel_abundance) OVER w AS m, stddev_samp(rel_abundance) OVER w AS sd, MIN(rel_abundance) OVER w AS lo,
    MAX(rel_abundance) OVER w AS hi FROM tiles_ok WINDOW w AS (PARTITION BY species_name)))""")
def _(t):
    d = scaled_tiles(t.tiles_ok)
    return d.select("species_name", "x", "y", r("scaled").alias("scaled"), r("rescaled").alias("rescaled"),
                    r("rescaled_log10").alias("rescaled_log10"))


@query("w11_rescale_cells", ("cells",), f"""
SELECT cell, CAST(week AS STRING) AS week, {R('CASE WHEN hi = lo THEN 0.5 ELSE (abundance - lo) / (hi - lo) END')} AS rescaled FROM (
  SELECT *, MIN(abundance) OVER w AS lo, MAX(abundance) OVER w AS hi FROM cells WINDOW w AS (PARTITION BY week))""")
def _(t):
    d = with_group_stats(t.cells, ["week"], F.min("abundance").alias("lo"), F.max("abundance").alias("hi"))
    unit = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("abundance") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return d.select("cell", text("week").alias("week"), r(unit).alias("rescaled"))
