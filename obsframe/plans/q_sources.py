"""Readers, writers and feeds, on files that Spark writes from the given tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import extract_attr, extract_attr_fast
from ..functions.names import clean_names
from ..functions.values import parse_date, parse_number
from ..operators.relational import semi_join
from ..operators.reshape import select_matching
from ..operators.spatial import edges, points_in
from ..session import scratch_path
from ..sources import grids as GR
from ..sources import records as RC
from ..sources import text as TX
from .q_rows import CROSS
from .registry import R, big, query, r, text

RAW = ["COMMON NAME", "SAMPLING EVENT IDENTIFIER", "OBSERVATION DATE", "OBSERVATION COUNT", "LOCALITY", "ALL SPECIES REPORTED"]
RAW_SCHEMA = ", ".join(f"`{c}` {k}" for c, k in zip(RAW, ["string", "long", "date", "string", "string", "int"]))
SUMMARY = """SELECT common_name, COUNT(*) AS n, CAST(SUM(checklist_id) AS BIGINT) AS ids, COUNT(CASE WHEN observation_count = 'X' THEN 1 END) AS uncounted,
  CAST(MIN(observation_date) AS STRING) AS first_day, COUNT(DISTINCT locality) AS places, CAST(SUM(all_species_reported) AS BIGINT) AS complete
FROM obs GROUP BY 1"""


def raw_obs(t) -> DataFrame:
    """Observation rows under the headers of the text extract."""
    return t.obs.select("common_name", "checklist_id", "observation_date", "observation_count", "locality",
                        "all_species_reported").toDF(*RAW)


def summary(df: DataFrame) -> DataFrame:
    d = clean_names(df)
    return d.groupBy("common_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sampling_event_identifier").alias("ids"),
        F.count(F.when(F.col("observation_count") == "X", 1)).alias("uncounted"),
        text(F.min("observation_date")).alias("first_day"), F.countDistinct("locality").alias("places"),
        big(F.sum("all_species_reported")).alias("complete"))


@query("s01_tab_delimited", ("obs",), SUMMARY)
def _(t):
    path = TX.write_csv(raw_obs(t), scratch_path(t.spark, "tsv"), "\t")
    return summary(TX.read_delimited(t.spark, path, RAW_SCHEMA, "\t"))


@query("s02_other_delimiter", ("obs",), SUMMARY)
def _(t):
    path = TX.write_csv(raw_obs(t), scratch_path(t.spark, "semicolon"), ";")
    return summary(TX.read_delimited(t.spark, path, RAW_SCHEMA, ";"))


def zip_rows(lines: DataFrame, header: str) -> DataFrame:
    """Zip archives as binary rows, one per batch of lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("extract.txt", header + "\n" + "\n".join(pdf["line"]) + "\n")
            yield pd.DataFrame({"content": [buffer.getvalue()]})

    return lines.mapInPandas(run, "content binary")


@query("s03_zip", ("obs",), SUMMARY)
def _(t):
    raw = raw_obs(t)
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in RAW]), {"sep": "\t"})
    return summary(TX.parse_zipped(zip_rows(raw.select(line.alias("line")), "\t".join(RAW)), RAW_SCHEMA))


@query("s04_gzip", ("obs",), SUMMARY)
def _(t):
    path = scratch_path(t.spark, "gzip")
    raw_obs(t).write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)
    return summary(TX.spread(TX.read_delimited(t.spark, path, RAW_SCHEMA, "\t")))


@query("s05_row_limit", (), "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000")
def _(t):
    return TX.first_rows(t.orders.select("o_orderkey", "o_custkey"), 1000, "o_orderkey")


@query("s06_columns_by_name", (), """
SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, COUNT(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' GROUP BY 1""")
def _(t):
    d = select_matching(t.orders, "DATE")
    return d.where(F.col("o_orderdate") > F.lit("1996-01-01").cast("timestamp")).groupBy(
        text(F.col("o_orderdate").cast("date")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("s07_all_text_quotes", (), f"""
SELECT o_orderkey, 'the "' || o_orderpriority || '" one' AS note, CAST(o_orderdate AS DATE)::VARCHAR AS day, o_totalprice AS price FROM orders""")
def _(t):
    note = F.concat(F.lit('the "'), F.col("o_orderpriority"), F.lit('" one'))
    out = t.orders.select("o_orderkey", note.alias("note"), F.col("o_orderdate").cast("date").alias("day"),
                          F.concat(F.lit("USD "), text("o_totalprice")).alias("price"))
    d = TX.read_text_columns(t.spark, TX.write_csv(out, scratch_path(t.spark, "quoted"), "\t"))
    return d.select(F.col("o_orderkey").try_cast("long").alias("o_orderkey"), "note", text(parse_date("day")).alias("day"),
                    parse_number("price").alias("price"))


TILES = f"SELECT species_name, x, y, {R('rel_abundance')} AS rel_abundance FROM tiles"


@query("s08_csv", ("tiles",), TILES)
def _(t):
    path = TX.write_csv(t.tiles, scratch_path(t.spark, "csv"))
    d = TX.read_delimited(t.spark, path, "species_name string, x double, y double, rel_abundance double", ",")
    return d.withColumn("rel_abundance", r("rel_abundance"))


@query("k01_csv_sink", ("tiles",), TILES)
def _(t):
    path = TX.write_csv(t.tiles, scratch_path(t.spark, "metrics"))
    return TX.read_text_columns(t.spark, path, ",").select(
        "species_name", *[F.col(c).try_cast("double").alias(c) for c in ("x", "y")], r(F.col("rel_abundance").try_cast("double")).alias("rel_abundance"))


@query("s09_bulk_filter", ("obs",), """
SELECT checklist_id, line_no, line_part FROM obs WHERE common_name IN ('Brand#4') AND locality IN ('1', '2', '3')""")
def _(t):
    return RC.filter_observations(t.obs, ["Brand#4"], ["1", "2", "3"], country_col="locality").select("checklist_id", "line_no", "line_part")


@query("k02_filtered_text", ("obs",), """
SELECT checklist_id, line_no, observation_count FROM obs WHERE common_name = 'Brand#7'""")
def _(t):
    d = RC.filter_observations(t.obs, ["Brand#7"]).select("checklist_id", "line_no", "observation_count")
    path = TX.write_filtered_text(d, scratch_path(t.spark, "filtered"))
    return TX.read_delimited(t.spark, path, "checklist_id long, line_no int, observation_count string")


GROUPED = "SELECT *, CASE WHEN checklist_id % 3 = 0 THEN observer_id END AS group_id FROM obs"


@query("s10_group_checklists", ("obs",), f"""
SELECT common_name, checklist_id, line_no, line_part, group_id FROM (SELECT *, row_number() OVER (PARTITION BY common_name, group_id
  ORDER BY checklist_id, line_no, line_part, line_supp, line_qty) AS rn FROM ({GROUPED})) WHERE rn = 1 OR group_id IS NULL""")
def _(t):
    d = t.obs.withColumn("group_id", F.when(F.col("checklist_id") % 3 == 0, F.col("observer_id")))
    d = RC.unique_group_checklists(d, "common_name", "group_id", ["checklist_id", "line_no", "line_part", "line_supp", "line_qty"])
    return d.select("common_name", "checklist_id", "line_no", "line_part", "group_id")


@query("s11_roll_up", ("clean",), """
WITH taxa AS (SELECT DISTINCT p_brand AS common_name, CASE WHEN CAST(substr(p_brand, 7) AS INT) % 5 <> 0
  THEN 'Species ' || (CAST(substr(p_brand, 7) AS INT) % 7) END AS species FROM part)
SELECT checklist_id, species, CASE WHEN COUNT(*) = COUNT(observation_count) THEN SUM(observation_count) END AS observation_count
FROM clean JOIN taxa USING (common_name) WHERE species IS NOT NULL GROUP BY 1, 2""")
def _(t):
    number = F.substring("p_brand", 7, 10).try_cast("int")
    taxa = t.part.select(F.col("p_brand").alias("common_name"),
                         F.when(number % 5 != 0, F.concat(F.lit("Species "), text(number % 7))).alias("species")).distinct()
    return RC.roll_up_taxa(t.clean, taxa, "common_name", "checklist_id", "observation_count")


@query("s12_cell_table", ("cells",), f"""
SELECT cell, CAST(week AS STRING) AS layer, {R('-80.5 + ((cell % 10) + 0.5) * CAST(0.2 AS DOUBLE)')} AS x, {R('41.25 - (FLOOR(cell / 10) + 0.5) * CAST(0.2 AS DOUBLE)')} AS y,
  {R('abundance')} AS value FROM cells""")
def _(t):
    from .q_spatial import grid_of

    grid = grid_of(t)
    x, y = grid.centre(F.col("cell") + 1)
    d = t.cells.withColumn("x", x).withColumn("y", y).where(grid.cell(F.col("x"), F.col("y")) == F.col("cell") + 1)
    return d.select("cell", text("week").alias("layer"), r("x").alias("x"), r("y").alias("y"), r("abundance").alias("value"))


@query("s13_product_choice", ("tiles",), f"""
SELECT species_name, FLOOR(x / 2) AS x, FLOOR(y / 2) AS y, {R('AVG(rel_abundance)')} AS v FROM tiles
WHERE species_name IN ('Brand#4', 'Brand#7') GROUP BY 1, 2, 3""")
def _(t):
    fine = t.tiles.withColumn("product", F.lit("abundance")).withColumn("resolution", F.lit("3km"))
    coarse = (t.tiles.groupBy("species_name", F.floor(F.col("x") / 2).cast("double").alias("x"), F.floor(F.col("y") / 2).cast("double").alias("y"))
              .agg(F.avg("rel_abundance").alias("rel_abundance"))
              .withColumn("product", F.lit("abundance")).withColumn("resolution", F.lit("27km")))
    path = GR.write_cells(fine.unionByName(coarse), scratch_path(t.spark, "cells"))
    d = GR.read_cells(t.spark, path, "abundance", "27km", ["Brand#4", "Brand#7"])
    return d.select("species_name", "x", "y", r("rel_abundance").alias("v"))


@query("s12_layers_to_long", ("cells",), f"SELECT cell, CAST(week AS STRING) AS layer, {R('abundance')} AS value FROM cells")
def _(t):
    wide = t.cells.withColumn("week", text("week")).groupBy("cell").pivot("week").agg(F.first("abundance"))
    d = GR.layers_to_long(wide, ["cell"]).where(F.col("value").isNotNull())
    return d.withColumn("value", r("value"))


@query("s14_metadata", (), """
SELECT p_partkey, p_name FROM part WHERE NOT (p_size % 2 = 0) AND p_size >= 10 AND NOT regexp_matches(p_name, 'example')""")
def _(t):
    runs = t.part.withColumn("is_resident", F.col("p_size") % 2 == 0)
    return runs.where(~F.col("is_resident") & (F.col("p_size") >= 10) & ~F.col("p_name").rlike("example")).select("p_partkey", "p_name")


#: The boundaries asked for, by name.
BOUNDARIES = ("NATION_0", "NATION_3", "NATION_5", "NATION_8", "NATION_11", "NATION_14", "NATION_17", "NATION_20", "NATION_23")


@query("s15_boundaries", ("sightings", "edges"), f"""
WITH spots AS (SELECT DISTINCT lng, lat FROM sightings),
inside AS (SELECT DISTINCT lng, lat FROM (SELECT s.lng, s.lat, e.name FROM spots s JOIN edges e ON {CROSS}
  WHERE e.name IN {BOUNDARIES} GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1))
SELECT species_code, COUNT(*) AS n FROM sightings JOIN inside USING (lng, lat) GROUP BY 1""")
def _(t):
    return points_in(t.sightings, t.regions.where(F.col("name").isin(*BOUNDARIES)), "lng", "lat").groupBy("species_code").agg(F.count(F.lit(1)).alias("n"))


@query("s15_boundary_edges", ("edges",), f"SELECT name, {R('x1')} AS x1, {R('y1')} AS y1, {R('x2')} AS x2, {R('y2')} AS y2 FROM edges")
def _(t):
    return edges(t.regions).select("name", *[r(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("s16_recent", ("sightings",), """
SELECT com_name, COUNT(*) AS n, CAST(SUM(how_many) AS BIGINT) AS total FROM sightings
WHERE CAST(obs_dt AS DATE) >= (SELECT CAST(MAX(obs_dt) AS DATE) - 30 FROM sightings) GROUP BY 1""")
def _(t):
    d = RC.sighting_dates(t.sightings)
    as_of = d.agg(F.max("obs_date")).scalar()
    return RC.recent(d, F.col("obs_date"), as_of).groupBy("com_name").agg(
        F.count(F.lit(1)).alias("n"), big(F.sum("how_many")).alias("total"))


FREQUENCY = """rows_ AS (SELECT DISTINCT common_name, observation_event_id AS e, strftime(observation_date, '%B') || '-' ||
  LEAST(CAST(FLOOR((day(observation_date) - 1) / 8) AS INT) + 1, 4) AS month_qt FROM clean WHERE year(observation_date) = 1997),
f AS (SELECT common_name, month_qt, CAST(tot AS DOUBLE) AS sample_size, seen / CAST(tot AS DOUBLE) AS frequency FROM (
  SELECT common_name, month_qt, COUNT(*) AS seen FROM rows_ GROUP BY 1, 2) JOIN (SELECT month_qt, COUNT(DISTINCT e) AS tot FROM rows_ GROUP BY 1) USING (month_qt))"""


def frequency_1997(t):
    year = t.clean.where((F.col("observation_date") >= F.lit("1997-01-01").cast("date")) & (F.col("observation_date") < F.lit("1998-01-01").cast("date")))
    return RC.frequency_table(year, "common_name", "observation_event_id", "observation_date")


@query("s17_frequency", ("clean",), f"WITH {FREQUENCY} SELECT common_name, month_qt, sample_size, {R('frequency')} AS frequency FROM f")
def _(t):
    return frequency_1997(t).withColumn("frequency", r("frequency"))


@query("s17_a03_monthly_frequency", ("clean",), f"""
WITH {FREQUENCY} SELECT common_name, split_part(month_qt, '-', 1) AS month, SUM(sample_size) AS sample_size, {R('AVG(frequency)')} AS frequency_mean,
  {R('SUM(frequency * sample_size) / SUM(sample_size)')} AS weighted FROM f GROUP BY 1, 2""")
def _(t):
    f = frequency_1997(t)
    plain = RC.monthly_frequency(f, "common_name").withColumn("frequency_mean", r("frequency_mean"))
    w = RC.monthly_frequency(f, "common_name", weighted=True).select("common_name", "month", r("frequency_mean").alias("weighted"))
    return plain.join(w, ["common_name", "month"])


@query("s18_taxonomy", ("taxonomy",), "SELECT class, ord, family_com_name, com_name FROM taxonomy")
def _(t):
    return t.taxonomy


@query("s19_name_to_code", ("sightings",), """
WITH codes AS (SELECT com_name, upper(substr(com_name, 1, 3)) AS code FROM (SELECT DISTINCT com_name FROM sightings))
SELECT species_code, obs_dt, code FROM sightings JOIN codes USING (com_name)""")
def _(t):
    codes = t.sightings.select("com_name").distinct().withColumn("code", F.upper(F.substring("com_name", 1, 3)))
    return t.sightings.join(codes, "com_name").select("species_code", "obs_dt", "code")


@query("s20_pages_per_link", (), "SELECT url, page_id, length(html) AS n FROM pages WHERE url LIKE 'https:%'")
def _(t):
    links = t.pages.where(F.col("url").like("https:%")).select("url").distinct()
    return semi_join(t.pages, links, ["url"]).select("url", "page_id", big(F.length("html")).alias("n"))


LINKS = r"""
SELECT page_id, CASE WHEN regexp_matches(html, '<a\s(?:[^>]*\s)?href="([^"]*)"') THEN regexp_extract(html, '<a\s(?:[^>]*\s)?href="([^"]*)"', 1) END AS link FROM pages"""


@query("h01_first_attribute_fast", (), LINKS)
def _(t):
    return t.pages.select("page_id", extract_attr_fast("html", "a", "href").alias("link"))


@query("h01_image_of_page", (), "SELECT page_id, CAST(NULL AS VARCHAR) AS image FROM pages")
def _(t):
    return t.pages.select("page_id", extract_attr("html", [], "img", "src").alias("image"))


@query("h01_first_link_parsed", (), LINKS)
def _(t):
    return t.pages.select("page_id", extract_attr("html", [], "a", "href").alias("link"))


@query("v02_function_per_row", ("sightings",), f"SELECT species_code, obs_dt, {R('sqrt(how_many) * 2')} AS v FROM sightings")
def _(t):
    @F.pandas_udf("double")
    def twice_root(v: pd.Series) -> pd.Series:
        return v.astype("float64").pow(0.5) * 2

    return t.sightings.select("species_code", "obs_dt", r(twice_root(F.col("how_many").cast("double"))).alias("v"))


@query("v04_table_per_species", ("tiles",), f"""
SELECT species_name, x, y, {R('rel_abundance')} AS v FROM tiles WHERE species_name IN (SELECT DISTINCT p_brand FROM part WHERE p_size = 1)""")
def _(t):
    wanted = t.part.where("p_size = 1").select(F.col("p_brand").alias("species_name")).distinct()
    return semi_join(t.tiles, wanted, ["species_name"]).select("species_name", "x", "y", r("rel_abundance").alias("v"))
