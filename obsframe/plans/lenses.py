"""Views that give the driver's tables the shapes of observation data, in Spark and in SQL."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairwise
from ..operators.aggregates import count_by
from ..operators.ordered import top_k_per_group
from ..operators.relational import anti_join, group_size_filter, semi_join
from ..session import cut_lineage
from ..sources.records import clean_observations

KEEP_ORDER = ("checklist_id", "line_no", "line_part", "line_supp", "line_qty")

# corners of the region outline around its centre, in degrees (an L shape)
OUTLINE = ((-0.15, -0.1), (0.15, -0.1), (0.15, 0.02), (0.01, 0.02), (0.01, 0.09), (-0.15, 0.09))


class Tables:
    """The tables of one folder and the lenses over them; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def obs(self) -> DataFrame:
        """Observation rows as they come: counts as text, some missing times."""
        rows = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
            self.part, F.col("l_partkey") == F.col("p_partkey"))
        key = F.col("o_orderkey")
        return rows.select(
            F.col("p_brand").alias("common_name"), key.alias("checklist_id"),
            F.col("o_custkey").cast("string").alias("observer_id"), (key % 50).cast("string").alias("locality"),
            F.col("o_orderdate").cast("date").alias("observation_date"),
            F.when(key % 11 != 0, (key % 24).cast("string")).alias("time_observations_started"),
            F.col("o_orderpriority").alias("protocol_type"),
            F.when(F.col("l_linenumber") == 7, F.lit("X")).otherwise(F.col("l_quantity").cast("int").cast("string"))
            .alias("observation_count"),
            F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("all_species_reported"),
            F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("line_part"),
            F.col("l_suppkey").alias("line_supp"), F.col("l_quantity").alias("line_qty"))

    @cached_property
    def clean(self) -> DataFrame:
        return clean_observations(self.obs)

    @cached_property
    def protocols(self) -> DataFrame:
        """The two most used protocols."""
        return count_by(self.clean, "protocol_type").limit(2)

    @cached_property
    def top2(self) -> DataFrame:
        return semi_join(self.clean, self.protocols, ["protocol_type"])

    @cached_property
    def tiles(self) -> DataFrame:
        rows = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        base = rows.groupBy(
            F.col("p_brand").alias("species_name"), (F.col("l_suppkey") % 10).cast("double").alias("x"),
            F.floor((F.col("l_suppkey") % 100) / 10.0).cast("double").alias("y")).agg(F.avg("l_quantity").alias("q"))
        name = F.col("species_name")
        value = (F.when(name == "Brand#1", 0.0).when(name == "Brand#3", 5.0)
                 .otherwise(F.greatest(F.col("q") - 20.0, F.lit(0.0))))
        tiles = base.select("species_name", "x", "y", value.alias("rel_abundance"))
        again = (self.part.where(F.col("p_brand") == "Brand#2").select("p_brand").distinct()
                 .select(F.col("p_brand").alias("species_name"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
                         F.lit(1.0).alias("rel_abundance")))
        return tiles.unionByName(again)

    @cached_property
    def tiles_ok(self) -> DataFrame:
        """Species without duplicated tiles that occur somewhere."""
        tiles = cut_lineage(self.tiles)  # read three times below
        twice = group_size_filter(tiles, ["species_name", "x", "y"]).select("species_name").distinct()
        single = anti_join(tiles, twice, ["species_name"])
        seen = single.groupBy("species_name").agg(F.avg((F.col("rel_abundance") == 0).cast("int")).alias("z")).where("z < 1")
        return semi_join(single, seen, ["species_name"])

    @cached_property
    def cells(self) -> DataFrame:
        return self.events.groupBy(F.col("user_id").alias("cell"), F.date_trunc("week", "ts").cast("date").alias("week")).agg(
            F.sum("value").alias("abundance"))

    @cached_property
    def sightings(self) -> DataFrame:
        return self.events.select(
            F.col("event_type").alias("com_name"), F.col("user_id").cast("string").alias("species_code"),
            F.col("ts").cast("date").cast("string").alias("obs_dt"),
            F.when(F.col("event_id") % 97 != 0, F.floor("value").cast("int")).alias("how_many"),
            (F.lit(-80.5) + (F.col("event_id") % 100) / 50.0).alias("lng"),
            (F.lit(40.0) + (F.col("user_id") % 50) / 40.0).alias("lat"))

    @cached_property
    def taxonomy(self) -> DataFrame:
        return (self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
                .join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
                .select(F.lit("ALL").alias("class"), F.col("r_name").alias("ord"),
                        F.col("n_name").alias("family_com_name"), F.col("c_name").alias("com_name")))

    @cached_property
    def regions(self) -> DataFrame:
        """One outline per nation: ``(name, rings)``."""
        k = F.col("n_nationkey")
        cx, cy = F.lit(-80.2963) + (k % 5) * F.lit(0.4), F.lit(40.1213) + F.floor(k / 5) * F.lit(0.24)
        ring = F.array(*[F.struct((cx + dx).alias("x"), (cy + dy).alias("y")) for dx, dy in OUTLINE])
        return self.nation.select(F.col("n_name").alias("name"), F.array(ring).alias("rings"))

    @cached_property
    def pairs(self) -> DataFrame:
        """Weighted pair counts, one triangle, unknown counts skipped."""
        return pairwise.pairwise_count(self.top2, "common_name", "observation_event_id", "observation_count",
                                       KEEP_ORDER, upper=False, null_weight="skip")

    @cached_property
    def phi(self) -> DataFrame:
        return pairwise.pairwise_phi(self.top2, "common_name", "observation_event_id")

    @cached_property
    def strong(self) -> DataFrame:
        """Undirected graph of each item's two best partners."""
        best = top_k_per_group(self.phi.where(F.col("correlation").isNotNull()), ["item1"],
                               [F.round("correlation", 9).desc(), F.col("item2")], 2)
        return best.select(F.least("item1", "item2").alias("src"), F.greatest("item1", "item2").alias("dst")).distinct()

    @cached_property
    def seasonal(self) -> DataFrame:
        """Mean monthly count per species on the log scale, all months present."""
        from .flows import seasonality

        return seasonality(self.top2)

    @cached_property
    def effort(self) -> DataFrame:
        """One row per checklist."""
        return self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).join(
            self.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("o_orderkey").alias("checklist_id"), F.col("o_orderdate").cast("date").alias("observation_date"),
            F.col("n_name").alias("country"), F.col("c_mktsegment").alias("state"),
            F.col("o_custkey").cast("string").alias("observer_id"),
            F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 24).cast("string")).alias("time_observations_started"))


_EDGES = " UNION ALL ".join(
    f"SELECT name, cx + {a[0]} AS x1, cy + {a[1]} AS y1, cx + {b[0]} AS x2, cy + {b[1]} AS y2 FROM c"
    for a, b in zip(OUTLINE, OUTLINE[1:] + OUTLINE[:1])).replace("+ -", "- ")

LENS_SQL: dict[str, str] = {
    "obs": """
SELECT p.p_brand AS common_name, o.o_orderkey AS checklist_id, CAST(o.o_custkey AS STRING) AS observer_id,
  CAST(o.o_orderkey % 50 AS STRING) AS locality, CAST(o.o_orderdate AS DATE) AS observation_date,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(o.o_orderkey % 24 AS STRING) END AS time_observations_started,
  o.o_orderpriority AS protocol_type,
  CASE WHEN l.l_linenumber = 7 THEN 'X' ELSE CAST(CAST(l.l_quantity AS INT) AS STRING) END AS observation_count,
  CASE WHEN o.o_orderstatus = 'P' THEN 0 ELSE 1 END AS all_species_reported,
  l.l_linenumber AS line_no, l.l_partkey AS line_part, l.l_suppkey AS line_supp, l.l_quantity AS line_qty
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "clean": """
SELECT * REPLACE (CASE WHEN contains(observation_count, 'X') THEN NULL ELSE TRY_CAST(observation_count AS DOUBLE) END
  AS observation_count), observer_id || '-' || locality || '-' || CAST(observation_date AS STRING) || '-' ||
  COALESCE(time_observations_started, 'NA') AS observation_event_id
FROM obs WHERE all_species_reported = 1""",
    "top2": """
SELECT * FROM clean WHERE protocol_type IN (
  SELECT protocol_type FROM clean GROUP BY 1 ORDER BY COUNT(*) DESC, protocol_type LIMIT 2)""",
    "tiles": """
SELECT p.p_brand AS species_name, CAST(l.l_suppkey % 10 AS DOUBLE) AS x,
  CAST(FLOOR((l.l_suppkey % 100) / 10.0) AS DOUBLE) AS y,
  CASE WHEN p.p_brand = 'Brand#1' THEN 0.0 WHEN p.p_brand = 'Brand#3' THEN 5.0
       ELSE GREATEST(AVG(l.l_quantity) - 20.0, 0.0) END AS rel_abundance
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2, 3
UNION ALL SELECT 'Brand#2', 0.0, 0.0, 1.0""",
    "tiles_ok": """
SELECT * FROM tiles WHERE species_name NOT IN (
    SELECT species_name FROM tiles GROUP BY species_name, x, y HAVING COUNT(*) > 1)
  AND species_name IN (SELECT species_name FROM tiles GROUP BY 1 HAVING AVG(CASE WHEN rel_abundance = 0 THEN 1.0 ELSE 0.0 END) < 1)""",
    "cells": "SELECT user_id AS cell, CAST(date_trunc('week', ts) AS DATE) AS week, SUM(value) AS abundance FROM events GROUP BY 1, 2",
    "sightings": """
SELECT event_type AS com_name, CAST(user_id AS STRING) AS species_code, CAST(CAST(ts AS DATE) AS STRING) AS obs_dt,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(FLOOR(value) AS INT) END AS how_many,
  CAST(-80.5 AS DOUBLE) + (event_id % 100) / 50.0 AS lng, CAST(40.0 AS DOUBLE) + (user_id % 50) / 40.0 AS lat
FROM events""",
    "taxonomy": """
SELECT 'ALL' AS class, r.r_name AS ord, n.n_name AS family_com_name, c.c_name AS com_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "edges": f"""
SELECT * FROM (WITH c AS (SELECT n_name AS name, CAST(-80.2963 AS DOUBLE) + (n_nationkey % 5) * CAST(0.4 AS DOUBLE) AS cx,
  CAST(40.1213 AS DOUBLE) + FLOOR(n_nationkey / 5) * CAST(0.24 AS DOUBLE) AS cy FROM nation) {_EDGES})""",
    "first_rows": """
SELECT common_name, observation_event_id, protocol_type, observation_date, observation_count AS w FROM (
  SELECT *, row_number() OVER (PARTITION BY common_name, observation_event_id
    ORDER BY checklist_id, line_no, line_part, line_supp, line_qty) AS rn FROM top2) WHERE rn = 1""",
    "pairs": """
SELECT a.common_name AS item1, b.common_name AS item2, SUM(CASE WHEN b.w > 0 THEN a.w ELSE 0 END) AS n
FROM first_rows a JOIN first_rows b ON a.observation_event_id = b.observation_event_id AND a.common_name < b.common_name
WHERE a.w IS NOT NULL AND b.w IS NOT NULL GROUP BY 1, 2""",
    "phi": """
SELECT u.item1, u.item2, CASE WHEN u.n1 = t.tot OR u.n2 = t.tot THEN NULL ELSE
  (t.tot * COALESCE(p.n11, 0) - u.n1 * u.n2) / sqrt(CAST(u.n1 AS DOUBLE) * (t.tot - u.n1) * u.n2 * (t.tot - u.n2)) END AS correlation
FROM (SELECT a.common_name AS item1, b.common_name AS item2, a.c AS n1, b.c AS n2
      FROM (SELECT common_name, COUNT(DISTINCT observation_event_id) AS c FROM top2 GROUP BY 1) a,
           (SELECT common_name, COUNT(DISTINCT observation_event_id) AS c FROM top2 GROUP BY 1) b
      WHERE a.common_name <> b.common_name) u
CROSS JOIN (SELECT COUNT(DISTINCT observation_event_id) AS tot FROM top2) t
LEFT JOIN (SELECT a.common_name AS item1, b.common_name AS item2, COUNT(*) AS n11
      FROM (SELECT DISTINCT common_name, observation_event_id FROM top2) a
      JOIN (SELECT DISTINCT common_name, observation_event_id FROM top2) b
        ON a.observation_event_id = b.observation_event_id AND a.common_name <> b.common_name GROUP BY 1, 2) p
  ON u.item1 = p.item1 AND u.item2 = p.item2""",
    "strong": """
SELECT DISTINCT LEAST(item1, item2) AS src, GREATEST(item1, item2) AS dst FROM (
  SELECT item1, item2, row_number() OVER (PARTITION BY item1 ORDER BY round(correlation, 9) DESC, item2) AS rn
  FROM phi WHERE correlation IS NOT NULL) WHERE rn <= 2""",
    "seasonal": """
SELECT g.common_name, g.m AS month_no, CASE WHEN COALESCE(s.v, 0) > 0 THEN log10(s.v) ELSE 0 END AS value
FROM (SELECT c.common_name, m.m FROM (SELECT DISTINCT common_name FROM top2) c,
        (SELECT DISTINCT month(observation_date) AS m FROM top2 WHERE observation_date >= DATE '1996-01-01') m) g
LEFT JOIN (SELECT common_name, m, CAST(round_even(AVG(s), 1) AS DOUBLE) AS v FROM (
    SELECT common_name, year(observation_date) AS y, month(observation_date) AS m, COALESCE(SUM(observation_count), 0) AS s
    FROM top2 WHERE observation_date >= DATE '1996-01-01' GROUP BY 1, 2, 3) GROUP BY 1, 2) s
  ON g.common_name = s.common_name AND g.m = s.m
WHERE g.common_name IN (SELECT common_name FROM top2 WHERE observation_date >= DATE '1996-01-01')""",
    "effort": """
SELECT o.o_orderkey AS checklist_id, CAST(o.o_orderdate AS DATE) AS observation_date, n.n_name AS country, c.c_mktsegment AS state,
  CAST(o.o_custkey AS STRING) AS observer_id,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(o.o_orderkey % 24 AS STRING) END AS time_observations_started
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""",
}

NEEDS = {"clean": ("obs",), "top2": ("clean",), "tiles_ok": ("tiles",), "first_rows": ("top2",), "pairs": ("first_rows",),
         "phi": ("top2",), "strong": ("phi",), "seasonal": ("top2",)}


def with_lenses(sql: str, uses: tuple[str, ...]) -> str:
    """Put the lens definitions a query uses in front of it."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, ()):
            add(dep)
        if name not in order:
            order.append(name)

    for name in uses:
        add(name)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({LENS_SQL[n].strip()})" for n in order)
    body = sql.strip()
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if m:
        return f"WITH {m.group(1) or ''}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"
