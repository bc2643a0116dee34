"""Regions, cells and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projections as PR
from ..functions import values as V
from ..operators import spatial as X
from ..operators.quantiles import exact_quantiles
from .flows import top_sightings
from .q_rows import CROSS
from .registry import R, big, query, r, text

def grid_of(t, split: int = 1) -> X.Grid:
    """The grid the cells of the weekly table lie on, ten columns wide and as many rows as the cells need; with ``split``
    each of its cells is cut in so many rows and columns."""
    last = t.cells.agg(F.max("cell")).first()[0] or 0
    return X.Grid(left=-80.5, top=41.25, size=0.2 / split, rows=(last // 10 + 1) * split, cols=10 * split)


CELL_X = "(-80.5 + (((cell - 1) % 10) + 0.5) * CAST(0.2 AS DOUBLE))"
CELL_Y = "(41.25 - (FLOOR((cell - 1) / 10) + 0.5) * CAST(0.2 AS DOUBLE))"


def placed(t):
    """Weekly cells with their centres; cell numbers start at 1."""
    cells = t.cells.withColumn("cell", F.col("cell") + 1)
    x, y = grid_of(t).centre(F.col("cell"))
    return cells.withColumn("x", x).withColumn("y", y)


PLACED = f"""placed AS (SELECT cell, week, abundance, CAST({CELL_X} AS DOUBLE) AS x, CAST({CELL_Y} AS DOUBLE) AS y FROM (
  SELECT cell + 1 AS cell, week, abundance FROM cells))"""


@query("x01_point_in_polygon", ("sightings", "edges"), f"""
WITH spots AS (SELECT DISTINCT lng, lat FROM sightings),
inside AS (SELECT s.lng, s.lat, e.name FROM spots s JOIN edges e ON {CROSS} GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1)
SELECT species_code, obs_dt, com_name, name FROM sightings LEFT JOIN inside USING (lng, lat)""")
def _(t):
    d = X.with_polygons(t.sightings, t.regions, "lng", "lat")
    return d.select("species_code", "obs_dt", "com_name", F.explode_outer("inside").alias("name"))


@query("x02_points_and_back", ("sightings",), f"""
SELECT species_code, obs_dt, {R('lng')} AS lng, {R('lat')} AS lat, 4326 AS srid FROM sightings""")
def _(t):
    d = X.as_points(t.sightings, "lng", "lat").withColumn("srid", F.col("geometry.srid"))
    return X.drop_geometry(d).select("species_code", "obs_dt", r("lng").alias("lng"), r("lat").alias("lat"), "srid")


@query("x03_sinusoidal", ("sightings",), f"""
SELECT species_code, obs_dt, {R('6371007.181 * radians(lng) * cos(radians(lat))', 3)} AS x, {R('6371007.181 * radians(lat)', 3)} AS y FROM sightings""")
def _(t):
    x, y = PR.SINUSOIDAL.forward(F.col("lng"), F.col("lat"))
    return t.sightings.select("species_code", "obs_dt", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query("x03_laea", ("sightings",), f"""
WITH p AS (SELECT species_code, obs_dt, radians(lng + 79.5) AS l, radians(lat) AS f, radians(40.5) AS f1 FROM sightings),
k AS (SELECT *, sqrt(2 / (1 + sin(f1) * sin(f) + cos(f1) * cos(f) * cos(l))) AS k FROM p)
SELECT species_code, obs_dt, {R('6378137.0 * k * cos(f) * sin(l)', 3)} AS x,
  {R('6378137.0 * k * (cos(f1) * sin(f) - sin(f1) * cos(f) * cos(l))', 3)} AS y FROM k""")
def _(t):
    x, y = PR.laea(-79.5, 40.5).forward(F.col("lng"), F.col("lat"))
    return t.sightings.select("species_code", "obs_dt", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query("x03_round_trip", ("sightings",), "SELECT species_code, obs_dt, round(lng, 6) + 0.0 AS lng, round(lat, 6) + 0.0 AS lat FROM sightings")
def _(t):
    """Sinusoidal → lon/lat → Mollweide → lon/lat gives the points back."""
    sx, sy = PR.SINUSOIDAL.forward(F.col("lng"), F.col("lat"))
    d = t.sightings.select("species_code", "obs_dt", sx.alias("x"), sy.alias("y"))
    d = X.transform_points(d, "x", "y", PR.SINUSOIDAL, PR.MOLLWEIDE)
    lon, lat = PR.MOLLWEIDE.inverse(F.col("x"), F.col("y"))
    return d.select("species_code", "obs_dt", r(lon).alias("lng"), r(lat).alias("lat"))


@query("x04_resample_nearest", ("cells",), f"""
WITH {PLACED}, tgt AS (SELECT i + 1 AS cell, CAST(-80.5 + ((i % 20) + 0.5) * 0.1 AS DOUBLE) AS x, CAST(41.25 - (FLOOR(i / 20) + 0.5) * 0.1 AS DOUBLE) AS y
  FROM range(0, (SELECT (MAX(cell) // 10 + 1) * 40 FROM cells)) v(i)),
src AS (SELECT *, CAST(FLOOR((41.25 - y) / 0.2) AS BIGINT) * 10 + CAST(FLOOR((x + 80.5) / 0.2) AS BIGINT) + 1 AS s FROM tgt)
SELECT t.cell, CAST(p.week AS STRING) AS week, {R('p.abundance')} AS abundance FROM src t JOIN placed p ON p.cell = t.s""")
def _(t):
    d = X.resample_nearest(placed(t), grid_of(t), PR.LONLAT, grid_of(t, 2), PR.LONLAT)
    return d.select("cell", text("week").alias("week"), r("abundance").alias("abundance"))


@query("x05_crop", ("cells",), f"""
WITH {PLACED} SELECT cell, CAST(week AS STRING) AS week, {R('abundance')} AS abundance FROM placed
WHERE x >= -80.11 AND x <= -79.13 AND y >= 40.3 AND y <= 41.21""")
def _(t):
    return X.crop(placed(t), -80.11, 40.3, -79.13, 41.21).select("cell", text("week").alias("week"), r("abundance").alias("abundance"))


INSIDE = """inside AS (SELECT DISTINCT cell FROM (SELECT s.cell, e.name FROM (SELECT DISTINCT cell, x AS lng, y AS lat FROM placed) s
  JOIN edges e ON {cross} GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1))""".format(cross=CROSS)


@query("x06_mask", ("cells", "edges"), f"""
WITH {PLACED}, {INSIDE} SELECT p.cell, CAST(week AS STRING) AS week, {R('CASE WHEN i.cell IS NOT NULL THEN abundance END')} AS abundance
FROM placed p LEFT JOIN inside i USING (cell)""")
def _(t):
    return X.mask(placed(t), t.regions, "abundance").select("cell", text("week").alias("week"), r("abundance").alias("abundance"))


@query("x07_trim", ("cells", "edges"), f"""
WITH {PLACED}, {INSIDE}, m AS (SELECT p.*, CASE WHEN i.cell IS NOT NULL THEN abundance END AS v FROM placed p LEFT JOIN inside i USING (cell)),
b AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM m WHERE v IS NOT NULL)
SELECT cell, CAST(week AS STRING) AS week, {R('v')} AS abundance FROM m, b WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def _(t):
    d = X.trim(X.mask(placed(t), t.regions, "abundance"), "abundance")
    return d.select("cell", text("week").alias("week"), r("abundance").alias("abundance"))


@query("x08_bounding_box", ("sightings",), f"""
SELECT com_name, {R('MIN(lng)')} AS xmin, {R('MIN(lat)')} AS ymin, {R('MAX(lng)')} AS xmax, {R('MAX(lat)')} AS ymax FROM sightings GROUP BY 1
UNION ALL SELECT 'all', {R('MIN(lng)')}, {R('MIN(lat)')}, {R('MAX(lng)')}, {R('MAX(lat)')} FROM sightings""")
def _(t):
    each = t.sightings.groupBy("com_name").agg(F.min("lng").alias("xmin"), F.min("lat").alias("ymin"),
                                               F.max("lng").alias("xmax"), F.max("lat").alias("ymax"))
    box = X.bounding_box(t.sightings, "lng", "lat").withColumn("com_name", F.lit("all"))
    return each.unionByName(box).select("com_name", *[r(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query("x09_centroid", ("edges",), f"""
SELECT name, {R('SUM((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * SUM(x1 * y2 - x2 * y1))', 4)} AS x,
  {R('SUM((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * SUM(x1 * y2 - x2 * y1))', 4)} AS y FROM edges GROUP BY 1""")
def _(t):
    return X.centroids(t.regions).select("name", r("x", 4).alias("x"), r("y", 4).alias("y"))


@query("x10_rasterize", ("edges",), f"""
WITH spots AS (SELECT i + 1 AS cell, -80.5 + ((i % 10) + 0.5) * CAST(0.2 AS DOUBLE) AS lng, 41.25 - (FLOOR(i / 10) + 0.5) * CAST(0.2 AS DOUBLE) AS lat
  FROM range(0, 4000) v(i))
SELECT s.cell, e.name FROM spots s JOIN edges e ON {CROSS} GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1""")
def _(t):
    return X.rasterize(t.regions, grid_of(t)).select("cell", "name")


@query("x11_layer_dates", ("cells",), """
SELECT cell, CAST(week AS STRING) AS day FROM cells""")
def _(t):
    named = t.cells.select("cell", F.concat(F.lit("X"), F.date_format("week", "yyyy.MM.dd")).alias("layer"))
    return named.select("cell", text(V.layer_date("layer")).alias("day"))


@query("x12_pick_layer", ("cells",), f"""
SELECT cell, {R('abundance')} AS abundance FROM cells WHERE week = (SELECT week FROM (SELECT DISTINCT week FROM cells) ORDER BY 1 LIMIT 1 OFFSET 2)""")
def _(t):
    return X.pick_layer(t.cells, "week", 3).select("cell", r("abundance").alias("abundance"))


def region_one(t):
    """One nation's outline."""
    last = t.nation.agg(F.max("n_nationkey")).scalar()
    name = t.nation.where(F.col("n_nationkey") == last).select(F.col("n_name").alias("name"))
    return t.regions.join(name, "name", "left_semi")


REGION_SQL = f"""
WITH {PLACED}, one AS (SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 1),
e AS (SELECT * FROM edges WHERE name = (SELECT n_name FROM one)),
box AS (SELECT MIN(x1) AS x0, MAX(x1) AS xx, MIN(y1) AS y0, MAX(y1) AS yy FROM e),
held AS (SELECT s.cell FROM (SELECT DISTINCT cell, x AS lng, y AS lat FROM placed) s JOIN e ON {CROSS} GROUP BY 1 HAVING COUNT(*) % 2 = 1),
masked AS (SELECT p.cell, p.week, CASE WHEN h.cell IS NOT NULL THEN abundance END AS v FROM placed p LEFT JOIN held h ON p.cell = h.cell, box
  WHERE p.x BETWEEN x0 AND xx AND p.y BETWEEN y0 AND yy),
mid AS (SELECT radians(round(SUM((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * SUM(x1 * y2 - x2 * y1)), 1)) AS l0,
  radians(round(SUM((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * SUM(x1 * y2 - x2 * y1)), 1)) AS f1 FROM e),
corner AS (SELECT 6378137.0 * k * cos(f) * sin(l) AS x, 6378137.0 * k * (cos(f1) * sin(f) - sin(f1) * cos(f) * cos(l)) AS y FROM (
  SELECT *, sqrt(2 / (1 + sin(f1) * sin(f) + cos(f1) * cos(f) * cos(l))) AS k FROM (
    SELECT radians(x1) - l0 AS l, radians(y1) AS f, f1 FROM e, mid))),
far AS (SELECT MIN(x) AS lft, MAX(y) AS top, CAST(FLOOR((MAX(x) - MIN(x)) / 2000) AS BIGINT) + 1 AS cols,
  CAST(FLOOR((MAX(y) - MIN(y)) / 2000) AS BIGINT) + 1 AS rws FROM corner),
tgt AS (SELECT i + 1 AS cell, lft + ((i % cols) + 0.5) * 2000 AS x, top - (FLOOR(i / cols) + 0.5) * 2000 AS y FROM range(0, 100000) v(i), far WHERE i < cols * rws),
inv AS (SELECT *, sqrt(x * x + y * y) AS rho, 2 * asin(sqrt(x * x + y * y) / (2 * 6378137.0)) AS c FROM tgt, mid),
ll AS (SELECT cell, x, y, degrees(l0 + atan2(x * sin(c), rho * cos(f1) * cos(c) - y * sin(f1) * sin(c))) AS lon,
  degrees(asin(cos(c) * sin(f1) + y * sin(c) * cos(f1) / rho)) AS lat FROM inv),
src AS (SELECT *, CAST(FLOOR((41.25 - lat) / 0.2) AS BIGINT) * 10 + CAST(FLOOR((lon + 80.5) / 0.2) AS BIGINT) + 1 AS s FROM ll WHERE FLOOR((lon + 80.5) / 0.2) BETWEEN 0 AND 9),
lay AS (SELECT t.cell, t.x, t.y, m.week, m.v FROM src t JOIN masked m ON t.s = m.cell),
fit AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM lay WHERE v IS NOT NULL)
SELECT cell, {R('x', 3)} AS x, {R('y', 3)} AS y, CAST(week AS STRING) AS week, {R('v')} AS abundance FROM lay, fit
WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"""


@query("x13_region_cells", ("cells", "edges"), REGION_SQL)
def _(t):
    d = X.region_cells(placed(t).drop("cell"), region_one(t), grid_of(t), PR.LONLAT, "abundance", 2000.0)
    return d.select("cell", r("x", 3).alias("x"), r("y", 3).alias("y"), text("week").alias("week"), r("abundance").alias("abundance"))


@query("x14_top_cells", ("cells",), f"""
SELECT cell, {R('AVG(abundance)')} AS mean_abundance, row_number() OVER (ORDER BY AVG(abundance) DESC, cell) AS id
FROM cells GROUP BY 1 ORDER BY AVG(abundance) DESC, cell LIMIT 100""")
def _(t):
    d = X.top_cells(t.cells, "abundance", 100, cell=["cell"])
    return d.select("cell", r("mean_abundance").alias("mean_abundance"), big("id").alias("id"))


@query("x14_top_cells_per_species", ("tiles",), f"""
SELECT species_name, x, {R('m')} AS mean_abundance, rn AS id FROM (SELECT species_name, x, AVG(rel_abundance) AS m,
  row_number() OVER (PARTITION BY species_name ORDER BY AVG(rel_abundance) DESC, x) AS rn FROM tiles GROUP BY 1, 2) WHERE rn <= 3""")
def _(t):
    d = X.top_cells(t.tiles, "rel_abundance", 3, ["species_name"], ["x"])
    return d.select("species_name", "x", r("mean_abundance").alias("mean_abundance"), big("id").alias("id"))


@query("x15_layer_bins", ("cells",), f"""
WITH b AS (SELECT quantile_cont(abundance, 0.2) AS b1, quantile_cont(abundance, 0.4) AS b2, quantile_cont(abundance, 0.6) AS b3,
  quantile_cont(abundance, 0.8) AS b4 FROM cells WHERE abundance > 0)
SELECT cell, CAST(week AS STRING) AS week, CAST(CASE WHEN abundance = 0 THEN 0 WHEN abundance > 0 THEN 1 + (abundance > b1)::INT + (abundance > b2)::INT
  + (abundance > b3)::INT + (abundance > b4)::INT END AS BIGINT) AS bin FROM cells, b""")
def _(t):
    return X.layer_bins(t.cells, "abundance", [0.2, 0.4, 0.6, 0.8]).select("cell", text("week").alias("week"), big("bin").alias("bin"))


@query("x15_breaks", ("tiles",), f"""
SELECT {R('quantile_cont(rel_abundance, 0.1)', 9)} AS p10, {R('quantile_cont(rel_abundance, 0.9)', 9)} AS p90 FROM tiles WHERE rel_abundance > 0""")
def _(t):
    d = exact_quantiles(t.tiles.where("rel_abundance > 0"), [], "rel_abundance", {"p10": 0.1, "p90": 0.9})
    return d.select(r("p10", 9).alias("p10"), r("p90", 9).alias("p90"))


@query("x16_facet_background", ("tiles",), """
WITH c AS (SELECT DISTINCT x, y, CAST(FLOOR(x / 3) AS BIGINT) AS cluster FROM tiles)
SELECT g.x, g.y, k.cluster, g.cluster = k.cluster AS member FROM c g CROSS JOIN (SELECT DISTINCT cluster FROM c) k""")
def _(t):
    c = t.tiles.select("x", "y", big(F.floor(F.col("x") / 3)).alias("cluster")).distinct()
    return X.facet_background(c, "cluster")


@query("d01_top_sightings_in_regions", ("sightings", "edges"), f"""
WITH spots AS (SELECT DISTINCT lng, lat FROM sightings),
inside AS (SELECT DISTINCT lng, lat FROM (SELECT s.lng, s.lat, e.name FROM spots s JOIN edges e ON {CROSS} GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1))
SELECT com_name, species_code, CAST(n AS BIGINT) AS n, last_seen, 'https://example.org/species/' || species_code AS link FROM (
  SELECT com_name, species_code, CASE WHEN COUNT(*) = COUNT(how_many) THEN SUM(how_many) END AS n, MAX(obs_dt) AS last_seen
  FROM sightings JOIN inside USING (lng, lat) GROUP BY 1, 2) ORDER BY n DESC NULLS LAST, com_name, species_code LIMIT 10""")
def _(t):
    local = X.points_in(t.sightings, t.regions, "lng", "lat")
    d = top_sightings(local)
    return d.select("com_name", "species_code", big("n").alias("n"), text("last_seen").alias("last_seen"), "link")
