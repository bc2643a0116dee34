"""Points, polygons and raster cells as tables.

Polygons are a table ``(name, rings ARRAY<ARRAY<STRUCT<x,y>>>)``. Rings are pooled, so holes work.
A raster is a cell table ``(x, y, layer…, value)`` on a regular grid.

Point in polygon is ray casting. Polygon edges are cut into horizontal strips and gathered per
strip; a point meets its strip by an equi-join on the strip number and counts the crossings in
one expression. Points stay one row each: nothing is shuffled per point and edge.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projections import LONLAT, Projection, laea
from .relational import combinations_of


# -- geometry tables -------------------------------------------------------------------------

def polygons_from_rings(spark: SparkSession, shapes: dict[str, Sequence[Sequence[tuple[float, float]]]]) -> DataFrame:
    """A polygon table from literal rings (reference geometry given in code)."""
    rows = [(name, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings])
            for name, rings in shapes.items()]
    return spark.createDataFrame(rows, "name string, rings array<array<struct<x:double,y:double>>>")


def edges(polygons: DataFrame) -> DataFrame:
    """``(name, ring, x1, y1, x2, y2)``; open rings are closed."""
    ring = polygons.select("name", F.posexplode("rings").alias("ring", "p"))
    nxt = F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1))
    seg = ring.select("name", "ring", F.explode(F.arrays_zip(F.col("p").alias("a"), nxt.alias("b"))).alias("e"))
    return seg.select("name", "ring", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"),
                      F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")).where(
        (F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def polygon_box(polygons: DataFrame) -> DataFrame:
    e = edges(polygons)
    return e.agg(F.min("x1").alias("xmin"), F.min("y1").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax"))


def bounding_box(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def centroids(polygons: DataFrame, digits: int | None = None) -> DataFrame:
    """Area centroid per polygon by the shoelace sums; holes wound the other way are taken off."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    s = edges(polygons).groupBy("name").agg(
        F.sum(cross).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"),
        F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"))
    cx, cy = F.try_divide("sx", 3 * F.col("a")), F.try_divide("sy", 3 * F.col("a"))
    if digits is not None:
        cx, cy = F.round(cx, digits), F.round(cy, digits)
    return s.select("name", cx.alias("x"), cy.alias("y"))


def as_points(df: DataFrame, x: str, y: str, srid: int = 4326) -> DataFrame:
    """Tag coordinate columns as points of a reference system."""
    return df.withColumn("geometry", F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
                                              F.lit(srid).alias("srid")))


def drop_geometry(df: DataFrame) -> DataFrame:
    return df.drop("geometry")


def transform_points(df: DataFrame, x: str, y: str, source: Projection, target: Projection) -> DataFrame:
    """Reproject coordinate columns in place."""
    lon, lat = source.inverse(F.col(x), F.col(y))
    with_ll = df.withColumn("__lon", lon).withColumn("__lat", lat)
    nx, ny = target.forward(F.col("__lon"), F.col("__lat"))
    return with_ll.withColumns({x: nx, y: ny}).drop("__lon", "__lat")


def transform_polygons(polygons: DataFrame, source: Projection, target: Projection) -> DataFrame:
    """Reproject the vertices."""
    def point(p):
        nx, ny = target.forward(*source.inverse(p["x"], p["y"]))
        return F.struct(nx.alias("x"), ny.alias("y"))

    return polygons.withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, point)))


# -- point in polygon ------------------------------------------------------------------------

def _strips(polygons: DataFrame, g: dict, n_strips: int) -> DataFrame:
    """Per strip the parts of polygons that reach it: ``(strip, shapes)``. A shape carries its
    range of x, so a point only looks at polygons that can hold it."""
    e = edges(polygons)
    wide = e.groupBy("name").agg(F.min("x1").alias("left"), F.max("x1").alias("right"))
    reach = F.sequence(strip_of(F.least("y1", "y2"), g, n_strips), strip_of(F.greatest("y1", "y2"), g, n_strips))
    spread = e.withColumn("strip", F.explode(reach))
    per_shape = spread.groupBy("strip", "name").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    return per_shape.join(wide, "name").groupBy("strip").agg(
        F.collect_list(F.struct("name", "left", "right", "edges")).alias("shapes"))


def strip_of(v: Column, g: dict, n_strips: int) -> Column:
    at = F.coalesce(F.try_divide((v - g["lo"]) * n_strips, F.lit(g["hi"] - g["lo"])), F.lit(0.0))
    return F.greatest(F.least(F.floor(at), F.lit(n_strips - 1)), F.lit(0)).cast("int")


def _hits(shape: Column, x: Column, y: Column, boundary: bool) -> Column:
    def crosses(e):
        return ((e["y1"] > y) != (e["y2"] > y)) & (
            x < (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"]) + e["x1"])

    def touches(e):
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return ((cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    odd = F.size(F.filter(shape["edges"], crosses)) % 2 == 1
    on = F.exists(shape["edges"], touches)
    return (odd | on) if boundary else (odd & ~on)


def _frame(polygons: DataFrame) -> dict:
    """The polygons' common box: one row, looked up first so that it can be pushed to the scan."""
    row = polygon_box(polygons).first()
    lo, hi, left, right = (0.0 if v is None else v for v in (row["ymin"], row["ymax"], row["xmin"], row["xmax"]))
    return {"lo": lo, "hi": hi, "left": left, "right": right}


def _in_frame(g: dict, x: str, y: str) -> Column:
    return F.col(y).between(g["lo"], g["hi"]) & F.col(x).between(g["left"], g["right"])


def _holding(x: str, y: str, boundary: bool) -> Column:
    px, py = F.col(x), F.col(y)
    near = F.filter("shapes", lambda s: px.between(s["left"], s["right"]))
    return F.transform(F.filter(near, lambda s: _hits(s, px, py, boundary)), lambda s: s["name"])


def with_polygons(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", boundary: bool = False,
                  into: str = "inside", n_strips: int = 256) -> DataFrame:
    """Adds the array of names of the polygons that hold each point (empty when none).

    ``boundary`` counts points on an edge as inside (intersects); otherwise they are outside
    (within). The strip table grows with the polygons' vertices only; adaptive execution
    broadcasts it when its size allows.
    """
    g = _frame(polygons)
    # points outside the common box match no strip; they are spread over negative numbers
    aside = -1 - F.pmod(F.xxhash64(x, y), F.lit(1024)).cast("int")
    pts = points.withColumn("__strip", F.when(_in_frame(g, x, y), strip_of(F.col(y), g, n_strips)).otherwise(aside))
    strips = _strips(polygons, g, n_strips).withColumnRenamed("strip", "__s")
    joined = pts.join(strips, F.col("__strip") == F.col("__s"), "left")
    return joined.withColumn(into, F.coalesce(_holding(x, y, boundary), F.array().cast("array<string>"))).drop(
        "__strip", "__s", "shapes")


def points_in(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", boundary: bool = False,
              n_strips: int = 256) -> DataFrame:
    """Points that lie in any of the polygons, each once. The common box is a plain range filter
    on the points, so it reaches their scan."""
    g = _frame(polygons)
    pts = points.where(_in_frame(g, x, y)).withColumn("__strip", strip_of(F.col(y), g, n_strips))
    strips = _strips(polygons, g, n_strips).withColumnRenamed("strip", "__s")
    hit = F.size(_holding(x, y, boundary)) > 0
    return pts.join(strips, F.col("__strip") == F.col("__s")).where(hit).drop("__strip", "__s", "shapes")


# -- rasters ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class Grid:
    """A regular grid: left and top edge, cell size, rows (from the top) and columns."""

    left: float
    top: float
    size: float
    rows: int
    cols: int

    def row(self, y: Column) -> Column:
        r = F.floor((self.top - y) / self.size)
        return F.when((r >= 0) & (r < self.rows), r)

    def col(self, x: Column) -> Column:
        c = F.floor((x - self.left) / self.size)
        return F.when((c >= 0) & (c < self.cols), c)

    def cell(self, x: Column, y: Column) -> Column:
        """1-based cell number, row by row from the top left; NULL outside."""
        return (self.row(y) * self.cols + self.col(x) + 1).cast("long")

    def centre(self, cell: Column) -> tuple[Column, Column]:
        zero = cell - 1
        x = self.left + ((zero % self.cols) + 0.5) * self.size
        y = self.top - (F.floor(zero / self.cols) + 0.5) * self.size
        return x, y

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every cell with its centre."""
        ids = spark.range(1, self.rows * self.cols + 1).withColumnRenamed("id", "cell")
        x, y = self.centre(F.col("cell"))
        return ids.select("cell", x.alias("x"), y.alias("y"))


def with_cell(df: DataFrame, grid: Grid, x: str = "x", y: str = "y", name: str = "cell") -> DataFrame:
    return df.withColumn(name, grid.cell(F.col(x), F.col(y)))


def crop(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, x: str = "x", y: str = "y") -> DataFrame:
    """Cells inside a box; constant bounds, so the filter reaches the scan."""
    return df.where((F.col(x) >= xmin) & (F.col(x) <= xmax) & (F.col(y) >= ymin) & (F.col(y) <= ymax))


def mask(cells: DataFrame, polygons: DataFrame, value: str, x: str = "x", y: str = "y") -> DataFrame:
    """Value kept where the cell centre lies in a polygon, else NULL."""
    flagged = with_polygons(cells, polygons, x, y, True, "__in")
    return flagged.withColumn(value, F.when(F.size("__in") > 0, F.col(value))).drop("__in")


def trim(cells: DataFrame, value: str, x: str = "x", y: str = "y") -> DataFrame:
    """Drop outer rows and columns that hold no value."""
    known = cells.where(F.col(value).isNotNull())
    box = known.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).alias("b"))
    b = F.col("__b")
    return cells.withColumn("__b", box.scalar()).where(
        F.col(x).between(b["x0"], b["x1"]) & F.col(y).between(b["y0"], b["y1"])).drop("__b")


def rasterize(polygons: DataFrame, grid: Grid) -> DataFrame:
    """Cells of the grid whose centre lies in a polygon, with the polygon name."""
    cells = with_polygons(grid.cells(polygons.sparkSession), polygons, boundary=True)
    return cells.select("cell", "x", "y", F.explode("inside").alias("name"))


def resample_nearest(cells: DataFrame, source: Grid, source_crs: Projection, target: Grid, target_crs: Projection,
                     x: str = "x", y: str = "y") -> DataFrame:
    """Value of the source cell under each target cell centre, for every layer.

    Only the inverse projection of the target centres is needed; the lookup is an equi-join on
    the integer source cell.
    """
    lon, lat = target_crs.inverse(F.col("x"), F.col("y"))
    grid = target.cells(cells.sparkSession).withColumn("__lon", lon).withColumn("__lat", lat)
    sx, sy = source_crs.forward(F.col("__lon"), F.col("__lat"))
    grid = grid.withColumn("__src", source.cell(sx, sy)).drop("__lon", "__lat").where(F.col("__src").isNotNull())
    values = with_cell(cells, source, x, y, "__cell").drop(x, y, *(["cell"] if "cell" in cells.columns else []))
    return grid.join(values, F.col("__src") == F.col("__cell")).drop("__src", "__cell")


def region_cells(cells: DataFrame, polygons: DataFrame, source: Grid, source_crs: Projection, value: str,
                 size: float, polygon_crs: Projection = LONLAT) -> DataFrame:
    """Crop, mask, reproject to an equal-area projection centred on the region, and trim.

    Cheap range filters come first, so only cells of the region are projected. The region's
    centroid and box are single rows of the polygon table.
    """
    here = transform_polygons(polygons, polygon_crs, source_crs)
    box = polygon_box(here).first()
    masked = mask(crop(cells, box["xmin"], box["ymin"], box["xmax"], box["ymax"]), here, value)
    lonlat = polygons if polygon_crs.kind == "lonlat" else transform_polygons(polygons, polygon_crs, LONLAT)
    mid = centroids(lonlat, 1).agg(F.round(F.avg("x"), 1).alias("x"), F.round(F.avg("y"), 1).alias("y")).first()
    target_crs = laea(mid["x"], mid["y"])
    far = polygon_box(transform_polygons(lonlat, LONLAT, target_crs)).first()
    cols = max(1, int((far["xmax"] - far["xmin"]) // size) + 1)
    rows = max(1, int((far["ymax"] - far["ymin"]) // size) + 1)
    target = Grid(far["xmin"], far["ymax"], size, rows, cols)
    return trim(resample_nearest(masked, source, source_crs, target, target_crs), value)


def pick_layer(cells: DataFrame, layer: str, k: int) -> DataFrame:
    """The k-th layer in layer order."""
    nth = cells.select(layer).distinct().orderBy(layer).limit(k).agg(F.max(layer), F.count(F.lit(1)).alias("n")).where(
        F.col("n") == k).select(F.col(f"max({layer})").alias("l"))
    return cells.where(F.col(layer) == nth.scalar())


def top_cells(cells: DataFrame, value: str, k: int, keys: Sequence[str] = (), cell: Sequence[str] = ("x", "y")) -> DataFrame:
    """The k cells with the largest mean over layers (per key), numbered 1..k."""
    from .ordered import top_k_per_group

    mean = cells.groupBy(*keys, *cell).agg(F.avg(value).alias("mean_abundance"))
    order = [F.col("mean_abundance").desc_nulls_last(), *[F.col(c) for c in cell]]
    if keys:
        return top_k_per_group(mean, keys, order, k, rank="id")
    best = mean.orderBy(*order).limit(k)
    # at most k rows are left: one constant group is bounded by k
    return top_k_per_group(best.withColumn("__all", F.lit(0)), ["__all"], order, k, rank="id").drop("__all")


def layer_bins(cells: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """Class of each value by quantile breaks of the positive values; zero is class 0."""
    from .quantiles import exact_quantiles

    breaks = exact_quantiles(cells.where(F.col(value) > 0), [], value, {f"b{i}": p for i, p in enumerate(probs)})
    arr = breaks.select(F.array(*[f"b{i}" for i in range(len(probs))]).alias("a")).scalar()
    v = F.col(value)
    klass = F.when(v == 0, 0).when(v > 0, 1 + F.size(F.filter("__breaks", lambda b: b < v)))
    return cells.withColumn("__breaks", arr).withColumn("bin", klass).drop("__breaks")


def facet_background(cells: DataFrame, cluster: str, x: str = "x", y: str = "y") -> DataFrame:
    """Every distinct cell once per cluster, flagged where it belongs to the cluster."""
    clusters = cells.select(cluster).where(F.col(cluster).isNotNull()).distinct()
    grid = combinations_of(cells.select(x, y).distinct(), clusters)
    own = cells.select(F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(cluster).alias("__c")).distinct()
    on = (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y")) & (F.col(cluster) == F.col("__c"))
    return grid.join(own, on, "left").withColumn("member", F.col("__c").isNotNull()).drop("__x", "__y", "__c")
