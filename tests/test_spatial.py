import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsframe.functions import projections as PR
from obsframe.operators import spatial as X

SHAPES = {
    "hole": [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)]],
    "concave": [[(12, 0), (20, 0), (20, 8), (16, 2), (12, 8)]],
    "far": [[(30, 30), (31, 30), (30.5, 31)]],
}


def inside(px, py, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


@pytest.mark.parametrize("strips", [1, 7, 64])
def test_points_in_polygons(spark, strips):
    rng = np.random.default_rng(0)
    pts = pd.DataFrame({"id": range(3000), "x": rng.uniform(-2, 33, 3000), "y": rng.uniform(-2, 33, 3000)})
    polys = X.polygons_from_rings(spark, SHAPES)
    got = X.with_polygons(spark.createDataFrame(pts), polys, n_strips=strips).toPandas().set_index("id").inside
    assert len(got) == len(pts)
    for p in pts.itertuples():
        assert sorted(got[p.id]) == sorted(n for n, rings in SHAPES.items() if inside(p.x, p.y, rings))


def test_boundary_counts_only_for_intersects(spark):
    polys = X.polygons_from_rings(spark, SHAPES)
    pts = spark.createDataFrame([(1, 0.0, 5.0), (2, 5.0, 10.0), (3, 3.0, 5.0), (4, 10.0, 10.0), (5, 5.0, 5.0)], "id int, x double, y double")
    assert [r.id for r in X.points_in(pts, polys).collect()] == []
    assert sorted(r.id for r in X.points_in(pts, polys, boundary=True).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("crs", [PR.SINUSOIDAL, PR.MOLLWEIDE, PR.laea(-77.8, 41.0)])
def test_projection_round_trip(spark, crs):
    df = spark.range(-80, 81, 4).select(F.col("id").cast("double").alias("lat"), (F.col("id") * 0.9 - 77).alias("lon"))
    x, y = crs.forward(F.col("lon"), F.col("lat"))
    df = df.withColumn("x", x).withColumn("y", y)
    lon, lat = crs.inverse(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r.a == pytest.approx(r.lon, abs=1e-8) and r.b == pytest.approx(r.lat, abs=1e-8)


def test_projection_values(spark):
    one = spark.createDataFrame([(-77.0, 40.0)], "lon double, lat double")
    x, y = PR.MOLLWEIDE.forward(F.col("lon"), F.col("lat"))
    got = one.select(x, y).first()
    theta = math.radians(40)
    for _ in range(50):
        theta -= (2 * theta + math.sin(2 * theta) - math.pi * math.sin(math.radians(40))) / (2 + 2 * math.cos(2 * theta))
    a = 6378137.0
    assert got[0] == pytest.approx(2 * math.sqrt(2) / math.pi * a * math.radians(13) * math.cos(theta))
    assert got[1] == pytest.approx(math.sqrt(2) * a * math.sin(theta))
    far = spark.createDataFrame([(1e9, 0.0)], "x double, y double")
    for crs in (PR.SINUSOIDAL, PR.MOLLWEIDE, PR.laea(0, 0)):
        assert far.select(crs.inverse(F.col("x"), F.col("y"))[0]).first()[0] is None


def test_resample_to_equal_area_grid(spark):
    source = X.Grid(left=-7_000_000, top=4_700_000, size=27_000, rows=20, cols=20)
    x, y = source.centre(F.col("id") + 1)
    cells = spark.range(400).select(x.alias("x"), y.alias("y"), F.col("id").cast("double").alias("v"), F.lit("w1").alias("week"))
    crs = PR.laea(-78.5, 41.0)
    target = X.Grid(left=-200_000, top=200_000, size=20_000, rows=20, cols=20)
    got = X.resample_nearest(cells, source, PR.SINUSOIDAL, target, crs).toPandas().set_index("cell").v
    f1, l0, rad, sr = math.radians(41), math.radians(-78.5), 6378137.0, 6371007.181
    hits = 0
    for cell in range(1, 401):
        tx, ty = -200_000 + ((cell - 1) % 20 + 0.5) * 20_000, 200_000 - ((cell - 1) // 20 + 0.5) * 20_000
        rho = math.hypot(tx, ty)
        c = 2 * math.asin(rho / (2 * rad))
        lat = math.asin(math.cos(c) * math.sin(f1) + ty * math.sin(c) * math.cos(f1) / rho)
        lon = l0 + math.atan2(tx * math.sin(c), rho * math.cos(f1) * math.cos(c) - ty * math.sin(f1) * math.sin(c))
        row, col = math.floor((4_700_000 - sr * lat) / 27_000), math.floor((sr * lon * math.cos(lat) + 7_000_000) / 27_000)
        if 0 <= row < 20 and 0 <= col < 20:
            hits += 1
            assert got[cell] == row * 20 + col
        else:
            assert cell not in got.index
    assert hits > 50


def test_grid_mask_trim_and_pipeline(spark):
    grid = X.Grid(0.0, 10.0, 1.0, 10, 10)
    cells = grid.cells(spark).withColumn("v", F.col("cell").cast("double"))
    assert cells.where(grid.cell(F.col("x"), F.col("y")) != F.col("cell")).count() == 0
    assert cells.select(grid.cell(F.lit(-0.1), F.lit(5.0))).first()[0] is None
    poly = X.polygons_from_rings(spark, {"p": [[(2.2, 2.2), (5.1, 2.2), (5.1, 6.9), (2.2, 6.9)]]})
    masked = X.mask(cells, poly, "v")
    assert masked.count() == 100 and masked.where("v is not null").count() == 3 * 5
    assert X.trim(masked, "v").count() == 15
    assert X.rasterize(poly, grid).count() == 15
    deg = X.Grid(-80.0, 42.0, 0.05, 60, 60)
    small = deg.cells(spark).select("x", "y", F.col("cell").cast("double").alias("v"))
    region = X.polygons_from_rings(spark, {"r": [[(-79.0, 40.0), (-78.0, 40.0), (-78.0, 41.0), (-79.0, 41.0)]]})
    out = X.region_cells(small, region, deg, PR.LONLAT, "v", 5000.0).toPandas()
    assert out.v.notna().sum() > 300 and set(out.v.dropna()) <= set(range(1, 3601))


def test_centroid_and_box(spark):
    polys = X.polygons_from_rings(spark, {"sq": [[(0, 0), (4, 0), (4, 2), (0, 2)]], "tri": [[(0, 0), (3, 0), (0, 3)]]})
    got = {r.name: (r.x, r.y) for r in X.centroids(polys, 1).collect()}
    assert got == {"sq": (2.0, 1.0), "tri": (1.0, 1.0)}
    assert tuple(X.polygon_box(polys).first()) == (0.0, 0.0, 4.0, 3.0)


def test_layers(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (1, "b", 4.0), (2, "a", 2.0), (2, "b", 8.0)], "cell int, layer string, v double")
    assert {r.v for r in X.pick_layer(df, "layer", 2).collect()} == {4.0, 8.0}
    assert X.pick_layer(df, "layer", 3).count() == 0
    bins = {(r.cell, r.layer): r.bin for r in X.layer_bins(df, "v", [0.5]).collect()}
    assert bins == {(1, "a"): 0, (1, "b"): 1, (2, "a"): 1, (2, "b"): 2}
