"""Scaling checks, PCA, clustering, mixtures, linear models, normality and local regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import stats as S
from ..operators.ordered import lag_change, weighted_sample
from ..operators.relational import keep_global_extreme, semi_join
from ..operators.reshape import distinct_values
from .flows import wide_tiles
from .q_rows import u_sql
from .registry import R, big, query, r, text

DIMS = 64  # length of the vectors
FEATURES = [f"e{i + 1}" for i in range(DIMS)]


def vectors_wide(t):
    """The vectors as a wide feature table; a vector of another length is an error."""
    whole = F.when(F.size("embedding") == DIMS, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector has not {DIMS} dimensions")).cast("array<float>"))
    vectors = t.embeddings.select("vec_id", "label", whole.alias("v"))
    return vectors.select("vec_id", "label", *[F.col("v")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)])


#: One row per vector and dimension, the dimension as a feature name.
LONG = "long_v AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings)"


def fits(assigned, centres):
    """Per row: no other centre is nearer than its own, and its own centre is the mean of its cluster's rows."""
    from ..session import cut_lineage

    rows = cut_lineage(assigned)
    all_centres = F.array(*[F.array(*[F.lit(v) for v in r["centre"]]) for r in centres.collect()])  # k rows, fixed by the query
    apart = lambda c: F.aggregate(F.zip_with(F.col("point"), c, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda a, x: a + x)
    nearest = F.col("d2") <= F.array_min(F.transform(all_centres, apart)) + 1e-9
    means = rows.groupBy("cluster").agg(F.array(*[F.avg(F.col("point")[i]) for i in range(DIMS)]).alias("mean"))
    off = means.join(centres, "cluster").select("cluster", F.array_max(F.zip_with("mean", "centre", lambda a, b: F.abs(a - b))).alias("off"))
    return rows.join(F.broadcast(off), "cluster").withColumn("fits", nearest & (F.col("off") < 1e-2))


def tile_matrix(t):
    species = distinct_values(t.tiles_ok, "species_name")
    return wide_tiles(t.tiles_ok, species), species


def season_matrix(t):
    months = list(range(1, 13))
    wide = t.seasonal.groupBy("common_name").pivot("month_no", months).agg(F.first("value"))
    names = [f"m{m}" for m in months]
    return wide.toDF("common_name", *names), names


@query("m01_pca_variance", (), f"""
WITH {LONG}, z AS (SELECT vec_id, i, x FROM long_v), c AS (SELECT corr(a.x, b.x) AS r FROM z a JOIN z b USING (vec_id) GROUP BY a.i, b.i)
SELECT {DIMS}::BIGINT AS components, 1.0::DOUBLE AS total, {R('SUM(r * r)', 3)} AS squares FROM c""")
def _(t):
    """The eigenvalues sum up to the trace of the correlations, their squares to the sum of squared correlations."""
    _, variance, _ = C.pca(vectors_wide(t), ["vec_id"], FEATURES)
    value = F.col("share") * DIMS
    return variance.agg(F.count(F.lit(1)).alias("components"), r(F.sum("share")).alias("total"), r(F.sum(value * value), 3).alias("squares"))


@query("m01_pca_correlations", (), f"""
WITH {LONG} SELECT 'e' || a.i AS a, 'e' || b.i AS b, {R('corr(a.x, b.x)', 5)} AS r FROM long_v a JOIN long_v b USING (vec_id) GROUP BY a.i, b.i""")
def _(t):
    """Rotation, eigenvalues and rotation again give the correlations back."""
    rotation, variance, _ = C.pca(vectors_wide(t), ["vec_id"], FEATURES)
    left = rotation.select("PC", F.col("column").alias("a"), F.col("value").alias("va"))
    right = rotation.select("PC", F.col("column").alias("b"), F.col("value").alias("vb"))
    back = left.join(right, "PC").join(variance, "PC")
    return back.groupBy("a", "b").agg(r(F.sum(F.col("va") * F.col("vb") * F.col("share") * DIMS), 5).alias("r"))


@query("m01_pca_norms", (), f"SELECT k AS pc, 1.0::DOUBLE AS norm FROM range(1, {DIMS + 1}) v(k)")
def _(t):
    rotation, _, _ = C.pca(vectors_wide(t), ["vec_id"], FEATURES)
    return rotation.groupBy(big("PC").alias("pc")).agg(r(F.sum(F.col("value") * F.col("value"))).alias("norm"))


@query("m02_rotation_wide")
def _(t):
    wide, species = tile_matrix(t)
    rotation, _, _ = C.pca(wide, ["x", "y"], species, 3)
    return C.rotation_wide(rotation, 3).select("column", *[r(f"PC{i}", 4).alias(f"PC{i}") for i in (1, 2, 3)])


@query("m03_kmeans_sizes", (), f"""
WITH {LONG} SELECT COUNT(DISTINCT vec_id) AS n, TRUE AS one_step_changes_nothing FROM long_v""")
def _(t):
    vec = C.vectors(vectors_wide(t), ["vec_id"], FEATURES)
    assigned, centres = C.kmeans(vec, 9)
    return fits(assigned, centres).agg(F.count(F.lit(1)).alias("n"), F.every("fits").alias("one_step_changes_nothing"))


@query("m03_m05_kmeans_table")
def _(t):
    wide, species = tile_matrix(t)
    assigned, centres = C.kmeans(C.vectors(wide, ["x", "y"], species), 9)
    return C.cluster_table(assigned, centres).select(big("cluster").alias("cluster"), "size", r("withinss").alias("withinss"))


@query("m04_sweep_one_cluster", (), f"""
WITH {LONG} SELECT 1::BIGINT AS k, {R('SUM(s)', 3)} AS tot_withinss FROM (SELECT var_pop(x) * COUNT(*) AS s FROM long_v GROUP BY i)""")
def _(t):
    s, _, _ = C.kmeans_sweep(vectors_wide(t), ["vec_id"], FEATURES, [1])
    return s.select(big("k").alias("k"), r("tot_withinss", 3).alias("tot_withinss"))


@query("m04_season_sweep")
def _(t):
    wide, names = season_matrix(t)
    s, _, _ = C.kmeans_sweep(wide, ["common_name"], names, range(1, 21))
    return s.select(big("k").alias("k"), r("tot_withinss").alias("tot_withinss"), r("betweenss").alias("betweenss"))


@query("m04_w05_sweep_change")
def _(t):
    wide, names = season_matrix(t)
    s, _, _ = C.kmeans_sweep(wide, ["common_name"], names, range(1, 21))
    return lag_change(s, "k", "tot_withinss", "diff").select(big("k").alias("k"), r("diff").alias("diff"))


@query("m04_sweep_tables", (), f"""
WITH {LONG}, tot AS (SELECT SUM(s) AS totss, ANY_VALUE(n) AS n FROM (SELECT var_pop(x) * COUNT(*) AS s, COUNT(*) AS n FROM long_v GROUP BY i))
SELECT k, n AS members, {R('totss', 2)} AS within_and_between FROM tot, (VALUES (1), (2), (5)) v(k)""")
def _(t):
    """Sizes of a sweep's clusters add up, and so do the squares within them and between their centres."""
    wide = vectors_wide(t)
    _, _, clusters = C.kmeans_sweep(wide, ["vec_id"], FEATURES, [1, 2, 5])
    middle = F.array(*[F.lit(v) for v in wide.agg(*[F.avg(c) for c in FEATURES]).first()])
    apart = F.aggregate(F.zip_with("centre", middle, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return clusters.groupBy("k").agg(F.sum("size").alias("members"), r(F.sum(F.col("withinss") + F.col("size") * apart), 2).alias("within_and_between"))


@query("m06_fit_summary", (), f"""
WITH {LONG} SELECT {R('SUM(s)', 3)} AS totss, TRUE AS adds_up FROM (SELECT var_samp(x) * (COUNT(*) - 1) AS s FROM long_v GROUP BY i)""")
def _(t):
    vec = C.vectors(vectors_wide(t), ["vec_id"], FEATURES)
    assigned, _ = C.kmeans(vec, 4)
    d = C.fit_summary(assigned, C.total_ss(vec, DIMS))
    ok = F.abs(F.col("totss") - F.col("tot_withinss") - F.col("betweenss")) < 1e-6
    return d.select(r("totss", 3).alias("totss"), (ok & (F.col("betweenss") > 0)).alias("adds_up"))


@query("m07_assignments", (), "SELECT vec_id, label, TRUE AS fits FROM embeddings")
def _(t):
    wide = vectors_wide(t)
    assigned, centres = C.kmeans(C.vectors(wide, ["vec_id", "label"], FEATURES), 4)
    return fits(assigned, centres).where(F.col("cluster").between(1, 4)).select("vec_id", big("label").alias("label"), "fits")


@query("m07_season_clusters")
def _(t):
    wide, names = season_matrix(t)
    assigned, _ = C.kmeans(C.vectors(wide, ["common_name"], names), 4)
    return assigned.select("common_name", big("cluster").alias("cluster"))


@query("m08_top_features", (), """
WITH p AS (SELECT label, 'e' || i AS name, round(AVG(embedding[i]), 9) AS v FROM embeddings, range(1, 65) v(i) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v DESC, name) AS rn FROM p)
SELECT rn AS "rank", MAX(CASE WHEN label = 0 THEN name END) AS "0", MAX(CASE WHEN label = 1 THEN name END) AS "1" FROM k WHERE rn <= 3 GROUP BY 1""")
def _(t):
    d = C.top_features(vectors_wide(t).drop("vec_id"), "label", FEATURES, 3)
    return d.select(big("rank").alias("rank"), "0", "1")


@query("m09_ward")
def _(t):
    wide, species = tile_matrix(t)
    return C.hierarchical(wide, ["x", "y"], species, 11).select("x", "y", big("cluster").alias("cluster"))


@query("m09_ward_members", (), "SELECT COUNT(*) AS n, 11::BIGINT AS clusters FROM embeddings")
def _(t):
    d = C.hierarchical(vectors_wide(t), ["vec_id"], FEATURES, 11)
    return d.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("clusters"))


@query("m10_ward_wss")
def _(t):
    wide, species = tile_matrix(t)
    return C.hierarchical_wss(wide, species, 20).select(big("clusters").alias("clusters"), "members", r("wss").alias("wss"))


@query("m10_ward_total", (), f"""
WITH {LONG} SELECT {R('SUM(s)', 3)} AS wss, ANY_VALUE(n) * 20 AS members, 19::BIGINT AS falls FROM (
  SELECT var_pop(x) * COUNT(*) AS s, COUNT(*) AS n FROM long_v GROUP BY i)""")
def _(t):
    d = lag_change(C.hierarchical_wss(vectors_wide(t), FEATURES, 20), "clusters", "wss", "diff")
    return d.agg(r(F.max(F.when(F.col("clusters") == 1, F.col("wss"))), 3).alias("wss"), F.sum("members").alias("members"),
                 F.count(F.when(F.col("diff") < 0, 1)).alias("falls"))


@query("m11_cluster_summary")
def _(t):
    wide, species = tile_matrix(t)
    return C.within_ss(C.hierarchical(wide, ["x", "y"], species, 11), len(species)).select(
        big("cluster").alias("cluster"), "members", r("sse").alias("sse"))


@query("m12_m13_mixture", (), f"""
SELECT 5::BIGINT AS g, {DIMS}::BIGINT AS d, COUNT(*) AS n, {4 + 5 * DIMS + 5 * DIMS * (DIMS + 1) // 2}::BIGINT AS df, TRUE AS likely FROM embeddings""")
def _(t):
    _, _, fit = C.gaussian_mixture(vectors_wide(t), ["vec_id"], FEATURES)
    return fit.select(big("G").alias("g"), big("d").alias("d"), "n", big("df").alias("df"),
                      (F.col("bic") < 2 * F.col("loglik")).alias("likely"))


@query("m13_components", (), "SELECT 1.0::DOUBLE AS total, COUNT(*) AS n FROM embeddings")
def _(t):
    _, parts, _ = C.gaussian_mixture(vectors_wide(t), ["vec_id"], FEATURES)
    return parts.agg(r(F.sum("proportion")).alias("total"), F.sum("size").alias("n"))


@query("m14_uncertainty", (), "SELECT vec_id, TRUE AS valid FROM embeddings")
def _(t):
    c, _, _ = C.gaussian_mixture(vectors_wide(t), ["vec_id"], FEATURES)
    return c.select("vec_id", (F.col("class").between(1, 5) & F.col("uncertainty").between(-1e-9, 0.8)).alias("valid"))


@query("a14_uncertainty_summary", (), f"""
SELECT label AS class, {R('AVG(abs(embedding[1]))', 5)} AS mean, {R('stddev_samp(abs(embedding[1]))', 5)} AS sd FROM embeddings GROUP BY 1""")
def _(t):
    d = t.embeddings.select(F.col("label").alias("class"), F.abs(F.col("embedding")[0].cast("double")).alias("uncertainty"))
    return C.uncertainty_summary(d).select(big("class").alias("class"), r("mean", 5).alias("mean"), r("sd", 5).alias("sd"))


MODEL = f"""lv AS (SELECT cell % 7 AS cell, CAST(week AS STRING) AS week, COUNT(*) AS n, AVG(abundance) AS m, var_pop(abundance) * COUNT(*) AS ss FROM cells GROUP BY 1, 2),
ft AS (SELECT cell, arg_min(m, week) AS m0, arg_min(n, week) AS n0, MIN(week) AS f0, SUM(ss) AS rss, SUM(n) - COUNT(*) AS df FROM lv GROUP BY 1)"""


@query("m15_factor_model", ("cells",), f"""
WITH {MODEL} SELECT lv.cell, CASE WHEN week = f0 THEN '(Intercept)' ELSE 'week' || week END AS term,
  {R('CASE WHEN week = f0 THEN m0 ELSE m - m0 END')} AS estimate,
  {R('CASE WHEN week = f0 THEN sqrt(rss / df / n0) ELSE sqrt(rss / df * (1 / n + 1 / n0)) END')} AS std_error FROM lv JOIN ft USING (cell)""")
def _(t):
    rows = t.cells.withColumn("cell", F.col("cell") % 7).withColumn("week", text("week"))
    d = S.factor_model(rows, ["cell"], "week", "abundance")
    return d.select("cell", "term", r("estimate").alias("estimate"), r("std_error").alias("std_error"))


@query("m16_mean_coefficient", ("cells",), f"""
SELECT weekofyear(week) AS week, {R('AVG(a - b)')} AS estimate FROM (
  SELECT week, abundance AS a, first_value(abundance) OVER (PARTITION BY cell ORDER BY week) AS b, row_number() OVER (PARTITION BY cell ORDER BY week) AS rn FROM cells)
WHERE rn > 1 GROUP BY 1""")
def _(t):
    rows = t.cells.withColumn("week", text("week")).fillna({"abundance": 0.0})
    d = S.factor_model(rows, ["cell"], "week", "abundance").where(F.col("term") != "(Intercept)")
    week = F.weekofyear(F.regexp_replace("term", "^week", "").try_cast("date"))
    return d.groupBy(big(week).alias("week")).agg(r(F.avg("estimate")).alias("estimate"))


@query("m17_normality")
def _(t):
    d = S.normality_test(t.tiles_ok, "species_name", "rel_abundance", ["species_name", "x", "y"])
    return d.select("species_name", r("w", 5).alias("w"), r("p_value", 5).alias("p_value"))


@query("m18_least_normal")
def _(t):
    d = S.normality_test(t.tiles_ok, "species_name", "rel_abundance", ["species_name", "x", "y"])
    least = keep_global_extreme(d, "p_value", smallest=True)
    rows = semi_join(t.tiles_ok, least, ["species_name"])
    return rows.select("species_name", "x", "y", r("rel_abundance").alias("v"))


@query("m19_sd_coverage", ("tiles_ok",), f"""
SELECT species_name, {R('mean')} AS mean, {R('sd')} AS sd, w1 AS within_1sd, w2 AS within_2sd, w1 >= 0.68 AS rule_68, w2 >= 0.95 AS rule_95 FROM (
  SELECT species_name, ANY_VALUE(m) AS mean, ANY_VALUE(s) AS sd,
    CAST(round_even(AVG(CASE WHEN rel_abundance BETWEEN m - s AND m + s THEN 1.0 ELSE 0.0 END), 4) AS DOUBLE) AS w1,
    CAST(round_even(AVG(CASE WHEN rel_abundance BETWEEN m - 2 * s AND m + 2 * s THEN 1.0 ELSE 0.0 END), 4) AS DOUBLE) AS w2
  FROM (SELECT *, AVG(rel_abundance) OVER w AS m, stddev_samp(rel_abundance) OVER w AS s FROM tiles_ok WHERE species_name <> 'Brand#3'
    WINDOW w AS (PARTITION BY species_name)) GROUP BY 1)""")
def _(t):
    d = S.sd_coverage(t.tiles_ok.where(F.col("species_name") != "Brand#3"), "species_name", "rel_abundance")
    return d.select("species_name", r("mean").alias("mean"), r("sd").alias("sd"), "within_1sd", "within_2sd", "rule_68", "rule_95")


FIT = "(b0*(s2*s4-s3*s3) - s1*(b1*s4-b2*s3) + s2*(b1*s3-b2*s2)) / (s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2))"


def loess_sql(daily: str) -> str:
    return f"""WITH d AS ({daily}), s AS (SELECT grp, COUNT(*) AS n, MIN(x) AS lo, MAX(x) AS hi FROM d GROUP BY 1),
p AS (SELECT d.grp, g, n, x, y, lo + g * (hi - lo) / 79 AS x0, abs(x - (lo + g * (hi - lo) / 79)) AS dist FROM d JOIN s USING (grp), range(0, 80) v(g)),
k AS (SELECT *, row_number() OVER (PARTITION BY grp, g ORDER BY dist, x) AS rn FROM p),
nb AS (SELECT *, MAX(dist) OVER (PARTITION BY grp, g) AS h FROM k WHERE rn <= GREATEST(FLOOR(n * 0.1 + 1e-5), 1)),
w AS (SELECT *, pow(1 - pow(dist / h, 3), 3) AS w, (x - x0) / h AS t FROM nb),
m AS (SELECT grp, g, ANY_VALUE(x0) AS x0, SUM(w) AS s0, SUM(w*t) AS s1, SUM(w*t*t) AS s2, SUM(w*t*t*t) AS s3, SUM(w*t*t*t*t) AS s4,
  SUM(w*y) AS b0, SUM(w*y*t) AS b1, SUM(w*y*t*t) AS b2 FROM w GROUP BY 1, 2)"""


DAYS = """SELECT 0 AS grp, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x, SUM(o_totalprice) / 1000 AS y FROM orders GROUP BY 2"""


@query("m20_loess", (), f"{loess_sql(DAYS)} SELECT {R('x0', 4)} AS x, {R(FIT, 3)} AS fit FROM m")
def _(t):
    d = t.orders.groupBy(F.unix_date(F.col("o_orderdate").cast("date")).alias("day")).agg((F.sum("o_totalprice") / 1000).alias("total"))
    return S.loess(d, "day", "total", 0.1).select(r("x", 4).alias("x"), r("fit", 3).alias("fit"))


YEARS = "SELECT year(o_orderdate) AS grp, CAST(dayofyear(o_orderdate) AS DOUBLE) AS x, CAST(COUNT(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2"


@query("m20_loess_per_year", (), f"{loess_sql(YEARS)} SELECT grp AS year, {R('x0', 4)} AS x, {R(FIT, 4)} AS fit FROM m")
def _(t):
    d = t.orders.groupBy(big(F.year("o_orderdate")).alias("year"), F.dayofyear("o_orderdate").alias("yday")).agg(F.count(F.lit(1)).alias("n"))
    return S.loess(d, "yday", "n", 0.1, ["year"]).select("year", r("x", 4).alias("x"), r("fit", 4).alias("fit"))


@query("m21_correlations", (), f"""
SELECT 'e' || i AS a, 'e' || j AS b, {R('corr(embedding[i], embedding[j])', 5)} AS r FROM embeddings, range(1, 65) p(i), range(1, 65) q(j) GROUP BY 1, 2""")
def _(t):
    return C.correlation_matrix(vectors_wide(t), FEATURES).withColumn("r", r("r", 5))


@query("m21_sampled_pairs", ("tiles_ok",), f"""
WITH s AS (SELECT species_name, x, y, log10(1 + CASE WHEN hi = lo THEN 0.5 ELSE (rel_abundance - lo) / (hi - lo) END) AS v FROM (
    SELECT *, MIN(rel_abundance) OVER w AS lo, MAX(rel_abundance) OVER w AS hi FROM tiles_ok WINDOW w AS (PARTITION BY species_name))),
k AS (SELECT species_name FROM (SELECT species_name, AVG(rel_abundance) AS m FROM tiles_ok GROUP BY 1)
  ORDER BY -ln({u_sql('species_name')}) / m, species_name LIMIT 10)
SELECT a.species_name AS a, b.species_name AS b, CASE WHEN stddev_pop(a.v) > 1e-12 AND stddev_pop(b.v) > 1e-12 THEN {R('corr(a.v, b.v)', 4)} END AS r
FROM s a JOIN s b USING (x, y) WHERE a.species_name IN (SELECT * FROM k) AND b.species_name IN (SELECT * FROM k) GROUP BY 1, 2""")
def _(t):
    wide, _ = tile_matrix(t)
    mean = t.tiles_ok.groupBy("species_name").agg(F.avg("rel_abundance").alias("mean"))
    names = distinct_values(weighted_sample(mean, 10, "mean", ["species_name"]), "species_name")
    return C.correlation_matrix(wide, names).withColumn("r", r("r", 4))


@query("v01_v03_guarded_test_per_group", ("cells",), "SELECT DISTINCT week::VARCHAR AS week, TRUE AS tested FROM cells")
def _(t):
    rows = t.cells.withColumn("week", text("week"))
    d = S.normality_test(rows, "week", "abundance", ["cell"])
    return d.select("week", (F.col("p_value").isNull() | F.col("p_value").between(0, 1)).alias("tested"))
