import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsframe.operators import cluster as C
from obsframe.operators import stats as S
from obsframe.plans.flows import scaled_tiles, seasonality


def blobs(n=240, d=4, k=4, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=8, size=(k, d))
    x = centres[np.arange(n) % k] + rng.normal(size=(n, d))
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(d)])
    pdf.insert(0, "id", range(n))
    return pdf, [f"c{i}" for i in range(d)]


def test_kmeans_invariants(spark):
    pdf, cols = blobs()
    df = spark.createDataFrame(pdf).repartition(4)
    x = pdf[cols].to_numpy()
    totss = ((x - x.mean(0)) ** 2).sum()
    s, a, clusters = C.kmeans_sweep(df, ["id"], cols, range(1, 7), starts=2)
    s = s.toPandas().sort_values("k")
    assert s.tot_withinss.iloc[0] == pytest.approx(totss)
    assert np.allclose(s.tot_withinss + s.betweenss, totss)
    assert s.tot_withinss.iloc[3] < 0.2 * totss and (s.tot_withinss.iloc[1:] < totss).all()
    parts = clusters.groupBy("k").agg(F.sum("size").alias("n"), F.sum("withinss").alias("w")).toPandas().sort_values("k")
    assert (parts.n == len(pdf)).all() and np.allclose(parts.w.to_numpy(), s.tot_withinss.to_numpy())
    a = a.toPandas()
    assert (a.groupby("k").size() == len(pdf)).all()
    for k, g in a.groupby("k"):
        m = g.merge(pdf, on="id")
        want = sum(((p[cols] - p[cols].mean()) ** 2).to_numpy().sum() for _, p in m.groupby("cluster"))
        assert s.set_index("k").tot_withinss[k] == pytest.approx(want, rel=1e-3)
    assigned, centres = C.kmeans(C.vectors(df, ["id"], cols), 4, starts=3)
    t = C.cluster_table(assigned, centres).toPandas()
    assert t["size"].sum() == len(pdf) and t.withinss.sum() == pytest.approx(assigned.agg(F.sum("d2")).first()[0])


def test_pca(spark):
    pdf, cols = blobs(d=5, seed=2)
    pdf["flat"] = 3.0
    rot, var, scores = C.pca(spark.createDataFrame(pdf), ["id"], [*cols, "flat"])
    x = pdf[cols].to_numpy()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert np.allclose(var.orderBy("PC").toPandas().share, values / values.sum())
    r = rot.toPandas().pivot(index="column", columns="PC", values="value")
    assert "flat" not in r.index and np.allclose(r.T @ r, np.eye(5), atol=1e-9)
    assert C.rotation_wide(rot, 2).columns == ["column", "PC1", "PC2"]
    assert scores.count() == len(pdf)


def test_hierarchy_of_separate_groups(spark):
    pdf, cols = blobs(400, 3, 4, seed=6)
    df, x = spark.createDataFrame(pdf), pdf[cols].to_numpy()
    got = C.hierarchical(df, ["id"], cols, 4).toPandas()
    assert sorted(sorted(g.id) for _, g in got.groupby("cluster")) == [list(range(i, 400, 4)) for i in range(4)]
    curve = C.hierarchical_wss(df, cols, 6).toPandas().set_index("clusters").sort_index()
    assert (curve.members == 400).all() and curve.wss[1] == pytest.approx(((x - x.mean(0)) ** 2).sum())
    assert curve.wss[4] == pytest.approx(sum(((x[i::4] - x[i::4].mean(0)) ** 2).sum() for i in range(4))) and (curve.wss.diff().dropna() < 0).all()
    sse = C.within_ss(C.hierarchical(df, ["id"], cols, 6), 3).agg(F.sum("sse"), F.sum("members")).first()
    assert sse[0] == pytest.approx(curve.wss[6]) and sse[1] == 400


def test_hierarchy_labels_run_by_size(spark):
    pdf, cols = blobs(900, 4, 5, seed=4)
    sizes = C.hierarchical(spark.createDataFrame(pdf), ["id"], cols, 7).groupBy("cluster").count().orderBy("cluster").toPandas()["count"].tolist()
    assert len(sizes) == 7 and sizes == sorted(sizes, reverse=True)


def test_mixture(spark):
    pdf, cols = blobs(300, 4, 3, seed=9)
    c, parts, fit = C.gaussian_mixture(spark.createDataFrame(pdf), ["id"], cols, g=3, components=3)
    row = fit.first()
    assert row["df"] == 2 + 9 + 18 and row.bic == pytest.approx(2 * row.loglik - 29 * math.log(300))
    p = parts.toPandas()
    assert p.proportion.sum() == pytest.approx(1) and p["size"].sum() == 300
    u = C.uncertainty_summary(c).toPandas()
    assert u["mean"].between(0, 2 / 3).all()


def test_mixture_of_many_features(spark):
    """Forty features: the groups are found, and posteriors follow from the fitted components."""
    pdf, cols = blobs(900, 40, 3, seed=11)
    c, parts, fit = C.gaussian_mixture(spark.createDataFrame(pdf), ["id"], cols, g=3)
    got = c.toPandas().set_index("id")
    assert fit.first()["d"] == 40 and all(got["class"][got.index % 3 == i].nunique() == 1 for i in range(3)) and got["class"].nunique() == 3
    means = {r["class"]: np.array(r["mean"]) for r in parts.collect()}
    for k, m in means.items():
        assert np.allclose(m, pdf[cols].to_numpy()[got["class"].loc[pdf.id].to_numpy() == k].mean(0), atol=1e-3)
    assert (got.uncertainty < 1e-6).all()


def test_mixture_passes_move_packed_rows(spark, monkeypatch):
    """A pass reads rows as bytes and gives the driver its sums in a few rows, however large the model; it never goes through pandas."""
    pdf, cols = blobs(600, 12, 3, seed=5)
    df = spark.createDataFrame(pdf).repartition(5)
    frame, read, got = type(df), [], []
    arrow, collect = frame.mapInArrow, frame.collect
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: read.append([kind for _, kind in self.dtypes]) or arrow(self, *a, **b))
    monkeypatch.setattr(frame, "collect", lambda self: got.append(collect(self)) or got[-1])
    for name in ("mapInPandas", "toPandas"):
        monkeypatch.setattr(frame, name, lambda self, *a, name=name, **b: pytest.fail(name))
    _, _, fit = C.gaussian_mixture(df, ["id"], cols, g=3)
    passes = [kinds for kinds in read if kinds == ["binary"]]
    assert len(passes) > 3 and max(len(rows) for rows in got) <= 5 and fit.first()["n"] == 600


def test_mixture_against_plain_numpy(spark):
    """Every step, over rows in several tasks and slices, is that of a plain loop from the same start; a column that is constant, NULL throughout or holds a NaN is left out."""
    pdf, cols = blobs(2600, 3, 2, seed=8)
    pdf["c1"] += 3 * pdf.c0 * np.sin(pdf.id)
    pdf["flat"], pdf["odd"] = 0.1, np.where(pdf.id == 9, np.nan, pdf.c0)
    df = spark.createDataFrame(pdf).coalesce(3).withColumn("none", F.lit(None).cast("double"))
    classified, parts, fit = C.gaussian_mixture(df, ["id"], ["flat", *cols, "none", "odd"], g=2)
    x, row = pdf[cols].to_numpy(), fit.first()
    model = parts.orderBy("class").toPandas()
    got = classified.toPandas().set_index("id").loc[pdf.id]
    p = np.zeros((len(x), 2))
    p[:, 0], p[:, 1] = got["class"] == 1, got["class"] == 2
    before = -np.inf
    for _ in range(200):
        w, m = p.mean(0), (p.T @ x) / p.sum(0)[:, None]
        c = [((x - m[j]) * p[:, [j]]).T @ (x - m[j]) / p[:, j].sum() + 1e-6 * np.diag(x.var(0)) for j in range(2)]
        logs = np.stack([np.log(w[j]) - .5 * (np.einsum("ij,ij->i", (x - m[j]) @ np.linalg.inv(c[j]), x - m[j]) + np.linalg.slogdet(2 * np.pi * c[j])[1]) for j in range(2)], 1)
        each = np.logaddexp.reduce(logs, 1)
        p = np.exp(logs - each[:, None])
        if each.mean() - before < 1e-9:
            break
        before = each.mean()
    assert row["d"] == 3 and row["n"] == 2600 and row["loglik"] / 2600 == pytest.approx(before, abs=1e-3)
    assert np.allclose(model.proportion, w, atol=1e-2) and np.allclose(np.stack(model["mean"]), m, atol=5e-2)
    assert (got["class"].to_numpy() == p.argmax(1) + 1).mean() > 0.995 and np.allclose(got.uncertainty, 1 - p.max(1), atol=5e-2)


def test_mixture_keeps_long_ids_beside_missing_ones(spark):
    pdf, cols = blobs(90, 3, 3, seed=1)
    rows = [(None if i % 9 == 0 else 2**53 + 1 + 2 * i, *map(float, v)) for i, v in zip(pdf.id, pdf[cols].to_numpy())]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))
    got = [r.id for r in C.gaussian_mixture(df, ["id"], cols, g=3)[0].collect()]
    assert sorted(map(str, got)) == sorted(str(r[0]) for r in rows)


def test_correlation_matrix_with_constant(spark):
    pdf, cols = blobs(50)
    pdf["flat"] = 1.0
    got = {(r.a, r.b): r.r for r in C.correlation_matrix(spark.createDataFrame(pdf), [*cols, "flat"]).collect()}
    assert got[("c0", "c1")] == pytest.approx(np.corrcoef(pdf.c0, pdf.c1)[0, 1]) and got[("c0", "flat")] is None and got[("flat", "flat")] is None


def test_shapiro_known_values():
    a = [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66]
    w, p = S.shapiro_wilk(np.array(a))
    assert w == pytest.approx(0.900473, abs=2e-6) and p == pytest.approx(0.042090, abs=2e-5)
    w, p = S.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.7888, abs=1e-4) and p == pytest.approx(0.0067, abs=1e-4)
    for bad in ([1, 2], [3.0] * 9, range(6000)):
        assert math.isnan(S.shapiro_wilk(np.array(bad, dtype=float))[0])
    assert S.shapiro_wilk(np.array([1.0, 2.0, 3.0]))[1] == pytest.approx(1.0)


def test_normality_per_group(spark):
    rng = np.random.default_rng(0)
    pdf = pd.concat([pd.DataFrame({"k": "normal", "v": rng.normal(50, 1, 800)}), pd.DataFrame({"k": "skew", "v": rng.lognormal(0, 2, 800)}),
                     pd.DataFrame({"k": "flat", "v": [2.0] * 9}), pd.DataFrame({"k": "zero", "v": [0.0] * 9})])
    pdf["id"] = range(len(pdf))
    got = {r.k: r.p_value for r in S.normality_test(spark.createDataFrame(pdf), "k", "v", ["id"]).collect()}
    assert got["normal"] > 0.05 > got["skew"] and got["flat"] is None and got["zero"] is None


def test_sd_coverage_of_normal_data(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": "n", "v": rng.normal(size=5000)})
    r = S.sd_coverage(spark.createDataFrame(pdf), "k", "v").first()
    assert abs(r.within_1sd - 0.683) < 0.02 and abs(r.within_2sd - 0.954) < 0.01


def test_factor_model_against_least_squares(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"cell": rng.integers(0, 3, 90), "week": rng.choice(list("abcd"), 90), "y": rng.normal(size=90)})
    got = {(r.cell, r.term): (r.estimate, r.std_error) for r in S.factor_model(spark.createDataFrame(pdf), ["cell"], "week", "y").collect()}
    for cell, g in pdf.groupby("cell"):
        levels = sorted(g.week.unique())
        m = np.column_stack([np.ones(len(g))] + [(g.week == lv).astype(float) for lv in levels[1:]])
        beta, rss, *_ = np.linalg.lstsq(m, g.y, rcond=None)
        se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * rss[0] / (len(g) - len(levels)))
        for term, b, s in zip(["(Intercept)"] + [f"week{lv}" for lv in levels[1:]], beta, se):
            assert got[(cell, term)] == (pytest.approx(b), pytest.approx(s))
    single = spark.createDataFrame([(1, "a", 2.0), (1, "b", 5.0)], "cell int, week string, y double")
    assert {(r.term, r.estimate, r.std_error) for r in S.factor_model(single, ["cell"], "week", "y").collect()} == {
        ("(Intercept)", 2.0, None), ("weekb", 3.0, None)}


def test_loess_against_weighted_fit(spark):
    rng = np.random.default_rng(4)
    x = np.sort(rng.choice(np.arange(400), 200, replace=False)).astype(float)
    y = np.sin(x / 40) + rng.normal(scale=0.2, size=200)
    got = S.loess(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y", 0.2, points=21).toPandas().sort_values("x")
    for x0, fit in got.itertuples(index=False):
        d = np.abs(x - x0)
        h = np.sort(d)[39]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        assert fit == pytest.approx(np.polyval(np.polyfit(x - x0, y, 2, w=np.sqrt(w)), 0), abs=1e-8)


def test_scalings_have_no_nan_and_constant_group_is_half(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("a", 1.0, 0.0, 3.0), ("c", 0.0, 0.0, 5.0), ("c", 1.0, 0.0, 5.0)],
                               "species_name string, x double, y double, rel_abundance double")
    got = scaled_tiles(df).toPandas()
    c = got[got.species_name == "c"]
    assert (c.rescaled == 0.5).all() and c.scaled.isna().all()
    assert np.allclose(got.rescaled_log10, np.log10(got.rescaled + 1))


def test_seasonality_fills_months(spark):
    df = spark.createDataFrame([("a", "2016-01-05", 3.0), ("a", "2017-01-09", None), ("b", "2016-02-01", 100.0), ("b", "1990-05-01", 9.0)],
                               "common_name string, d string, observation_count double").withColumn("observation_date", F.col("d").cast("date"))
    got = {(r.common_name, r.month_no): r.value for r in seasonality(df, 2016).collect()}
    assert got == {("a", 1): pytest.approx(math.log10(1.5)), ("a", 2): 0.0, ("b", 1): 0.0, ("b", 2): 2.0}


def test_seasonality_reads_its_rows_once(spark, tmp_path):
    df = spark.createDataFrame([("a", date(2020, 1, 1), 3.0), ("b", date(2021, 2, 1), None)], "common_name string, observation_date date, observation_count double")
    df.write.parquet(str(tmp_path / "observed"))
    out = seasonality(spark.read.parquet(str(tmp_path / "observed")), 2016)
    assert out.inputFiles() and not any("/observed/" in f for f in out.inputFiles())
    assert {(r.common_name, r.month_no) for r in out.collect()} == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
