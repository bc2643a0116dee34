import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsframe.operators import ordered as O
from obsframe.operators.aggregates import box_summary, density_1d, density_2d, histogram
from obsframe.operators.quantiles import exact_quantiles

PROBS = {"p0": 0.0, "p05": 0.05, "p25": 0.25, "p5": 0.5, "p9": 0.9, "p99": 0.99, "p1": 1.0}


def test_quantiles_are_exact_beyond_the_sketch(spark):
    rng = np.random.default_rng(3)
    groups = {
        "big": rng.normal(size=60_000), "ties": rng.integers(0, 5, 30_000).astype(float), "one": np.array([4.0]),
        "two": np.array([1.0, 10.0]), "const": np.full(50, 2.5), "ten": np.arange(10.0), "skew": rng.lognormal(0, 3, 20_001)}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in groups.items()])
    df = spark.createDataFrame(pdf).repartition(7).unionByName(spark.createDataFrame([("big", float("nan")), ("big", None)], "k string, v double"))
    for r in exact_quantiles(df, ["k"], "v", PROBS).collect():
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(np.quantile(groups[r.k], p), rel=1e-12, abs=1e-12), (r.k, name)
    whole = exact_quantiles(df, [], "v", PROBS).first()
    assert whole.p25 == pytest.approx(np.quantile(pdf.v, 0.25))


def test_quantiles_random_small(spark):
    rng = np.random.default_rng(8)
    parts = [pd.DataFrame({"k": n, "v": rng.integers(0, 50, n) / 7}) for n in range(1, 60)]
    df = spark.createDataFrame(pd.concat(parts))
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", PROBS).collect()}
    for p in parts:
        for name, q in PROBS.items():
            assert got[p.k[0]][name] == pytest.approx(np.quantile(p.v, q))


def hot(spark, n=4000):
    """One key holds most rows."""
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("k"),
        F.col("id").alias("t"), (F.col("id") * 7919 % 101).cast("double").alias("v"))


def test_running_sum_row_number_rolling(spark):
    df = hot(spark).repartition(5)
    pdf = df.toPandas().sort_values(["k", "t"])
    pdf["s"] = pdf.groupby("k").v.cumsum()
    pdf["n"] = pdf.groupby("k").cumcount() + 1
    pdf["m"] = pdf.groupby("k").v.transform(lambda x: x.rolling(21).mean())
    got = O.running_sum(df, ["t"], "v", "s", ["k"]).toPandas().sort_values(["k", "t"])
    assert np.allclose(got.s, pdf.s)
    got = O.running_sum(df, ["t"], "v", "s", ["k"], segment=F.floor(F.col("t") / 500)).toPandas().sort_values(["k", "t"])
    assert np.allclose(got.s, pdf.s)
    got = O.row_number(df, ["t"], "n", ["k"]).toPandas().sort_values(["k", "t"])
    assert (got.n.to_numpy() == pdf.n.to_numpy()).all()
    got = O.rolling_mean(df, ["k"], ["t"], "v", 21, "m", block=64).toPandas().sort_values(["k", "t"])
    assert len(got) == len(pdf) and np.allclose(got.m, pdf.m, equal_nan=True)
    whole = O.row_number(df, [F.col("v").desc(), "t"], "n").orderBy("n").toPandas()
    assert whole.n.tolist() == list(range(1, len(pdf) + 1)) and whole.v.is_monotonic_decreasing


def test_fill_down_across_segments(spark):
    df = hot(spark).withColumn("v", F.when(F.col("t") % 97 == 5, F.col("v"))).repartition(6)
    want = df.toPandas().sort_values(["k", "t"])
    want["v"] = want.groupby("k").v.ffill()
    got = O.fill_down(df, ["k"], ["t"], "v").toPandas().sort_values(["k", "t"])
    assert np.allclose(got.v, want.v, equal_nan=True)


def test_top_and_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 4), ("d", 4), ("e", 1), ("f", None)], "k string, v int")
    assert {r.k for r in O.top_n_with_ties(df, "v", 3).collect()} == {"a", "b", "c", "d"}
    assert {r.k for r in O.top_frac_with_ties(df.dropna(), "v", 0.4).collect()} == {"a", "b"}
    assert {r.k for r in O.top_frac_with_ties(df.dropna(), "v", 0.6).collect()} == {"a", "b", "c", "d"}
    assert O.top_frac_with_ties(df.dropna(), "v", 0.1).count() == 0
    big = hot(spark, 9000)
    top = O.top_k_per_group(big, ["k"], ["t"], 2000).groupBy("k").agg(F.count("*").alias("n"), F.max("t").alias("m")).toPandas()
    assert top.set_index("k").n["hot"] == 2000
    want = big.toPandas().sort_values("t").groupby("k").head(2000).groupby("k").t.max()
    assert top.set_index("k").m.to_dict() == want.to_dict()


def test_samples_do_not_depend_on_partitioning(spark):
    df = hot(spark)
    for draw in (lambda d: O.sample_rows(d, 50, ["t"]), lambda d: O.sample_rows_per_group(d, ["k"], 9, ["t"]),
                 lambda d: O.weighted_sample(d, 40, "v", ["t"]), lambda d: O.weighted_sample(d, 7, "v", ["t"], ["k"])):
        a, b = (sorted(r.t for r in draw(d).collect()) for d in (df, df.repartition(13).orderBy(F.col("v"))))
        assert a == b
    assert O.weighted_sample(df.where("v = 0"), 5, "v", ["t"]).count() == 0


def test_lag_change(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 0.0)], "k int, w double")
    got = {r.k: r.d for r in O.lag_change(df, "k", "w", "d").collect()}
    assert got == {1: None, 2: -1.0, 3: None}


def test_histogram_box_density(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": x})).unionByName(spark.createDataFrame([("c", 2.0)] * 3, "k string, v double"))
    h = histogram(df, "v", 10, ["k"]).toPandas()
    counts, _ = np.histogram(x, 10)
    assert h[h.k == "a"].set_index("bin").n.reindex(range(1, 11), fill_value=0).tolist() == counts.tolist()
    assert h[h.k == "c"][["bin", "n"]].values.tolist() == [[1, 3]]
    b = box_summary(df, ["k"], "v").toPandas().set_index("k")
    q1, q3 = np.quantile(x, [0.25, 0.75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    assert b.low["a"] == inside.min() and b.high["a"] == inside.max() and b.outliers["a"] == len(x) - len(inside)
    d = density_1d(df.where("k = 'a'"), "v").toPandas().sort_values("x")
    bw = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    exact = np.exp(-0.5 * ((d.x.to_numpy()[:, None] - x) / bw) ** 2).sum(1) / (len(x) * bw * np.sqrt(2 * np.pi))
    assert len(d) == 512 and np.allclose(d.density, exact, atol=2e-4)


def test_density_2d_against_all_points(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=800), rng.exponential(size=800)
    d = density_2d(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y", points=9).toPandas()

    def h(v):
        q1, q3 = np.quantile(v, [0.25, 0.75])
        return 1.06 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2

    hx, hy = h(x), h(y)
    kx = np.exp(-0.5 * ((d.x.to_numpy()[:, None] - x) / hx) ** 2) / (hx * np.sqrt(2 * np.pi))
    ky = np.exp(-0.5 * ((d.y.to_numpy()[:, None] - y) / hy) ** 2) / (hy * np.sqrt(2 * np.pi))
    exact = (kx * ky).mean(1)
    assert len(d) == 81 and np.allclose(d.density, exact, atol=0.01 * exact.max())


def test_quantiles_by_radix_on_hot_keys_ties_and_odd_values(spark):
    """One key with most rows, equal values, both zeros, infinities, subnormals, NULL and NaN values, a NULL key, and an empty table."""
    import random

    rng = random.Random(6)
    rows = [("hot", rng.choice([1.5, 1.5, -2.25, 0.0, -0.0, 5e-324, rng.uniform(-1e9, 1e9)])) for _ in range(4000)]
    rows += [("same", 7.0)] * 300 + [("one", -3.5), (None, 2.0), (None, 4.0), ("odd", float("nan")), ("odd", None), ("odd", 1e300), ("odd", -1e300)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q99": 0.99, "top": 1.0}
    got = {r["g"]: [r[p] for p in probs] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in {r[0] for r in rows}:
        values = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g] == pytest.approx([float(np.quantile(values, p)) for p in probs.values()], rel=1e-12), g
    assert exact_quantiles(df.limit(0), ["g"], "v", probs).collect() == []
    whole = exact_quantiles(df, [], "v", {"mid": 0.5}).first()["mid"]
    assert whole == pytest.approx(float(np.quantile([v for _, v in rows if v is not None and v == v], .5)))
