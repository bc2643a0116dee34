import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsframe.operators import pairwise as P


def rows(seed=0, n=900, nulls=0.1):
    """A third of all rows sits in one feature; pairs of (item, feature) repeat."""
    rng = np.random.default_rng(seed)
    feature = np.where(rng.random(n) < 1 / 3, "hot", np.char.add("f", rng.integers(0, 60, n).astype(str)))
    w = np.where(rng.random(n) < nulls, np.nan, rng.integers(0, 4, n))
    return pd.DataFrame({"item": np.char.add("i", rng.integers(0, 17, n).astype(str)), "feature": feature, "w": w, "o": np.arange(n)})


def to_df(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("w", F.when(~F.isnan("w"), F.col("w"))).repartition(6)


def brute(pdf, skip=False):
    first = pdf.sort_values("o").drop_duplicates(["item", "feature"])
    held = {f: dict(zip(g.item, g.w)) for f, g in first.groupby("feature")}
    out = {}
    for items in held.values():
        for a, b in itertools.permutations(sorted(items), 2):
            wa, wb = items[a], items[b]
            if skip and (np.isnan(wa) or np.isnan(wb)):
                continue
            out.setdefault((a, b), []).append(np.nan if np.isnan(wa) or np.isnan(wb) else wa * (wb > 0))
    return {k: (None if np.isnan(v).any() else float(sum(v))) for k, v in out.items()}


@pytest.mark.parametrize("block", [2000, 3])
@pytest.mark.parametrize("null_weight", ["null", "skip"])
def test_weighted_pairs(spark, block, null_weight):
    pdf = rows()
    got = {(r.item1, r.item2): r.n for r in P.pairwise_count(
        to_df(spark, pdf), "item", "feature", "w", ["o"], null_weight=null_weight, block=block).collect()}
    assert got == brute(pdf, null_weight == "skip")


def test_triangle_and_unweighted(spark):
    pdf = rows(1, nulls=0)
    df = to_df(spark, pdf)
    full = P.pairwise_count(df, "item", "feature").toPandas()
    low = P.pairwise_count(df, "item", "feature", upper=False).toPandas()
    assert len(full) == 2 * len(low) and (low.item1 < low.item2).all()
    sets = pdf.drop_duplicates(["item", "feature"]).groupby("item").feature.agg(set)
    assert all(r.n == len(sets[r.item1] & sets[r.item2]) for r in full.itertuples())


@pytest.mark.parametrize("block", [2000, 4])
def test_phi_against_dense_matrix(spark, block):
    pdf = rows(2, 300)
    pdf = pd.concat([pdf, pd.DataFrame({"item": "everywhere", "feature": pdf.feature.unique(), "w": 1.0, "o": 0}),
                     pd.DataFrame({"item": ["lonely"], "feature": ["f0"], "w": [1.0], "o": [0]})])
    m = pd.crosstab(pdf.feature, pdf["item"]).clip(upper=1)
    got = {(r.item1, r.item2): r.correlation for r in P.pairwise_phi(to_df(spark, pdf), "item", "feature", block=block).collect()}
    assert len(got) == m.shape[1] * (m.shape[1] - 1)
    with np.errstate(all="ignore"):
        want = np.corrcoef(m.to_numpy().T)
    for (a, b), v in got.items():
        w = want[m.columns.get_loc(a), m.columns.get_loc(b)]
        assert (v is None and np.isnan(w)) or v == pytest.approx(w, abs=1e-12)


def test_phi_per_stratum_equals_separate_runs(spark):
    pdf = rows(3)
    pdf["s"] = np.where(pdf.o % 3 == 0, "x", "y")
    df = to_df(spark, pdf)
    both = P.pairwise_phi(df, "item", "feature", ["s"], upper=False, block=5).toPandas()
    for s in "xy":
        one = P.pairwise_phi(df.where(F.col("s") == s), "item", "feature", upper=False).toPandas()
        a = both[both.s == s].set_index(["item1", "item2"]).correlation.sort_index()
        assert np.allclose(a, one.set_index(["item1", "item2"]).correlation.sort_index(), equal_nan=True)


def test_empty_and_null_keys(spark):
    df = spark.createDataFrame([("a", None, 1.0), (None, "f", 1.0), ("a", "f", 1.0)], "item string, feature string, w double")
    assert P.pairwise_count(df, "item", "feature", "w").count() == 0
    assert P.pairwise_phi(df, "item", "feature").count() == 0


@pytest.mark.parametrize("block", [2000, 3])
def test_missing_stratum_is_a_stratum(spark, block):
    rng = np.random.default_rng(12)
    rows = [(None if s == 0 else f"s{s}", f"i{i}", f"f{f}") for s in range(3) for i in range(7) for f in range(9) if rng.random() < .5]
    named = [("none" if s is None else s, i, f) for s, i, f in rows]
    kind = "s string, i string, f string"
    for fn, value in ((P.pairwise_phi, "correlation"), (P.pairwise_count, "n")):
        got = {(r.s or "none", r.item1, r.item2): r[value] for r in fn(spark.createDataFrame(rows, kind), "i", "f", strata=["s"], block=block).collect()}
        want = {(r.s, r.item1, r.item2): r[value] for r in fn(spark.createDataFrame(named, kind), "i", "f", strata=["s"], block=block).collect()}
        assert got.keys() == want.keys() and any(k[0] == "none" for k in got)
        assert all(got[k] == want[k] or got[k] == pytest.approx(want[k]) for k in got)


def test_nest_keeps_missing_keys(spark):
    from obsframe.operators.reshape import nest, unnest

    rows = [(None, 1), (None, 2), ("a", 3)]
    back = unnest(nest(spark.createDataFrame(rows, "k string, v int"), ["k"])).collect()
    assert sorted((r.k or "", r.v) for r in back) == [("", 1), ("", 2), ("a", 3)]


def test_wide_cell_with_several_values(spark):
    from obsframe.operators.reshape import wider

    rows = [(1, "a", 5), (1, "a", 3), (1, "b", None), (2, "b", 7)]
    got = wider(spark.createDataFrame(rows, "k int, name string, v int").repartition(3), ["k"], "name", "v").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 3, None), (2, None, 7)]
