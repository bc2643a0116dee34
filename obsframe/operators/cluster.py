"""Clustering and dimension reduction on Spark ML.

Input is a wide table; ``ids`` are carried along, ``features`` are the numeric columns. The
feature vectors are written once before a fit, so no iteration goes back to their source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans, KMeansModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..session import cut_lineage


def vectors(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``(ids…, point ARRAY, features VECTOR)``."""
    point = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    return df.select(*ids, point.alias("point")).withColumn("features", array_to_vector("point"))


def _squares(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def total_ss(vec: DataFrame, dims: int) -> float:
    """Total sum of squares: per column variance · (n - 1)."""
    row = vec.agg(F.count(F.lit(1)).alias("n"), *[F.var_samp(F.col("point")[i]).alias(f"v{i}") for i in range(dims)]).first()
    return sum((row[f"v{i}"] or 0.0) for i in range(dims)) * max(row["n"] - 1, 0)


# -- PCA -------------------------------------------------------------------------------------

def varying(df: DataFrame, features: Sequence[str]) -> list[str]:
    """The features that are not constant."""
    row = df.agg(*[F.stddev_samp(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(features)]).first()
    return [c for i, c in enumerate(features) if row[str(i)] and not math.isnan(row[str(i)])]


def pca(df: DataFrame, ids: Sequence[str], features: Sequence[str], k: int | None = None):
    """PCA of centred and scaled columns; constant columns are left out.

    Returns ``(rotation, variance, scores)``: the long rotation table ``(column, PC, value)``,
    ``(PC, share)`` and the input ids with a ``pc`` vector. Signs are set so that the largest
    loading of each component is positive.
    """
    spark = df.sparkSession
    features = varying(df, features)
    k = min(k or len(features), len(features))
    vec = cut_lineage(vectors(df, ids, features))
    scaled = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(vec).transform(vec)
    model = PCA(k=k, inputCol="z", outputCol="pc").fit(scaled)
    loadings = model.pc.toArray()
    signs = [1.0 if col[np.argmax(np.abs(col))] >= 0 else -1.0 for col in loadings.T]
    rotation = spark.createDataFrame(
        [(c, j + 1, float(loadings[i, j] * signs[j])) for i, c in enumerate(features) for j in range(k)],
        "`column` string, PC int, value double")
    variance = spark.createDataFrame(
        [(j + 1, float(v)) for j, v in enumerate(model.explainedVariance)], "PC int, share double")
    sign = F.array(*[F.lit(s) for s in signs])
    scores = model.transform(scaled).withColumn(
        "pc", array_to_vector(F.zip_with(vector_to_array("pc"), sign, lambda a, b: a * b))).select(*ids, "pc")
    return rotation, variance, scores


def rotation_wide(rotation: DataFrame, k: int) -> DataFrame:
    wide = rotation.groupBy("column").pivot("PC", list(range(1, k + 1))).agg(F.first("value"))
    return wide.withColumnsRenamed({str(i): f"PC{i}" for i in range(1, k + 1)})


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long Pearson matrix ``(a, b, r)``; NULL for constant columns."""
    moving = set(varying(df, features))
    m = Correlation.corr(vectors(df, [], features), "features").first()[0].toArray()
    rows = [(a, b, float(m[i, j]) if a in moving and b in moving else None)
            for i, a in enumerate(features) for j, b in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


# -- k-means ---------------------------------------------------------------------------------

def _best_kmeans(vec: DataFrame, k: int, seed: int, starts: int) -> KMeansModel:
    runs = [KMeans(k=k, seed=seed + i, maxIter=50, tol=1e-6).fit(vec) for i in range(starts)]
    return min(runs, key=lambda m: m.summary.trainingCost)


def kmeans(vec: DataFrame, k: int, seed: int = 1234, starts: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(assigned, centres)``: the input with ``cluster`` (1..k) and ``d2`` to its centre, and
    ``(cluster, centre ARRAY)``. ``k = 1`` is the column means; otherwise the best of
    ``starts`` seeded runs."""
    spark = vec.sparkSession
    if k == 1:
        dims = len(vec.select("point").first()[0])
        mean = vec.agg(*[F.avg(F.col("point")[i]).alias(str(i)) for i in range(dims)]).first()
        centres = [[float(v) for v in mean]]
        labelled = vec.withColumn("cluster", F.lit(1))
    else:
        model = _best_kmeans(vec, k, seed, starts)
        centres = [[float(v) for v in c] for c in model.clusterCenters()]
        labelled = model.transform(vec).withColumn("cluster", F.col("prediction") + 1).drop("prediction")
    table = spark.createDataFrame([(i + 1, c) for i, c in enumerate(centres)], "cluster int, centre array<double>")
    # k rows, fixed by the argument
    assigned = labelled.join(F.broadcast(table), "cluster").withColumn("d2", _squares(F.col("point"), F.col("centre")))
    return assigned.drop("centre"), table


def cluster_table(assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """``(cluster, centre, size, withinss)``."""
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("d2").alias("withinss"))
    return centres.join(sums, "cluster", "left").fillna({"size": 0, "withinss": 0.0})


def fit_summary(assigned: DataFrame, totss: float) -> DataFrame:
    """One row ``(totss, tot_withinss, betweenss)``."""
    return assigned.agg(F.sum("d2").alias("tot_withinss")).select(
        F.lit(totss).alias("totss"), "tot_withinss", (F.lit(totss) - F.col("tot_withinss")).alias("betweenss"))


def kmeans_sweep(df: DataFrame, ids: Sequence[str], features: Sequence[str], ks: Sequence[int], seed: int = 1234,
                 starts: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(summaries, assignments, clusters)`` for several k: one row per k, the ids with (k, cluster), and
    ``(k, cluster, centre, size, withinss)``.

    Each fit is a distributed job; the labels of all fits are then read off in one pass.
    """
    spark = df.sparkSession
    vec = cut_lineage(vectors(df, ids, features))
    totss = total_ss(vec, len(features))
    labelled, centres = vec, []
    for k in ks:
        if k == 1:
            row = vec.agg(*[F.avg(F.col("point")[i]).alias(str(i)) for i in range(len(features))]).first()
            labelled = labelled.withColumn("1", F.lit(0))
            centres.append((1, 0, [float(v) for v in row]))
            continue
        model = _best_kmeans(vec, k, seed, starts)
        labelled = model.setPredictionCol(str(k)).transform(labelled)
        centres += [(k, i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    # as many rows as the requested k sum up to
    table = F.broadcast(spark.createDataFrame(centres, "k int, cluster int, centre array<double>"))
    long = labelled.drop("features").unpivot([*ids, "point"], [str(k) for k in ks], "k", "cluster")
    long = long.withColumn("k", F.col("k").cast("int")).join(table, ["k", "cluster"])
    long = long.withColumn("d2", _squares(F.col("point"), F.col("centre")))
    summaries = long.groupBy("k").agg(F.sum("d2").alias("tot_withinss")).select(
        "k", F.lit(totss).alias("totss"), "tot_withinss", (F.lit(totss) - F.col("tot_withinss")).alias("betweenss"))
    sizes = long.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("d2").alias("withinss"))
    clusters = table.join(sizes, ["k", "cluster"], "left").fillna({"size": 0, "withinss": 0.0}).withColumn("cluster", F.col("cluster") + 1)
    return summaries, long.select(*ids, "k", (F.col("cluster") + 1).alias("cluster")), clusters


def cluster_profile(wide: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Mean of every feature per cluster, long."""
    return (wide.unpivot([cluster], list(features), "name", "value")
            .groupBy(cluster, "name").agg(F.avg("value").alias("value")))


def top_features(wide: DataFrame, cluster: str, features: Sequence[str], k: int = 3) -> DataFrame:
    """One column per cluster, its k highest features by rank down the rows."""
    from .ordered import top_k_per_group
    from .reshape import wider

    best = top_k_per_group(cluster_profile(wide, cluster, features), [cluster],
                           [F.col("value").desc(), F.col("name")], k, rank="rank")
    return wider(best, ["rank"], cluster, "name")


# -- hierarchy -------------------------------------------------------------------------------

def _bisecting(vec: DataFrame, k: int, seed: int):
    return BisectingKMeans(k=k, seed=seed, maxIter=20).fit(vec)


def hierarchical(df: DataFrame, ids: Sequence[str], features: Sequence[str], k: int, seed: int = 1234) -> DataFrame:
    """A divisive hierarchy cut at k: ``(ids…, point, cluster)``.

    The cluster that is split next is always a largest one, each split is a two-means fit on Spark. Labels run from the largest
    cluster (1) down, ties by centre.
    """
    vec = cut_lineage(vectors(df, ids, features))
    model = _bisecting(vec, k, seed)
    labelled = model.transform(vec)
    sizes = {r["prediction"]: r["n"] for r in labelled.groupBy("prediction").agg(F.count(F.lit(1)).alias("n")).collect()}
    centres = model.clusterCenters()
    rank = {c: i + 1 for i, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], tuple(centres[c]))))}
    table = df.sparkSession.createDataFrame(list(rank.items()), "prediction int, cluster int")
    return labelled.join(F.broadcast(table), "prediction").select(*ids, "point", "cluster")


def hierarchical_wss(df: DataFrame, features: Sequence[str], k_max: int = 20, seed: int = 1234) -> DataFrame:
    """``(clusters, members, wss)`` of the cuts 1..k_max: the sum of squares inside the clusters, about their own means."""
    vec = cut_lineage(vectors(df, [], features))
    labelled = vec.withColumn("1", F.lit(0))
    for k in range(2, k_max + 1):
        labelled = _bisecting(vec, k, seed).setPredictionCol(str(k)).transform(labelled)
    long = labelled.drop("features").unpivot(["point"], [str(k) for k in range(1, k_max + 1)], "k", "cluster")
    sums = long.withColumn("cluster", F.struct(F.col("k").cast("int").alias("k"), F.col("cluster").alias("c")))
    per = within_ss(sums, len(features)).select("cluster.k", "members", "sse")
    return per.groupBy(F.col("k").alias("clusters")).agg(F.sum("members").alias("members"), F.sum("sse").alias("wss"))


def within_ss(assigned: DataFrame, dims: int) -> DataFrame:
    """``(cluster, members, sse)`` of any labelled vectors."""
    sums = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"),
        F.array(*[F.coalesce(F.var_pop(F.col("point")[i]), F.lit(0.0)) for i in range(dims)]).alias("v"))
    return sums.select("cluster", "members", (F.aggregate("v", F.lit(0.0), lambda s, v: s + v) * F.col("members")).alias("sse"))


# -- Gaussian mixture ------------------------------------------------------------------------

def _packed(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``(ids…, point ARRAY, packed BINARY)``, written once: the point's doubles also as bytes, so that a pass does not decode them one by one.

    Not compressed, which spares doubles little room and costs every pass; in row groups small enough that a pass is dealt evenly."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("point").flatten()
            width = 8 * (len(flat) // max(len(batch), 1))
            data = pa.py_buffer(np.ascontiguousarray(flat.to_numpy(zero_copy_only=False)))
            at = pa.py_buffer(np.arange(len(batch) + 1, dtype=np.int64) * width)
            yield batch.append_column("packed", pa.Array.from_buffers(pa.large_binary(), len(batch), [None, at, data]).cast(pa.binary()))

    df = df.select(*ids, "point")
    return cut_lineage(df.mapInArrow(pack, StructType([*df.schema, StructField("packed", BinaryType())])), **{"compression": "uncompressed", "parquet.block.size": 16 << 20})


def _matrices(batches: Iterator[pa.RecordBatch], keep: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The packed rows as they lie in memory, a batch at a time; ``keep``: only these of their columns."""
    for batch in batches:
        if len(batch):
            column = batch.column("packed").cast(pa.large_binary())
            at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
            x = np.frombuffer(column.buffers()[2], np.float64, (at[-1] - at[0]) // 8, at[0]).reshape(len(column), -1)
            yield x if keep is None else x[:, keep]


def _spread(data: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Per column its values that are not NULL and their sum of squares about the mean (0 for a constant, NaN where a value is), and how many tasks have rows."""
    def join(a: tuple, b: tuple) -> tuple:
        n, apart = a[0] + b[0], b[1] - a[1]
        share = b[0] / np.maximum(n, 1)
        return n, a[1] + apart * share, a[2] + b[2] + apart * apart * a[0] * share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for column in (batch.column("point") for batch in batches if len(batch)):
            flat = column.flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            x, n = flat.to_numpy(zero_copy_only=False).reshape(there.shape), there.sum(0)
            some = x[there.argmax(0), np.arange(x.shape[1])]
            y = np.where(there, x - some, 0)  # exactly 0 where nothing varies
            mean = y.sum(0) / np.maximum(n, 1)
            parts.append((n, np.where(n, some + mean, 0), (np.where(there, y - mean, 0) ** 2).sum(0)))
        if parts:
            yield pa.RecordBatch.from_pydict({"sums": [np.concatenate(reduce(join, parts)).tobytes()]})

    got = [np.split(np.frombuffer(r["sums"]), 3) for r in data.select("point").mapInArrow(run, "sums binary").collect()]  # three numbers a column and task
    n, _, squares = reduce(join, got) if got else np.zeros((3, 0))
    return n, squares, len(got)


def _factors(weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a model: what each log density begins with, the means, and the matrices that whiten a row."""
    low = np.linalg.cholesky(covs)
    begin = np.log(np.maximum(weights, 1e-300)) - .5 * means.shape[1] * np.log(2 * np.pi) - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1)
    return begin, means, np.linalg.inv(low).transpose(0, 2, 1)


def _log_densities(x: np.ndarray, begin: np.ndarray, means: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    """Rows by components: log of weight times density."""
    out = np.empty((len(x), len(begin)))
    for j, (m, w) in enumerate(zip(means, whiten)):
        z = (x - m) @ w
        out[:, j] = begin[j] - .5 * np.einsum("ij,ij->i", z, z)
    return out


def _posteriors(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = logs.max(1, keepdims=True)
    p = np.exp(logs - top)
    total = p.sum(1, keepdims=True)
    return p / total, (top + np.log(total))[:, 0]


#: Rows that are worked on at a time, few enough to stay in a core's cache.
SLICE = 1024


def _moments(data: DataFrame, keep: np.ndarray | None, model: tuple, g: int, d: int, meet: int) -> tuple:
    """Log-likelihood, rows, weights, sums and cross products under the model's posteriors: one pass, one partial sum per
    task, half as many numbers as the model has, which are added up in ``meet`` tasks."""
    factors, half = _factors(*model), np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loglik, n, size, first, second = 0.0, 0, np.zeros(g), np.zeros((g, d)), np.zeros((g, d, d))
        for rows in _matrices(batches, keep):
            for i in range(0, len(rows), SLICE):
                x = rows[i:i + SLICE]
                p, each = _posteriors(_log_densities(x, *factors))
                loglik, n, size, first = loglik + each.sum(), n + len(x), size + p.sum(0), first + p.T @ x
                for j in range(g):
                    own = np.flatnonzero(p[:, j])  # a posterior of 0 adds nothing
                    y = (x if len(own) == len(x) else x[own]) * np.sqrt(p[own, j])[:, None]
                    second[j] += y.T @ y  # of a matrix with itself: half the work
        if n:
            flat = np.concatenate([[loglik, n], size, first.ravel(), second[:, *half].ravel()])
            yield pa.RecordBatch.from_pydict({"sums": [flat.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted(v for batch in batches for v in batch.column("sums").to_pylist())  # in one order in every run
        if parts:
            yield pa.RecordBatch.from_pydict({"sums": [sum(np.frombuffer(v) for v in parts).tobytes()]})

    sums = data.select("packed").mapInArrow(run, "sums binary").repartition(meet).mapInArrow(add, "sums binary").collect()
    flat = sum((np.frombuffer(r["sums"]) for r in sums), np.zeros(2 + g + g * d + g * len(half[0])))
    loglik, n, size, first, upper = flat[0], flat[1], *np.split(flat[2:], [g, g + g * d])
    second = np.zeros((g, d, d))
    second[:, *half] = upper.reshape(g, -1)
    second[:, *half[::-1]] = upper.reshape(g, -1)
    return loglik, n, size, first.reshape(g, d), second


def gaussian_mixture(df: DataFrame, ids: Sequence[str], features: Sequence[str], g: int = 5, components: int | None = None,
                     seed: int = 1234, tol: float = 1e-4):
    """Full-covariance mixture on all features that vary, or on so many leading principal components if asked for.

    Expectation maximisation from seeded k-means centres until the mean log-likelihood grows by less than ``tol``; a step is one pass
    over the rows, which lie packed as bytes. Works with log-densities, so many features do not underflow.

    Returns ``(classified, components, fit)``: ids with ``class`` and ``uncertainty`` (one minus
    the largest posterior), ``(class, proportion, mean, size)`` and ``(G, d, n, loglik, df, bic)``.
    """
    spark = df.sparkSession
    if components is None:
        data = _packed(vectors(df, ids, features), ids)
    else:
        data = _packed(pca(df, ids, features, components)[2].withColumn("point", vector_to_array("pc")), ids)
    n, squares, tasks = _spread(data)
    varies = (n > 1) & (squares > 0)
    keep = None if components or varies.all() else np.flatnonzero(varies)
    point = F.col("point") if keep is None else F.array(*[F.col("point")[int(i)] for i in keep])
    centres = KMeans(k=g, seed=seed, maxIter=20).fit(data.select(array_to_vector(point).alias("features"))).clusterCenters()
    means = np.array([centres[j % len(centres)] for j in range(g)])
    d = means.shape[1]
    variance = np.maximum((squares / np.maximum(n, 1))[... if keep is None else keep], 1e-12)
    ridge = 1e-6 * np.diag(variance)
    model = (np.full(g, 1 / g), means, np.stack([np.diag(variance)] * g))
    meet = math.isqrt(tasks - 1) + 1
    before = -np.inf
    while True:
        loglik, n, size, first, second = _moments(data, keep, model, g, d, meet)
        if n == 0 or loglik / n - before < tol:
            break
        before = loglik / n
        held = np.maximum(size, 1e-9)
        means = first / held[:, None]
        covs = second / held[:, None, None] - means[:, :, None] * means[:, None, :]
        model = (size / n, means, np.where((size > d / 100)[:, None, None], covs, model[2]) + ridge)
    factors = _factors(*model)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if len(b)):
            x, = _matrices([batch], keep)
            p, _ = _posteriors(_log_densities(x, *factors))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ids], pa.array(p.argmax(1) + 1, pa.int32()), pa.array(1 - p.max(1))],
                                             names=[*ids, "class", "uncertainty"])

    kept = data.select(*ids, "packed")
    classified = kept.mapInArrow(classify, kept.drop("packed").schema.add("class", "integer").add("uncertainty", "double"))
    table = spark.createDataFrame([(j + 1, float(w), [float(v) for v in mean]) for j, (w, mean) in enumerate(zip(model[0], model[1]))],
                                  "class int, proportion double, mean array<double>")
    sizes = classified.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    table = table.join(sizes, "class", "left").fillna({"size": 0})
    free = (g - 1) + g * d + g * d * (d + 1) // 2
    fit = spark.createDataFrame([(g, d, int(n), float(loglik), free, 2 * float(loglik) - free * math.log(max(n, 1)))],
                                "G int, d int, n long, loglik double, df int, bic double")
    return classified, table, fit


def uncertainty_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("class").agg(F.avg("uncertainty").alias("mean"), F.stddev_samp("uncertainty").alias("sd"))
