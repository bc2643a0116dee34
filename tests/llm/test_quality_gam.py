import random

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from obsframe.llm.frames import bounded_sample, keep_out, smallest_hashes
from obsframe.llm.quality_gam import FEATURES, fit, score_quality, text_features


def test_features_of_whole_texts():
    x = text_features(pa.array(["Ab ab ab!!\nc9", None, "", "é|é"]))
    at = {n: i for i, n in enumerate(FEATURES)}
    assert x.shape == (4, len(FEATURES)) and not x[1].any() and not x[2].any()
    assert x[0, at["upper_share"]] == 1 / 7 and x[0, at["digit_share"]] == 1 / 13 and x[0, at["exclamation_share"]] == 2 / 13
    assert x[0, at["repeats_previous_share"]] == 2 / 4 and x[0, at["distinct_word_share"]] == 2 / 4 and x[0, at["mark_after_word_share"]] == 1 / 4
    assert x[3, at["bar_share"]] == 1 / 5 and x[3, at["beyond_ascii_share"]] == 4 / 5 and x[3, at["mean_word_bytes"]] == 2
    long = "word " * 700_000
    assert text_features(pa.array([long, "word word"]))[0, at["repeats_previous_share"]] == 699_999 / 700_000


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > .5) ^ (x[:, 1] > .5)).astype(float)
    weight = np.ones(len(y))
    m = fit(x[:3000], y[:3000], weight[:3000])
    assert (0, 1) in m.pairs
    assert ((m.logits(x[3000:]) > 0) == (y[3000:] > 0)).mean() > .97
    alone = fit(x[:3000], y[:3000], weight[:3000], n_pairs=0)
    assert ((alone.logits(x[3000:]) > 0) == (y[3000:] > 0)).mean() < .65


def test_held_out_documents(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghio") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(1200):
        w = [word() for _ in range(rng.randrange(20, 200))]
        kind = i % 10
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        elif kind == 1:
            w = [x for x in w for _ in range(9)]
        elif kind == 2:
            w = [x + rng.choice(["%%%", "***"]) for x in w]
        rows.append((i, " ".join(w), int(kind > 2)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], .5) for r in rows], "doc_id long, quality int, score double")
    held = keep_out("doc_id", 5, 0)
    got = [r for r in score_quality(docs, labels, held).withColumn("held", held).collect() if r["held"]]
    assert sum((r["score"] >= .3) == (rows[r["doc_id"]][2] == 1) for r in got) >= .98 * len(got)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    held = keep_out("doc_id", 5, 0)
    got = score_quality(odd_docs, labels, held).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert score_quality(no_docs, labels, held).collect() == []
    assert {r["score"] for r in score_quality(odd_docs, labels.limit(0), held).collect()} == {0.5}


def test_query_on_the_tables(spark, folder):
    from obsframe.llm.queries import op1_quality_additive_model

    folder = folder.replace("sf0.001", "sf0.1")  # the smallest tables hold too few labels
    got = op1_quality_additive_model(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == docs.count() and all(r["predicted"] == (r["score"] >= .3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= .97 * len(held)


def test_large_samples_are_cut_in_slices(spark):
    """No task ranks a whole class: the last window sees at most ``n`` rows of each slice."""
    keyed = spark.range(20000).select((F.col("id") % 10 > 0).cast("int").alias("__by"), F.xxhash64("id", F.lit(11)).alias("__h"))
    rows = keyed.collect()
    ranked = smallest_hashes(keyed, 1500)
    assert sorted(map(tuple, ranked.collect())) == sorted((k, h) for k in (0, 1) for h in sorted(r["__h"] for r in rows if r["__by"] == k)[:1500])
    assert "__slice" in ranked._jdf.queryExecution().optimizedPlan().toString()
    drawn = bounded_sample(spark.range(20000), F.lit(True), F.col("id") % 2, 1500, "id")
    assert drawn.count() == 3000 and drawn.where("id % 2 = 0").count() == 1500
