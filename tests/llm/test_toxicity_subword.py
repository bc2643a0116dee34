import random

from obsframe.llm.frames import keep_out
from obsframe.llm.toxicity_subword import score_toxicity

def held_out():
    return keep_out("doc_id", 5, 0)


def world(rng, n):
    """Long clean prose; toxic documents hold a few words of three stems with endings that need not repeat."""
    syllables = [a + b for a in "bdgklmnprst" for b in "aeiou"]
    word = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    vocabulary = [word(rng.randrange(1, 4)) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([20, 80, 300]))]
        toxic = i % 4 == 0
        for _ in range(max(1, len(w) // 60) if toxic else 0):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["zquorv", "xyphlo", "wevvik"]) + word(rng.randrange(1, 3)))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_documents(spark):
    rows = world(random.Random(6), 800)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], "x") for r in rows], "doc_id long, toxic int, text string")
    got = score_toxicity(docs, labels, held_out()).withColumn("held", held_out()).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [(r["score"] >= .5, truth[r["doc_id"]]) for r in got if r["held"]]
    assert sum(p == t for p, t in held) >= .95 * len(held)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    got = score_toxicity(odd_docs, labels, held_out()).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert score_toxicity(no_docs, labels, held_out()).collect() == []
    assert {r["score"] for r in score_toxicity(odd_docs, labels.limit(0), held_out()).collect()} == {0.0}


def test_query_on_the_tables(spark, folder):
    from obsframe.llm.queries import op3_toxicity_subword_bag

    got = op3_toxicity_subword_bag(spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert {r["predicted"] for r in got} <= {0, 1} and all(r["predicted"] == (r["score"] >= .5) for r in got)
