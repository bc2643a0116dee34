import random

import numpy as np

from obsframe.llm.frames import keep_out
from obsframe.llm.langid_ecoc import codewords, fit, identify


def test_codewords_part_every_two_languages():
    for n in (1, 2, 3, 4, 5, 8, 20, 60):
        code = codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
        assert len({tuple(r) for r in code}) == n
        apart = (code[:, None] != code[None]).sum(2)
        if n > 2:
            assert apart[~np.eye(n, dtype=bool)].min() >= 2


def test_decoding_survives_one_wrong_bit():
    rows = [(name, np.array([i]), np.array([1])) for i, name in enumerate("abcde") for _ in range(3)]
    m = fit(rows)
    for y in range(5):
        z = 6.0 * m.code[y]
        z[y] = -z[y]
        assert m.decode(z[None])[0][0] == y


def test_learns_from_rows_that_are_not_held_out(spark, folder):
    from obsframe.llm.queries import op9_language_output_codes

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = op9_language_output_codes(spark, folder).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= .97 * len(held)


def test_odd_rows(spark, odd_docs, no_docs):
    held = keep_out("doc_id", 3, 1)
    got = identify(odd_docs, ~held).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))
    assert identify(no_docs, ~held).collect() == []
    assert {r["lang_pred"] for r in identify(odd_docs.withColumn("lang", odd_docs.source.substr(9, 1)).na.replace("", None), ~held).collect()} == {"und"}


def test_five_invented_languages(spark):
    rng = random.Random(1)
    kinds = {name: [rng.choice("bcdfgjklmnp") + rng.choice("aeiouéøß日本") for _ in range(12)] for name in ("aa", "bb", "cc", "dd", "ee", "ff", "gg")}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randrange(1, 4))) for _ in range(40)), k) for i, k in enumerate(sorted(kinds) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = keep_out("doc_id", 3, 1)
    got = identify(df, ~held).withColumn("held", held).collect()
    truth = {i: k for i, _, k in rows}
    out = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held"]]
    assert sum(out) >= .97 * len(out)


def test_what_a_task_holds_does_not_follow_the_batch():
    import tracemalloc

    import pyarrow as pa

    from obsframe.llm.langid_ecoc import bucket_counts, predict

    texts = [f"{w} word{i} and more {w} of it, " * 80 for i in range(800) for w in ("alpha", "ünder")]
    model = fit([("ab"[r % 2], u, c) for r, u, c in bucket_counts(pa.array(texts[:40]))], 5)
    most = []
    for n in (200, 1600):
        tracemalloc.start()
        predict(model, pa.array(texts[:n] + [None, "", "..."]), 0.05)
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most[1] < 20e6 and most[1] < 2 * most[0]
    names, p, close = predict(model, pa.array([texts[0], None, *texts[1:1600], "...", ""]), 0.05)
    whole = [x[0] for x in predict(model, pa.array([texts[1599]]), 0.05)]
    assert [names[1600], p[1600], close[1600]] == whole and (names[[1, 1601, 1602]] == "und").all() and close[[1, 1601, 1602]].all()
