"""Collocations against plain counting."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from obsframe.llm.phrase_trie import FILTER_BITS, DoubleArray, _pairs, _phrases, collocations


def brute(rows, least, k):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i:i + m])] += 1
    often = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = {}
    for (lang, p), a in often.items():
        if any(lang == other and len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (other, q), b in often.items()):
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:c]] * f[lang, p[c:]]), c) for c in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -score)
            for lang in sorted(out) for i, (score, a, p, left, right) in enumerate(sorted(out[lang])[:k], 1)]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    common = ["of", "the", "And", "in", "é", "x-1", "日本"]
    phrases = ["New York city hall", "on the other hand", "a a a a a a", "ß straße Straße", "to be or not to be"]
    rows = []
    for i in range(60):
        parts = [rng.choice(phrases) if rng.random() < .3 else rng.choice(common) for _ in range(rng.randint(0, 120))]
        rows.append(("".join(p + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\r", ";"]) for p in parts), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", None), (" \t", "de"), ("a b " * 3000, "fr"), rows[0], rows[0]]


@pytest.mark.parametrize("least, k, trie", [(3, 2000, 1 << 18), (12, 5, 1 << 18), (3, 2000, 20)])
def test_against_plain_counting(spark, prose, least, k, trie):
    docs = spark.createDataFrame([(t, lang, 1, "x") for t, lang in prose], "text string, lang string, a int, phrase string").repartition(3)
    assert found(collocations(docs, least, k, trie=trie)) == brute(prose, least, k)


def test_query_on_the_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("text", "lang").collect()]
    assert found(collocations(docs, 40, 2000)) == brute(rows, 40, 2000)


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    assert found(collocations(odd_docs, 2, 50)) == brute([(r["text"], r["lang"]) for r in odd_docs.collect()], 2, 50)
    assert collocations(no_docs).collect() == []


def test_products_beyond_64_bits(spark):
    """A score whose product needs more than 64 bits: the exact arithmetic of the query on one row."""
    from pyspark.sql import functions as F

    from obsframe.llm.phrase_trie import _exact

    a, n, left, right = 987654321987, 987654321987654, 987654321990, 987654321991
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    row = row.withColumn("t", _exact("a") * F.lit(1000).cast("decimal(4,0)") * _exact("n")).withColumn("b", _exact("l") * _exact("r"))
    assert row.select(F.expr("t div b")).first()[0] == 1000 * a * n // (left * right)


def test_double_array():
    rng = np.random.default_rng(2)
    phrases = sorted({tuple(rng.integers(0, 40, rng.integers(1, 6)).tolist()) for _ in range(500)})
    trie = DoubleArray([np.array(p, dtype=np.uint64) for p in phrases])
    known = {p: i for i, p in enumerate(phrases)}
    for p in phrases + [tuple(rng.integers(0, 45, 4).tolist()) for _ in range(300)]:
        state, ok = np.zeros(1, dtype=np.int64), np.array([True])
        for x in p:
            state, ok = trie.step(state, trie.symbols(np.array([x], dtype=np.uint64)))
            if not ok[0]:
                break
        assert (int(trie.key[state[0]]) if ok[0] else -1) == known.get(p, -1)


def test_a_candidate_gives_no_row_per_slice_of_the_input(spark, monkeypatch):
    """As many tasks count as keep the cores busy, so the rows before the sum do not follow tasks times candidates."""
    frame = type(spark.range(1))
    made, arrow = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, *a, **k: (out := arrow(self, f, schema, *a, **k), made.append(out.count()) if schema == "id long, n long" else 0)[0])
    few, many = (spark.createDataFrame([("en", "one two three")] * 400, "lang string, text string").repartition(n) for n in (1, 100))
    rows = [sorted(map(tuple, collocations(d, 100).collect())) for d in (few, many)]
    assert rows[0] == rows[1] and len(rows[0]) == 1
    assert made[0] == 3 and made[1] <= 3 * 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("k", [2, 5])
def test_a_counting_task_holds_and_passes_a_bounded_number_of_bytes(k):
    """Few phrases come twice here, so counting spares nothing: what is held has to be passed on, in small batches."""
    words = [f"w{i}" for i in range(3000)]
    rng = np.random.default_rng(k)
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 4000)) for _ in range(150)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 50), pa.array(texts[i:i + 50])], names=["lang", "text"]) for i in range(0, 150, 50)]
    every = b"\xff" * (1 << FILTER_BITS - 3)
    tracemalloc.start()
    sizes, total = [], 0
    for b in (_pairs if k == 2 else _phrases)(every)(iter(batches)):
        sizes.append(b.num_rows)
        total += sum(b.column("n").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(sizes) <= 1 << 16
    assert total == 150 * sum(4000 - m + 1 for m in range(2, k + 1))
    assert peak < 250e6


def listed_rows(monkeypatch, spark):
    """Rows that the pass over phrases with their words gives, call by call."""
    frame = type(spark.range(1))
    made, arrow = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, *a, **k: (out := arrow(self, f, schema, *a, **k), made.append(out.count()) if "words array<long>" in schema else 0)[0])
    return made


@pytest.mark.parametrize("slices", [3, 60])
def test_rare_phrases_of_frequent_pairs_give_no_rows(spark, monkeypatch, slices):
    """All pairs are frequent here and no triple is, so only pairs are candidates: a row of one for each task that counts, not for each slice of the input."""
    rng = np.random.default_rng(5)
    rows = [(" ".join(f"w{i}" for i in rng.integers(0, 20, 1000)), "en") for _ in range(90)]
    made = listed_rows(monkeypatch, spark)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(slices)
    assert found(collocations(docs, 100, 2000)) == brute(rows, 100, 2000)
    assert made[0] <= 400 * min(slices, 2 * spark.sparkContext.defaultParallelism) * 1.1


@pytest.mark.parametrize("slices", [1, 7])
def test_counts_beyond_what_a_place_holds(spark, slices):
    rows = [("one two three four, five six", "en")] * 500 + [("one two three four", "en")] * 99 + [("five six", "de")] * 499
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(slices)
    for least in (500, 599, 600):
        assert found(collocations(docs, least, 2000)) == brute(rows, least, 2000)


def test_counts_that_take_little_room_are_kept(monkeypatch):
    """A task meets the same pairs block by block: it puts their counts together and passes one row of each."""
    monkeypatch.setattr("obsframe.llm.phrase_trie.HELD", 1 << 16)
    text = " ".join(f"w{i % 500}" for i in range(20_000))
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"]) for _ in range(40)]
    out = list(_pairs(b"\xff" * (1 << FILTER_BITS - 3))(iter(batches)))
    assert sum(b.num_rows for b in out) == 500 and sum(sum(b.column("n").to_pylist()) for b in out) == 40 * 19_999
