"""The Jaccard join against all pairs of sets."""

import random
import re

import numpy as np
import pytest

from obsframe.llm.jaccard_groups import jaccard_components, overlaps, qualifying

WORD = re.compile("[^ \t-\r]+")


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """Component id and size of every (key, text), all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    kinds = sorted(set(sets), key=len)
    label = {s: s for s in kinds}

    def root(s):
        while label[s] is not s:
            s = label[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[i + 1:]:
            if 100 * len(a) < 80 * len(b):
                break
            common = len(a & b)
            if a and 100 * common >= 80 * (len(a) + len(b) - common):
                label[root(b)] = root(a)
    groups = {}
    for (key, _), s in zip(rows, sets):
        if s:
            groups.setdefault(root(s), []).append(key)
    out = []
    for (key, _), s in zip(rows, sets):
        keys = groups[root(s)] if s else [key]
        known = [k for k in keys if k is not None]
        out.append((key, len(s), min(known) if known else None, len(keys)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "component_size").collect()), key=repr)


def test_query_on_the_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert found(jaccard_components(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("edits", [(1, 2, 3), (2, 4, 6)])
def test_a_large_family_of_edited_copies(spark, edits):
    """Most copies are near the original and not near each other; groups are cut in slices."""
    rng = random.Random(edits[0])
    base = [f"w{rng.randint(0, 900)}" for _ in range(140)]
    rows = [(0, " ".join(base))]
    for i in range(1, 700):
        words = list(base)
        for at in rng.sample(range(140), rng.choice(edits)):
            words[at] = f"x{rng.randint(0, 10 ** 6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{rng.randint(0, 10 ** 6)}" for _ in range(60)) + " " + " ".join(base[:60])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path_rows = [tuple(r) for r in docs.collect()]
    assert found(jaccard_components(docs)) == brute(path_rows)


def test_odd_rows(odd_docs):
    assert found(jaccard_components(odd_docs)) == brute([tuple(r)[:2] for r in odd_docs.collect()])


def test_short_texts_and_the_threshold(spark):
    words = [f"t{i}" for i in range(40)]
    rows = [(1, "A b"), (2, "a B"), (3, "a\tb\n"), (4, "a b c"), (5, "a b c d e"), (6, "a b c d e a b c d e"), (7, " \t\r\n"), (8, None), (9, None),
            (10, " ".join(words)), (11, " ".join(words[:32])), (12, " ".join(words[:33])), (13, " ".join(words) + " z1 z2"), (None, "a b"), (None, "é ü ö ß ñ ô")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard_components(docs)) == brute(rows)


def test_empty_table(no_docs):
    assert jaccard_components(no_docs).collect() == []


def test_bounds_and_overlaps():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, n)) for n in rng.integers(1, 50, 30)]
    common = overlaps(sets[:12], sets[12:])
    assert (common == [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]).all()
    size = np.array([len(s) for s in sets])
    linked = 100 * common >= 40 * (size[:12, None] + size[None, 12:] - common)
    assert set(np.flatnonzero(linked.any(1))) <= set(qualifying(sets[:12], sets[12:], 40).tolist())
