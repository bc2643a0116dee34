import os
import random

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return FOLDER


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with those of the operators."""
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "délta", "x1", "the", "of", "zeta"]
    prose = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 4, 30, 200, 3000)]
    texts = [None, "", " ", "\n\n", "!!! ???", *prose, prose[2], prose[3], "a" * 5000, "é" * 700, "word" + " word" * 900]
    rows = [(i, t, "en" if i % 2 else "fr", f"src{i % 3}", i) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[1], (None, prose[2], "en", None, 1), (None, None, None, None, None), (None, "", "de", "s", 0)]
    rows = [(*r, "x", 7, 1.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, length long, fp double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
