import hashlib
import random
import re
from collections import Counter

import pytest

from obsframe.llm.decontam_winnow import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, span=10):
    out = []
    split = [(str(i) if i is not None else "", words(t)) for i, t in items]
    for d, t in docs:
        w = words(t)
        hit, names = set(), set()
        for name, v in split:
            n = min(span, len(v))
            grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    names.add(name)
        out.append((d, len(w), len(hit), len(names), ",".join(sorted(names)), bool(hit)))
    return out


def ours(docs, items, **kw):
    return [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in decontaminate(docs, items, **kw).collect()]


def test_against_brute_force(spark):
    rng = random.Random(5)
    few = ["a", "b", "C", "d", "é"]
    many = [f"w{i}" for i in range(400)]
    draw = lambda n, v: [rng.choice(v) for _ in range(n)]
    items = [(i, draw(rng.choice([1, 3, 5, 9, 10, 11, 40]), many)) for i in range(30)] + [(100, draw(12, few)), (101, ["the", "end"]), (101, draw(15, many))]
    docs = []
    for i in range(120):
        t = draw(rng.choice([0, 2, 9, 10, 60, 300]), few if i % 9 == 0 else many)
        for _ in range(rng.choice([0, 0, 1, 3])):
            v = rng.choice(items)[1]
            cut = v[rng.choice([0, 0, 1]):len(v) - rng.choice([0, 0, 1, 3])]
            at = rng.randrange(len(t) + 1)
            t[at:at] = [x.upper() if rng.random() < .2 and x.isascii() else x for x in cut]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(t)))
    docs += [docs[7], docs[7], (None, docs[8][1])]
    items = [(i, " ".join(v)) for i, v in items] + [(7, None), (8, ""), (None, items[0][1] and " ".join(items[0][1]))]
    got = ours(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(got) == Counter(brute(docs, items))
    assert sum(r[5] for r in got) > 30


@pytest.mark.parametrize("span,k", [(1, 1), (4, 2), (10, 10)])
def test_other_windows(spark, span, k):
    rng = random.Random(span)
    draw = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    items, docs = [(i, draw(rng.randrange(14))) for i in range(8)], [(i, draw(rng.randrange(60))) for i in range(40)]
    got = ours(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), span=span, k=k)
    assert Counter(got) == Counter(brute(docs, items, span))


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "alpha"), (2, "word " * 30)], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert Counter(ours(odd_docs, items)) == Counter(brute(rows, [(1, "alpha"), (2, "word " * 30)]))
    assert ours(no_docs, items) == []
    assert not any(r[5] for r in ours(odd_docs, items.limit(0)))


def test_query_on_the_tables(spark, folder):
    from obsframe.llm.queries import op7_decontaminate_winnowing

    read = lambda n: [tuple(r) for r in spark.read.parquet(f"{folder}/{n}.parquet").select("doc_id" if n == "documents" else "item_id", "text").collect()]
    want = [(*r[:4], hashlib.sha256(r[4].encode()).hexdigest(), r[5]) for r in brute(read("documents"), read("benchmark"))]
    got = [tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in op7_decontaminate_winnowing(spark, folder).collect()]
    assert Counter(got) == Counter(want) and any(r[5] for r in got)
