import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from obsframe.llm.dedup_pfp import LENGTH, remove_repeats


def brute(docs):
    where = defaultdict(list)
    raws = [(t or "").encode() for _, t in docs]
    for d, x in enumerate(raws):
        for i in range(len(x) - LENGTH + 1):
            where[x[i:i + LENGTH]].append((d, i))
    gone = [bytearray(len(x)) for x in raws]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i:i + LENGTH] = b"\1" * LENGTH
    out = []
    for (key, _), x, g in zip(docs, raws, gone):
        kept = bytes(b for b, flag in zip(x, g) if not flag)
        out.append((key, len(x), sum(g), sum(1 for i, flag in enumerate(g) if flag and (i == 0 or not g[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def ours(df, **kw):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(df, **kw).collect()]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_against_brute_force(spark):
    rng = random.Random(3)
    draw = lambda n, s="abcdefghijklmnopqrstuvwxyzéß \n": "".join(rng.choice(s) for _ in range(n))
    shared = [draw(n) for n in (300, 399, 400, 401, 420, 700, 1500)]
    docs = []
    for i in range(90):
        t = draw(rng.choice([0, 50, 399, 400, 900, 2500]))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            s = rng.choice(shared)
            s = s[rng.randrange(0, 40):][:len(s) - rng.randrange(0, 60)]
            at = rng.randrange(len(t) + 1)
            t = t[:at] + s + t[at:]
        docs.append((i, t))
    base = draw(3000)
    for i in range(12):  # near copies with few edits
        t = list(base)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(len(t))] = "#"
        docs.append((200 + i, "".join(t)))
    docs += [(300, "ab" * 700), (301, "x" * 1000), (302, "x" * 450), (303, draw(37) * 30), (304, draw(500) + draw(500, "ab")), (305, docs[5][1]), (306, docs[5][1]),
             docs[7], docs[7], (None, docs[8][1]), (None, None), (307, "x" * 400), (308, "y" * 400), (309, "z" * 401), (310, draw(213) * 4)]
    assert Counter(ours(frame(spark, docs))) == Counter(brute(docs))


def test_pieces_of_a_long_text(spark, monkeypatch):
    """Small pieces, so that rows, segments and matches are cut at their borders; run on the driver's copy of the functions."""
    import obsframe.llm.dedup_pfp as m

    rng = random.Random(5)
    text = "".join(rng.choice("abcdef ") for _ in range(6000))
    text = text[:2500] + text[100:1400] + text[2500:] + text[:450] + "k" * 900
    data, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    whole = {(r, t + s, c) for _, row, shift, trig, _, _, core in m._batch_segments(data, offs) for r, t, s, c in zip(row, trig, shift, core)}
    monkeypatch.setattr(m, "PIECE", 700)
    cut = {(r, t + s, c) for _, row, shift, trig, _, _, core in m._batch_segments(data, offs) for r, t, s, c in zip(row, trig, shift, core)}
    assert cut == whole
    starts = [i for _, _, shift, _, first, last, _ in m._batch_segments(data, offs) for f, z, s in zip(first, last, shift) for i in range(f + s, z + s + 1)]
    assert sorted(starts) == list(range(len(text) - LENGTH + 1))


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert Counter(ours(odd_docs)) == Counter(brute(docs))
    assert ours(no_docs) == []


def test_kept_text(spark):
    same = "s" * 10 + "".join(chr(97 + i * i % 26) for i in range(600))
    docs = [(1, "left é " + same + " right"), (2, same + "!"), (3, "short"), (4, "copy " * 200), (5, "copy " * 200), (6, None)]
    rows = {r["doc_id"]: r for r in remove_repeats(frame(spark, docs), with_text=True).collect()}
    for d, _, _, _, sha in brute(docs):
        assert hashlib.sha256(rows[d]["kept"]).hexdigest() == sha == rows[d]["kept_sha256"]
    assert rows[3]["kept"] == b"short" and rows[4]["kept"] == b""


def test_query_on_the_tables(spark, folder):
    from obsframe.llm.queries import op10_repeats_prefix_free_parsing

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in op10_repeats_prefix_free_parsing(spark, folder).collect()]
    want = brute(docs)
    assert Counter(got) == Counter(want) and any(w[2] for w in want)
