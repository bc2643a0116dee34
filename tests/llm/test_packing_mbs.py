import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from obsframe.llm.packing_mbs import WordIds, fill, pack, plan_windows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(2)
    alphabet = ["a", "B", "é", "É", "ß", "Σ", "ς", "İ", "ſ", "1", "٣", "'", "'s", "'ll", ".", ",", "!!", "-", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "́",
                "é", " ", " ", "\t", "\r", "\x1c", "\x85", " ", "  ", "\n", "日本", "ﬁ", "K", "ª", "th", "ing", "*%", "x_y", "😀", "‍", "(", "µ", "×"]
    texts = ["", " ", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(3000))]
    ids = WordIds(PATH)
    assert ids.direct
    for t in texts:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids.of_text(t, max(t, default="") <= "ÿ"), "<u4").tolist() == want, t
        assert np.frombuffer(ids.of_text(t, False), "<u4").tolist() == want, t


def test_fill_is_closest_to_capacity():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(0, 4) for _ in range(rng.randrange(0, 7))}
        capacity = rng.randrange(0, 120)
        got = fill(counts, capacity)
        assert all(0 < c <= counts[x] for x, c in got.items())
        sums = {0}
        for x, c in counts.items():
            sums |= {s + x * k for s in sums for k in range(c + 1)}
        assert sum(x * c for x, c in got.items()) == max(s for s in sums if s <= capacity)


def test_plan_uses_every_piece():
    histogram = {1: 5000, 7: 13, 100: 40, 513: 9, 1024: 3, 2000: 17, 2048: 100000}
    used = Counter()
    for times, pattern in plan_windows(histogram, 2048):
        assert sum(x * c for x, c in pattern.items()) <= 2048
        for x, c in pattern.items():
            used[x] += times * c
    assert used == histogram


def check(rows, docs, tokenizer, window, end_id=1):
    want = Counter()
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id]
        for at in range(0, len(ids), window):
            piece = np.array(ids[at:at + window], dtype="<u4")
            want[d, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_tokens"], r["padded_to"]))
    assert set(by) == set(range(len(by)))
    padded = 0
    for pieces in by.values():
        at = 0
        for offset, length, *_ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window and {p[2] for p in pieces} == {at}
        assert {p[3] for p in pieces} == {at if at & (at - 1) == 0 else window}
        padded += pieces[0][3]
    return sum(r["length"] for r in rows) / max(padded, 1)


@pytest.mark.parametrize("window", [16, 2048])
def test_odd_rows(odd_docs, no_docs, tokenizer, window):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(pack(odd_docs, PATH, window).collect(), docs, tokenizer, window)
    assert pack(no_docs, PATH, window).collect() == []


def test_ids_are_kept(odd_docs, tokenizer):
    rows = pack(odd_docs, PATH, 64, with_ids=True).where("doc_id = 8").orderBy("start").collect()
    text = next(r["text"] for r in odd_docs.collect() if r["doc_id"] == 8)
    assert sum((list(r["ids"]) for r in rows), []) == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_query_on_the_tables(spark, folder, tokenizer):
    from obsframe.llm.queries import op4_pack_min_bin_slack

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = [r.asDict() for r in op4_pack_min_bin_slack(spark, folder).collect()]
    totals = Counter()
    for r in rows:
        totals[r["sequence_id"]] += r["length"]
    assert check([r | {"sequence_tokens": totals[r["sequence_id"]]} for r in rows], docs, tokenizer, 2048) > .95
