import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from obsframe.llm import dedup_omh as D
from obsframe.llm.dedup_omh import BITMAP, SHINGLE, _near_pairs, labelled_shingles, near_duplicates, order_sketch, text_sketch, within_band, word_bitmaps
from obsframe.llm.textbatch import find_words, text_bytes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_banded_alignment_against_the_full_table():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.randrange(rng.choice([2, 4, 30])) for _ in range(rng.randrange(0, 25))]
        b = list(a) if rng.random() < .7 else [rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(0, 2)] = [rng.randrange(4) for _ in range(rng.randrange(0, 3))]
        most = rng.randrange(0, 12)
        assert within_band(np.array(a, np.int64), np.array(b, np.int64), most) == (distance(a, b) <= most), (a, b, most)


def test_bitmaps_bound_the_distance():
    rng = random.Random(3)
    for _ in range(300):
        a = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 60))]
        b = [x if rng.random() > .2 else f"w{rng.randrange(60)}" for x in a if rng.random() > .05] or ["w"]
        data, offs = text_bytes(pa.array([" ".join(a), " ".join(b)]))
        bits = word_bitmaps(find_words(data, offs))
        assert sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(*bits)) <= 2 * distance(a, b)


def sketches(texts):
    data, offs = text_bytes(pa.array(texts))
    rows, sketch = order_sketch(*labelled_shingles(find_words(data, offs)))
    return dict(zip(rows.tolist(), sketch))


def test_tuples_see_order_and_repeats():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    halves = " ".join(words[150:] + words[:150])
    few = list(words)
    for i in range(0, 300, 30):
        few[i] = "new" + str(rng.random())
    s = sketches([" ".join(words), halves, " ".join(few), " ".join(words * 2), " ".join(words)])
    agree = lambda a, b: (s[a] == s[b]).mean()
    assert agree(0, 4) == 1 and agree(0, 1) < .7 < 1 and agree(0, 3) < .5 and .15 < agree(0, 2) < .9


def nwords(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower() if (t or "").isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def classes(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["class_key"]].append(r)
    for members in out.values():
        ids = [r["doc_id"] for r in members if r["doc_id"] is not None]
        assert {r["class_id"] for r in members} == {min(ids, default=None)} and {r["class_size"] for r in members} == {len(members)}
        assert len({(r["doc_id"], r["text_hash"]) for r in members if r["representative"]}) == 1
    return out


def near(x, y):
    """Whether at most a fifth of the longer one's words must be edited; no shared shingle is asked for. Texts under five words are only equal ones."""
    most = .2 * max(len(x), len(y)) + 1e-9
    if min(len(x), len(y)) < 5 or abs(len(x) - len(y)) > most:
        return False
    if max(len(x), len(y)) - sum((Counter(x) & Counter(y)).values()) > most:  # words without a partner cost an edit each
        return False
    return distance(x, y) <= most


def test_against_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: nwords(r["text"]) for r in docs.collect()}
    parent = {d: d for d in texts}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = texts[a], texts[b]
            if x == y or near(x, y):
                parent[top(b)] = top(a)
    want = defaultdict(set)
    for d in ids:
        want[top(d)].add(d)
    got = {frozenset(r["doc_id"] for r in m) for m in classes(near_duplicates(docs).collect()).values()}
    assert got == {frozenset(m) for m in want.values()} and len(got) < len(ids)


def test_large_groups_and_chains(spark):
    """A group of many edited copies beside texts that share a long passage with it: the group is one class, the others stay alone."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(200)], None
    passage = base[40:100]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(6):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join([word() for _ in range(100)] + passage + [word() for _ in range(100)])) for i in range(60)]
    rows += [(5000, " ".join(base[:170])), (None, " ".join(base)), (None, " ".join(base)), (6000, "one two"), (6001, "One, two!"), (6002, "one three")]
    got = classes(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sizes = sorted(len(m) for m in got.values())
    assert sizes == [1] * 61 + [2, 153]
    assert {r["class_id"] for m in got.values() if len(m) == 153 for r in m} == {851}


def edited(rng, n, rate):
    """Texts of ``n`` words and a copy of each in which a share of the words, or every fifth one, is another word."""
    word = lambda: "w%d" % rng.randrange(10 ** 9)
    a = [word() for _ in range(n)]
    gone = set(range(2, n, 5) if rate == "fifth" else rng.sample(range(n), int(rate * n + 1e-9)))
    return [" ".join(a), " ".join(word() if i in gone else x for i, x in enumerate(a))]


@pytest.mark.parametrize("rate", [.13, .14, .16, .18, .2, "fifth"])
def test_copies_up_to_the_threshold_are_candidates(rate):
    rng = random.Random(11)
    for n in (30, 40, 60, 100, 400):
        data, offs = text_bytes(pa.array([t for _ in range(200) for t in edited(rng, n, rate)]))
        s = text_sketch(find_words(data, offs))[1]
        found = np.mean([(s[i] == s[i + 1]).any() for i in range(0, 400, 2)])
        assert found >= (.9 if rate == "fifth" else .985), (n, found)


def test_copies_up_to_the_threshold_are_linked(spark):
    rng = random.Random(12)
    texts = [t for rate in (.14, .16, .18, .2, "fifth") for n in (30, 50, 100, 300) for _ in range(5) for t in edited(rng, n, rate)]
    got = classes(near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    pairs = {tuple(sorted(r["doc_id"] for r in m)) for m in got.values()}
    assert len(pairs & {(i, i + 1) for i in range(0, len(texts), 2)}) >= 98


@pytest.mark.parametrize("similarity, block", [(.8, 3), (.8, 2000), (1.0, 2), (.5, 7), (0.0, 5)])
def test_pairs_of_a_large_band_in_blocks(spark, similarity, block):
    """All pairs that lengths and bitmaps allow, each once per band, from keys of few nodes."""
    rng = random.Random(9)
    rows = [(b, bytes([i]), rng.choice([5, 9, 10, 12, 15, 60, 75, 76]), bytes([rng.randrange(40)])) for i in range(60) for b in (1, 2) if rng.random() < .8]
    words = {c: n for _, c, n, _ in rows}
    bitmaps = {c: [rng.getrandbits(3)] + [0] * (BITMAP - 1) for c in words}
    rows = [(b, c, words[c], k) for b, c, _, k in rows]
    want = []
    for b, c, n, k in rows:
        for b2, c2, n2, k2 in rows:
            edits = (1 - similarity) * max(n, n2) + 1e-9
            if b == b2 and c < c2 and k != k2 and abs(n - n2) <= edits and bin(bitmaps[c][0] ^ bitmaps[c2][0]).count("1") <= 2 * edits:
                want.append((c, c2))
    undecided = spark.createDataFrame(rows, "band long, content binary, n_words long, component binary")
    nodes = spark.createDataFrame(list(bitmaps.items()), "content binary, bitmap array<long>")
    got = [(bytes(r["src"]), bytes(r["dst"])) for r in _near_pairs(undecided, nodes, similarity, block).collect()]
    assert sorted(got) == sorted(want) and want


def test_words_of_any_script():
    texts = ["日本語、カナ abc日x", "a\u00a0b\u3000c，d«é»", "ไทย", "한국어 말", "naïve 𠀀𠀁é", "", "plain text"]
    words = lambda w, data: [[bytes(data[a:z]).decode() for a, z in zip(w.start[f:g], w.end[f:g])] for f, g in zip(w.first, w.first[1:])]
    data, offs = text_bytes(pa.array(texts))
    assert words(find_words(data, offs, scripts=True), data) == [
        ["日", "本", "語", "カ", "ナ", "abc", "日", "x"], ["a", "b", "c", "d", "é"], ["ไ", "ท", "ย"], ["한국어", "말"], ["naïve", "𠀀", "𠀁", "é"], [], ["plain", "text"]]
    rng = random.Random(2)
    long = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(1_500_000))  # cut into pieces at whole characters
    data, offs = text_bytes(pa.array([long, "é" * 1_200_000 + "、" * 400_000]))
    w = find_words(data, offs, scripts=True)
    assert np.diff(w.first).tolist() == [1_500_000, 1] and (w.end - w.start)[:-1].tolist() == [3] * 1_500_000


def test_edited_copy_without_blanks(spark):
    rng = random.Random(6)
    char = lambda: chr(rng.randrange(0x4E00, 0x9FFF))
    a = [char() if i % 20 else "。" for i in range(2000)]
    b = [char() if i % 10 == 3 else x for i, x in enumerate(a)]
    rows = [(1, "".join(a)), (2, "".join(b)), (3, "".join(char() for _ in range(2000))), (4, "\u3000".join("one two three four five six seven eight".split())),
            (5, "one\u00a0two three four，five six seven EIGHT")]
    got = classes(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sorted(sorted(r["doc_id"] for r in m) for m in got.values()) == [[1, 2], [3], [4, 5]]


def test_odd_rows(spark, odd_docs, no_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    classes(got)
    assert near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("similarity", [1.0, 0.5])
def test_other_similarity(spark, similarity):
    a = [f"w{i}" for i in range(100)]
    b = [x if i % 10 else "changed" + x for i, x in enumerate(a)]
    rows = near_duplicates(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string"), similarity).collect()
    assert len({r["class_key"] for r in rows}) == (1 if similarity < .9 else 2)


def test_tuples_of_many_nodes_give_the_same_classes(spark, folder, monkeypatch):
    """Nodes that meet whole components, in blocks, instead of tuple by tuple."""
    from obsframe.llm import dedup_omh

    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60").selectExpr(
        "doc_id + 100000 doc_id", "concat('x y ', substring(text, 9), ' z') text", "lang", "source", "n_chars"))
    want = {frozenset(r["doc_id"] for r in m) for m in classes(near_duplicates(docs).collect()).values()}
    monkeypatch.setattr(dedup_omh, "MANY", 0)
    assert {frozenset(r["doc_id"] for r in m) for m in classes(near_duplicates(docs).collect()).values()} == want


def test_a_crowd_of_unlinked_texts_makes_no_rows_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(40)]
    texts = [base[:13] + [base[13 + i] for i in rng.permutation(14)] + base[27:] for _ in range(60)]
    texts += [["x", "y", *t[2:]] for t in texts[:6]]
    linked = lambda i, j: D.within_band(*(np.array([hash(x) for x in texts[k]]) for k in (i, j)), 8)
    part = list(range(len(texts)))
    for i, j in ((i, j) for i in range(len(texts)) for j in range(i) if linked(i, j)):
        part = [part[j] if p == part[i] else p for p in part]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    made, near = [], D._near_pairs
    monkeypatch.setattr(D, "_near_pairs", lambda *a, **k: (out := near(*a, **k), made.append(out.count()))[0])
    classes = lambda: {r.doc_id: r.class_id for r in D.near_duplicates(df, 0.8).collect()}
    now = classes()
    monkeypatch.setattr(D, "CROWD", 1000)
    assert now == classes() == {i: min(j for j in range(len(texts)) if part[j] == part[i]) for i in range(len(texts))}
    assert made[0] <= len(texts) < made[1]


def test_shared_tuples_are_found_by_parts(spark):
    rng = np.random.default_rng(8)
    sketch = rng.integers(-2 ** 63, 2 ** 63 - 1, (60, D.TUPLES + D.SHORT_TUPLES))
    for a, b, j in ((0, 1, 3), (0, 59, 3), (20, 40, 7), (20, 41, 7), (20, 42, 100), (5, 6, 127)):
        sketch[b, j] = sketch[a, j]
    ids = [i + (10 if i >= 30 else 0) for i in range(60)]  # numbers with a gap
    nodes = spark.createDataFrame([(i, s.tolist()) for i, s in zip(ids, sketch)], "id long, sketch array<long>").coalesce(2)
    want = {}
    for i, s in zip(ids, sketch.tolist()):
        for v in s:
            want.setdefault(v, []).append(i)
    want = sorted((i, v, len(w)) for v, w in want.items() if len(w) > 1 for i in w)
    assert len(want) == 3 + 3 + 2 + 2
    for rows in (7, 8192):
        assert sorted(tuple(r) for r in D._shared_bands(nodes, rows).select("id", "band", "__n").collect()) == want


def test_decided_tuples_and_sketches_are_not_dealt_again(spark, monkeypatch):
    """The second round looks at tuples of several components alone; no step but the nodes keeps sketches."""
    rng = np.random.default_rng(5)
    texts = [[f"w{k}" for k in rng.integers(0, 5000, 100)] for _ in range(20)]
    texts += [[w if i != 50 else "changed" for i, w in enumerate(t)] for t in texts[:15]]
    texts += [texts[19][:60] + [f"z{i}" for i in range(40)]]  # shares tuples, is not linked
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    seen, stood, kept, cut = [], D._standing, [], D.cut_lineage
    monkeypatch.setattr(D, "_standing", lambda placed, *a, **k: (seen.append(placed.count()), stood(placed, *a, **k))[1])
    monkeypatch.setattr(D, "cut_lineage", lambda d: (kept.append(d.columns), cut(d))[1])
    got = {r.doc_id: r.class_id for r in D.near_duplicates(df, 0.8).collect()}
    assert got == {i: i - 20 if 20 <= i < 35 else i for i in range(36)}
    assert seen[0] > 1000 > 10 * seen[1] and [c for c in kept if "sketch" in c][1:] == [["content", "n_words", "sketch", "bitmap", "id"]]


def test_wide_rows_that_no_pair_needs_stay_out_of_joins(spark):
    names = [np.random.default_rng(i).bytes(16) for i in range(2000)]
    table = spark.createDataFrame([(bytearray(x), [i]) for i, x in enumerate(names)], "content binary, words array<long>")
    wanted = spark.createDataFrame([(bytearray(names[i]),) for i in (0, 7, 7, 1999)] + [(bytearray(b"not there at all"),)], "content binary")
    got = sorted(r.words[0] for r in D._among(table, wanted).collect())
    assert {0, 7, 1999} <= set(got) and len(got) < 20


def test_alignments_get_small_batches(spark, monkeypatch):
    """A batch is held several times for each core; 10,000 pairs with the words of both texts take 50 MB and more."""
    key, seen, linked = "spark.sql.execution.arrow.maxBytesPerBatch", [], D._linked
    monkeypatch.setattr(D, "_linked", lambda *a: (seen.append(spark.conf.get(key)), linked(*a))[1])
    before = spark.conf.get(key)
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words than those of the first texts"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in D.near_duplicates(df, 0.8).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert seen and all(re.fullmatch(r"\d+[bB]?", x) and int(x.rstrip("bB")) <= 8 << 20 for x in seen)
    assert spark.conf.get(key) == before
