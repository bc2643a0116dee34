"""Jump consistent hashing against the scalar algorithm, and the laws of its shards."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.llm.sharding_jump import assign_shards, jump, shard_slots


def scalar(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        ahead = int((at + 1) * (2.0 ** 31 / ((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 1000])
def test_jump(shards):
    keys = np.random.default_rng(shards).integers(0, 2 ** 64, 400, dtype=np.uint64)
    keys[:3] = 0, 1, 2 ** 64 - 1
    assert jump(keys, shards).tolist() == [scalar(int(k), shards) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.random.default_rng(3).integers(0, 2 ** 64, 50000, dtype=np.uint64)
    for n in (1, 16, 17):
        before, after = jump(keys, n), jump(keys, n + 1)
        moved = before != after
        assert (after[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < .02


def checked(docs, rows, shards):
    """Sizes, checksums, slots and moves of every row against plain Python."""
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert texts == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["law"] == "key" and 0 <= r["shard"] < shards
        assert r["grown_shard"] in (r["shard"], shards)
        slots[r["shard"]].append(r["slot"])
        homes[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())  # equal keys share a shard
    hashes = {r["doc_id"]: r["h"] % 2 ** 64 for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    assert all((r["shard"], r["grown_shard"]) == (scalar(hashes[r["doc_id"]], shards), scalar(hashes[r["doc_id"]], shards + 1)) for r in rows)


@pytest.mark.parametrize("shards", [1, 16, 17])
def test_odd_rows(odd_docs, shards):
    checked(odd_docs, shard_slots(odd_docs, shards).collect(), shards)


def test_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    checked(docs, shard_slots(docs).collect(), 16)
    whole = assign_shards(docs, 16, 17)
    again = assign_shards(docs.repartition(7), 16, 17)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, again.collect()))


def test_empty_table_and_bad_counts(no_docs):
    assert shard_slots(no_docs).collect() == []
    with pytest.raises(ValueError):
        assign_shards(no_docs, 0, 1)
