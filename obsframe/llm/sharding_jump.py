"""Sharding by jump consistent hashing (Lamping and Veach 2014).

The shard of a row follows from its key and the number of shards alone: no ring table, and a grown number of
shards moves only the rows that go into the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import number_rows


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys take their jumps together."""
    state = keys.astype(np.uint64)
    at = np.zeros(len(keys), dtype=np.int64)
    ahead = np.zeros(len(keys), dtype=np.int64)
    going = np.arange(len(keys))
    while len(going):
        at[going] = ahead[going]
        state[going] = state[going] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[going] = np.floor((at[going] + 1) * (2.0 ** 31 / draw)).astype(np.int64)
        going = going[ahead[going] < shards]
    return at


def assign_shards(docs: DataFrame, shards: int, grown: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size, text_crc32, shard, grown_shard)`` for every row.

    ``size`` is the number of UTF-8 bytes of the text plus 1, a null text counts as empty, a null key is a key
    like any other. Equal keys share a shard, whatever else their rows hold. Only the key's hash, the size and
    the checksum leave the JVM; the texts do not, and nothing is shuffled.
    """
    if shards < 1 or grown < 1:
        raise ValueError("the number of shards must be positive")
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    small = docs.select(F.col(key), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"),
                        F.xxhash64(F.col(key)).alias("__hash"))
    schema = small.drop("__hash").schema.add("shard", "integer").add("grown_shard", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.asarray(b.column("__hash")).view(np.uint64)
            cols = [*b.columns[:3], pa.array(jump(h, shards), pa.int32()), pa.array(jump(h, grown), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:3], "shard", "grown_shard"])

    return small.mapInArrow(run, schema)


def shard_slots(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard and a slot, gapless from 0 within the shard; ``grown_shard`` with one shard more.

    The law is ``key``. An empty table gives no rows. Columns of other names are not looked at.
    """
    placed = assign_shards(docs, shards, shards + 1, key, text)
    return number_rows(placed, "shard", "slot").select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
