"""Frame helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import top_k_per_group
from ..session import cut_lineage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    """Into how many parts a hot group is cut: follows the shuffle partitions, which follow the input."""
    return 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def number_rows(df: DataFrame, group: str, out: str) -> DataFrame:
    """Numbers the rows of each group without gaps from 0, in no group's own task.

    Equal rows are counted first. A group is cut into parts by a hash of its rows; a part is numbered by
    itself and starts where the parts before it end. Columns must be hashable and sortable.
    """
    cols, parts = df.columns, spread(df.sparkSession)
    part = F.pmod(F.xxhash64(*cols, F.lit(5)), F.lit(parts)).alias("__part")
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(group, "__part").orderBy(*[c for c in cols if c != group])
    inner = cut_lineage(counted.select("*", part).withColumn("__at", F.sum("__n").over(own) - F.col("__n")))
    total = inner.groupBy(group, "__part").agg(F.sum("__n").alias("__m"))
    before = total.withColumn("__base", F.sum("__m").over(Window.partitionBy(group).orderBy("__part")) - F.col("__m"))
    before = before.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), "__base")
    same = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p"))
    at = F.col("__base") + F.col("__at")
    return inner.join(before, same).select(*cols, F.explode(F.sequence(at, at + F.col("__n") - 1)).alias(out))


def smallest_hashes(keyed: DataFrame, n: int) -> DataFrame:
    """The rows of the ``n`` smallest ``__h`` per ``__by``; above 1,000, where the engine no longer cuts before the shuffle, from slices of each group."""
    return top_k_per_group(keyed, ["__by"], ["__h"], n)


def bounded_sample(df: DataFrame, keep: Column, by: Column, n: int, *cols: str | Column) -> DataFrame:
    """At most ``n`` rows for each value of ``by`` among the rows of ``keep``: those of the smallest hash of ``cols[0]``.

    The first pass reads only the key columns and finds each group's last hash; the second pass takes the rows
    up to it. Rows that share a key beyond the ``n``-th are cut by the final limit.
    """
    h = F.xxhash64(F.col(cols[0]) if isinstance(cols[0], str) else cols[0], F.lit(11))
    keyed = df.where(keep).select(by.alias("__by"), h.alias("__h"))
    last = {r[0]: r[1] for r in smallest_hashes(keyed, n).groupBy("__by").agg(F.max("__h")).collect()}
    if not last:
        return df.where(F.lit(False)).select(*cols)
    within = F.lit(False)
    for value, cut in last.items():
        within = within | ((by == F.lit(value)) & (h <= F.lit(cut)))
    return df.where(keep & within).select(*cols).limit(n * len(last))


def keep_out(key: str, parts: int, out: int) -> Column:
    """Whether a row is held out: the CRC-32 of its key as text leaves the remainder ``out``. A null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == out, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, n: int, key: str = "doc_id", text: str = "text",
                    max_chars: int | None = None) -> DataFrame:
    """``(text, label)`` of at most ``n`` documents per value of ``label`` that are not held out.

    Which ones follows from a hash of the key. With ``max_chars`` only texts up to that length are drawn, which bounds the
    sample's bytes; this bounds what is learned from, not what is scored. Keys that repeat give several rows: callers
    limit what they collect.
    """
    drawn = bounded_sample(labels, ~held_out & F.col(label).isNotNull(), F.col(label), n, key, label)
    drawn = F.broadcast(drawn.select(F.col(key).alias("__key"), F.col(label).alias("__label")))  # n rows per class
    few = docs.select(F.col(key), F.col(text))
    if max_chars is not None:
        few = few.where(F.length(F.col(text)) <= max_chars)
    return few.join(drawn, F.col(key) == F.col("__key")).select(F.col(text).alias("text"), F.col("__label").alias("label"))


def bitmap_of(df: DataFrame, place: Column, bits: int) -> bytes:
    """One bit for each of the ``2**bits`` places, set for those that occur, lowest bit of a byte first.

    Its size is fixed whatever the number of rows. As a filter before a join it only spares shuffled rows: where it
    fills up, more rows pass and the join decides as before.
    """
    n = (place + 1).alias("n")
    rows = (df.select(n).groupBy(F.bitmap_bucket_number("n").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits")).collect())
    known = {r["bucket"]: bytes(r["bits"]) for r in rows}
    return b"".join(known.get(i, bytes(4096)) for i in range(1, max(1, (1 << bits) // 32768) + 1))
