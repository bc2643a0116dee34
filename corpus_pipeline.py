"""A corpus pipeline over ``documents``: language, near-duplicates, decontamination, secrets, packing.

Every stage takes what the one before it kept, as ``(spark, docs, sf_dir)``, and its result is written before the next
one begins, so a lost executor costs tasks and never a stage. All stages but the last return the columns of ``documents``.
Null texts go with the first stage, since they have no language; rows with a null id are rows like any other; of repeated rows one stays. Ties between
near-duplicates go to the smallest id. An empty table goes through all stages. Further columns, whatever their names, are kept up to the last stage;
long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsframe.llm.decontam_winnow import decontaminate
from obsframe.llm.dedup_omh import near_duplicates
from obsframe.llm.frames import keep_out, table
from obsframe.llm.langid_ecoc import keep_identified
from obsframe.llm.packing_mbs import pack
from obsframe.llm.queries import TOKENIZER, WINDOW
from obsframe.llm.secret_crf import redact_secrets
from obsframe.session import scratch_path

#: SQL cannot express the classifiers and the alignment; tests compare the stages with brute force.
ORACLE_SQL = None


def _nested(docs: DataFrame) -> DataFrame:
    """Rows as one struct, so that no column of theirs meets a helper, with what the operators tell rows apart by: the id as text that is never null,
    and the text's hash."""
    return docs.select(F.struct(*docs.columns).alias("row"), _id(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("hash"))


def _id(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters and texts between two languages go."""
    return keep_identified(docs, ~keep_out("doc_id", 3, 1))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of the smallest id; of rows with equal id and text, one."""
    found = near_duplicates(docs, 0.8).where("representative")
    kept = found.select(_id(F.col("doc_id")).alias("id"), F.col("text_hash").alias("hash")).distinct()
    one = Window.partitionBy("id", "hash").orderBy(F.xxhash64("row"))
    rows = _nested(docs).withColumn("rn", F.row_number().over(one)).where(F.col("rn") == 1)
    return rows.join(kept, ["id", "hash"], "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row, or a whole shorter item, with the benchmark go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    gone = found.select(_id(F.col("doc_id")).alias("id"), F.col("text_hash").alias("hash")).distinct()
    return _nested(docs).join(gone, ["id", "hash"], "left_anti").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, ``n_chars`` follows its text."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return pack(docs, TOKENIZER, WINDOW, end_id=1)


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
