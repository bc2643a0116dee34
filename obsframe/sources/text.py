"""Delimited text: readers with explicit schemas, compressed input, writers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def string_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t", doubled_quotes: bool = True) -> DataFrame:
    """Text with a header. Plain and gzip files (by extension); a doubled quote stands for one
    quote. A gzip file is one task: ``spread`` the rows before heavy work."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"')
    if doubled_quotes:
        reader = reader.option("escape", '"')
    return reader.csv(path)


def read_text_columns(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """All columns as strings, names from the header; cast afterwards with ``try_cast``."""
    names = spark.read.option("header", True).option("sep", sep).csv(path).columns
    return read_delimited(spark, path, string_schema(names), sep)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Redistribute rows that came from an unsplittable file."""
    return df.repartition(partitions) if partitions else df.repartition(
        max(df.sparkSession.sparkContext.defaultParallelism, 1))


def unzip_lines(archives: DataFrame, content: str = "content", batch: int = 10_000) -> DataFrame:
    """Lines of zip archives held as binary rows: ``(member, line_no, line)``.

    Members are inflated as a stream and handed on in batches, so a task holds one compressed
    archive and one batch of lines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf[content]:
                with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                    for member in archive.namelist():
                        with io.TextIOWrapper(archive.open(member), encoding="utf-8") as lines:
                            held: list[str] = []
                            first = 0
                            for i, line in enumerate(lines):
                                held.append(line.rstrip("\r\n"))
                                if len(held) == batch:
                                    yield pd.DataFrame({"member": member, "line_no": range(first, i + 1), "line": held})
                                    held, first = [], i + 1
                            if held:
                                yield pd.DataFrame({"member": member, "line_no": range(first, first + len(held)), "line": held})

    return archives.select(content).mapInPandas(run, "member string, line_no long, line string")


def read_zip(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Delimited text (with a header line) inside zip archives; one task per archive for the
    unzip, then the rows are spread."""
    archives = spark.read.format("binaryFile").load(path).select("content")
    return parse_zipped(archives, schema, sep)


def parse_zipped(archives: DataFrame, schema: str, sep: str = "\t") -> DataFrame:
    lines = unzip_lines(archives).where(F.col("line_no") > 0)
    row = F.from_csv("line", schema, {"sep": sep, "quote": '"', "escape": '"'})
    return spread(lines.select("line")).select(row.alias("r")).select("r.*")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """A row cap; with ``order`` the same rows every time."""
    return (df.orderBy(*order) if order else df).limit(n)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return path


def write_filtered_text(df: DataFrame, path: str) -> str:
    """The filtered extract as tab-delimited text, one file per task."""
    return write_csv(df, path, "\t")
