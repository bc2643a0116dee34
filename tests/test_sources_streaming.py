import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from obsframe.operators import relational as J
from obsframe.operators import reshape as R
from obsframe.session import scratch_path
from obsframe.sources import grids as GR
from obsframe.sources import records as RC
from obsframe.sources import text as TX
from obsframe.streaming import files as ST

SCHEMA = "`COMMON NAME` string, N int, NOTE string"
TEXT = 'COMMON NAME\tN\tNOTE\nJay\t1\tplain\nWren\t2\t"said ""hi"""\nOwl\t\t\n'
WANT = [("Jay", 1, "plain"), ("Owl", None, None), ("Wren", 2, 'said "hi"')]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_plain_gzip_and_zip(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write(TEXT)
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("m.txt", TEXT)
    assert rows(TX.read_delimited(spark, str(tmp_path / "a.txt"), SCHEMA)) == WANT
    assert rows(TX.spread(TX.read_delimited(spark, str(tmp_path / "b.txt.gz"), SCHEMA), 3)) == WANT
    assert rows(TX.read_zip(spark, str(tmp_path / "c.zip"), SCHEMA)) == WANT
    assert TX.read_text_columns(spark, str(tmp_path / "a.txt")).dtypes == [("COMMON NAME", "string"), ("N", "string"), ("NOTE", "string")]


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame(WANT, SCHEMA)
    assert rows(TX.read_delimited(spark, TX.write_csv(df, str(tmp_path / "o")), SCHEMA, ",")) == WANT
    assert rows(TX.read_delimited(spark, TX.write_filtered_text(df, str(tmp_path / "t")), SCHEMA)) == WANT


def test_cells_are_partitioned(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0, "abundance", "3km"), ("b", 1.0, 2.0, 4.0, "abundance", "27km")],
                               "species_name string, x double, y double, v double, product string, resolution string")
    out = GR.read_cells(spark, GR.write_cells(df, scratch_path(spark, "t")), "abundance", "27km", ["b", "a"])
    assert rows(out) == [("b", 1.0, 2.0, 4.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(product" in plan and "PushedFilters: [In(species_name" in plan


def test_records(spark):
    df = spark.createDataFrame([("s", "g", 2), ("s", "g", 1), ("s", None, 3), ("s", None, 4), ("t", "g", 5)], "sp string, g string, id int")
    assert rows(RC.unique_group_checklists(df, "sp", "g", ["id"]).select("id")) == [(1,), (3,), (4,), (5,)]
    obs = spark.createDataFrame([(1, "a1", 2.0), (1, "a2", 3.0), (2, "a1", None), (2, "x", 1.0)], "c int, n string, v double")
    taxa = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("x", None)], "n string, species string")
    assert rows(RC.roll_up_taxa(obs, taxa, "n", "c", "v")) == [(1, "a", 5.0), (2, "a", None)]
    assert RC.filter_observations(obs, ["a1"], None, "n").count() == 2
    seen = spark.createDataFrame([("a", "e1", "2019-01-01"), ("a", "e2", "2019-01-02"), ("b", "e2", "2019-01-02"), ("b", "e3", "2019-01-31")],
                                 "s string, e string, d string").withColumn("d", F.col("d").cast("date"))
    got = {(r.s, r.month_qt): (r.sample_size, r.frequency) for r in RC.frequency_table(seen, "s", "e", "d").collect()}
    assert got == {("a", "January-1"): (2.0, 1.0), ("b", "January-1"): (2.0, 0.5), ("b", "January-4"): (1.0, 1.0)}


def test_null_safe_joins(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([(None, 9)], "k string, w int")
    assert rows(J.semi_join(a, b, ["k"])) == [(None, 2)]
    assert rows(J.anti_join(a, b, ["k"])) == [("x", 1)]
    assert sorted(map(str, J.left_join(a, b, ["k"]).collect())) == sorted(map(str, spark.createDataFrame(
        [("x", 1, None), (None, 2, 9)], "k string, v int, w int").collect()))
    assert rows(J.group_size_filter(a.unionByName(a), ["k"], 3)) == []
    assert rows(J.semi_join(a, a.where("v = 1"), ["k"])) == [("x", 1)]


def test_group_extremes_ignore_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", float("nan")), ("b", None)], "k string, v double")
    assert rows(J.keep_group_extreme(df, ["k"], "v")) == [("a", 3.0), ("a", 3.0)]
    assert rows(J.keep_global_extreme(df, "v", smallest=True)) == [("a", 1.0)]
    assert not J.no_nan_in(df, "v") and J.no_nan_in(df.where("v > 0 and not isnan(v)"), "v")


def test_reshape(spark):
    df = spark.createDataFrame([("a", "p", 1), ("a", "q", 2), ("b", "p", 3)], "id string, n string, v int")
    wide = R.wider(df, ["id"], "n", "v", prefix="n_")
    assert {tuple(r) for r in wide.select("id", "n_p", "n_q").collect()} == {("a", 1, 2), ("b", 3, None)}
    assert R.longer(wide, ["id"]).count() == 4
    nested = R.nest(spark.range(1000).select((F.col("id") % 2).alias("k"), "id"), ["k"], cell_rows=100)
    assert nested.agg(F.max(F.size("data"))).first()[0] < 200 and nested.count() >= 8
    assert rows(R.unnest(nested).select("id")) == [(i,) for i in range(1000)]
    s = R.separate(spark.createDataFrame([("May-2",), ("June",)], "m string"), "m", ["month", "week"])
    assert sorted(map(str, s.collect())) == ["Row(month='June', week=None)", "Row(month='May', week='2')"]
    ranked = R.wider_by_rank(df, "id", "n", [F.col("v").desc()], ["a", "b"])
    assert {tuple(r) for r in ranked.collect()} == {(1, "q", "p"), (2, "p", None)}


@pytest.fixture()
def folder(spark, tmp_path):
    df = spark.range(600).select("id", (F.col("id") % 3).alias("kind"), (F.col("id") * 1.5).alias("v"),
                                 F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7200).alias("ts"))
    df.repartition(5).write.parquet(str(tmp_path / "t"))
    return df, str(tmp_path / "t")


def test_streams_equal_batch(spark, folder):
    df, path = folder

    def stream():
        return ST.table_stream(spark, path, "part", df.schema)

    assert rows(ST.filter_chunks(stream(), F.col("kind") == 1)) == rows(df.where("kind = 1"))
    seen = []

    def callback(chunk, number):
        seen.append(number)
        return chunk.where("v > 300").withColumn("pos", F.lit(number))

    got = ST.map_chunks(stream(), callback).select(*df.columns)
    assert rows(got) == rows(df.where("v > 300")) and seen == list(range(5))
    got = ST.run_updates(ST.daily_sums(stream(), "ts", "v"), ["day"])
    want = ST.daily_sums(df, "ts", "v")
    assert rows(got) == rows(want) and got.agg(F.sum("n")).first()[0] == 600
    got = ST.run_updates(ST.daily_sums(stream(), "ts", "v", late="60 days"), ["day"])
    assert rows(got) == rows(want)


def test_text_stream(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(f"COUNTRY\tN\nUS\t{i}\nCA\t{i}\n")
    s = ST.text_stream(spark, str(tmp_path), "COUNTRY string, N int")
    assert rows(ST.filter_chunks(s, F.col("COUNTRY") == "US")) == [("US", 0), ("US", 1), ("US", 2)]
