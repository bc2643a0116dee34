from pyspark.sql import functions as F

from obsframe.functions import values as V
from obsframe.functions.html import extract_attr, extract_attr_fast, first_attr
from obsframe.functions.names import clean_names


def one(spark, ddl, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*cols).collect()]


def test_numbers_and_sentinels(spark):
    got = one(spark, "c string", [("3",), ("X",), (None,), ("abc",)], V.count_or_null("c"))
    assert got == [(3.0,), (None,), (None,), (None,)]
    got = one(spark, "c string", [("USD 1,234.5",), ("-7",), ("none",), (None,)], V.parse_number("c"))
    assert got == [(1234.5,), (-7.0,), (None,), (None,)]
    got = one(spark, "c double", [(100.0,), (0.0,), (-1.0,), (None,)], V.log10_finite("c"))
    assert got == [(2.0,), (0.0,), (None,), (None,)]


def test_strict_and_lenient_sums(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("c", None)], "k string, v int")
    got = {r.k: (r.s, r.z, r.m) for r in df.groupBy("k").agg(
        V.sum_strict("v").alias("s"), V.sum_or_zero("v").alias("z"), V.mean_strict("v").alias("m")).collect()}
    assert got == {"a": (None, 1, None), "b": (2, 2, 2.0), "c": (None, 0, None)}


def test_text_and_dates(spark):
    got = one(spark, "a string, b string", [("x", None), ("x", "y")], V.join_text("a", "b", sep="-"),
              V.join_text("a", V.null_to_text("b"), sep="-"))
    assert got == [(None, "x-NA"), ("x-y", "x-y")]
    got = one(spark, "a string", [("seen 2020-01-31 10:00",), ("bad 2020-13-45",), ("none",)], V.date_in_text("a").cast("string"))
    assert got == [("2020-01-31",), (None,), (None,)]
    got = one(spark, "a string", [("X2018.01.04",), ("oops",)], V.layer_date("a").cast("string"))
    assert got == [("2018-01-04",), (None,)]
    got = one(spark, "a string", [("March",), ("Nomonth",)], V.date_from_month_name("a", F.lit(2019)).cast("string"))
    assert got == [("2019-03-01",), (None,)]


def test_weekly_layer_names(spark):
    rows = spark.range(52).select(F.date_format(F.date_add(F.lit("2022-01-04").cast("date"), F.col("id").cast("int") * 7), "'X'yyyy.MM.dd").alias("n"))
    days = [r[0] for r in rows.select(V.layer_date("n").cast("string")).collect()]
    assert days[0] == "2022-01-04" and days[-1] == "2022-12-27" and len(set(days)) == 52


def test_predicates(spark):
    df = spark.createDataFrame([("a", 1.0), (None, float("nan")), ("b", None)], "k string, v double")
    assert [r.k for r in df.where(V.not_in_keep_null("k", ["a"])).collect()] == [None, "b"]
    assert [r.k for r in V.drop_missing(df, "v").collect()] == ["a"]
    assert V.drop_missing(df).count() == 1


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "`STATE CODE` int, comName int, `.cluster` int, `cluster` int, `2nd %` int")
    assert clean_names(df).columns == ["state_code", "com_name", "cluster", "cluster_2", "x2nd_percent"]
    assert clean_names(df, "sentence").columns[1] == "Com name"


PAGE = """<html><img src="top.png"><div class='Media Media--hero Media--slides'><p class="x">t</p>
<div class="Media-content"><span><img alt="no"></span><img src="bird.png"></div></div>
<div class="Media-content"><img src="late.png"></div></html>"""


def test_html(spark):
    path = ["Media Media--hero Media--slides", "Media-content"]
    assert first_attr(PAGE.replace('<img alt="no">', ""), path, "img", "src") == "bird.png"
    assert first_attr(PAGE, path, "img", "src") is None  # the first image has no src
    assert first_attr("<div class='a'></div><div class='b'><img src='1'></div>", ["a", "b"], "img", "src") is None
    assert first_attr(None, [], "a", "href") is None
    df = spark.createDataFrame([(1, '<a class="x" href="u">t</a>'), (2, "<a>none</a>"), (3, None), (4, "<<<")], "id int, h string")
    got = [tuple(r) for r in df.select(extract_attr("h", [], "a", "href"), extract_attr_fast("h", "a", "href")).collect()]
    assert got == [("u", "u"), (None, None), (None, None), (None, None)]
