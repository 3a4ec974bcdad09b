"""Edge cases of cleaning expressions, sources and gates."""

import gzip

import pytest
from pyspark.sql import functions as F

from crestline.functions import calendars, changes, cleaning
from crestline.sources import conform, quality, readers, sinks


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_sentinels_ratios_and_numbers(spark):
    df = spark.createDataFrame(
        [("-999999", 0.0, 5.0), ("4", 10.0, 25.0), ("nan", 10.0, -1.0), ("x", 10.0, 5.0)], "t string, beds double, used double")
    assert values(df, cleaning.unsuppress(cleaning.to_number(F.col("t")))) == [None, 4.0, None, None]
    assert values(df, cleaning.bounded_ratio(F.col("used"), F.col("beds"))) == [None, None, None, 0.5]


def test_dates_and_digits(spark):
    df = spark.createDataFrame([("20200715.0",), ("bad",), (None,)], "d string")
    assert [str(v) for v in values(df, cleaning.compact_day(F.col("d")))] == ["2020-07-15", "None", "None"]
    df = spark.createDataFrame([("1001",), ("01001.0",), ("123456",), ("text",)], "d string")
    assert values(df, cleaning.digits(F.col("d"), 5)) == ["01001", "01001", "123456", None]


def test_calendar(spark):
    df = spark.sql("SELECT explode(sequence(date'2021-02-27', date'2021-03-02')) AS d")
    assert [str(v) for v in values(df, calendars.week_start_sunday(F.col("d")))] == ["2021-02-21", "2021-02-28", "2021-02-28", "2021-02-28"]
    assert values(df, calendars.period_label(F.col("d"))) == ["2020_21_winter", "2020_21_winter", "2021_spring", "2021_spring"]
    assert values(df, calendars.week_span_label(F.col("d")))[0] == "2021-02-22/2021-02-28"


def test_guarded_changes(spark):
    df = spark.createDataFrame([(2.0, 1.0), (0.0, 1.0), (-1.0, 1.0)], "a double, b double")
    assert values(df, changes.log_change(F.col("a"), F.col("b")))[1:] == [None, None]
    assert values(df, changes.log1p_change(F.col("a"), F.col("b")))[2] is None
    assert values(df, changes.sign_label(F.col("a"))) == ["positive", "zero", "negative"]


def test_facility_name(spark):
    df = spark.createDataFrame([("Saint Mary's University Medical Center & Hospital",)], "n string")
    assert values(df, cleaning.facility_name(F.col("n"))) == ["st mary s univ med center and hosp"]


def test_conform_prefers_exact_over_part(spark):
    df = spark.createDataFrame([(1, 2)], "`weekly state code` int, State int")
    got = conform.conform(df, [conform.Field("state", ["state"]), conform.Field("x", ["nope"], "double", False)], fuzzy=True)
    assert got.first().asDict() == {"state": 2, "x": None}
    with pytest.raises(ValueError):
        conform.conform(df, [conform.Field("y", ["nope"])])


def test_paged_csv_refuses_html(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.csv").write_text("k,v\n3,4\n")
    assert readers.read_paged_csv(spark, str(tmp_path), ["k", "v"]).count() == 2
    (tmp_path / "c.csv").write_text("<html>\n<body>error</body>\n")
    with pytest.raises(Exception):
        readers.read_paged_csv(spark, str(tmp_path), ["k", "v"]).count()


def test_fixed_width_gzip(spark, tmp_path):
    line = "2020AL01001991012500000042"
    with gzip.open(tmp_path / "p.txt.gz", "wt") as f:
        f.write(line + "\n")
    row = readers.read_fixed_width(spark, str(tmp_path / "p.txt.gz")).first()
    assert (row["year"], row["state_fips"], row["county_fips3"], row["population"]) == ("2020", "01", "001", "00000042")


def test_gates(spark):
    df = spark.range(3)
    assert quality.require_rows(df, "t", 3).count() == 3
    with pytest.raises(ValueError):
        quality.require_rows(df, "t", 4)
    with pytest.raises(Exception):
        quality.assert_total(df, "id", 10, 20).collect()


def test_profile_counts_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "k int, v string")
    got = {r["column"]: (r["missing"], r["unique"]) for r in quality.column_profile(df).collect()}
    assert got == {"k": (0, 2), "v": (2, 1)}


def test_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert sinks.to_json_lines(df).first()[0] == '{"a":1,"b":null}'


def test_bucketed_panel_needs_no_exchange(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS crest LOCATION '{tmp_path}/crest.db'")
    df = spark.range(100).selectExpr("id % 10 AS h", "id AS w", "id * 1.0 AS x")
    sinks.write_bucketed(df, "crest.panel", "h", "w", 4)
    plan = spark.table("crest.panel").groupBy("h").agg(F.sum("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP DATABASE crest CASCADE")
