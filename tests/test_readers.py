"""Pages and stages: what is read, what is refused, what is reused."""

import pytest
from pyspark.sql import functions as F

from crestline.sources import readers


@pytest.fixture
def pages(tmp_path):
    for i, body in enumerate(["a,b\n1,x\n2,\"y, z\"\n", "a,b\n3,\n", "a,b\n"]):
        (tmp_path / f"p{i}.csv").write_text(body)
    return tmp_path


def test_pages(spark, pages):
    rows = readers.read_paged_csv(spark, str(pages), ["a", "b"])
    assert sorted(map(tuple, rows.collect())) == [("1", "x"), ("2", "y, z"), ("3", None)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_an_html_page_is_refused(spark, pages):
    (pages / "p9.csv").write_text("<!DOCTYPE html>\n<html>error</html>\n")
    with pytest.raises(Exception, match="p9.csv"):
        readers.read_paged_csv(spark, str(pages), ["a", "b"]).count()


def test_stage_is_reused_only_for_the_same_input(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "stage")
    runs = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(v):
        runs.add(1)
        return v

    def made(n=1):
        return spark.read.parquet(source).select((counted("id") * n).alias("v"))

    spark.range(10).coalesce(1).write.parquet(source)
    assert readers.stage(made(), path).count() == 10 and runs.value == 10
    assert readers.stage(made(), path).count() == 10 and runs.value == 10  # hit
    assert readers.stage(made(2), path, {"n": 2}).agg(F.sum("v")).first()[0] == 90 and runs.value == 20  # other parameters
    spark.range(12).coalesce(1).write.mode("overwrite").parquet(source)
    assert readers.stage(made(), path).count() == 12 and runs.value == 32  # changed rows
    for f in (tmp_path / "stage").glob("manifest-*/part-*"):
        f.write_text("")  # as if the write had not come to its end
    assert readers.stage(made(), path).count() == 12 and runs.value == 44


def test_gates_ride_on_the_write(spark, tmp_path):
    from crestline.sources import quality

    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(v):
        read.add(1)
        return v

    rows = spark.range(100).select(counted("id").alias("v"))
    back, seen = quality.write_measured(rows, str(tmp_path / "t"), {"rows": F.count("*"), "total": F.sum("v"), "half": F.percentile_approx("v", 0.5)})
    quality.gate("t", seen, rows=(100, None), total=(0, 5000))
    assert read.value == 100 and back.count() == 100 and seen["total"] == 4950 and abs(seen["half"] - 49.5) < 2
    with pytest.raises(ValueError, match="t: rows is 100"):
        quality.gate("t", seen, rows=(101, None))
    with pytest.raises(ValueError):
        quality.gate("t", {"x": None}, x=(0, None))
    _, empty = quality.write_measured(rows.limit(0), str(tmp_path / "e"), {"rows": F.count("*"), "total": F.sum("v")})
    assert empty == {"rows": 0, "total": None}
    assert [tuple(r) for r in quality.measured_summary(spark, {"e": empty}).collect()] == [("e", "rows", 0.0), ("e", "total", None)]
