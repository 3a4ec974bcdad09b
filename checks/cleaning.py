"""Sources, sinks, gates, cleaning and label expressions over the provided tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession, functions as F

from checks.registry import query
from checks.standins import facility_ratios, facility_week, sql, table
from crestline.functions import calendars, changes, cleaning
from crestline.functions.places import REGION_OF_STATE, STATE_OF_FIPS
from crestline.operators.quantiles import quantile_value
from crestline.operators.windows import calendar_index, collapse_rare, keep_last, zscore
from crestline.sources import conform, quality, readers, sinks


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared checkpoint folder (a temporary one in local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="crestline-")
    return f"{base}/crestline-{tag}-{uuid.uuid4().hex}"


# --- sources and sinks ------------------------------------------------------------------------


@query("src1_csv_scan", "segment:s n:i balance:f2", """
SELECT c_mktsegment AS segment, count(*) AS n, sum(c_acctbal) AS balance FROM customer GROUP BY 1""")
def _(spark, sf):
    path = scratch(spark, "csv")
    sinks.write_table(table(spark, sf, "customer"), path, "csv")
    rows = readers.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("n"), F.sum("c_acctbal").alias("balance")
    )


@query("src2_paged_csv", "priority:s n:i total:f2", """
SELECT o_orderpriority AS priority, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1""")
def _(spark, sf):
    path = scratch(spark, "pages")
    columns = ["o_orderkey", "o_orderpriority", "o_totalprice"]
    table(spark, sf, "orders").select(*columns).repartition(5, "o_orderkey").write.option("header", True).csv(path)
    rows = readers.read_paged_csv(spark, path, columns)
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("n"), F.sum(cleaning.to_number(F.col("o_totalprice"))).alias("total")
    )


@query("src3_fixed_width", "county_fips:s population:i", """
SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '0' || right('0' || CAST(abs(CAST(floor(c_acctbal) AS BIGINT)) % 100 AS VARCHAR), 2) AS county_fips,
sum(abs(CAST(floor(c_acctbal) AS BIGINT))) AS population FROM customer GROUP BY 1""")
def _(spark, sf):
    amount = F.abs(F.floor("c_acctbal"))
    line = F.concat(
        F.lit("2020"), F.lit("XX"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("0"),
        F.lpad((amount % 100).cast("string"), 2, "0"), F.lit("991"), F.lit("0"), F.lit("1"), F.lit("05"),
        F.lpad(amount.cast("string"), 8, "0"),
    )
    path = scratch(spark, "fixed")
    table(spark, sf, "customer").select(line.alias("value")).write.option("compression", "gzip").text(path)
    rows = readers.read_fixed_width(spark, path).where(F.col("year").try_cast("int") == 2020)
    return rows.groupBy(F.concat("state_fips", "county_fips3").alias("county_fips")).agg(
        F.sum(F.col("population").try_cast("bigint")).alias("population")
    )


@query("src4_crosswalk", "county_fips:s area_id:s area_name:s", """
SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS county_fips, CAST(n_regionkey AS VARCHAR) AS area_id, r_name AS area_name
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(spark, sf):
    sheet = table(spark, sf, "nation").join(
        table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
    )
    clean = sheet.select(
        cleaning.digits(F.col("n_nationkey"), 5).alias("county_fips"),
        cleaning.digits(F.col("n_regionkey")).alias("area_id"), F.col("r_name").alias("area_name"),
    ).dropna(subset=["county_fips", "area_id"]).dropDuplicates(["county_fips"])
    return clean.where(~F.col("county_fips").endswith("999"))


DEPLOY_SQL = {
    "deploy": ("fw", """SELECT f.hospital_id, f.state, max_by(week, struct_pack(a := admissions, b := -epoch(week))) AS start_date
        FROM fw f JOIN supplier ON s_suppkey = hospital_id WHERE s_acctbal < 1500 GROUP BY 1, 2"""),
}


def deployments(spark, sf):
    """Inventory stand-in: suppliers with a low balance, starting in their busiest week."""
    listed = table(spark, sf, "supplier").where("s_acctbal < 1500").select(
        F.col("s_suppkey").alias("hospital_id"), F.col("s_name").alias("official_hospital_name")
    )
    peak = F.max_by("week", F.struct(F.col("admissions"), -F.unix_date("week")))
    return facility_week(spark, sf).join(listed, "hospital_id").groupBy("hospital_id", "state", "official_hospital_name").agg(
        peak.alias("start_date")
    )


@query("src5_inventory", "hospital_id:i state:s start_date:d", sql("deploy", "SELECT * FROM deploy", DEPLOY_SQL))
def _(spark, sf):
    return deployments(spark, sf)


@query("src6_stage_reuse", "state:s n:i", sql("fw", "SELECT state, count(*) AS n FROM fw GROUP BY 1"))
def _(spark, sf):
    path = scratch(spark, "stage")
    made = facility_week(spark, sf).groupBy("state").agg(F.count("*").alias("n"))
    readers.stage(made, path, {"by": "state"})
    return readers.stage(made, path, {"by": "state"})


PROFILE = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
           ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")]


@query("src7_column_profile", "field:s dtype:s missing:i distinct_values:i", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS field, '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS distinct_values FROM orders"
    for c, t in PROFILE
))
def _(spark, sf):
    rows = table(spark, sf, "orders").select(*[F.col(c).cast(t).alias(c) for c, t in PROFILE])
    return quality.column_profile(rows).withColumnRenamed("column", "field").withColumnRenamed("unique", "distinct_values")


FIELDS = [
    conform.Field("hospital_id", ["hospital_pk", "s_suppkey"]),
    conform.Field("state", ["state", "s_nationkey"]),
    conform.Field("beds", ["beds"], "double", required=False),
]


@query("src8_conform_exact", "hospital_id:i state:i beds:f",
       "SELECT s_suppkey AS hospital_id, s_nationkey AS state, CAST(NULL AS DOUBLE) AS beds FROM supplier")
def _(spark, sf):
    return conform.conform(table(spark, sf, "supplier"), FIELDS)


@query("src9_conform_fuzzy", "hospital_id:i balance:f2 name:s",
       "SELECT s_suppkey AS hospital_id, s_acctbal AS balance, s_name AS name FROM supplier")
def _(spark, sf):
    fields = [
        conform.Field("hospital_id", ["hospital id", "suppkey"]),
        conform.Field("balance", ["Acct Bal", "acctbal"]), conform.Field("name", ["S-Name"]),
    ]
    return conform.conform(table(spark, sf, "supplier"), fields, fuzzy=True)


@query("src10_required_columns", "orderstatus:s n:i", "SELECT o_orderstatus AS orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    rows = conform.require(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"])
    return rows.groupBy(F.col("o_orderstatus").alias("orderstatus")).agg(F.count("*").alias("n"))


@query("src11_row_gate", "state:s weeks:i", sql("fw", "SELECT state, count(*) AS weeks FROM fw GROUP BY 1"))
def _(spark, sf):
    panel, seen = quality.write_measured(facility_week(spark, sf), scratch(spark, "weeks"), {"rows": F.count("*")})
    quality.gate("facility weeks", seen, rows=(500, None))
    return panel.groupBy("state").agg(F.count("*").alias("weeks"))


@query("src12_total_gate", "total:f2", "SELECT sum(l_quantity) AS total FROM lineitem")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    quantity = F.col("l_quantity").cast("double")
    _, seen = quality.write_measured(lines, scratch(spark, "lines"), {"rows": F.count("*"), "total": F.sum(quantity)})
    quality.gate("lines", seen, total=(20.0 * seen["rows"], 31.0 * seen["rows"]))  # a line holds 1 to 50 pieces
    return spark.createDataFrame([(float(seen["total"]),)], "total double")


@query("src13_stage_summary", "stage:s metric:s value:f", sql("epi", """
SELECT 'panel' AS stage, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM fw
UNION ALL SELECT 'panel', 'hospitals', count(DISTINCT hospital_id) FROM fw
UNION ALL SELECT 'episodes', 'rows', count(*) FROM epi
UNION ALL SELECT 'episodes', 'mean_signal', avg(signal_admissions) FROM epi"""))
def _(spark, sf):
    from checks.standins import episodes

    signal = F.col("signal_admissions")
    panel, weeks = quality.write_measured(facility_week(spark, sf), scratch(spark, "weeks"), {"rows": F.count("*")})
    _, found = quality.write_measured(episodes(spark, sf), scratch(spark, "episodes"), {"rows": F.count("*"), "mean_signal": F.avg(signal), "quartiles": F.percentile_approx(signal, [0.25, 0.5, 0.75])})
    low, _, high = found.pop("quartiles")
    quality.gate("episodes", {**found, "spread": high - low}, rows=(1, None), spread=(0, None))
    weeks["hospitals"] = panel.select("hospital_id").distinct().count()  # no combining sum: one column of what was written
    return quality.measured_summary(spark, {"panel": weeks, "episodes": found})


@query("snk1_table_round_trip", "state:s n:i", sql("fw", "SELECT state, count(*) AS n FROM fw GROUP BY 1"))
def _(spark, sf):
    path = scratch(spark, "table")
    sinks.write_table(facility_week(spark, sf).groupBy("state").agg(F.count("*").alias("n")), path)
    return spark.read.parquet(path)


@query("snk2_json_summary", "json:s", sql("epi", """
SELECT to_json(struct_pack(state := state, episodes := count(*), hospitals := count(DISTINCT hospital_id))) AS json
FROM epi GROUP BY state"""))
def _(spark, sf):
    from checks.standins import episodes

    rows = episodes(spark, sf).groupBy("state").agg(
        F.count("*").alias("episodes"), F.count_distinct("hospital_id").alias("hospitals")
    )
    return sinks.to_json_lines(rows)


@query("snk2_nested_summary", "json:s", sql("epi", """
SELECT to_json(struct_pack(panel := (SELECT struct_pack(n := count(*), hospitals := count(DISTINCT hospital_id)) FROM fw),
states := (SELECT list(struct_pack(state := state, episodes := n) ORDER BY state) FROM (SELECT state, count(*) AS n FROM epi GROUP BY 1)))) AS json"""))
def _(spark, sf):
    from checks.standins import episodes

    panel = facility_week(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("hospital_id").alias("hospitals"))
    states = episodes(spark, sf).groupBy("state").agg(F.count("*").alias("episodes"))
    return sinks.nested_json(spark, {"panel": panel}, {"states": states})


# --- cleaning ---------------------------------------------------------------------------------


@query("prj1_key_normalise", "key:s n:i", """
SELECT upper(trim('  ' || lower(o_orderpriority) || ' ')) AS key, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    raw = F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" "))
    return table(spark, sf, "orders").groupBy(cleaning.key_text(raw, upper=True).alias("key")).agg(F.count("*").alias("n"))


@query("prj2_date_coerce", "status:s parsed:i first:d", """
SELECT o_orderstatus AS status, count(try_cast(CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE)) AS parsed,
min(try_cast(CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE)) AS first FROM orders GROUP BY 1""")
def _(spark, sf):
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = cleaning.to_day(text)
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(day).alias("parsed"), F.min(day).alias("first")
    )


@query("prj3_number_coerce", "segment:s numbers:i total:f2", """
SELECT c_mktsegment AS segment, count(v) AS numbers, sum(v) AS total FROM (SELECT c_mktsegment,
try_cast(CASE WHEN c_acctbal < 0 THEN '(' || CAST(-c_acctbal AS VARCHAR) || ')' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS v FROM customer) GROUP BY 1""")
def _(spark, sf):
    b = F.col("c_acctbal")
    text = F.when(b < 0, F.concat(F.lit("("), (-b).cast("string"), F.lit(")"))).otherwise(b.cast("string"))
    v = cleaning.to_number(text)
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(v).alias("numbers"), F.sum(v).alias("total")
    )


@query("prj4_compact_date", "day:d n:i", """
SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1
UNION ALL SELECT NULL, count(*) FROM orders WHERE o_orderstatus = 'P'""")
def _(spark, sf):
    compact = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderstatus") == "F", ".0").otherwise(""))
    text = F.when(F.col("o_orderstatus") == "P", "bad").otherwise(compact)
    return table(spark, sf, "orders").groupBy(cleaning.compact_day(text).alias("day")).agg(F.count("*").alias("n"))


FIPS_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in STATE_OF_FIPS.items())
REGION_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in REGION_OF_STATE.items())


@query("prj5_dictionary_map", "state:s region:s n:i", f"""
WITH fips(k, v) AS (VALUES {FIPS_ROWS}), reg(k, v) AS (VALUES {REGION_ROWS})
SELECT coalesce(fips.v, 'N' || CAST(c_nationkey AS VARCHAR)) AS state, coalesce(reg.v, 'Unknown') AS region, count(*) AS n
FROM customer LEFT JOIN fips ON fips.k = lpad(CAST(c_nationkey AS VARCHAR), 2, '0') LEFT JOIN reg ON reg.k = fips.v GROUP BY 1, 2""")
def _(spark, sf):
    code = cleaning.digits(F.col("c_nationkey"), 2)
    state = cleaning.lookup(code, STATE_OF_FIPS, F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    rows = table(spark, sf, "customer").select(state.alias("state"))
    return rows.groupBy("state", cleaning.lookup(F.col("state"), REGION_OF_STATE, F.lit("Unknown")).alias("region")).agg(
        F.count("*").alias("n")
    )


@query("prj6_membership", "state:s n:i", f"""
WITH fips(k, v) AS (VALUES {FIPS_ROWS}) SELECT v AS state, count(*) AS n FROM customer
JOIN fips ON k = lpad(CAST(c_nationkey AS VARCHAR), 2, '0') GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(cleaning.digits(F.col("c_nationkey"), 2).alias("fips"))
    return rows.where(F.col("fips").isin(*STATE_OF_FIPS)).groupBy(
        cleaning.lookup(F.col("fips"), STATE_OF_FIPS).alias("state")
    ).agg(F.count("*").alias("n"))


@query("prj7_date_range", "status:s n:i", """
SELECT o_orderstatus AS status, count(*) AS n FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-07-15' AND TIMESTAMP '1998-12-31' GROUP BY 1""")
def _(spark, sf):
    inside = F.col("o_orderdate").between(F.to_timestamp(F.lit("1996-07-15")), F.to_timestamp(F.lit("1998-12-31")))
    return table(spark, sf, "orders").where(inside).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("prj8_sentinel", "segment:s observed:i mean:f", """
SELECT c_mktsegment AS segment, count(*) FILTER (c_acctbal >= 0) AS observed, avg(c_acctbal) FILTER (c_acctbal >= 0) AS mean FROM customer GROUP BY 1""")
def _(spark, sf):
    reported = F.when(F.col("c_acctbal") < 0, F.lit(-999999.0)).otherwise(F.col("c_acctbal"))
    v = cleaning.unsuppress(reported)
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(v).alias("observed"), F.avg(v).alias("mean")
    )


@query("prj9_bounded_ratio", "hospital_id:i week:d occupancy:f", sql("fr", "SELECT hospital_id, week, occupancy FROM fr"))
def _(spark, sf):
    return facility_ratios(spark, sf)


@query("prj10_zero_denominator", "hospital_id:i week:d ratio:f",
       sql("fw", "SELECT hospital_id, week, covid_census / nullif(icu_beds, 0) AS ratio FROM fw"))
def _(spark, sf):
    return facility_week(spark, sf).withColumn("ratio", cleaning.per(F.col("covid_census"), F.col("icu_beds")))


@query("prj11_unit_switch", "hospital_id:i week:d icu_occupancy:f", sql("fr", "SELECT hospital_id, week, icu_occupancy FROM fr"))
def _(spark, sf):
    return facility_ratios(spark, sf)


@query("prj12_complete_cases", "state:s n:i", sql("fr", """
SELECT state, count(*) AS n FROM fr WHERE occupancy IS NOT NULL AND icu_occupancy IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    rows = facility_ratios(spark, sf).withColumn("icu_occupancy", cleaning.finite(F.col("icu_occupancy")))
    return rows.dropna(subset=["occupancy", "icu_occupancy"]).groupBy("state").agg(F.count("*").alias("n"))


@query("prj13_digits", "code:s n:i", """
SELECT CASE WHEN length(nullif(regexp_extract(c_name, '(\\d+)', 1), '')) < 8 THEN lpad(regexp_extract(c_name, '(\\d+)', 1), 8, '0')
ELSE nullif(regexp_extract(c_name, '(\\d+)', 1), '') END AS code, count(*) AS n FROM customer GROUP BY 1""")
def _(spark, sf):
    return table(spark, sf, "customer").groupBy(cleaning.digits(F.col("c_name"), 8).alias("code")).agg(F.count("*").alias("n"))


@query("prj14_suffix_filter", "segment:s n:i", """
SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE NOT (lpad(CAST(c_custkey AS VARCHAR), 9, '0') LIKE '%99') GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "customer").where(~cleaning.digits(F.col("c_custkey"), 9).endswith("99"))
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("prj15_optional_column", "hospital_id:i subtype:s", "SELECT s_suppkey AS hospital_id, 'Unknown' AS subtype FROM supplier")
def _(spark, sf):
    fields = [conform.Field("hospital_id", ["s_suppkey"]), conform.Field("subtype", ["hospital_subtype"], required=False)]
    return conform.conform(table(spark, sf, "supplier"), fields).withColumn("subtype", F.coalesce("subtype", F.lit("Unknown")))


@query("prj16_calendar_labels", "day:d year:i month:s quarter:s monday:d n:i", """
SELECT CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS year, strftime(o_orderdate, '%Y-%m') AS month,
CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, count(*) AS n FROM orders GROUP BY ALL""")
def _(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").groupBy(day.alias("day")).agg(F.count("*").alias("n")).withColumns({
        "year": F.year("day"), "month": calendars.month_label(F.col("day")),
        "quarter": calendars.quarter_label(F.col("day")), "monday": calendars.monday(F.col("day")),
    })


@query("prj17_calendar_index", "hospital_id:i week:d index:f", sql("fw", """
SELECT hospital_id, week, date_diff('day', (SELECT min(week) FROM fw), week) / 7.0 AS "index" FROM fw""").replace('AS "index"', "AS index"))
def _(spark, sf):
    return calendar_index(facility_week(spark, sf), "week", "index")


WAVES = [("1995-01-01", "w1"), ("1996-06-01", "w2"), ("1998-03-01", "w3"), ("2000-01-01", "w4")]


@query("prj18_waves", "wave:s n:i", f"""
SELECT CASE {' '.join(f"WHEN o_orderdate < DATE '{d}' THEN '{w}'" for d, w in WAVES)} ELSE 'later' END AS wave, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    wave = calendars.period_label(F.col("o_orderdate").cast("date"), WAVES, "later")
    return table(spark, sf, "orders").groupBy(wave.alias("wave")).agg(F.count("*").alias("n"))


@query("prj19_sunday_snap", "sunday:d n:i", """
SELECT CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INT) AS sunday, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy(calendars.week_start_sunday(F.col("o_orderdate").cast("date")).alias("sunday")).agg(
        F.count("*").alias("n")
    )


@query("prj20_composite_key", "key:s n:i", """
SELECT o_orderstatus || '__' || o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    key = cleaning.composite_key(F.col("o_orderstatus"), F.col("o_orderpriority"))
    return table(spark, sf, "orders").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("prj21_log_change", "hospital_id:i week:d change:f change1:f", sql("fw", """
SELECT hospital_id, week, CASE WHEN occupied_beds > 0 AND staffed_beds > 0 THEN 100 * (ln(occupied_beds) - ln(staffed_beds)) END AS change,
CASE WHEN occupied_beds > 0 AND staffed_beds > 0 THEN ln(occupied_beds) - ln(staffed_beds) END AS change1 FROM fw"""))
def _(spark, sf):
    a, b = F.col("occupied_beds"), F.col("staffed_beds")
    return facility_week(spark, sf).withColumn("change", changes.log_change(a, b)).withColumn("change1", changes.log_change(a, b, 1.0))


@query("prj22_log1p_change", "hospital_id:i week:d change:f", sql("fw", """
SELECT hospital_id, week, 100 * (ln(1 + covid_census) - ln(1 + icu_beds)) AS change FROM fw"""))
def _(spark, sf):
    return facility_week(spark, sf).withColumn("change", changes.log1p_change(F.col("covid_census"), F.col("icu_beds")))


@query("prj23_percent_to_log", "hospital_id:i week:d change:f", sql("based", """
SELECT hospital_id, week, CASE WHEN level / nullif(bm, 0) > 0 THEN 100 * ln(1 + (100 * (level / nullif(bm, 0) - 1)) / 100) END AS change FROM based"""))
def _(spark, sf):
    from crestline.plans.panels import HOSPITAL_WEEK, signal_columns
    from dataclasses import replace

    rows = signal_columns(facility_week(spark, sf), ["hospital_id"], "week", "admissions", replace(HOSPITAL_WEEK, baseline_min=1))
    return rows.withColumn("change", changes.percent_to_log(F.col("rel_change") * 100))


@query("prj24_log_level", "hospital_id:i week:d level:f",
       sql("fw", "SELECT hospital_id, week, CASE WHEN covid_census > 0 THEN ln(covid_census) END AS level FROM fw"))
def _(spark, sf):
    return facility_week(spark, sf).withColumn("level", changes.log_level(F.col("covid_census")))


@query("prj25_fixed_base_change", "hospital_id:i week:d change:f", sql("fw", """
SELECT hospital_id, week, CASE WHEN icu_beds > 0 THEN (occupied_beds - covid_census) / icu_beds END AS change FROM fw"""))
def _(spark, sf):
    change = changes.fixed_base_change(F.col("occupied_beds"), F.col("covid_census"), F.col("icu_beds"))
    return facility_week(spark, sf).withColumn("change", change)


@query("prj26_one_hot", "orderkey:i status_F:f1 status_O:f1", """
SELECT o_orderkey AS orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS status_F,
CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS status_O FROM orders""")
def _(spark, sf):
    dummies = cleaning.one_hot(F.col("o_orderstatus"), ["F", "O"], "status")
    return table(spark, sf, "orders").withColumns(dummies).withColumnRenamed("o_orderkey", "orderkey")


@query("prj29_rare_levels", "level:s n:i", """
WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), m AS (SELECT avg(n) AS a FROM c)
SELECT CASE WHEN n >= 300 THEN p_type ELSE 'Other' END AS level, sum(n) AS n FROM c GROUP BY 1""")
def _(spark, sf):
    rows = collapse_rare(table(spark, sf, "part").select("p_type"), "p_type", 300)
    return rows.groupBy(F.col("p_type").alias("level")).agg(F.count("*").alias("n"))


@query("prj30_zscore", "hospital_id:i week:d z:f5 zs:f5", sql("fw", """
SELECT hospital_id, week, coalesce((staffed_beds - avg(staffed_beds) OVER ()) / nullif(stddev_samp(staffed_beds) OVER (), 0), 0) AS z,
coalesce((staffed_beds - avg(staffed_beds) OVER (PARTITION BY state)) / nullif(stddev_samp(staffed_beds) OVER (PARTITION BY state), 0), 0) AS zs FROM fw"""))
def _(spark, sf):
    rows = zscore(facility_week(spark, sf).select("hospital_id", "state", "week", "staffed_beds"), ["staffed_beds"], suffix="_g")
    return zscore(rows, ["staffed_beds"], ["state"]).select(
        "hospital_id", "week", F.col("staffed_beds_g").alias("z"), F.col("staffed_beds_z").alias("zs")
    )


@query("prj31_median_imputation", "hospital_id:i week:d icu:f", sql("fr", """
SELECT hospital_id, week, coalesce(icu_occupancy, (SELECT quantile_cont(icu_occupancy, 0.5) FROM fr)) AS icu FROM fr"""))
def _(spark, sf):
    rows = facility_ratios(spark, sf)
    return rows.withColumn("icu", F.coalesce("icu_occupancy", F.lit(quantile_value(rows, "icu_occupancy", 0.5))))


@query("prj32_category_imputation", "orderkey:i status:s", """
SELECT o_orderkey AS orderkey, coalesce(nullif(o_orderstatus, 'P'), 'Missing') AS status FROM orders""")
def _(spark, sf):
    status = F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("Missing"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), status.alias("status"))


@query("prj35_facility_name", "name:s n:i", r"""
SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower('St. ' || p_name || ' Hospital & University Medical Center'), '&', ' and ', 'g'),
'\buniversity\b', ' univ ', 'g'), '\bmedical center\b|\bhospital\b|[^a-z0-9]+', ' ', 'g')) AS name0,
trim(regexp_replace('st ' || lower(p_name) || ' hosp and univ med center', '\s+', ' ', 'g')) AS name, count(*) AS n FROM part GROUP BY 1, 2""")
def _(spark, sf):
    raw = F.concat(F.lit("St. "), F.col("p_name"), F.lit(" Hospital & University Medical Center"))
    return table(spark, sf, "part").groupBy(cleaning.facility_name(raw).alias("name")).agg(F.count("*").alias("n"))


@query("prj37_sign_label", "label:s n:i", """
SELECT CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal > 0 THEN 'positive' ELSE 'zero' END AS label, count(*) AS n FROM customer GROUP BY 1""")
def _(spark, sf):
    return table(spark, sf, "customer").groupBy(changes.sign_label(F.col("c_acctbal")).alias("label")).agg(F.count("*").alias("n"))


@query("prj39_select_rename", "id:i day:d price:f2", "SELECT o_orderkey AS id, o_orderdate AS day, o_totalprice AS price FROM orders")
def _(spark, sf):
    fields = [conform.Field("id", ["o_orderkey"]), conform.Field("day", ["o_orderdate"]), conform.Field("price", ["o_totalprice"])]
    return conform.conform(table(spark, sf, "orders"), fields)


@query("win8_keep_last", "custkey:i orderkey:i day:d", """
SELECT o_custkey AS custkey, max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS orderkey,
max(o_orderdate) AS day FROM orders GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderdate").alias("day"))
    return keep_last(rows, ["custkey"], [F.col("day"), F.col("orderkey")])
