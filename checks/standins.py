"""The panels of the domain, derived from the provided tables by aggregation over all rows.

Raw tables are reduced to panel grain by combining aggregates before any join, so a supplier
or nation with much of the data never travels as raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crestline.plans.panels import hospital_surges, with_ratios


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def week_of(column: str):
    return F.date_trunc("week", column).cast("date")


def facility_week(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier-weeks as facility-weeks."""
    q = F.col("l_quantity")
    kept = F.col("l_returnflag") != "R"
    open_ = F.col("l_linestatus") == "O"
    part = lambda cond: F.sum(F.when(cond, q).otherwise(0.0))
    weeks = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("hospital_id"), week_of("l_shipdate").alias("week")
    ).agg(
        F.count("*").cast("double").alias("admissions"), F.sum(q).alias("staffed_beds"),
        part(kept).alias("occupied_beds"), part(F.col("l_returnflag") == "A").alias("covid_census"),
        part(open_).alias("icu_beds"), part(open_ & kept).alias("icu_occupied"),
        F.max("l_linestatus").alias("subtype"),
    )
    place = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("hospital_id"), F.col("s_nationkey").cast("string").alias("state")
    )
    return weeks.join(place, "hospital_id")


def facility_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return with_ratios(facility_week(spark, sf))


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    return hospital_surges(facility_week(spark, sf))


def orders_by_nation(spark: SparkSession, sf: str, day) -> DataFrame:
    """Orders summed per customer and day first, then per nation."""
    per_customer = table(spark, sf, "orders").groupBy("o_custkey", day.alias("day")).agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total")
    )
    nation = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("state")
    )
    return per_customer.join(nation, "o_custkey").groupBy("state", "day").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )


def policy_day(spark: SparkSession, sf: str) -> DataFrame:
    days = orders_by_nation(spark, sf, F.col("o_orderdate").cast("date"))
    return days.select("state", F.col("day").alias("date"), (F.col("total") / F.col("n") / 9973).alias("response_index"))


def excess_week(spark: SparkSession, sf: str) -> DataFrame:
    weeks = orders_by_nation(spark, sf, week_of("o_orderdate"))
    return weeks.select("state", F.col("day").alias("week_ending_date"), (F.col("total") / 99991).alias("excess_deaths"))


def region_day(spark: SparkSession, sf: str) -> DataFrame:
    """Nation-days as state-days."""
    q, open_ = F.col("l_quantity"), F.col("l_linestatus") == "O"
    per_supplier = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum(q).alias("q"), F.sum(F.when(open_, q).otherwise(0.0)).alias("qo"), F.count("*").alias("n"),
        F.count_if(F.col("l_returnflag") == "R").alias("nr"),
    )
    place = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("state")
    )
    return per_supplier.join(place, "l_suppkey").groupBy("state", "date").agg(
        F.sum("q").alias("covid_admissions"), F.sum("qo").alias("covid_icu_patients"),
        F.sum("q").alias("icu_beds_total"), (F.sum("nr") / F.sum("n")).alias("hospitals_staffing_shortage"),
    )


def population(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("county_fips")).agg(
        F.count("*").cast("double").alias("population")
    )


def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("county_fips"), F.col("n_regionkey").cast("string").alias("area_id")
    )


def county_week(spark: SparkSession, sf: str, suppress_below: int = 2) -> DataFrame:
    """Nation-weeks as county-weeks; small counts are suppressed.  The area serves as its state."""
    weeks = orders_by_nation(spark, sf, week_of("o_orderdate")).select(
        F.col("state").alias("county_fips"), F.col("day").alias("week_end"),
        F.when(F.col("n") >= suppress_below, F.col("n").cast("double")).alias("deaths"),
    )
    return weeks.join(crosswalk(spark, sf).withColumnRenamed("area_id", "state"), "county_fips")


# --- the same panels as SQL -------------------------------------------------------------------

CTES = {
    "fw": ("", """SELECT l_suppkey AS hospital_id, CAST(s_nationkey AS VARCHAR) AS state,
        CAST(date_trunc('week', l_shipdate) AS DATE) AS week, CAST(count(*) AS DOUBLE) AS admissions,
        sum(l_quantity) AS staffed_beds,
        sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS occupied_beds,
        sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS covid_census,
        sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS icu_beds,
        sum(CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS icu_occupied,
        max(l_linestatus) AS subtype
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3"""),
    "q95": ("fw", "SELECT quantile_cont(icu_occupied, 0.95) AS q FROM fw"),
    "fr": ("fw q95", """SELECT fw.*, CASE WHEN staffed_beds > 0 AND occupied_beds / staffed_beds BETWEEN 0 AND 2
        THEN occupied_beds / staffed_beds END AS occupancy,
        CASE WHEN (CASE WHEN q <= 1.5 THEN icu_occupied ELSE icu_occupied / nullif(icu_beds, 0) END) BETWEEN 0 AND 2
        THEN (CASE WHEN q <= 1.5 THEN icu_occupied ELSE icu_occupied / nullif(icu_beds, 0) END) END AS icu_occupancy
        FROM fw, q95"""),
    "based": ("fw", """SELECT hospital_id, state, week, admissions AS level, count(admissions) OVER w AS bn,
        median(admissions) OVER w AS bm FROM fw WINDOW w AS (PARTITION BY hospital_id ORDER BY week
        RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"""),
    "cand": ("based", """SELECT hospital_id, state, week, level, bm AS baseline, level / nullif(bm, 0) - 1 AS rel_change
        FROM based WHERE bn >= 3 AND level >= 5 AND level / nullif(bm, 0) - 1 >= 0.5"""),
    "chain": ("cand", """SELECT hospital_id, min(week) AS week, 1 AS episode_no FROM cand GROUP BY 1 UNION ALL
        SELECT hospital_id, (SELECT min(c.week) FROM cand c WHERE c.hospital_id = chain.hospital_id
        AND c.week >= chain.week + 42), episode_no + 1 FROM chain WHERE week IS NOT NULL"""),
    "epi": ("cand chain", """SELECT c.hospital_id, c.state, c.week AS signal_week, episode_no, c.level AS signal_admissions,
        c.rel_change AS signal_rel_change, c.baseline AS baseline_admissions
        FROM chain JOIN cand c USING (hospital_id, week)"""),
    "ew": ("epi fr", """SELECT e.hospital_id, e.state, e.signal_week, f.week,
        CAST(round(date_diff('day', e.signal_week, f.week) / 7.0) AS INT) AS event_week,
        f.admissions, f.staffed_beds, f.occupied_beds, f.covid_census, f.icu_beds, f.icu_occupied, f.subtype,
        f.occupancy, f.icu_occupancy FROM epi e JOIN fr f ON e.hospital_id = f.hospital_id
        AND f.week BETWEEN e.signal_week - 28 AND e.signal_week + 42"""),
    "nation_day": ("", """SELECT CAST(c_nationkey AS VARCHAR) AS state, CAST(o_orderdate AS DATE) AS date,
        avg(o_totalprice) / 9973 AS response_index FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""),
    "excess": ("", """SELECT CAST(c_nationkey AS VARCHAR) AS state, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_ending_date,
        sum(o_totalprice) / 99991 AS excess_deaths, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""),
    "rday": ("", """SELECT CAST(s_nationkey AS VARCHAR) AS state, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS covid_admissions,
        sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS covid_icu_patients, sum(l_quantity) AS icu_beds_total,
        avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS hospitals_staffing_shortage
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""),
    "pop": ("", "SELECT CAST(c_nationkey AS VARCHAR) AS county_fips, CAST(count(*) AS DOUBLE) AS population FROM customer GROUP BY 1"),
    "xwalk": ("", "SELECT CAST(n_nationkey AS VARCHAR) AS county_fips, CAST(n_regionkey AS VARCHAR) AS area_id FROM nation"),
    "cweek": ("excess xwalk", """SELECT e.state AS county_fips, week_ending_date AS week_end,
        CASE WHEN n >= 2 THEN CAST(n AS DOUBLE) END AS deaths, x.area_id AS state
        FROM excess e JOIN xwalk x ON e.state = x.county_fips"""),
}


def sql(names: str, body: str, extra: dict[str, tuple[str, str]] | None = None) -> str:
    """``body`` preceded by the named table expressions and what they depend on."""
    known = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in known[name][0].split():
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    if not ordered:
        return body
    clauses = [
        f"{n}{'(hospital_id, week, episode_no)' if n == 'chain' else ''} AS {'' if n == 'chain' else 'MATERIALIZED '}({known[n][1]})"
        for n in ordered
    ]
    return "WITH RECURSIVE " + ",\n".join(clauses) + "\n" + body
