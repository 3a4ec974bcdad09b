"""Composite panels: surges, quality, event windows, bridges and area outcomes.

Names used throughout: ``hospital_id`` (entity), ``state`` (cluster), ``week``, ``signal_week``
and the measures ``admissions``, ``staffed_beds``, ``occupied_beds``, ``covid_census``,
``icu_beds``, ``icu_occupied``, ``subtype``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from crestline.functions.calendars import month_label, period_label, quarter_label
from crestline.functions.changes import fixed_base_change, log1p_change, log_change, per_100k, percent_to_log
from crestline.functions.cleaning import bounded_ratio, composite_key, lookup
from crestline.functions.places import REGION_OF_STATE
from crestline.operators.aggregates import (
    mean_in_weeks, mode_in_weeks, sd_in_weeks, slope_in_weeks, weighted_mean, weighted_median_day,
)
from crestline.operators.episodes import assign_sessions, spaced_episodes
from crestline.operators.expectation import left_out_linear, left_out_linear_imputed
from crestline.operators.joins import asof_last, first_rise_after, salted_band_aggregate, window_join
from crestline.operators.quantiles import quantile_value
from crestline.operators.windows import calendar_index, relative_change, rolling_mean, trailing_median
from crestline.session import cut_lineage

DAY = 86400
PRE = (-4, -3, -2)
POST = (2, 3, 4)
EPISODE = ["hospital_id", "state", "signal_week"]


@dataclass(frozen=True)
class SurgeRule:
    """When a value counts as a surge signal."""

    smooth_rows: int | None
    smooth_min: int
    baseline: int
    baseline_min: int
    by_days: bool
    min_level: float
    min_rise: float
    min_gap_days: int


# The state-day and the hospital-week rule.
STATE_DAY = SurgeRule(7, 4, 28, 14, False, 25.0, 0.5, 42)
HOSPITAL_WEEK = SurgeRule(None, 0, 28, 3, True, 5.0, 0.5, 42)


def signal_columns(panel: DataFrame, keys: Sequence[str], day: str, value: str, rule: SurgeRule) -> DataFrame:
    """Panel with ``level``, ``baseline`` and ``rel_change``: one exchange by entity."""
    level = F.col(value) if rule.smooth_rows is None else rolling_mean(keys, day, value, rule.smooth_rows, rule.smooth_min)
    with_level = panel.withColumn("level", level)
    base = trailing_median(keys, day, "level", rule.baseline, rule.baseline_min, rule.by_days)
    return with_level.withColumn("baseline", base).withColumn(
        "rel_change", relative_change(F.col("level"), F.col("baseline"))
    )


def detect_surges(panel: DataFrame, keys: Sequence[str], day: str, value: str, rule: SurgeRule,
                  carry: Sequence[str] = ()) -> DataFrame:
    """``(keys, episode_no, day, level, rel_change, baseline)`` of the spaced surge signals."""
    candidates = signal_columns(panel, keys, day, value, rule).where(
        (F.col("rel_change") >= rule.min_rise) & (F.col("level") >= rule.min_level)
    )
    return spaced_episodes(candidates, keys, day, rule.min_gap_days, carry=[*carry, "level", "rel_change", "baseline"])


def hospital_surges(facility_week: DataFrame, rule: SurgeRule = HOSPITAL_WEEK) -> DataFrame:
    found = detect_surges(facility_week, ["hospital_id"], "week", "admissions", rule, carry=["state"])
    return found.select(
        "hospital_id", "state", F.col("week").alias("signal_week"), "episode_no",
        F.col("level").alias("signal_admissions"), F.col("rel_change").alias("signal_rel_change"),
        F.col("baseline").alias("baseline_admissions"),
    )


def response_latency(signals: DataFrame, policy: DataFrame, key: str = "state", day: str = "signal_date",
                     search_days: int = 21, rise: float = 5.0) -> DataFrame:
    """Baseline index at the signal, first escalation after it, latency, censoring flag."""
    based = asof_last(signals, policy, [key], day, "date", "response_index", "baseline_response_index", cell_seconds=None)
    return first_rise_after(
        based, policy, [key], [key, day], day, "date", "response_index", "baseline_response_index", search_days, rise
    )


def state_surge_outcomes(region_day: DataFrame, policy_day: DataFrame, excess_week: DataFrame,
                         rule: SurgeRule = STATE_DAY) -> DataFrame:
    """State-day surges with response latency and the outcomes of the following weeks."""
    signals = detect_surges(region_day, ["state"], "date", "covid_admissions", rule).select(
        "state", F.col("episode_no").alias("episode_id"), F.col("date").alias("signal_date"),
        F.col("level").alias("signal_admissions_7dma"), F.col("rel_change").alias("signal_rel_change"),
    )
    episodes = response_latency(signals, policy_day)
    key = ["state", "signal_date"]
    probe = episodes.select(*key)
    deaths = window_join(probe, excess_week, ["state"], "signal_date", "week_ending_date", 7, 35).groupBy(*key).agg(
        F.sum("excess_deaths").alias("excess_deaths_next_28d")
    )
    share = F.col("covid_icu_patients") / F.nullif(F.col("icu_beds_total"), F.lit(0.0))
    stay = window_join(probe, region_day, ["state"], "signal_date", "date", 1, 28).groupBy(*key).agg(
        F.sum("covid_admissions").alias("covid_admissions_next_28d"),
        F.max(share).alias("max_icu_covid_share_next_28d"),
        F.avg("hospitals_staffing_shortage").alias("mean_staffing_shortage_next_28d"),
    )
    return (
        episodes.join(deaths, key, "left").join(stay, key, "left")
        .withColumn("signal_month", month_label(F.col("signal_date")))
        .withColumn("signal_year", F.year("signal_date"))
    )


def with_ratios(facility_week: DataFrame) -> DataFrame:
    """Occupancy and ICU occupancy; the ICU field is a ratio already if its 95th percentile says so."""
    q95 = quantile_value(facility_week, "icu_occupied", 0.95)
    is_ratio = q95 is not None and q95 <= 1.5
    icu = F.col("icu_occupied") if is_ratio else F.try_divide(F.col("icu_occupied"), F.col("icu_beds"))
    return facility_week.withColumn(
        "occupancy", bounded_ratio(F.col("occupied_beds"), F.col("staffed_beds"))
    ).withColumn("_icu", icu).withColumn(
        "icu_occupancy", F.when(F.col("_icu").between(0.0, 2.0), F.col("_icu"))
    ).drop("_icu")


def episode_weeks(episodes: DataFrame, facility_week: DataFrame, first: int = -4, last: int = 4) -> DataFrame:
    """Facility weeks around each episode with their ``event_week``.

    Both sides and the later ``groupBy`` on the episode share the exchange by hospital.
    """
    panel = facility_week.drop("state")
    rows = window_join(episodes, panel, ["hospital_id"], "signal_week", "week", 7 * first, 7 * last)
    return rows.withColumn("event_week", F.round(F.datediff("week", "signal_week") / F.lit(7.0)).cast("int"))


def target_trial(episodes: DataFrame, facility_week: DataFrame, by_week_count: bool = False,
                 ratio_of_means: bool = False) -> DataFrame:
    """Pre-period features and occupancy change per episode with two observed weeks on each side."""
    rows = episode_weeks(episodes.select(*EPISODE), facility_week)
    pre, post = F.col("event_week").isin(*PRE), F.col("event_week").isin(*POST)
    week = lambda c: F.when(c, F.col("week"))
    count = (lambda c: F.count_distinct(week(c))) if by_week_count else (lambda c: F.count(week(c)))
    level = lambda weeks: (
        F.try_divide(mean_in_weeks("occupied_beds", weeks), mean_in_weeks("staffed_beds", weeks))
        if ratio_of_means else mean_in_weeks("occupancy", weeks)
    )
    wide = rows.groupBy(*EPISODE).agg(
        count(pre).alias("_pre"), count(post).alias("_post"),
        level(PRE).alias("occupancy_pre_mean"), level(POST).alias("_post_mean"),
        slope_in_weeks("occupancy", PRE).alias("occupancy_pre_slope"),
        sd_in_weeks("occupancy", PRE).alias("occupancy_pre_volatility"),
        mean_in_weeks("occupancy", [-2]).alias("occupancy_week_m2"),
        mean_in_weeks("admissions", PRE).alias("admissions_pre_mean"),
        slope_in_weeks("admissions", PRE).alias("admissions_pre_slope"),
        mean_in_weeks("staffed_beds", PRE).alias("staffed_beds_pre_mean"),
        mean_in_weeks("icu_occupancy", PRE).alias("icu_pre_mean"),
        slope_in_weeks("icu_occupancy", PRE).alias("icu_pre_slope"),
        mode_in_weeks("subtype", PRE).alias("hospital_subtype"),
    )
    return (
        wide.where((F.col("_pre") >= 2) & (F.col("_post") >= 2))
        .withColumn("delta_occupancy", F.col("_post_mean") - F.col("occupancy_pre_mean"))
        .where(F.col("delta_occupancy").isNotNull())
        .withColumn("region", lookup(F.col("state"), REGION_OF_STATE, F.lit("Unknown")))
        .withColumn("signal_quarter", quarter_label(F.col("signal_week")))
        .withColumn("wave", period_label(F.col("signal_week")))
        .drop("_pre", "_post", "_post_mean")
    )


def quality_audit(episodes: DataFrame, facility_week: DataFrame, capacity: str = "staffed_beds",
                  demand: str = "covid_census", min_coverage: float = 4.0,
                  coverage: Sequence[str] = ()) -> DataFrame:
    """Good weeks, baselines and two-week persistence per episode; episodes without weeks keep NULLs."""
    rows = episode_weeks(episodes.select(*EPISODE), facility_week)
    good = F.col(capacity).isNotNull() & F.col(demand).isNotNull()
    for c in coverage:
        good = good & F.coalesce(F.col(c) >= min_coverage, F.lit(False))
    in_base = F.col("event_week").between(-4, -1) & good
    at = lambda k, c: F.max(F.when((F.col("event_week") == k) & good, F.col(c)))
    median = lambda c: F.percentile(F.when(in_base, F.col(c)), F.lit(0.5))
    wide = rows.groupBy(*EPISODE).agg(
        F.count_if(in_base).alias("n_baseline_good_weeks"),
        F.count_if(F.col("event_week").isin(1, 2) & good).alias("n_post_good_weeks"),
        median(capacity).alias("_bcap"), median(demand).alias("_bdem"),
        at(1, capacity).alias("_c1"), at(2, capacity).alias("_c2"),
        at(1, demand).alias("_d1"), at(2, demand).alias("_d2"),
    )
    enough = F.col("n_baseline_good_weeks") >= 3
    both = F.col("_c1").isNotNull() & F.col("_c2").isNotNull() & (F.col("n_post_good_weeks") == 2)
    bcap, bdem = F.col("baseline_capacity_quality"), F.col("baseline_demand_quality")
    audit = (
        wide.withColumn("baseline_capacity_quality", F.when(enough, F.col("_bcap")))
        .withColumn("baseline_demand_quality", F.when(enough, F.col("_bdem")))
        .withColumn("capacity_week1", F.when(both & (bcap > 0), F.col("_c1")))
        .withColumn("capacity_week2", F.when(both & (bcap > 0), F.col("_c2")))
        .withColumn("persistent_capacity_ok", F.coalesce(
            F.abs(F.col("capacity_week2") - F.col("capacity_week1")) <= F.greatest(bcap, F.lit(50.0)), F.lit(False)
        ))
        .withColumn("sustained_capacity_change_w1_2_pp",
                    ((F.col("capacity_week1") + F.col("capacity_week2")) / 2 / F.when(bcap > 0, bcap) - 1) * 100)
        .withColumn("sustained_demand_change_w1_2_pp",
                    F.when(both, ((F.col("_d1") + F.col("_d2")) / 2 / F.when(bdem > 0, bdem) - 1) * 100))
        .withColumn("objective_quality_ok", F.coalesce(
            enough & both & (bcap > 0) & (bdem > 0) & F.col("persistent_capacity_ok"), F.lit(False)
        ))
        .drop("_bcap", "_bdem", "_c1", "_c2", "_d1", "_d2")
    )
    return episodes.join(audit, EPISODE, "left")


def event_time_panel(episodes: DataFrame, facility_week: DataFrame, carry: Sequence[str] = (),
                     first: int = -4, last: int = 6) -> DataFrame:
    """Long panel (episode, event week) with occupancy and the episode's own columns."""
    rows = episode_weeks(episodes.select(*EPISODE, *carry), facility_week, first, last)
    return rows.select(
        composite_key(F.col("hospital_id").cast("string"), F.col("signal_week").cast("string")).alias("episode_id"),
        *EPISODE, *carry, "event_week", F.col("week").alias("calendar_week"), "occupancy",
    )


def pretrend_features(event_time: DataFrame, weeks: Sequence[int] = PRE, value: str = "occupancy") -> DataFrame:
    """Weekly levels before and after the signal in wide form, with slope, spread and change."""
    wide = event_time.groupBy(*EPISODE).pivot("event_week", list(range(-4, 7))).agg(F.avg(value))
    names = {w: f"{value}_{'m' if w < 0 else 'p'}{abs(w)}" for w in range(-4, 7)}
    wide = wide.select(*EPISODE, *[F.col(f"`{w}`").alias(n) for w, n in names.items()])
    mean = lambda ws: F.aggregate(
        F.filter(F.array(*[F.col(names[w]) for w in ws]), lambda x: x.isNotNull()),
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["n"] + 1).alias("n")),
        lambda acc: F.try_divide(acc["s"], acc["n"]),
    )
    spread = event_time.groupBy(*EPISODE).agg(sd_in_weeks(value, weeks).alias("pre_sd"))
    return (
        wide.join(spread, EPISODE)
        .withColumn("pre_mean", mean(weeks))
        .withColumn("post_mean", mean(POST))
        .withColumn("pre_slope", (F.col(names[weeks[-1]]) - F.col(names[weeks[0]])) / F.lit(float(weeks[-1] - weeks[0])))
        .withColumn("delta", F.col("post_mean") - F.col("pre_mean"))
    )


def early_mediators(episodes: DataFrame, facility_week: DataFrame, early: Sequence[int] = (1, 2)) -> DataFrame:
    """Log change of beds and ICU beds from the pre period to the first weeks after the signal."""
    rows = episode_weeks(episodes.select(*EPISODE), facility_week)
    wide = rows.groupBy(*EPISODE).agg(*[
        mean_in_weeks(c, weeks).alias(f"_{tag}_{c}")
        for tag, weeks in (("pre", PRE), ("early", early)) for c in ("staffed_beds", "icu_beds")
    ])
    change = lambda c: log_change(F.col(f"_early_{c}"), F.col(f"_pre_{c}"), 1.0)
    return wide.select(
        *EPISODE, change("staffed_beds").alias("early_log_bed_change"), change("icu_beds").alias("early_log_icu_bed_change")
    )


def lagged_outcomes(episodes: DataFrame, facility_week: DataFrame,
                    windows: dict[str, Sequence[int]] | None = None) -> DataFrame:
    """Ratio, fixed-capacity and log outcomes for several post windows, one ``groupBy`` for all."""
    windows = windows or {"w2_4": POST}
    last = max(max(w) for w in windows.values())
    rows = episode_weeks(episodes.select(*EPISODE), facility_week, -4, last)
    measures = ("staffed_beds", "occupied_beds", "covid_census")
    wide = rows.groupBy(*EPISODE).agg(*[
        mean_in_weeks(c, weeks).alias(f"_{tag}_{c}") for tag, weeks in {"pre": PRE, **windows}.items() for c in measures
    ], *[
        F.count_distinct(F.when(F.col("event_week").isin(*weeks), F.col("week"))).alias(f"{tag}_weeks")
        for tag, weeks in {"pre": PRE, **windows}.items()
    ])
    v = lambda tag, c: F.col(f"_{tag}_{c}")
    ratio = lambda tag: F.when(v(tag, "staffed_beds") > 0, v(tag, "occupied_beds") / v(tag, "staffed_beds"))
    out: dict[str, Column] = {}
    for tag in windows:
        base = v("pre", "staffed_beds")
        out[f"{tag}_occupancy_ratio_change"] = ratio(tag) - ratio("pre")
        out[f"{tag}_fixed_occupied_burden"] = fixed_base_change(v(tag, "occupied_beds"), v("pre", "occupied_beds"), base)
        out[f"{tag}_log_occupied_change"] = log_change(v(tag, "occupied_beds"), v("pre", "occupied_beds"))
        out[f"{tag}_fixed_covid_census"] = fixed_base_change(v(tag, "covid_census"), v("pre", "covid_census"), base)
        out[f"{tag}_log1p_covid_change"] = log1p_change(v(tag, "covid_census"), v("pre", "covid_census"))
    weeks = [f"{tag}_weeks" for tag in ("pre", *windows)]
    return wide.select(*EPISODE, *weeks, *[c.alias(n) for n, c in out.items()])


def log_responses(quality: DataFrame, placebo_pct: str | None = None) -> DataFrame:
    """Post (and, from a placebo percentage, pre) log capacity change of quality episodes."""
    post = (F.col("capacity_week1") + F.col("capacity_week2")) / 2
    out = quality.withColumn("post_log_capacity_change", log_change(post, F.col("baseline_capacity_quality")))
    if placebo_pct:
        out = out.withColumn("pre_log_capacity_change", percent_to_log(F.col(placebo_pct)))
    return out


def response_innovation(
    panel: DataFrame, post: str, pre: str, post_predictors: Sequence[str], pre_predictors: Sequence[str],
    factors: Sequence[str] = ("signal_quarter",), cluster: str = "state", out: str = "response_innovation",
    min_train: int = 100,
) -> DataFrame:
    """Post change beyond expectation minus pre change beyond expectation, expectations from the
    other clusters only."""
    p = left_out_linear(panel, post, post_predictors, factors, cluster, f"expected_{post}", min_train)
    q = left_out_linear(p, pre, pre_predictors, factors, cluster, f"expected_{pre}", min_train)
    return (
        q.withColumn(f"{post}_residual", F.col(post) - F.col(f"expected_{post}"))
        .withColumn(f"{pre}_residual", F.col(pre) - F.col(f"expected_{pre}"))
        .withColumn(out, F.col(f"{post}_residual") - F.col(f"{pre}_residual"))
    )


def preonly_innovation(panel: DataFrame, pre: str, predictors: Sequence[str], factors: Sequence[str] = ("signal_quarter",),
                       cluster: str = "state", out: str = "preonly_innovation") -> DataFrame:
    """Pre change beyond its expectation, with imputed predictors."""
    fitted = left_out_linear_imputed(panel, pre, predictors, factors, cluster, f"expected_{pre}")
    return fitted.withColumn(out, F.col(pre) - F.col(f"expected_{pre}"))


def cluster_bridge(cluster_episodes: DataFrame, hospital_episodes: DataFrame, post: str, pre: str, weight: str,
                   half_width: int = 14) -> DataFrame:
    """Capacity-weighted hospital responses around each cluster episode; unmatched episodes kept."""
    use = hospital_episodes.dropna(subset=[post, pre, weight]).select(
        "state", "hospital_id", F.col("signal_week").alias("_week"), post, pre, weight
    )
    w = F.when(F.col(weight) > 0, F.col(weight))
    sums = {
        "state_hospital_episode_count": F.lit(1),
        "state_capacity_weight": F.col(weight),
        "_w": w, "_wpost": w * F.col(post), "_wpre": w * F.col(pre),
        "_upost": F.col(post), "_upre": F.col(pre),
    }
    out = salted_band_aggregate(
        cluster_episodes, use, ["state"], ["state", "signal_date"], "signal_date", "_week", half_width,
        "hospital_id", sums, "state_hospital_count",
    )
    return out.withColumns({
        "state_post_response": F.try_divide(F.col("_wpost"), F.col("_w")),
        "state_pre_response": F.try_divide(F.col("_wpre"), F.col("_w")),
        "state_response_innovation": F.try_divide(F.col("_wpost") - F.col("_wpre"), F.col("_w")),
        "state_unweighted_innovation": (F.col("_upost") - F.col("_upre")) / F.col("state_hospital_episode_count"),
    }).drop("_w", "_wpost", "_wpre", "_upost", "_upre")


def area_week(county_week: DataFrame, population: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Area-week counts, population and the share of population whose counts are not suppressed."""
    joined = county_week.join(population, "county_fips", "left").join(crosswalk, "county_fips", "left")
    observed = F.when(F.col("deaths").isNotNull(), F.col("population")).otherwise(F.lit(0.0))
    weekly = joined.where(F.col("area_id").isNotNull()).groupBy("area_id", "state", "week_end").agg(
        F.sum("deaths").alias("deaths"), F.sum(observed).alias("observed_population")
    )
    totals = crosswalk.join(population, "county_fips", "left").groupBy("area_id").agg(F.sum("population").alias("population"))
    return weekly.join(totals, "area_id", "left").withColumn(
        "population_coverage", F.try_divide("observed_population", "population")
    )


def area_episodes(hospital_episodes: DataFrame, post: str, pre: str, weight: str, gap_days: int = 21) -> DataFrame:
    """Hospital episodes of an area merged while gaps stay within the limit, capacity weighted."""
    use = cut_lineage(hospital_episodes.dropna(subset=["area_id", "signal_week", post, pre, weight]))
    numbered = assign_sessions(use, ["area_id", "state"], "signal_week", gap_days * DAY)
    key = ["area_id", "state", "session_no"]
    summary = numbered.groupBy(*key).agg(
        F.count("*").alias("hospital_episode_count"),
        F.count_distinct("hospital_id").alias("hospital_count"),
        F.sum(weight).alias("represented_capacity"),
        weighted_mean(post, weight).alias("area_post_response"),
        weighted_mean(pre, weight).alias("area_pre_response"),
        weighted_mean("signal_admissions", weight).alias("signal_admissions_weighted"),
    )
    middle = weighted_median_day(numbered, key, "signal_week", weight, "signal_date")
    return (
        summary.join(middle, key, "left")
        .withColumn("area_response_innovation", F.col("area_post_response") - F.col("area_pre_response"))
        .withColumnRenamed("session_no", "area_episode_no")
    )


def area_mortality(episodes: DataFrame, area_weeks: DataFrame, windows: dict[str, tuple[int, int]] | None = None,
                   min_coverage: float = 0.8) -> DataFrame:
    """Deaths per 100,000 in windows after the signal, where enough of the population is observed."""
    windows = windows or {"14_42": (14, 42), "21_49": (21, 49)}
    lo, hi = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    key = ["area_id", "state", "area_episode_no"]
    weeks = area_weeks.select("area_id", "state", "week_end", "deaths", "population_coverage")
    rows = window_join(episodes.select(*key, "signal_date"), weeks, ["area_id", "state"], "signal_date", "week_end", lo, hi)
    days = F.datediff("week_end", "signal_date")
    aggs = []
    for tag, (a, b) in windows.items():
        inside = days.between(a, b)
        aggs += [
            F.sum(F.when(inside, F.col("deaths"))).alias(f"_deaths_{tag}"),
            F.avg(F.when(inside, F.col("population_coverage"))).alias(f"coverage_{tag}"),
            F.count_if(inside).alias(f"_weeks_{tag}"),
        ]
    totals = area_weeks.groupBy("area_id").agg(F.max("population").alias("population"))
    out = episodes.join(totals, "area_id", "left").join(rows.groupBy(*key).agg(*aggs), key, "left")
    for tag in windows:
        rate = F.when(F.col(f"coverage_{tag}") >= min_coverage, per_100k(F.col(f"_deaths_{tag}"), F.col("population")))
        out = out.withColumn(f"deaths_{tag}_per100k", rate).withColumn(
            f"weeks_{tag}", F.coalesce(F.col(f"_weeks_{tag}"), F.lit(0))
        ).drop(f"_deaths_{tag}", f"_weeks_{tag}")
    return out


def label_episodes(episodes: DataFrame, day: str) -> DataFrame:
    """Month, quarter, wave and calendar index of the signal day."""
    labelled = episodes.withColumns({
        "signal_month": month_label(F.col(day)), "signal_quarter": quarter_label(F.col(day)), "wave": period_label(F.col(day)),
    })
    return calendar_index(labelled, day, "calendar_week_index")
