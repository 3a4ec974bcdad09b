"""Event-window, as-of, first-after and band joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crestline.session import cut_lineage


def window_join(
    events: DataFrame,
    panel: DataFrame,
    keys: Sequence[str],
    event_day: str,
    panel_day: str,
    from_day: int,
    to_day: int,
    spread: bool = False,
) -> DataFrame:
    """Panel rows whose day lies in ``[event + from_day, event + to_day]`` of the same key.

    Plain form: equality on the keys, range as residual.  With a panel per entity both sides
    and every later ``groupBy`` by entity share one exchange.

    ``spread=True`` also joins on a time bucket as wide as the window.  A panel row falls in
    one bucket and an event touches at most two, so a key that holds much of the data (a state,
    a busy user) is split over its buckets and no pair is met twice.
    """
    lo = F.date_add(F.col(event_day), from_day)
    hi = F.date_add(F.col(event_day), to_day)
    inside = F.col(panel_day).between(lo, hi)
    if not spread:
        return events.join(panel, list(keys)).where(inside)
    width = to_day - from_day + 1
    touched = F.sequence(F.floor(F.unix_date(lo) / width), F.floor(F.unix_date(hi) / width))
    left = events.withColumn("_bucket", F.explode(touched))
    right = panel.withColumn("_bucket", F.floor(F.unix_date(panel_day) / width))
    return left.join(right, [*keys, "_bucket"]).where(inside).drop("_bucket")


def salted_band_aggregate(
    events: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    event_id: Sequence[str],
    event_day: str,
    row_day: str,
    half_width: int,
    unit: str,
    sums: dict[str, Column],
    unit_count: str,
    salts: int = 16,
) -> DataFrame:
    """Sums and a distinct count of ``unit`` over rows within ``half_width`` days of each event.

    Rows carry a salt from the hash of ``unit``; the few events are repeated per salt.  A state
    with a third of all rows is spread over salts and time buckets.  All rows of one unit share
    a salt, so distinct counts per salt add up exactly.  Events without rows are kept.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(unit), F.lit(salts)).cast("int"))
    probe = events.select(*dict.fromkeys([*event_id, *keys, event_day])).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    pairs = window_join(
        probe, salted, [*keys, "_salt"], event_day, row_day, -half_width, half_width, spread=True
    )
    partial = pairs.groupBy(*event_id, "_salt").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], F.count_distinct(unit).alias(unit_count)
    )
    total = partial.groupBy(*event_id).agg(*[F.sum(c).alias(c) for c in [*sums, unit_count]])
    return events.join(total, list(event_id), "left")


def asof_last(
    probes: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    probe_time: str,
    history_time: str,
    value: str,
    out: str,
    cell_seconds: int | None = 30 * 86400,
    shared_times: bool = False,
) -> DataFrame:
    """Last non-NULL value at or before each probe: union and one running window, no pairs.

    ``shared_times`` is for probes of which many have the same key and time: the window then sees
    each (key, time) once, and an equi join, which AQE can split, brings the value to the rows.

    The window runs per (key, time cell), so a key with much of the data is split by time; each
    cell starts from the last value of earlier cells, carried over a table with one row per key
    and non-empty cell.  ``cell_seconds=None`` runs per key: for probes and histories that are
    both panels, with a bounded number of rows per key.
    """
    if shared_times:
        at = [*keys, probe_time]
        found = asof_last(probes.select(*at).distinct(), history, keys, probe_time, history_time, value, out, cell_seconds)
        return probes.join(found, at, "left").select(*probes.columns, out)
    columns = probes.columns
    seen = history.where(F.col(value).isNotNull())
    p = probes.select(
        *keys,
        F.col(probe_time).cast("timestamp").alias("_t"),
        F.lit(1).alias("_probe"),
        F.lit(None).cast(history.schema[value].dataType).alias("_v"),
        F.struct(*columns).alias("_row"),
    )
    h = seen.select(
        *keys,
        F.col(history_time).cast("timestamp").alias("_t"),
        F.lit(0).alias("_probe"),
        F.col(value).alias("_v"),
        F.lit(None).cast(p.schema["_row"].dataType).alias("_row"),
    )
    mixed = p.unionByName(h)
    by = list(keys)
    if cell_seconds is not None:
        cell = F.floor(F.unix_timestamp("_t") / cell_seconds)
        mixed = mixed.withColumn("_cell", cell)
        last = mixed.groupBy(*keys, "_cell").agg(
            F.max_by("_v", F.when(F.col("_probe") == 0, F.col("_t"))).alias("_v")
        )
        before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            last.withColumn("_v", F.last("_v", ignorenulls=True).over(before))
            .where(F.col("_v").isNotNull())
            .select(*keys, F.lit(None).cast("timestamp").alias("_t"), F.lit(0).alias("_probe"), "_v",
                    F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), "_cell")
        )
        mixed = mixed.unionByName(carried)
        by = [*keys, "_cell"]
    w = (
        Window.partitionBy(*by)
        .orderBy(F.col("_t").asc_nulls_first(), "_probe")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        mixed.withColumn(out, F.last("_v", ignorenulls=True).over(w))
        .where(F.col("_probe") == 1)
        .select("_row.*", out)
    )


def first_rise_after(
    events: DataFrame,
    panel: DataFrame,
    keys: Sequence[str],
    event_id: Sequence[str],
    event_day: str,
    panel_day: str,
    value: str,
    baseline: str,
    search_days: int,
    rise: float,
) -> DataFrame:
    """First day within the search span on which the value is ``rise`` above the baseline.

    Events with no observed value in the span, or no baseline, drop out; events without a rise
    are censored at ``search_days + 1`` with ``detected = 0``.
    """
    events = cut_lineage(events)
    pairs = window_join(
        events.where(F.col(baseline).isNotNull()),
        panel.where(F.col(value).isNotNull()),
        keys, event_day, panel_day, 0, search_days, spread=True,
    )
    rose = F.col(value) - F.col(baseline) >= rise
    found = pairs.groupBy(*event_id).agg(F.min(F.when(rose, F.col(panel_day))).alias("response_date"))
    latency = F.datediff("response_date", event_day)
    return (
        events.join(found, list(event_id))
        .withColumn("detected", F.col("response_date").isNotNull().cast("int"))
        .withColumn("latency_days", F.coalesce(latency, F.lit(search_days + 1)))
    )


def week_scaffold(df: DataFrame, week: str, first: int, last: int, reference: int, zero: Sequence[str]) -> DataFrame:
    """All event weeks in order; listed columns are 0 in the reference week, which has no row."""
    weeks = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last))).alias(week)
    )
    filled = {c: F.when(F.col(week) == reference, F.lit(0.0)).otherwise(F.col(c)) for c in zero}
    return weeks.join(df, week, "left").withColumns(filled)
