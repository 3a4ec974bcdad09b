"""Blocked name matching, nearest controls and stacked cohorts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from crestline.functions.cleaning import facility_name
from crestline.operators.joins import window_join
from crestline.operators.quantiles import exact_quantiles
from crestline.session import cut_lineage

#: Stretches of letters that are searched side by side.
STRETCHES = 4096
#: Candidates that a task sorts into leaves.
ROWS_OF_TASK = 500_000
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate "  # fixed value: letters from rare to common in English


def common_letters(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Letters in matching blocks of each pair, for many pairs at once.

    The longest common run of letters is a block (the earliest on the left, then on the right), and
    so on in what lies before it on both sides and after it on both sides.  All open stretches of
    all pairs are one array: a step extends every run that ends at a letter of the left by one.
    """
    total = np.zeros(len(left), np.int64)
    if not len(left):
        return total
    letters = [_padded(side, pad) for side, pad in ((left, -1), (right, -2))]
    spans = np.array([(k, 0, len(a), 0, len(b)) for k, (a, b) in enumerate(zip(left, right, strict=True)) if a and b], np.int64).reshape(-1, 5)
    while len(spans):
        spans = spans[np.argsort(spans[:, 2] - spans[:, 1], kind="stable")]
        found = [_longest_runs(letters, spans[first : first + STRETCHES]) for first in range(0, len(spans), STRETCHES)]
        size, i, j = (np.concatenate(v) for v in zip(*found, strict=True))
        spans, size, i, j = spans[size > 0], size[size > 0], i[size > 0], j[size > 0]
        np.add.at(total, spans[:, 0], size)
        pair, a0, a1, b0, b1 = spans.T
        spans = np.concatenate([np.column_stack([pair, a0, i, b0, j]), np.column_stack([pair, i + size, a1, j + size, b1])])
        spans = spans[(spans[:, 1] < spans[:, 2]) & (spans[:, 3] < spans[:, 4])]
    return total


def _padded(texts: Sequence[str], pad: int) -> np.ndarray:
    out = np.full((len(texts), max(1, max(map(len, texts)))), pad, np.int64)
    for k, text in enumerate(texts):
        out[k, : len(text)] = [ord(c) for c in text]
    return out


def _longest_runs(letters: list[np.ndarray], spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and both starts of the longest common run of each stretch."""
    pair, a0, a1, b0, b1 = spans.T
    here = np.arange(int((b1 - b0).max()))
    at = b0[:, None] + here
    b = np.where(at < b1[:, None], letters[1][pair[:, None], np.minimum(at, letters[1].shape[1] - 1)], -2)
    run, best = np.zeros((len(spans), len(here) + 1), np.int64), np.zeros((3, len(spans)), np.int64)
    for step in range(int((a1 - a0).max())):
        a = np.where(a0 + step < a1, letters[0][pair, np.minimum(a0 + step, letters[0].shape[1] - 1)], -1)
        run[:, 1:] = np.where(b == a[:, None], run[:, :-1] + 1, 0)
        end = run.argmax(axis=1)
        size = run[np.arange(len(run)), end]
        longer = size > best[0]
        best[:, longer] = np.stack([size, a0 + step + 1 - size, b0 + end - size])[:, longer]
    return best[0], best[1], best[2]


@F.pandas_udf(DoubleType())
def block_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """0-100: twice the letters in matching blocks over all letters, worked out for a batch of pairs at once."""
    both = a.str.len() + b.str.len()
    return (200.0 * common_letters(a.tolist(), b.tolist()) / both.where(both > 0, 1)).where(both > 0, 100.0)


def token_set_score(a: Column, b: Column) -> Column:
    """0-100: best block score among the sorted token strings and what they have in common.

    Token sets are compared in the JVM.  Only pairs of names that differ are scored, and the common
    part only where its length lets it beat the whole names.
    """
    common = F.array_join(F.array_intersect(F.split(a, " "), F.split(b, " ")), " ")
    whole = F.when(a == b, 100.0).when((a == "") | (b == ""), 0.0).otherwise(block_score(a, b))
    share = lambda s: F.when((common != "") & (a != b), block_score(common, s)).otherwise(0.0)
    return F.greatest(whole, share(a), share(b))


def edit_score(a: Column, b: Column) -> Column:
    """0-100 from the edit distance of the sorted token strings, inside the JVM."""
    return 100.0 * (1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def edit_set_score(a: Column, b: Column) -> Column:
    """0-100: best edit score among the sorted token strings and their common part, inside the JVM."""
    common = F.array_join(F.array_intersect(F.split(a, " "), F.split(b, " ")), " ")
    partial = F.when(common != "", F.greatest(edit_score(common, a), edit_score(common, b))).otherwise(0.0)
    return F.greatest(edit_score(a, b), partial)


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.trim(name), r"\s+"))), " ")


def letter_bag(text: Column) -> Column:
    """Letters numbered by occurrence, so the bag is a set, in a fixed order: rare first.

    ``aab`` gives ``b1 a2 a1``: bags share as many elements as the strings share letters.
    """
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    numbered = F.transform(
        F.sequence(F.lit(1), F.size(chars)),
        lambda i: F.struct(
            (-F.size(F.filter(F.slice(chars, 1, i), lambda x: x == F.element_at(chars, i)))).alias("a"),
            F.instr(F.lit(RARE_FIRST), F.element_at(chars, i)).alias("b"),
            F.element_at(chars, i).alias("c"),
        ),
    )
    ordered = F.array_sort(F.when(F.size(chars) > 0, numbered))
    return F.coalesce(
        F.transform(ordered, lambda e: F.concat(e["c"], (-e["a"]).cast("string"))), F.array().cast("array<string>")
    )


def candidate_pairs(left: DataFrame, right: DataFrame, block: str, threshold: float) -> DataFrame:
    """Pairs of one block whose score can reach ``threshold`` (0-1), found by an index.

    A score of at least t on strings of length m and n needs common letters of at least
    ``phi * m`` or ``phi * n`` with ``phi = t / (2 - t)``.  A side can then miss at most
    ``m - phi * m`` letters, so among its first ``m - ceil(phi * m) + 1`` letters in the fixed
    order one is shared.  Both sides look their prefix up in the other's letters; a pair is
    emitted at its first common prefix letter only, and the letter bound is checked in full
    before any string comparison.  No pair that can reach the threshold is lost.
    """
    phi = threshold / (2.0 - threshold)

    def prepared(names: DataFrame, side: str) -> DataFrame:
        n = F.size(f"{side}_bag")
        keep = F.greatest(n - F.ceil(n * F.lit(phi) - 1e-9) + 1, F.lit(0)).cast("int")
        return cut_lineage(names.withColumn(f"{side}_pre", F.slice(f"{side}_bag", 1, keep)))

    def lookup(probe: DataFrame, index: DataFrame, p: str, q: str) -> DataFrame:
        postings = probe.withColumn("_e", F.explode(f"{p}_pre"))
        whole = index.withColumn("_e", F.explode(f"{q}_bag"))
        pairs = postings.join(whole, [block, "_e"])
        first = F.get(F.array_intersect(f"{p}_pre", f"{q}_bag"), F.lit(0))
        return pairs.where(first == F.col("_e")).drop("_e")

    left, right = prepared(left, "l"), prepared(right, "r")
    common = F.size(F.array_intersect("l_bag", "r_bag"))
    by_left = common >= F.lit(phi) * F.size("l_bag") - 1e-9
    by_right = common >= F.lit(phi) * F.size("r_bag") - 1e-9
    forward = lookup(left, right, "l", "r").where(by_left)
    backward = lookup(right, left, "r", "l").where(by_right & ~by_left)
    return forward.unionByName(backward)


def match_names(
    left: DataFrame,
    right: DataFrame,
    block: str,
    left_id: str,
    right_id: str,
    name: str,
    city: str | None = None,
    min_score: float = 85.0,
    min_gap: float = 3.0,
    city_bonus: float = 2.0,
    scorer: str = "token_set",
    thresholds: Sequence[float] = (80.0, 60.0, 40.0),
) -> DataFrame:
    """Best right-hand name per left row with score, runner-up, gap, the match's city and the decision.

    Names must be normalised; cities are normalised here before they earn the bonus.  The search
    falls through ``thresholds``: a name with two candidates at or above one has its exact top two
    and leaves, the others go on, and what is left after the last is compared with its whole block.
    So every row of a block with names gets its best match, however poor.  Equal names of a block
    are compared once; several holders of the best name are a tie.
    """
    place = F.coalesce(F.col(city), F.lit("")) if city else F.lit("")
    l_names = left.select(block, F.col(name).alias("l_name"), facility_name(place).alias("l_city"), F.col(left_id).alias("_lid"))
    l_keys = l_names.select(block, "l_name", "l_city").distinct()
    r_keys = right.select(block, F.col(name).alias("r_name"), place.alias("_place"), F.col(right_id).alias("_id")).groupBy(
        block, "r_name", facility_name(F.col("_place")).alias("r_city")
    ).agg(F.min("_id").alias("_rid"), F.min_by("_place", "_id").alias("_place"), F.count("*").alias("_holders"))
    open_ = l_keys.withColumn("l_sorted", sorted_tokens(F.col("l_name"))).withColumn("l_bag", letter_bag(F.col("l_sorted")))
    r_ready = r_keys.withColumn("r_sorted", sorted_tokens(F.col("r_name"))).withColumn("r_bag", letter_bag(F.col("r_sorted")))
    bonus = F.when((F.col("l_city") != "") & (F.col("l_city") == F.col("r_city")), F.lit(city_bonus)).otherwise(0.0)
    key = [block, "l_name", "l_city"]
    order = Window.partitionBy(*key).orderBy(F.desc("_score"), "_rid")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def top_two(pairs: DataFrame, least: float) -> DataFrame:
        if scorer == "token_set":
            # scoring is heavy per pair while pairs are short: spread them by left name, not by bytes
            pairs, base = pairs.repartition(tasks, *key), token_set_score(F.col("l_sorted"), F.col("r_sorted"))
        else:
            base = (edit_set_score if scorer == "edit_set" else edit_score)(F.col("l_sorted"), F.col("r_sorted"))
        scored = pairs.withColumn("_score", base)
        if city:
            scored = scored.withColumn("_score", F.least(F.lit(100.0), F.col("_score") + bonus))
        ranked = scored.where(F.col("_score") >= least).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= 2)
        return cut_lineage(ranked.select(*key, "r_name", "_rid", "_place", "_holders", "_score", "_k"))

    tops = []
    for t in thresholds:
        pairs = candidate_pairs(open_, r_ready, block, max(t - (city_bonus if city else 0.0), 0.0) / 100.0)
        found = top_two(pairs, t)
        decided = found.groupBy(*key).agg(F.count("*").alias("_n"), F.max(F.when(F.col("_k") == 1, F.col("_holders"))).alias("_h")).where("_n = 2 OR _h > 1").select(key)
        tops.append(found.join(decided, key, "left_semi"))
        open_ = open_.join(decided, key, "left_anti")
    tops.append(top_two(open_.join(r_ready, block), 0.0))
    top = reduce(DataFrame.unionByName, tops)
    best, runner = F.col("_k") == 1, F.col("_k") == 2
    found = top.groupBy(*key).agg(
        F.max(F.when(best, F.col("_rid"))).alias("matched_id"),
        F.max(F.when(best, F.col("r_name"))).alias("matched_name"),
        F.max(F.when(best, F.col("_place"))).alias("matched_city"),
        F.max(F.when(best, F.col("_score"))).alias("score"),
        F.max(F.when(best & (F.col("_holders") > 1), F.col("_score")).when(runner, F.col("_score"))).alias("second_score"),
    )
    gap = F.col("score") - F.col("second_score")
    ok = (F.col("score") >= min_score) & F.coalesce(gap >= min_gap, F.lit(True))
    return (
        l_names.join(found, key, "left")
        .withColumn("score_gap", gap)
        .withColumn("match_ok", F.coalesce(ok, F.lit(False)))
        .withColumn(
            "reason",
            F.when(F.col("match_ok"), "accepted").when(F.col("score").isNull(), "no names in block").otherwise("manual review required"),
        )
        .select(F.col("_lid").alias(left_id), block, F.col("l_name").alias(name), "matched_id", "matched_name", "matched_city",
                "score", "second_score", "score_gap", "match_ok", "reason")
    )


def pre_features(starts: DataFrame, panel: DataFrame, block: str, entity: str, start: str, week: str,
                 levels: dict[str, bool], first_week: int = -4, last_week: int = -1) -> DataFrame:
    """Features of every entity of a block before each start week: mean of each level column and,
    where asked, its slope.  Start weeks per block are bounded by the calendar."""
    rows = window_join(starts, panel, [block], start, week, 7 * first_week, 7 * last_week, spread=True)
    x = (F.datediff(week, start) / F.lit(7.0)).alias("x")
    aggs = [F.count_distinct(week).alias("pre_weeks")]
    for c, slope in levels.items():
        aggs.append(F.avg(c).alias(f"{c}_mean"))
        if slope:
            aggs.append(F.regr_slope(F.col(c), F.when(F.col(c).isNotNull(), x)).alias(f"{c}_slope"))
    return rows.groupBy(block, start, entity).agg(*aggs)


def _median_with(x: Column, axis: str) -> Column:
    """Median of a pool and one more value, from the pool's median and its nearest values.

    Of n values, ``lt`` and ``gt`` lie below and above the median ``mid``, ``lo`` and ``hi`` are the
    nearest of these; one more value moves the middle by at most one place.
    """
    n, mid, lt, gt, lo, hi, eq = (F.col(f"{axis}_{c}") for c in ("n", "mid", "lt", "gt", "lo", "hi", "eq"))
    half = F.floor(n / 2)
    # even: the two middle values, equal to mid where mid is a value with room on that side
    left = F.when(lt == half, lo).otherwise(mid)
    right = F.when(gt == half, hi).otherwise(mid)
    even = F.greatest(left, F.least(right, x))
    odd = F.when(x <= mid, (F.greatest(left, x) + mid) / 2).otherwise((F.least(right, x) + mid) / 2)
    odd = F.when(n == 1, (x + mid) / 2).otherwise(odd)
    return F.when(x.isNull(), mid).when(n.isNull(), x).otherwise(F.when(n % 2 == 0, even).otherwise(odd))


def candidate_leaves(candidates: DataFrame, pool_key: Sequence[str], control: str, axes: Sequence[str], k: int, leaf: int) -> DataFrame:
    """Leaves of a pool, ``leaf`` candidates at most, with the box over all axes (``_lo_``, ``_hi_``, ``_no_`` for missing values) and
    the ``_points``.

    Of candidates of a pool that agree in every axis only the first ``k`` are kept.  Leaves are runs of equal length along one
    axis after the other.
    """
    pool_key = list(pool_key)
    rows = candidates.select(*pool_key, control, *axes)
    tasks = -(-rows.count() // ROWS_OF_TASK)
    dealt = (lambda df: df.repartition(tasks, *pool_key)) if tasks > 1 else (lambda df: df)
    alike = Window.partitionBy(*pool_key, *axes).orderBy(control)
    apart = cut_lineage(dealt(rows).withColumn("_k", F.row_number().over(alike)).where(F.col("_k") <= k).drop("_k"))
    placed = dealt(apart.join(apart.groupBy(*pool_key).agg(F.count("*").alias("_run")), pool_key)).withColumn("_leaf", F.lit(0).cast("long"))
    for i, a in enumerate(axes):
        parts = F.greatest(F.ceil(F.pow(F.col("_run") / F.lit(leaf), F.lit(1.0 / (len(axes) - i)))), F.lit(1))
        place = F.row_number().over(Window.partitionBy(*pool_key, "_leaf").orderBy(a, control)) - 1
        placed = placed.withColumns({"_parts": parts, "_place": place}).withColumn("_run", F.ceil(F.col("_run") / F.col("_parts")))
        placed = placed.withColumn("_leaf", F.col("_leaf") * F.col("_parts") + F.floor(F.col("_place") / F.col("_run"))).drop("_parts", "_place")
    boxes = [x for a in axes for x in (F.min(a).alias(f"_lo_{a}"), F.max(a).alias(f"_hi_{a}"), F.count_if(F.col(a).isNull()).alias(f"_no_{a}"))]
    return cut_lineage(placed.groupBy(*pool_key, "_leaf").agg(F.count("*").alias("_size"), *boxes, F.collect_list(F.struct(control, *axes)).alias("_points")))


def nearest_controls(
    cohorts: DataFrame,
    features: DataFrame,
    treated: DataFrame,
    block: str,
    entity: str,
    start: str,
    cohort: str,
    axes: Sequence[str],
    optional_axes: Sequence[str] = (),
    needed: Sequence[str] = (),
    optional_gate: str | None = None,
    k: int = 3,
    min_weeks: int = 3,
    leaf: int = 32,
) -> DataFrame:
    """``(cohort, control, distance)``: the k never-treated entities nearest to the treated one.

    Distances are Euclidean over features scaled by the deviation of candidates and treated
    unit together; missing features take the median of candidates and treated unit together.
    Candidates need all of ``needed`` (by default every axis that is not a slope).  A pool's
    candidates lie in leaves of ``leaf`` at most, split over all axes; the leaf nearest to the treated
    unit gives an upper bound, and only leaves whose box is within it are compared, each giving its k
    nearest, so that no task holds the pairs.  Exact.
    """
    axes, optional_axes = list(axes), list(optional_axes)
    every = axes + optional_axes
    needed = list(needed or [a for a in axes if not a.endswith("_slope")])
    if axes[0] not in needed:
        raise ValueError("the first axis must be needed: treated units have it")
    pool_key = [block, start]
    usable = features.where(F.col("pre_weeks") >= min_weeks)
    candidates = usable.join(treated.select(entity).distinct(), entity, "left_anti").dropna(subset=needed)
    cells = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("x")) for a in every])
    values = cut_lineage(candidates.select(*pool_key, F.inline(cells)).where(F.col("x").isNotNull()))
    spot = [*pool_key, "axis"]
    middle = exact_quantiles(values, "x", [0.5], spot).select(*spot, F.col("quantile").alias("_mid"))
    below, above = F.col("x") < F.col("_mid"), F.col("x") > F.col("_mid")
    near = values.join(middle, spot).groupBy(*spot).agg(
        F.count("*").alias("n"), F.first("_mid").alias("mid"), F.count_if(below).alias("lt"), F.count_if(above).alias("gt"),
        F.max(F.when(below, F.col("x"))).alias("lo"), F.min(F.when(above, F.col("x"))).alias("hi"), F.count_if(F.col("x") == F.col("_mid")).alias("eq"))
    around_middle = near.groupBy(*pool_key).pivot("axis", every).agg(*[F.first(c).alias(c) for c in ("n", "mid", "lt", "gt", "lo", "hi", "eq")])
    around_middle = cut_lineage(around_middle)
    gate = optional_gate or (optional_axes[0] if optional_axes else axes[0])
    observed = candidates.groupBy(*pool_key).agg(F.count(gate).alias("_gate"), F.count("*").alias("_all"))
    moments = candidates.groupBy(*pool_key).agg(
        *[x for a in every for x in (F.count(a).alias(f"_n_{a}"), F.avg(a).alias(f"_m_{a}"), F.var_pop(a).alias(f"_v_{a}"))]
    )
    own = usable.where(F.col(axes[0]).isNotNull())
    probe = (
        cohorts.join(own, [block, start, entity])
        .withColumn("_gate_ok", F.col(gate).isNotNull())
        .join(around_middle, pool_key).join(moments, pool_key).join(observed, pool_key)
    )
    weights = {}
    for a in every:
        fill = _median_with(F.col(a), a)
        x, n, m, v = F.coalesce(F.col(a), fill), F.col(f"_n_{a}"), F.col(f"_m_{a}"), F.col(f"_v_{a}")
        all_, missing = F.col("_all"), F.col("_all") - F.col(f"_n_{a}")
        # the pool once its missing values are filled, then the treated unit beside it
        m = F.coalesce((n * m + missing * fill) / all_, fill)
        v = (n * F.coalesce(v, F.lit(0.0)) + n * (F.coalesce(F.col(f"_m_{a}"), fill) - m) ** 2 + missing * (fill - m) ** 2) / all_
        ss = all_ * v + all_ / (all_ + 1) * (x - m) * (x - m)
        scale = F.when(ss / all_ > 1e-24, F.lit(1.0) / F.sqrt(ss / all_))
        if a in optional_axes:
            scale = F.when(F.col("_gate_ok") & (F.col("_gate") >= 5), scale)
        weights[f"_w_{a}"] = F.coalesce(scale, F.lit(0.0))
        weights[f"_t_{a}"] = x
        weights[f"_f_{a}"] = fill
    probe = cut_lineage(probe.withColumns(weights).select(cohort, *pool_key, F.col(entity).alias("_treated"), *weights))
    leaves = candidate_leaves(candidates.withColumnRenamed(entity, "control"), pool_key, "control", every, k, leaf)
    outside = [  # least distance of the leaf's box along each axis; a leaf with a missing value may hold the median
        F.coalesce(F.when(F.col(f"_no_{a}") == 0, F.col(f"_w_{a}") * F.greatest(F.col(f"_lo_{a}") - F.col(f"_t_{a}"), F.col(f"_t_{a}") - F.col(f"_hi_{a}"), F.lit(0.0))) ** 2, F.lit(0.0))
        for a in every
    ]
    apart_by = F.sqrt(sum(outside[1:], outside[0]))

    def distance(point: Column) -> Column:
        # an axis that neither side has weighs nothing; a missing value is the joint median
        squares = [F.coalesce((F.col(f"_w_{a}") * (F.coalesce(point[a], F.col(f"_f_{a}")) - F.col(f"_t_{a}"))) ** 2, F.lit(0.0)) for a in every]
        return F.sqrt(sum(squares[1:], squares[0]))

    closest = F.slice(F.array_sort(F.transform("_points", lambda p: F.struct(distance(p).alias("distance"), p["control"].alias("control")))), 1, k)
    first = probe.join(leaves.where(F.col("_size") >= k).drop("_points"), pool_key).groupBy(cohort, *pool_key).agg(F.min_by("_leaf", apart_by).alias("_leaf"))
    bound = probe.join(first, [cohort, *pool_key]).join(leaves.select(*pool_key, "_leaf", "_points"), [*pool_key, "_leaf"]).select(
        cohort, (closest[k - 1]["distance"] * (1 + 1e-9) + 1e-12).alias("_bound"))
    near = probe.join(cut_lineage(bound), cohort, "left").join(leaves, pool_key).where(F.col("_bound").isNull() | (apart_by <= F.col("_bound")))
    pairs = near.select(cohort, *pool_key, "_bound", F.inline(closest)).where(F.col("_bound").isNull() | (F.col("distance") <= F.col("_bound")))
    order = Window.partitionBy(cohort).orderBy("distance", "control")
    return pairs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).select(cohort, *pool_key, "control", "distance")


def matched_cohorts(cohorts: DataFrame, controls: DataFrame, cohort: str, block: str, entity: str, start: str) -> DataFrame:
    """Treated and control rows ``(cohort, block, start, entity, treated, distance)`` of cohorts with controls."""
    pairs = controls.select(
        cohort, block, start, F.col("control").alias(entity), F.lit(0).alias("treated"), "distance"
    )
    heads = cohorts.join(controls.select(cohort).distinct(), cohort, "left_semi").select(
        cohort, block, start, entity, F.lit(1).alias("treated"), F.lit(0.0).alias("distance")
    )
    return heads.unionByName(pairs)


def stacked_panel(matches: DataFrame, panel: DataFrame, entity: str, start: str, week: str, weeks: int = 6) -> DataFrame:
    """Weeks around the start for every matched row; an entity recurs once per cohort."""
    rows = window_join(matches, panel, [entity], start, week, -7 * weeks, 7 * weeks)
    return rows.withColumn("event_week", F.round(F.datediff(week, start) / F.lit(7.0)).cast("int"))
