"""Grouped summaries: loading bins, ratio profiles, lag grids, coverage and scores."""

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import InverterParameters
from ..functions import clock
from ..functions.binning import cut, floor_bin
from ..functions.errors import Pair
from ..functions.values import beside, count_if, finite, holds, is_finite, ratio
from .align import _tag, offset_block
from .histograms import grouped_quantiles
from .ordered import islands, with_quantiles
from .rank_pairs import rank_correlations

INF = float("inf")
# Fixed bin edges.
LOADING_EDGES = [-INF, 0, .05, .1, .25, .5, .75, .9, .95, 1, 1.05, 1.1, 1.15, 1.2, INF]
DC_LOADING_EDGES = [0, .01, .05, .1, .25, .5, .75, .9, 1, 1.05, 1.1, 1.2, 1.5, 2, INF]
TEMP_CELL_EDGES = [-20, 10, 20, 30, 40, 50, 60, 70, 90]
AMBIENT_EDGES = [-20, 0, 10, 20, 30, 40, 50]
WIND_EDGES = [0, .5, 1, 2, 3, 4, 6, 10, 30]
POA_EDGES = [0, 300, 400, 500, 600, 700, 800, 1000, 1500]
AOI_EDGES = [0, 20, 30, 40, 50, 60, 70, 80, 90, 180]
AC_FRACTION_EDGES = [0, .2, .4, .6, .8, .9, 1, 2, 5]
DC_FRACTION_EDGES = [0, .2, .4, .6, .8, .9, 1, 2]


def loading_summary(df: DataFrame, expected: str, measured: str, paco: float, basis: str, groups=()) -> DataFrame:
    """Fourteen loading bins plus the unavailable one: counts and paired medians."""
    if basis not in ("expected", "measured"):
        raise ValueError("basis must be 'expected' or 'measured'")
    e, m = finite(expected), finite(measured)
    both = e.isNotNull() & m.isNotNull()
    level = (e if basis == "expected" else m) / paco
    rows = df.select(*groups, cut(level, LOADING_EDGES, "unavailable_loading").alias("loading_bin"),
                     F.when(both, e).alias("__e"), F.when(both, m).alias("__m"), F.when(both, m - e).alias("__d"),
                     F.when(both & (e > 0), m / F.when(e > 0, e)).alias("__q"))
    keys = [*groups, "loading_bin"]
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_samples"), F.count("__d").alias("valid_pairs"),
        (F.count(F.lit(1)) - F.count("__d")).alias("excluded_pairs"), F.count("__q").alias("valid_ratio_count"))
    out = with_quantiles(base, rows, keys, {
        "median_measured": ("__m", .5), "median_expected": ("__e", .5), "median_residual": ("__d", .5), "median_ratio": ("__q", .5)})
    return out.withColumn("loading_basis", F.lit(basis))


def upper_region(df: DataFrame, value: str, unit: str, paco: float, width: float = 100.0, minimum_repeats: int = 12,
                 cadence: int = 300, ts: str = "ts") -> DataFrame:
    """High-end profile per device: percentiles, dominant band, repeated band, longest run in the band."""
    v = finite(value)
    rows = df.select(unit, ts, v.alias("__v"))
    base = rows.groupBy(unit).agg(
        F.count(F.lit(1)).alias("total_samples"), F.count("__v").alias("finite_samples"),
        count_if(F.col("__v") > 0).alias("positive_samples"), count_if(F.col("__v") > paco).alias("above_rating"),
        F.max("__v").alias("maximum"))
    base = base.withColumn("fraction_above", F.when(F.col("finite_samples") > 0, F.col("above_rating") / F.col("finite_samples")))
    base = base.withColumn("fraction_above_positive",
                           F.when(F.col("positive_samples") > 0, F.col("above_rating") / F.col("positive_samples")))
    base = with_quantiles(base, rows, [unit], {"p95": ("__v", .95), "p99": ("__v", .99), "p999": ("__v", .999)})
    bands = rows.where(F.col("__v") >= paco).groupBy(unit, floor_bin("__v", width).alias("band")).agg(F.count(F.lit(1)).alias("c"))
    best = bands.groupBy(unit).agg(
        F.max_by("band", F.struct("c", -F.col("band"))).alias("dominant_band"), F.max("c").alias("dominant_count"),
        F.max(F.when(F.col("c") >= minimum_repeats, F.col("band"))).alias("highest_repeated_band"))
    inside = rows.join(best.select(unit, "dominant_band"), unit).where(
        (F.col("__v") >= F.col("dominant_band")) & (F.col("__v") < F.col("dominant_band") + width))
    runs = islands(inside.withColumn("sec", clock.seconds(ts)), [unit], "sec", cadence)
    longest = runs.groupBy(unit).agg(F.max("samples").alias("longest_run"))
    out = base.join(best, unit, "left").join(longest, unit, "left")
    zero = F.lit(0).cast("long")
    return out.withColumn("dominant_count", F.coalesce("dominant_count", zero)).withColumn(
        "longest_run", F.coalesce("longest_run", zero))


def dc_loading_summary(table: DataFrame, pdco: float, groups=()) -> DataFrame:
    """Conversion by DC loading: medians, efficiency spread, ratio above one, errors."""
    rows = table.where("conversion_analysis_mask").withColumn(
        "dc_loading_bin", cut(F.col("measured_dc_power") / pdco, DC_LOADING_EDGES)).where(F.col("dc_loading_bin").isNotNull())
    keys = [*groups, "dc_loading_bin"]
    p = Pair("sandia_ac_from_measured_dc", "measured_ac_power")
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.count("efficiency").alias("efficiency_valid_count"),
        count_if(F.col("ac_dc_power_ratio") > 1).alias("ratio_gt_1_count"), p.count().alias("valid_pairs"),
        p.mae().alias("mae"), p.rmse().alias("rmse"), p.mbe().alias("mbe"))
    return with_quantiles(base, rows, keys, {
        "median_dc": ("measured_dc_power", .5), "median_ac": ("measured_ac_power", .5),
        "median_sandia": ("sandia_ac_from_measured_dc", .5), "efficiency_p10": ("efficiency", .1),
        "median_efficiency": ("efficiency", .5), "efficiency_p90": ("efficiency", .9),
        "median_ratio": ("ac_dc_power_ratio", .5), "median_residual": ("residual_ac_power", .5)})


def conversion_metrics(table: DataFrame, masks: dict, groups=()) -> DataFrame:
    """Conversion error per population."""
    from .validation import population_metrics
    return population_metrics(table, "sandia_ac_from_measured_dc", "measured_ac_power", masks, groups)


def below_rating(q: InverterParameters, guard: float = 0.9) -> Column:
    return (F.col("conversion_analysis_mask") & (F.col("measured_dc_power") < guard * q.pdco)
            & (F.col("measured_ac_power") < guard * q.paco))


def device_efficiency(table: DataFrame, unit: str) -> DataFrame:
    rows = table.where("conversion_analysis_mask")
    base = rows.groupBy(unit).agg(
        F.count(F.lit(1)).alias("records"), count_if(F.col("ac_dc_power_ratio") > 1).alias("ratio_gt_1_count"),
        F.min("efficiency").alias("efficiency_min"), F.max("efficiency").alias("efficiency_max"))
    return with_quantiles(base, rows, [unit], {
        "ratio_median": ("ac_dc_power_ratio", .5), "efficiency_p10": ("efficiency", .1),
        "efficiency_median": ("efficiency", .5), "efficiency_p90": ("efficiency", .9)})


def device_coverage(table: DataFrame, unit: str) -> DataFrame:
    mask, day = F.col("conversion_analysis_mask"), F.col("positive_day_qc")
    return table.groupBy(unit).agg(
        F.count(F.lit(1)).alias("total_rows"), count_if(is_finite("measured_dc_power")).alias("finite_dc_power"),
        count_if(day).alias("positive_day_qc"), count_if(mask).alias("above_power_floors"),
        count_if(day & ~mask).alias("excluded_low_power"))


def device_bands(table: DataFrame, unit: str, bands: dict) -> DataFrame:
    """Medians of a few AC bands ``name -> (low, high)`` per device."""
    a = F.col("measured_ac_power")
    label = None
    for n, (lo, hi) in bands.items():
        cond = (a >= lo) & (a < hi)
        label = F.when(cond, n) if label is None else label.when(cond, n)
    rows = table.where("conversion_analysis_mask").withColumn("ac_band", label).where(F.col("ac_band").isNotNull())
    keys = [unit, "ac_band"]
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"),
                                   count_if(F.col("ac_dc_power_ratio") > 1).alias("ratio_gt_1_count"))
    return with_quantiles(base, rows, keys, {
        "median_dc": ("measured_dc_power", .5), "median_ac": ("measured_ac_power", .5),
        "median_ratio": ("ac_dc_power_ratio", .5), "median_residual": ("residual_ac_power", .5)})


def ratio_profiles(df: DataFrame, dimensions: dict, ratios, probabilities=(.1, .5, .9)) -> DataFrame:
    """Ratio quantiles over many one-dimensional groupings at once.

    ``dimensions`` maps name -> label column. No row is repeated for a dimension: see
    :func:`grouped_quantiles`, which runs one job when this is called.
    """
    found = grouped_quantiles(df, dimensions, ratios, probabilities)
    of = lambda r, c: F.max(F.when(F.col("measure") == r, F.col(c)))
    cols = [x for r in ratios for x in (of(r, "finite").alias(f"{r}_finite"), (F.max("total") - of(r, "finite")).alias(f"{r}_excluded"))]
    cols += [of(r, f"q{i}").alias(f"{r}_p{round(p * 100)}") for r in ratios for i, p in enumerate(probabilities)]
    return found.groupBy("dimension", "bin").agg(F.max("total").alias("total"), *cols)


def stratified_medians(df: DataFrame, keys, values) -> DataFrame:
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))
    return with_quantiles(base, df, list(keys), {f"{v}_median": (v, .5) for v in values})


def describe(df: DataFrame, columns, probabilities=(.1, .25, .5, .75, .9)) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles, one row per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("quantity"), finite(c).alias("v")) for c in columns])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*")
    base = rows.groupBy("quantity").agg(F.count("v").alias("records"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                        F.min("v").alias("minimum"), F.max("v").alias("maximum"))
    return with_quantiles(base, rows, ["quantity"], {f"p{round(p * 100)}": ("v", p) for p in probabilities})


def spearman(df: DataFrame, phase: str, quantities, variables) -> DataFrame:
    """Rank correlation per phase ('all' and each phase), quantity and variable.

    Runs jobs (see :func:`rank_correlations`): rows are read once, kept packed on disk while the
    pairs follow one another, and nothing is left on disk in the end.
    """
    quantities, variables = list(quantities), list(variables)
    rows = df.select(F.col(phase).cast("string").alias("scope"), *[finite(c).cast("double").alias(f"__c{i}") for i, c in enumerate(quantities + variables)])
    sizes, found = rank_correlations(rows, len(quantities))
    out = []
    for scope, total in sizes.items():
        for (i, j), told in found.items():
            valid, correlation = told[scope]
            if total:
                out.append(("all" if scope is None else scope, quantities[i], variables[j], total, valid, total - valid, correlation))
    names = ["phase", "quantity", "variable", "total", "valid", "excluded", "correlation"]
    columns = [pa.array([r[k] for r in out], pa.string() if k < 3 else pa.int64() if k < 6 else pa.float64()) for k in range(len(names))]
    return df.sparkSession.createDataFrame(pa.Table.from_arrays(columns, names))


def comparison_columns(x: str, y: str, mask: Column | None = None) -> list:
    """n, correlation, MAE, RMSE, through-origin gain and gain-adjusted RMSE."""
    p = Pair(x, y, mask)
    n, a, b = p.count(), p.expected, p.measured
    xx, xy, yy = F.sum(a * a), F.sum(a * b), F.sum(b * b)
    enough = n >= 3
    gain = F.when(enough & (xx > 0), xy / F.when(xx > 0, xx))
    left = yy - xy * xy / F.when(xx > 0, xx)
    return [n.alias("n"), F.when(enough, p.correlation()).alias("correlation"), F.when(enough, p.mae()).alias("mae"),
            F.when(enough, p.rmse()).alias("rmse"), gain.alias("gain"),
            F.when(enough & (xx > 0), F.sqrt(F.greatest(left, F.lit(0.0)) / n)).alias("gain_rmse")]


def shift_grid(anchors: DataFrame, series: DataFrame, value: str, mappings: dict, shifts, ts: str = "ts",
               flagged: DataFrame | None = None) -> DataFrame:
    """Strict means of another series under every (mapping, shift), long by candidate.

    ``mappings`` maps name -> offsets in minutes. All offsets come from one
    grouped block; candidates are assembled inside the row.
    """
    offsets = sorted({o + s for group in mappings.values() for o in group for s in shifts})
    block = offset_block(series.select(ts, F.col(value).alias("__v")), ["__v"], offsets, (), ts)
    wide = anchors.join(block, ts, "left")
    if flagged is not None:
        marks = offset_block(flagged.select(ts).distinct().withColumn("__f", F.lit(1)), ["__f"], offsets, (), ts)
        wide = wide.join(marks, ts, "left")
    rows = []
    for name, group in mappings.items():
        for s in shifts:
            cols = [F.col(f"__v_{_tag(o + s)}") for o in group]
            known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
            mean = reduce(lambda a, b: a + b, cols) / len(cols)
            bad = F.lit(False)
            if flagged is not None:
                bad = reduce(lambda a, b: a | b, [F.col(f"__f_{_tag(o + s)}").isNotNull() for o in group])
            rows.append(F.struct(F.lit(name).alias("mapping"), F.lit(s).alias("shift"), F.when(known, mean).alias("estimate"),
                                 bad.alias("touches_flag")))
    return wide.select(*anchors.columns, F.inline(F.array(*rows)))


def shift_scores(grid: DataFrame, measured: str, floor: float = 50.0, groups=(), own_flag: str | None = None) -> DataFrame:
    """Scores per candidate, with and without flagged intervals, all and active."""
    active = (F.col("estimate") > floor) | (F.col(measured) > floor)
    flagged = F.col("touches_flag") if own_flag is None else (F.col("touches_flag") | F.col(own_flag))
    tags = F.array_compact(F.array(
        F.struct(F.lit("retained").alias("sensitivity"), F.lit("all").alias("subset")),
        F.when(holds(active), F.struct(F.lit("retained").alias("sensitivity"), F.lit("active").alias("subset"))),
        F.when(~flagged, F.struct(F.lit("review_flags_excluded").alias("sensitivity"), F.lit("all").alias("subset"))),
        F.when(~flagged & holds(active), F.struct(F.lit("review_flags_excluded").alias("sensitivity"), F.lit("active").alias("subset")))))
    rows = grid.select(*grid.columns, F.inline(tags))
    return rows.groupBy(*groups, "mapping", "shift", "sensitivity", "subset").agg(*comparison_columns("estimate", measured))


def best_shift(scores: DataFrame, keys, error: str = "gain_rmse") -> DataFrame:
    """Lowest error per key; the smaller shift on a tie."""
    rank = F.struct(F.col(error), F.abs("shift"), F.col("shift"))
    return scores.where(F.col(error).isNotNull()).groupBy(*keys).agg(
        F.min_by("shift", rank).alias("shift"), F.min(error).alias(error))


def lag_correlations(df: DataFrame, moving: str, fixed: str, offsets, floor: float = 100.0, equal_support: bool = False,
                     groups=(), ts: str = "ts") -> DataFrame:
    """Correlation of one series at t+k with another at t, over all and active rows."""
    block = offset_block(df.select(ts, F.col(moving).alias("__m")), ["__m"], offsets, (), ts)
    wide = df.join(block, ts, "left")
    names = [f"__m_{_tag(o)}" for o in offsets]
    if equal_support:
        wide = wide.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))
    rows = F.array(*[F.struct(F.lit(o).alias("offset"), F.col(n).alias("x")) for o, n in zip(offsets, names)])
    long = wide.select(*groups, fixed, F.inline(rows))
    subset = F.array_compact(F.array(F.lit("all"), F.when(F.col("x") > floor, F.lit("active"))))
    long = long.withColumn("subset", F.explode(subset))
    p = Pair("x", fixed)
    return long.groupBy(*groups, "offset", "subset").agg(p.count().alias("n"), p.correlation().alias("correlation"))


def self_lag(df: DataFrame, value: str, offsets, ts: str = "ts") -> DataFrame:
    """Correlation of a slow sensor with itself at fixed lags."""
    block = offset_block(df.select(ts, F.col(value).alias("__m")), ["__m"], offsets, (), ts)
    wide = df.join(block, ts, "left")
    cols = F.array(*[F.struct(F.lit(o).alias("lag_minutes"), F.col(f"__m_{_tag(o)}").alias("x")) for o in offsets])
    p = Pair(value, "x")
    return wide.select(value, F.inline(cols)).groupBy("lag_minutes").agg(p.count().alias("n"), p.correlation().alias("correlation"))


def availability_scenarios(slots: DataFrame, mappings: dict, requirements: dict, spring: Column) -> DataFrame:
    """Counts of slots meeting cumulative requirements under several mappings.

    ``mappings`` maps name -> base condition; ``requirements`` maps name ->
    further condition, each adding to the ones before it.
    """
    cols, tags = [], []
    for m, base in mappings.items():
        cond = holds(base)
        for r, extra in requirements.items():
            cond = cond & holds(extra)
            tags.append((m, r))
            cols.append(count_if(cond).alias(f"__c{len(cols)}"))
    row = slots.agg(*cols, F.count(F.lit(1)).alias("slots"), count_if(~spring).alias("real"))
    structs = [F.struct(F.lit(m).alias("mapping"), F.lit(r).alias("requirement"), F.col(f"__c{i}").alias("count"))
               for i, (m, r) in enumerate(tags)]
    out = row.select("slots", "real", F.inline(F.array(*structs)))
    return out.select("mapping", "requirement", "count", F.col("slots").alias("nominal_slots"),
                      (100.0 * F.col("count") / F.col("slots")).alias("naive_pct"),
                      (100.0 * F.col("count") / F.col("real")).alias("spring_adjusted_pct"))


def worst_months(slots: DataFrame, condition: Column, k: int = 12, ts: str = "ts") -> DataFrame:
    """Months with the lowest availability."""
    months = slots.groupBy(clock.month_label(ts).alias("month")).agg(
        (100.0 * F.avg(holds(condition).cast("double"))).alias("available_pct"))
    return months.orderBy("available_pct", "month").limit(k)


def event_summary(context: DataFrame, groups, columns) -> DataFrame:
    """Counts and ranges of the context columns around QC events."""
    cols = [F.count(F.lit(1)).alias("events")]
    for c in columns:
        cols += [F.count(c).alias(f"{c}_available"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return context.groupBy(*groups).agg(*cols)


def yearly_device_coverage(df: DataFrame, unit: str, ac: str, counters: dict, denominator: str, numerator: str,
                           ts: str = "ts") -> DataFrame:
    """Named counters per device and year, with one coverage fraction."""
    out = df.groupBy(unit, F.year(ts).alias("year")).agg(*[count_if(holds(c)).alias(n) for n, c in counters.items()])
    return out.withColumn("coverage", F.when(F.col(denominator) > 0, F.col(numerator) / F.col(denominator)))


def monthly_ratios(df: DataFrame, unit: str, ratios, ts: str = "ts") -> DataFrame:
    """Median, pair count and day count of each ratio per device and month."""
    rows = df.withColumn("month", clock.month_label(ts))
    keys = [unit, "month"]
    cols = []
    for r in ratios:
        cols += [F.count(r).alias(f"{r}_pairs"), F.count_distinct(F.when(F.col(r).isNotNull(), F.col(ts).cast("date"))).alias(f"{r}_days")]
    return with_quantiles(rows.groupBy(*keys).agg(*cols), rows, keys, {f"{r}_median": (r, .5) for r in ratios})


def forecast_support(df: DataFrame, power: str, poa: str, clear: str, weather: str, minimum_poa: float, horizons=(5, 15, 30, 60),
                     lags=(0, 5, 10, 15), ts: str = "ts") -> DataFrame:
    """Origins per year and horizon whose exact history and target all exist."""
    usable = df.select(ts, F.when(F.col(clear), F.col(power)).alias("__p"), F.when(F.col(clear), F.col(poa)).alias("__q"))
    offsets = sorted({*[-x for x in lags], *horizons})
    wide = df.join(offset_block(usable, ["__p", "__q"], offsets, (), ts), ts, "left")
    history = F.col(clear) & (F.col(poa) >= minimum_poa)
    for x in lags:
        history = history & F.col(f"__p_{_tag(-x)}").isNotNull() & F.col(f"__q_{_tag(-x)}").isNotNull()
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), holds(history & F.col(f"__p_{_tag(h)}").isNotNull()).alias("ok")) for h in horizons])
    long = wide.select(F.year(ts).alias("year"), holds(F.col(weather)).alias("__w"), F.inline(rows))
    return long.groupBy("year", "horizon").agg(count_if(F.col("ok")).alias("history_pairs"),
                                               count_if(F.col("ok") & F.col("__w")).alias("with_weather"))


def phase_ratio_summary(df: DataFrame, ratio_: str, phase: str, groups=()) -> DataFrame:
    """Morning/afternoon medians, gap, spread and counts of a ratio."""
    ok = is_finite(ratio_) & F.col(phase).isin("AM", "PM")
    r = F.when(holds(ok), F.col(ratio_))
    rows = df.select(*groups, r.alias("__r"), F.when(F.col(phase) == "AM", r).alias("__a"), F.when(F.col(phase) == "PM", r).alias("__p"))
    base = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"), F.count("__r").alias("valid"), (F.count(F.lit(1)) - F.count("__r")).alias("excluded"),
        F.count("__a").alias("am_samples"), F.count("__p").alias("pm_samples"), F.stddev_samp("__r").alias("overall_std"))
    out = with_quantiles(base, rows, list(groups), {"am_median": ("__a", .5), "pm_median": ("__p", .5),
                                                    "__q1": ("__r", .25), "__q3": ("__r", .75)})
    return (out.withColumn("am_minus_pm", F.col("am_median") - F.col("pm_median"))
            .withColumn("overall_iqr", F.col("__q3") - F.col("__q1")).drop("__q1", "__q3"))


def model_scores(df: DataFrame, actual: str, models, day: str, groups=()) -> DataFrame:
    """Daylight and all-day errors of many model columns on identical rows."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in models])
    long = df.select(*groups, actual, day, F.inline(rows))
    everything, light = Pair(actual, "prediction"), Pair(actual, "prediction", F.col(day))

    def r2(p):
        n, sst = p.count(), F.var_pop(p.expected) * p.count()
        return F.when((n >= 2) & (sst > 0), 1.0 - F.sum(p.residual * p.residual) / sst)

    return long.groupBy(*groups, "model").agg(
        light.count().alias("day_n"), light.mae().alias("day_mae"), light.rmse().alias("day_rmse"), light.mbe().alias("day_bias"),
        r2(light).alias("day_r2"), everything.count().alias("all_n"), everything.mae().alias("all_mae"),
        everything.rmse().alias("all_rmse"), everything.mbe().alias("all_bias"), r2(everything).alias("all_r2"))


def check_predictions(df: DataFrame, models) -> None:
    """Refuse NULL or non-finite predictions."""
    bad = df.agg(*[count_if(~is_finite(m)).alias(m) for m in models]).first().asDict()
    if any(bad.values()):
        raise ValueError(f"missing predictions: {bad}")


def improvement(scores: DataFrame, reference: str, error: str, out: str, keys=()) -> DataFrame:
    """Percent improvement over a reference model; NULL when its error is zero."""
    ref = scores.where(F.col("model") == reference).select(*keys, F.col(error).alias("__r"))
    joined = scores.join(ref, list(keys)) if keys else beside(scores, ref)
    r = F.col("__r")
    return joined.withColumn(out, F.when(r != 0, 100.0 * (r - F.col(error)) / r)).drop("__r")


def seed_summary(scores: DataFrame, groups, columns) -> DataFrame:
    """Mean and sample deviation over repeated runs."""
    cols = []
    for c in columns:
        cols += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    return scores.groupBy(*groups).agg(F.count(F.lit(1)).alias("runs"), *cols)


def pooled_folds(folds: DataFrame, groups, n="n", mae="mae", rmse="rmse") -> DataFrame:
    """Row-weighted MAE, and root of the row-weighted mean square."""
    w = F.sum(n)
    return folds.groupBy(*groups).agg(
        w.alias("n"), (F.sum(F.col(mae) * F.col(n)) / w).alias("mae"),
        F.sqrt(F.sum(F.col(rmse) * F.col(rmse) * F.col(n)) / w).alias("rmse"))


def night_tare(df: DataFrame, unit: str, poa: str, expected: str, measured: str) -> DataFrame:
    """Paired readings at zero irradiance."""
    rows = df.where((F.col(poa) == 0) & is_finite(expected) & is_finite(measured))
    base = rows.groupBy(unit).agg(
        F.count(F.lit(1)).alias("pairs"), count_if(F.col(expected) < 0).alias("expected_negative"),
        count_if(F.col(measured) < 0).alias("measured_negative"), count_if(F.col(measured) == 0).alias("measured_zero"))
    return with_quantiles(base, rows, [unit], {"expected_median": (expected, .5), "measured_median": (measured, .5)})


def tail_summary(df: DataFrame, ratio_: str, keys) -> DataFrame:
    base = df.groupBy(*keys).agg(F.min(ratio_).alias("minimum"), F.max(ratio_).alias("maximum"),
                                 count_if(F.col(ratio_) > 2).alias("above_two"))
    return with_quantiles(base, df, list(keys), {"p01": (ratio_, .01), "p99": (ratio_, .99)})


def share_above_one(df: DataFrame, ratio_: str, phase: str, ts: str = "ts", groups=()) -> DataFrame:
    """Share of devices above one at each label; median of that share per phase."""
    shares = df.where(F.col(ratio_).isNotNull()).groupBy(*groups, ts, phase).agg(
        F.avg((F.col(ratio_) > 1).cast("double")).alias("share"))
    keys = [*groups, phase]
    base = shares.groupBy(*keys).agg(F.count(F.lit(1)).alias("labels"))
    return with_quantiles(base, shares, keys, {"median_share": ("share", .5)})


def device_ranges(df: DataFrame, unit: str, expected: str, measured: str, module: str, poa: str, limit: float,
                  minimum_poa: float = 600.0) -> DataFrame:
    """Finite ranges per device and the measured/module ratio under strong light."""
    e, m = finite(expected), finite(measured)
    both = e.isNotNull() & m.isNotNull()
    lit = both & (F.col(poa) >= minimum_poa) & (F.col(module) > 0)
    rows = df.select(unit, e.alias("__e"), m.alias("__m"), both.alias("__b"),
                     F.when(lit, m / F.when(F.col(module) > 0, F.col(module))).alias("__r"))
    base = rows.groupBy(unit).agg(
        count_if(F.col("__b")).alias("valid_pairs"), F.min("__e").alias("expected_min"), F.max("__e").alias("expected_max"),
        F.min("__m").alias("measured_min"), F.max("__m").alias("measured_max"), count_if(F.col("__m") < 0).alias("negative"),
        F.count("__r").alias("illuminated_pairs"), count_if(F.col("__m") > limit).alias("above_reference"))
    return with_quantiles(base, rows, [unit], {"ratio_p10": ("__r", .1), "ratio_median": ("__r", .5), "ratio_p90": ("__r", .9)})


def monthly_counts(df: DataFrame, condition: Column, ts: str = "ts") -> DataFrame:
    """Rows meeting a condition per month, empty months included."""
    span = df.agg(clock.month_start(F.min(ts)).cast("date").alias("a"), clock.month_start(F.max(ts)).cast("date").alias("z"))
    months = span.select(F.explode(F.sequence("a", "z", F.expr("interval 1 month"))).alias("month"))
    counts = df.where(holds(condition)).groupBy(clock.month_start(ts).cast("date").alias("month")).agg(
        F.count(F.lit(1)).alias("records"))
    return months.join(counts, "month", "left").na.fill(0, ["records"])


def dataset_summary(series: dict, cadences: dict, values: dict) -> DataFrame:
    """Rows, span, modal cadence, expected slots, coverage and missing cells per dataset."""
    from .timeline import modal_interval
    out = None
    for name, df in series.items():
        c = cadences[name]
        seconds = (clock.seconds(F.max("ts")) - clock.seconds(F.min("ts")))
        missing = sum((F.sum(F.col(v).isNull().cast("long")) for v in values[name]), F.lit(0))
        row = df.agg(F.count(F.lit(1)).alias("records"), F.min("ts").alias("first"), F.max("ts").alias("last"),
                     (F.floor(seconds / c) + 1).alias("expected_slots"), missing.alias("missing_cells"))
        row = beside(row, modal_interval(df.select("ts")).select(F.col("step").alias("modal_seconds")))
        row = row.withColumn("coverage_pct", 100.0 * F.col("records") / F.col("expected_slots")).withColumn("dataset", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
