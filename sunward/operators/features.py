"""Chronological splits and leakage-free forecasting features."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock
from ..functions.values import beside, count_if, holds, is_finite
from .align import _tag, asof_backward, offset_block

HORIZON = 15
LAGS = tuple(range(0, 121, 5))


def split_edges(df: DataFrame, target: str = "target_ts", train: float = 0.70, validation: float = 0.15,
                grid_minutes: int = 5) -> DataFrame:
    """Edges of training, validation and testing by elapsed time, rounded up to the grid; one row."""
    step = grid_minutes * 60
    span = df.agg(F.min(clock.seconds(target)).alias("a"), F.max(clock.seconds(target)).alias("z"))
    width = F.col("z") - F.col("a")

    def edge(share):
        return (F.ceil((F.col("a") + width * share) / step) * step).cast("long")

    return span.select(clock.from_seconds("a").alias("start"), clock.from_seconds(edge(train)).alias("validation_start"),
                       clock.from_seconds(edge(train + validation)).alias("testing_start"),
                       clock.from_seconds(F.col("z") + step).alias("end"))


def label_splits(df: DataFrame, edges: DataFrame, target: str = "target_ts", out: str = "split") -> DataFrame:
    """Half-open membership by target label. ``edges`` is the one row of :func:`split_edges`."""
    t = F.col(target)
    label = (F.when((t >= F.col("start")) & (t < F.col("validation_start")), "training")
             .when((t >= F.col("validation_start")) & (t < F.col("testing_start")), "validation")
             .when((t >= F.col("testing_start")) & (t < F.col("end")), "testing"))
    return beside(df, edges).select(*df.columns, label.alias(out))


def training_blocks(edges: DataFrame, fractions=(.4, .6, .8), grid_minutes: int = 5) -> DataFrame:
    """Successive issue blocks inside the training period, each fitted on what precedes it."""
    step = grid_minutes * 60
    a, z = clock.seconds("start"), clock.seconds("validation_start")
    cuts = [(F.ceil((a + (z - a) * f) / step) * step).cast("long") for f in fractions] + [z]
    rows = [F.struct(F.lit(i).alias("block"), clock.from_seconds(lo).alias("cutoff"), clock.from_seconds(hi).alias("block_end"))
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]), 1)]
    return edges.select(F.inline(F.array(*rows)))


def assign_blocks(df: DataFrame, blocks: DataFrame, target: str = "target_ts") -> DataFrame:
    """Issue block of each target; ``blocks`` is a handful of rows."""
    cond = (F.col(target) >= F.col("cutoff")) & (F.col(target) < F.col("block_end"))
    return df.join(F.broadcast(blocks), cond, "left")


def year_split(ts, train, validate, evaluate) -> Column:
    """1, 2, 3 for the named calendar years, 0 elsewhere."""
    y = F.year(ts)
    return F.when(y.isin(*train), 1).when(y.isin(*validate), 2).when(y.isin(*evaluate), 3).otherwise(0)


def lag_features(origins: DataFrame, poa: DataFrame, poa_value: str, environment: DataFrame, sensors, lags=LAGS,
                 ts: str = "ts") -> DataFrame:
    """Exact irradiance lags and availability-limited sensor lags for every origin.

    The as-of lookup runs once over all labels any lag reaches; both blocks
    are then assembled by one grouped shuffle each, not a join per lag.
    """
    back = [-x for x in lags]
    light = offset_block(poa.select(ts, F.col(poa_value).alias("poa")), ["poa"], back, (), ts)
    reach = origins.select(F.explode(F.array(*[clock.shift(ts, b) for b in back])).alias(ts)).distinct()
    known = asof_backward(reach, environment, sensors, ts=ts).where(F.col("record_ts").isNotNull())
    slow = offset_block(known, list(sensors), back, (), ts)
    out = origins.select(ts).join(light, ts, "left").join(slow, ts, "left")
    for name in ("poa", *sensors):
        for x in lags:
            out = out.withColumnRenamed(f"{name}_{_tag(-x)}", f"{name}_lag{x}")
    return out


def origin_features(plant: DataFrame, power: str, poa: DataFrame, poa_value: str, environment: DataFrame, sensors,
                    elevation: str, zero_fraction: str, lags=(0, 5, 15, 30), ts: str = "ts") -> DataFrame:
    """Power and irradiance lags and changes, as-of weather, cyclic phases, elevation."""
    back = [-x for x in lags]
    a = offset_block(plant.select(ts, F.col(power).alias("ac_kw")), ["ac_kw"], back, (), ts)
    b = offset_block(poa.select(ts, F.col(poa_value).alias("poa")), ["poa"], back, (), ts)
    base = plant.select(ts, F.col(zero_fraction).alias("zero_unit_fraction"), F.col(elevation).alias("origin_elevation"))
    out = base.join(a, ts, "left").join(b, ts, "left")
    for name in ("ac_kw", "poa"):
        for x in lags:
            out = out.withColumnRenamed(f"{name}_{_tag(-x)}", f"{name}_lag{x}")
        for x in lags[1:]:
            out = out.withColumn(f"{name}_change{x}", F.col(f"{name}_lag0") - F.col(f"{name}_lag{x}"))
    out = asof_backward(out, environment, sensors, ts=ts).drop("record_ts")
    day = 2 * math.pi * (F.hour(ts) + F.minute(ts) / 60.0) / 24.0
    year = 2 * math.pi * (F.dayofyear(ts) - 1) / 365.25
    return (out.withColumn("hour_sin", F.sin(day)).withColumn("hour_cos", F.cos(day))
            .withColumn("season_sin", F.sin(year)).withColumn("season_cos", F.cos(year)))


def exact_targets(origins: DataFrame, sources: dict, horizon: int = HORIZON, ts: str = "ts") -> DataFrame:
    """Recorded values at origin + horizon; never a carried or nearby value.

    ``sources`` maps output name -> (DataFrame, value column).
    """
    out = origins.select(ts)
    for name, (df, value) in sources.items():
        later = df.select(clock.shift(ts, -horizon).alias(ts), F.col(value).alias(name))
        out = out.join(later, ts, "left")
    return out.withColumn("target_ts", clock.shift(ts, horizon))


CORRECTION_FEATURES = ("forecast_poa", "forecast_ambient", "forecast_wind", "physics_forecast_kw", "origin_power_kw",
                       "origin_poa", "power_change_15_kw")
DIRECT_FEATURES = tuple(c for c in CORRECTION_FEATURES if c != "physics_forecast_kw")


def correction_features(table: DataFrame, plant: DataFrame, power: str, poa: DataFrame, poa_value: str, origin: str = "origin",
                        ts: str = "ts") -> DataFrame:
    """Forecast inputs plus power and irradiance known at the origin."""
    now = offset_block(plant.select(ts, F.col(power).alias("__p")), ["__p"], [0, -15], (), ts).select(
        F.col(ts).alias(origin), F.col("__p_p0").alias("origin_power_kw"),
        (F.col("__p_p0") - F.col("__p_m15")).alias("power_change_15_kw"))
    light = poa.select(F.col(ts).alias(origin), F.col(poa_value).alias("origin_poa"))
    return table.join(now, origin, "left").join(light, origin, "left")


def eligible_examples(table: DataFrame):
    """Rows fit for training with the funnel of exclusions, as (rows, counts)."""
    labelled = is_finite("physics_forecast_kw") & is_finite("actual_target_power_kw") & is_finite("correction_kw")
    inputs = is_finite("forecast_poa") & is_finite("forecast_ambient") & is_finite("forecast_wind") & is_finite("physics_forecast_kw")
    power, light = is_finite("origin_power_kw"), is_finite("origin_poa")
    ok = labelled & inputs & power & light
    counts = table.agg(
        F.count(F.lit(1)).alias("saved_rows"), count_if(~labelled).alias("missing_label_or_physics"),
        count_if(labelled & ~inputs).alias("invalid_forecast_inputs"), count_if(labelled & inputs & ~power).alias("missing_current_power"),
        count_if(labelled & inputs & power & ~light).alias("missing_current_poa"), count_if(ok).alias("eligible"),
        count_if(ok & ~is_finite("power_change_15_kw")).alias("older_power_missing_retained"))
    return table.where(ok), counts


def reconstruction_errors(df: DataFrame, physics: str, correction: str, final: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows where physics + correction departs from the final value."""
    return df.agg(F.count(F.lit(1)).alias("records"),
                  count_if(F.abs(F.col(physics) + F.col(correction) - F.col(final)) > tolerance).alias("mismatches"))


def check_reconstruction(df, physics, correction, final) -> None:
    if reconstruction_errors(df, physics, correction, final).first()["mismatches"]:
        raise ValueError("physics + correction does not give the final power")


def check_horizon(df: DataFrame, origin: str = "origin", target: str = "target_ts", minutes: int = HORIZON) -> DataFrame:
    """Refuse tables whose targets are not exactly one horizon after their origin."""
    if df.where(F.col(target) != clock.shift(origin, minutes)).limit(1).collect():
        raise ValueError("targets must be exactly one horizon after their origins")
    return df


def availability_report(df: DataFrame, columns, groups) -> DataFrame:
    """Rows and available labels per split."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"{c}_available") for c in columns])


def load_examples(steps: dict, blocks: DataFrame, cutoff, target: str = "target_ts"):
    """Union of step tables below a cutoff, with targets outside their own block counted.

    ``steps`` maps block number -> table; ``cutoff`` (a Column) is applied to
    every scan, so later measurements never enter.
    """
    out = None
    for number, df in steps.items():
        part = df.where(F.col(target) < cutoff).withColumn("block", F.lit(number))
        out = part if out is None else out.unionByName(part)
    joined = out.join(F.broadcast(blocks), "block", "left")  # a handful of rows
    inside = holds((F.col(target) >= F.col("cutoff")) & (F.col(target) < F.col("block_end")))
    return out, joined.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), count_if(~inside).alias("outside_block"))


def load_test_rows(forecasts: DataFrame, physics: DataFrame, current: DataFrame, origin: str = "origin"):
    """Held-out rows: forecasts and physics joined on origin, identity violations counted."""
    b = physics.select(origin, F.col("target_ts").alias("__t"), F.col("actual_target_power_kw").alias("__a"),
                       "physics_forecast_kw", "correction_kw", F.lit(True).alias("__in"))
    rows = forecasts.join(b, origin, "left").join(current, origin, "left")
    violations = rows.agg(
        F.count(F.lit(1)).alias("rows"), count_if(F.col("__in").isNull()).alias("without_physics"),
        count_if(F.col("__in") & (F.col("target_ts") != F.col("__t"))).alias("shifted_targets"),
        count_if(F.col("__in") & ~F.col("actual_kw").eqNullSafe(F.col("__a"))).alias("altered_labels"))
    return rows.drop("__t", "__a", "__in"), violations
