"""Plant-wide candidate screening and matched-condition contrasts."""

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CandidateThresholds
from ..functions import clock
from ..functions.binning import floor_bin
from ..functions.values import count_if, holds, is_finite, ratio
from .masks import rule_funnel, rule_mask
from .ordered import with_quantiles
from .windows import relative_ramp

QUANTITIES = ("voltage", "current", "power")


def candidate_features(baseline: DataFrame, readings: DataFrame, units: int, without_voltage=(), cadence: int = 300,
                       unit: str = "inverter_id", ts: str = "ts") -> DataFrame:
    """Same-time fleet diagnostics beside the nominal model, for every label.

    ``readings`` is long: ``ts, inverter_id, voltage, current, power, ac``.
    Units without a voltage channel take part in current and AC only.
    Everything per label comes from one grouped pass over a short roster.
    """
    blind = F.col(unit).isin(*without_voltage) if without_voltage else F.lit(False)
    full_vp = units - len(tuple(without_voltage))
    exp = baseline.select(ts, *[f"expected_dc_{q}_ideal" for q in QUANTITIES])
    rows = readings.join(exp, ts)
    cols, need = [], {"voltage": full_vp, "power": full_vp, "current": units, "ac": units}
    val = {q: F.when(is_finite(q) & (~blind if q in ("voltage", "power") else F.lit(True)), F.col(q)) for q in need}
    full = {q: F.count(val[q]) == need[q] for q in need}
    for q in ("voltage", "current", "power"):
        r = ratio(val[q], f"expected_dc_{q}_ideal")
        ok = full[q] & (F.count(r) == need[q])
        cols += [F.when(full[q], F.median(val[q])).alias(f"measured_dc_{q}_median"), F.when(ok, F.median(r)).alias(f"{q}_ratio")]
        if q == "voltage":
            dev = F.greatest(F.abs(F.max(r) - 1.0), F.abs(F.min(r) - 1.0))
            cols.append(F.when(ok, dev).alias("maximum_voltage_mpp_deviation"))
    for q, name in (("current", "maximum_current_consensus_deviation"), ("ac", "maximum_ac_consensus_deviation")):
        med = F.median(val[q])
        dev = F.greatest(F.max(val[q]) - med, med - F.min(val[q])) / F.when(med > 0, med)
        cols.append(F.when(full[q] & (med > 0), dev).alias(name))
    acdc = F.when(~blind, ratio(val["ac"], val["power"]))
    cols += [
        (full["voltage"] & full["current"] & full["power"]).alias("finite_dc"),
        ((F.count(F.when(val["voltage"] > 0, 1)) == full_vp) & (F.count(F.when(val["current"] > 0, 1)) == units)
         & (F.count(F.when(val["power"] > 0, 1)) == full_vp)).alias("positive_dc"),
        full["ac"].alias("finite_ac"), F.when(full["ac"], F.min(val["ac"])).alias("minimum_ac_power_w"),
        F.when(full["ac"], F.max(val["ac"])).alias("maximum_ac_power_w"),
        F.when(full["ac"], F.median(val["ac"])).alias("measured_ac_power_median_w"),
        F.when(F.count(acdc) == full_vp, F.max(acdc)).alias("maximum_ac_to_dc_power_ratio")]
    features = baseline.join(rows.groupBy(ts).agg(*cols), ts, "left")
    for flag in ("finite_dc", "positive_dc", "finite_ac"):
        features = features.withColumn(flag, F.coalesce(flag, F.lit(False)))
    return relative_ramp(features, "poa", "maximum_adjacent_poa_ramp", cadence, (), ts)


def candidate_rules(paco: float, pdco: float, t: CandidateThresholds = CandidateThresholds()) -> dict:
    """The nine ordered screens as conditions over :func:`candidate_features`."""
    if min(paco, pdco) <= 0:
        raise ValueError("ratings must be positive")
    known = is_finite("expected_dc_voltage_ideal") & is_finite("expected_dc_current_ideal") & is_finite("expected_dc_power_ideal")
    ramp = F.lit(True) if t.maximum_poa_ramp is None else F.col("maximum_adjacent_poa_ramp") <= t.maximum_poa_ramp
    return {
        "valid_model_inputs": F.col("model_inputs_available") & F.col("dc_model_computed") & known,
        "known_qc_and_dst_clear": ~F.col("electrical_qc_flag") & ~F.col("irradiance_qc_flag") & ~F.col("dst_fall_ambiguous"),
        "meaningful_irradiance": F.col("poa") >= t.minimum_poa,
        "available_dc_and_ac": F.col("finite_dc") & F.col("positive_dc") & F.col("finite_ac"),
        "all_inverters_operating": F.col("minimum_ac_power_w") >= t.minimum_ac_fraction * paco,
        "below_rating_guards": (F.col("maximum_ac_power_w") < t.rating_margin * paco)
        & (F.col("expected_dc_power_ideal") < t.rating_margin * pdco),
        "voltage_mpp_compatible": F.col("maximum_voltage_mpp_deviation") <= t.voltage_tolerance,
        "all_inverters_consensus": (F.col("maximum_current_consensus_deviation") <= t.consensus_tolerance)
        & (F.col("maximum_ac_consensus_deviation") <= t.consensus_tolerance),
        "stable_adjacent_poa": ramp,
    }


def select_candidates(features: DataFrame, paco: float, pdco: float, t: CandidateThresholds = CandidateThresholds()):
    """Rule columns with the common mask, and the screening funnel."""
    rules = candidate_rules(paco, pdco, t)
    return rule_mask(features, rules, "candidate_healthy_mask"), rule_funnel(features, rules)


# Fixed one-at-a-time settings of the sensitivity sweep.
SWEEP = {
    "minimum_poa": [200, 300, 400],
    "minimum_ac_fraction": [.05, .10, .15],
    "rating_margin": [.80, .90, .95],
    "voltage_tolerance": [.05, .10, .15],
    "consensus_tolerance": [.05, .10, .15, .20],
    "maximum_poa_ramp": [.10, .20, .30, None],
}


def threshold_sweep(features: DataFrame, paco: float, pdco: float, base: CandidateThresholds = CandidateThresholds(),
                    sweep=None) -> DataFrame:
    """Candidates and ratio medians for every single-threshold change, in one scan.

    A row is repeated only for the settings it passes. Settings nobody passes
    are kept with a count of zero.
    """
    from functools import reduce
    sweep = sweep or SWEEP
    tags, labels = [], []
    for name, values in sweep.items():
        for v in values:
            rules = candidate_rules(paco, pdco, replace(base, **{name: v}))
            ok = reduce(lambda a, b: a & b, [holds(r) for r in rules.values()])
            tag = F.struct(F.lit(name).alias("threshold"), F.lit(str(v)).alias("setting"))
            labels.append(tag)
            tags.append(F.when(ok, tag))
    rows = features.select(*[f"{q}_ratio" for q in QUANTITIES], F.inline(F.array_compact(F.array(*tags))))
    keys = ["threshold", "setting"]
    passed = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("timestamps"))
    passed = with_quantiles(passed, rows, keys, {f"{q}_ratio_median": (f"{q}_ratio", .5) for q in QUANTITIES})
    grid = features.sparkSession.range(1).select(F.inline(F.array(*labels)))
    return grid.join(passed, keys, "left").na.fill(0, ["timestamps"])


def device_candidate_coverage(masks: DataFrame, readings: DataFrame, tolerance: float, preliminary: str = "preliminary",
                              candidate: str = "candidate_healthy_mask", unit: str = "inverter_id", ts: str = "ts"):
    """Per device: valid pairs and ratio spread at candidate labels, disagreement with the fleet median."""
    exp = [f"expected_dc_{q}_ideal" for q in QUANTITIES]
    med = {"current": "measured_dc_current_median", "ac": "measured_ac_power_median_w"}
    rows = readings.join(masks.select(ts, candidate, preliminary, *exp, *med.values()), ts)
    for q in QUANTITIES:
        rows = rows.withColumn(f"__{q}", F.when(F.col(candidate) & is_finite(q), ratio(q, f"expected_dc_{q}_ideal")))
    cols = [F.count(f"__{q}").alias(f"{q}_valid_pairs") for q in QUANTITIES]
    for q, m in med.items():
        off = holds(F.abs(F.col(q) - F.col(m)) / F.when(F.col(m) > 0, F.col(m)) > tolerance)
        cols.append(F.avg(F.when(F.col(preliminary), off.cast("double"))).alias(f"{q}_disagreement_fraction"))
    base = rows.groupBy(unit).agg(*cols)
    wanted = {f"{q}_ratio_p{round(p * 100)}": (f"__{q}", p) for q in QUANTITIES for p in (.1, .5, .9)}
    return with_quantiles(base, rows, [unit], wanted)


MATCHED = ("voltage_ratio", "current_ratio", "power_ratio", "poa", "temp_cell", "wind", "aoi")


def matched_strata(df: DataFrame, poa_width: float = 100.0, temperature_width: float = 10.0, extra=(), minimum: int = 10,
                   phase: str = "phase", values=MATCHED, groups=()) -> DataFrame:
    """Morning and afternoon medians inside shared condition bins.

    ``extra`` may add 'year', 'aoi' (10 degrees) or 'wind' (1 m/s) to the bins.
    """
    if min(poa_width, temperature_width) <= 0 or minimum < 1:
        raise ValueError("bin widths and the minimum count must be positive")
    rows = df.withColumn("poa_bin", floor_bin("poa", poa_width)).withColumn("temp_bin", floor_bin("temp_cell", temperature_width))
    keys = [*groups, "poa_bin", "temp_bin", "season"]
    for e in extra:
        made = {"year": F.year("ts"), "aoi": floor_bin("aoi", 10.0), "wind": F.floor("wind").cast("double")}[e]
        rows, keys = rows.withColumn(f"{e}_bin", made), [*keys, f"{e}_bin"]
    cols, wanted = [], {}
    for ph in ("AM", "PM"):
        cols.append(count_if(F.col(phase) == ph).alias(f"{ph}_samples"))
        for v in values:
            rows = rows.withColumn(f"__{ph}_{v}", F.when(F.col(phase) == ph, F.col(v)))
            wanted[f"{ph}_{v}"] = (f"__{ph}_{v}", .5)
    out = with_quantiles(rows.groupBy(*keys).agg(*cols), rows, keys, wanted)
    out = out.withColumn("balanced_weight", F.least("AM_samples", "PM_samples"))
    out = out.withColumn("adequate", F.col("balanced_weight") >= minimum)
    for q in QUANTITIES:
        if f"{q}_ratio" in values:
            out = out.withColumn(f"{q}_pm_minus_am", F.col(f"PM_{q}_ratio") - F.col(f"AM_{q}_ratio"))
    return out


def matched_summary(strata: DataFrame, quantities=QUANTITIES, groups=()) -> DataFrame:
    """Balanced-weighted contrasts over adequate bins; NULL without any."""
    w = F.when(F.col("adequate"), F.col("balanced_weight"))
    total = F.sum(w)
    cols = [F.count(F.lit(1)).alias("occupied_bins"), count_if(F.col("adequate")).alias("adequate_bins"),
            F.coalesce(total, F.lit(0)).alias("balanced_samples")]
    for q in quantities:
        for ph in ("AM", "PM"):
            cols.append((F.sum(F.col(f"{ph}_{q}_ratio") * w) / F.when(total > 0, total)).alias(f"{q}_{ph}"))
    out = strata.groupBy(*groups).agg(*cols)
    for q in quantities:
        out = out.withColumn(f"{q}_pm_minus_am", F.col(f"{q}_PM") - F.col(f"{q}_AM"))
    return out


def weather_matched_years(df: DataFrame, unit: str, ratio_: str, keys, reference: int, minimum: int = 20) -> DataFrame:
    """Each year against the reference year on shared weather bins, balanced by the smaller count."""
    from .align import matched_to_reference
    group = [unit, "year", *keys]
    bins = df.groupBy(*group).agg(F.count(ratio_).alias("n"))
    bins = with_quantiles(bins, df, group, {"mid": (ratio_, .5)})
    pairs = matched_to_reference(bins, [unit, *keys], "year", reference)
    pairs = pairs.where((F.col("n") >= minimum) & (F.col("n_reference") >= minimum)).withColumn("w", F.least("n", "n_reference"))
    found = pairs.groupBy(unit, "year").agg(
        F.count(F.lit(1)).alias("shared_bins"), F.sum("w").alias("balanced_weight"),
        (F.sum(F.col("mid") * F.col("w")) / F.sum("w")).alias("ratio_year"),
        (F.sum(F.col("mid_reference") * F.col("w")) / F.sum("w")).alias("ratio_reference"))
    every = df.where(F.col("year") != reference).select(unit, "year").distinct()
    return every.join(found, [unit, "year"], "left").na.fill(0, ["shared_bins", "balanced_weight"])


def timing_study(ratios: DataFrame, ratio_: str, phase: str, offset: str, dimensions=None) -> DataFrame:
    """Phase summaries per offset and grouping; the offset with the smallest gap is marked."""
    from pyspark.sql import Window as W
    from .profiles import phase_ratio_summary
    dims = {"all": F.lit("all"), **(dimensions or {})}
    tags = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("bin")) for n, c in dims.items()])
    rows = ratios.select(offset, ratio_, phase, F.inline(tags))
    out = phase_ratio_summary(rows, ratio_, phase, [offset, "dimension", "bin"])
    w = W.partitionBy("dimension", "bin").orderBy(F.abs("am_minus_pm").asc_nulls_last(), F.abs(offset), offset)
    return out.withColumn("best", F.row_number().over(w) == 1)


def ramp_timing(pairs: DataFrame, offsets, ts: str = "ts"):
    """Fit a gain per offset on selection dates, score both splits by several groupings.

    ``pairs`` comes from ``windows.ramp_pairs`` through ``windows.alternate_dates``.
    """
    from .align import _tag
    cols = F.array(*[F.struct(F.lit(o).alias("offset_minutes"), F.col(f"poa_change_{_tag(o)}").alias("x")) for o in offsets])
    long = pairs.select(ts, "split", F.col("electrical_change").alias("y"), F.inline(cols))
    fit = long.where(F.col("split") == "selection").groupBy("offset_minutes").agg(
        F.greatest(F.lit(0.0), F.sum(F.col("x") * F.col("y")) / F.nullif(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("gain"))
    rows = long.join(fit, "offset_minutes")
    tags = F.array(
        F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("value")),
        F.struct(F.lit("year").alias("grouping"), F.year(ts).cast("string").alias("value")),
        F.struct(F.lit("season").alias("grouping"), clock.season(ts).alias("value")),
        F.struct(F.lit("direction").alias("grouping"), F.when(F.col("y") > 0, "rise").otherwise("fall").alias("value")))
    rows = rows.select(ts, "split", "offset_minutes", "x", "y", "gain", F.inline(tags))
    e = F.col("y") - F.col("gain") * F.col("x")
    varied = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    return rows.groupBy("split", "grouping", "value", "offset_minutes").agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct(F.col(ts).cast("date")).alias("days"), F.first("gain").alias("gain"),
        F.when(varied, F.corr("x", "y")).alias("correlation"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("direction_agreement"))


def chosen_offset(scores: DataFrame) -> DataFrame:
    """Offset with the lowest selection error, earlier offsets winning ties."""
    rows = scores.where((F.col("split") == "selection") & (F.col("grouping") == "all"))
    return rows.groupBy().agg(F.min_by("offset_minutes", F.struct("rmse", "offset_minutes")).alias("offset_minutes"),
                              F.min("rmse").alias("rmse"))


def outage_census(df: DataFrame, conditions: dict, cadence: int = 300, keys=(), ts: str = "ts") -> DataFrame:
    """Runs of several conditions in one table; ``conditions`` maps kind -> (condition, minimum samples)."""
    from .timeline import label_runs
    tags = F.array_compact(F.array(*[F.when(holds(c), F.struct(F.lit(n).alias("kind"), F.lit(k).alias("floor")))
                                     for n, (c, k) in conditions.items()]))
    rows = df.select(*keys, ts, F.inline(tags))
    return label_runs(rows, F.lit(True), cadence, 1, [*keys, "kind", "floor"], ts).where(F.col("samples") >= F.col("floor")).drop("floor")
