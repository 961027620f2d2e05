"""Expected against measured: exact keys, explicit masks, counted metrics."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock
from ..functions.errors import Normalization, Pair, metrics_from_sums
from ..functions.values import count_if, finite, is_finite


@dataclass(frozen=True)
class ValidationResult:
    """Every key of either side, and one metric row per quantity and group."""

    table: DataFrame
    metrics: DataFrame


def pair_keys(expected: DataFrame, measured: DataFrame, keys, e: str, m: str) -> DataFrame:
    """Outer union of exact keys with presence and finiteness marks."""
    left = expected.select(*keys, F.col(e).cast("double").alias("expected"), F.lit(True).alias("__e"))
    right = measured.select(*keys, F.col(m).cast("double").alias("measured"), F.lit(True).alias("__m"))
    both = left.join(right, list(keys), "full_outer")
    return both.select(
        *keys, "expected", "measured", F.col("__e").isNotNull().alias("expected_record_present"),
        F.col("__m").isNotNull().alias("measured_record_present"),
        (is_finite("expected") & is_finite("measured")).alias("finite_pair"))


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def check_unique(df: DataFrame, keys, what: str) -> None:
    if duplicate_keys(df, keys).limit(1).collect():
        raise ValueError(f"{what}: duplicate keys {list(keys)}")


def annotate(pairs: DataFrame, notes: DataFrame, column: str, keys) -> DataFrame:
    """Attach a label or mask by exact key; label-level notes reach every device."""
    return pairs.join(notes.select(*keys, column), list(keys), "left")


def uncovered(pairs: DataFrame, notes: DataFrame, keys) -> DataFrame:
    """Pair keys without an annotation; must be empty before use."""
    return pairs.select(*keys).distinct().join(notes.select(*keys), list(keys), "left_anti")


def check_covered(pairs, notes, keys) -> None:
    if uncovered(pairs, notes, keys).limit(1).collect():
        raise ValueError("labels or masks must cover every key; none is inferred")


def period_from_masks(masks: DataFrame, names) -> DataFrame:
    """Exclusive period label per key; ``overlaps`` counts masks that hold at once."""
    label = F.lit("unlabelled")
    for n in reversed(list(names)):
        label = F.when(F.col(n), F.lit(n)).otherwise(label)
    return masks.withColumn("period_label", label).withColumn(
        "overlaps", sum((F.col(n).cast("int") for n in names), F.lit(0)))


def check_exclusive(masks: DataFrame, names) -> DataFrame:
    labelled = period_from_masks(masks, names)
    if labelled.where(F.col("overlaps") > 1).limit(1).collect():
        raise ValueError("period masks overlap")
    return labelled.drop("overlaps")


def counted_metrics(pairs: DataFrame, groups, normalization: Normalization | None = None) -> DataFrame:
    """Population counts and error metrics per group.

    Expects ``expected, measured, finite_pair, valid_pair`` and the record marks.
    """
    p = Pair("expected", "measured", F.col("valid_pair"))
    total = F.count(F.lit(1))
    cols = [
        total.alias("total_samples"), p.count().alias("valid_paired_samples"),
        (total - p.count()).alias("excluded_samples"),
        count_if(F.col("finite_pair")).alias("finite_paired_samples"),
        count_if(~F.col("finite_pair")).alias("missing_or_nonfinite_samples"),
        count_if(F.col("finite_pair") & ~F.col("valid_pair")).alias("excluded_by_masks_samples"),
        count_if(~F.col("expected_record_present")).alias("missing_expected_records"),
        count_if(~F.col("measured_record_present")).alias("missing_measured_records"),
        p.mae().alias("mae"), p.rmse().alias("rmse"), p.mbe().alias("mbe"), p.r_squared().alias("r_squared"),
        F.when(p.count() > 0, "computed").otherwise("no valid pairs").alias("metric_status")]
    out = pairs.groupBy(*groups).agg(*cols)
    value = F.lit(normalization.value if normalization else None).cast("double")
    basis = F.lit(normalization.basis if normalization else None).cast("string")
    return (out.withColumn("normalized_mae", F.col("mae") / value).withColumn("normalized_rmse", F.col("rmse") / value)
            .withColumn("normalization_value", value).withColumn("normalization_basis", basis))


def validate(expected: DataFrame, measured: DataFrame, signals: dict, by_device: bool = True, normalizations=None,
             period_labels: DataFrame | None = None, period_masks: DataFrame | None = None, mask_names=(),
             periods=None, healthy: DataFrame | None = None, ts: str = "ts", unit: str = "inverter_id",
             checks: bool = True) -> ValidationResult:
    """Pair, select and score named signals.

    ``signals`` maps quantity -> (expected column, measured column, unit text).
    Annotations are DataFrames keyed by label, or by label and device.
    """
    if period_labels is not None and period_masks is not None:
        raise ValueError("give period labels or period masks, not both")
    if periods is not None and period_labels is None and period_masks is None:
        raise ValueError("selecting periods needs labels or masks")
    normalizations = normalizations or {}
    if set(normalizations) - set(signals):
        raise ValueError("a normalisation names an unknown signal")
    keys = [ts, unit] if by_device else [ts]
    if checks:
        check_unique(expected, keys, "expected")
        check_unique(measured, keys, "measured")
    table = metrics = None
    for quantity, (e, m, unit_text) in signals.items():
        pairs = pair_keys(expected, measured, keys, e, m)
        chosen, well = F.lit(True), F.lit(True)
        if period_labels is not None or period_masks is not None:
            notes = period_labels if period_labels is not None else (
                check_exclusive(period_masks, mask_names) if checks else period_from_masks(period_masks, mask_names))
            on = [k for k in keys if k in notes.columns]
            if checks:
                check_covered(pairs, notes, on)
            pairs = annotate(pairs, notes, "period_label", on)
            if periods is not None:
                chosen = F.col("period_label").isin(*periods)
        else:
            pairs = pairs.withColumn("period_label", F.lit("unlabelled"))
        if healthy is not None:
            on = [k for k in keys if k in healthy.columns]
            if checks:
                check_covered(pairs, healthy, on)
            pairs = annotate(pairs, healthy, "healthy", on)
            well = F.col("healthy")
        else:
            pairs = pairs.withColumn("healthy", F.lit(True))
        pairs = pairs.withColumn("valid_pair", F.col("finite_pair") & chosen & well)
        pairs = pairs.withColumn("residual", F.when(F.col("finite_pair"), F.col("measured") - F.col("expected")))
        pairs = pairs.withColumn("quantity", F.lit(quantity)).withColumn("unit", F.lit(unit_text))
        groups = ["quantity", "unit", unit] if by_device else ["quantity", "unit"]
        scored = counted_metrics(pairs, groups, normalizations.get(quantity))
        table = pairs if table is None else table.unionByName(pairs)
        metrics = scored if metrics is None else metrics.unionByName(scored)
    return ValidationResult(table, metrics)


def validate_dc(expected, measured, **options) -> ValidationResult:
    return validate(expected, measured, {
        "dc_voltage": ("expected_dc_voltage", "measured_dc_voltage", "V"),
        "dc_current": ("expected_dc_current", "measured_dc_current", "A"),
        "dc_power": ("expected_dc_power", "measured_dc_power", "W")}, True, **options)


def validate_inverter_ac(expected, measured, **options) -> ValidationResult:
    return validate(expected, measured, {"ac_power": ("expected_ac_power", "measured_ac_power", "W")}, True, **options)


def validate_plant_ac(expected, measured, **options) -> ValidationResult:
    return validate(expected, measured,
                    {"plant_ac_power": ("expected_plant_ac_power", "measured_meter_power", "W")}, False, **options)


def in_populations(df: DataFrame, masks: dict) -> DataFrame:
    """Repeat each row once per population it belongs to."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in masks.items()]))
    return df.withColumn("population", F.explode(names))


def population_metrics(df: DataFrame, expected: str, measured: str, masks: dict, groups=()) -> DataFrame:
    """Metrics of overlapping populations in one pass, no row repeated."""
    cols, names = [], list(masks)
    for n, c in masks.items():
        p = Pair(expected, measured, c)
        inside = count_if(F.coalesce(c, F.lit(False)))
        cols.append(F.struct(F.lit(n).alias("population"), inside.alias("total"), p.count().alias("n"),
                             (inside - p.count()).alias("excluded"), p.mae().alias("mae"), p.rmse().alias("rmse"),
                             p.mbe().alias("mbe"), p.r_squared().alias("r_squared")).alias(f"__p{names.index(n)}"))
    out = df.groupBy(*groups).agg(*cols)
    return out.select(*groups, F.explode(F.array(*[f"__p{i}" for i in range(len(names))])).alias("p")).select(*groups, "p.*")


def partial_sums(df: DataFrame, expected: str, measured: str, groups) -> DataFrame:
    """Mergeable error sums per group."""
    return df.groupBy(*groups).agg(*Pair(expected, measured).sums())


def merge_sums(sums: DataFrame, groups=()) -> DataFrame:
    """Metrics of pooled groups out of their partial sums."""
    return sums.groupBy(*groups).agg(*metrics_from_sums())


SCALES = ("hour", "day", "month")


def complete_scales(intervals: DataFrame, scale, expected: str, measured: str, clear: str, ts: str = "ts",
                    per_hour: int = 4) -> DataFrame:
    """Quarter-hour averages to hour, day or month; several scales share one pass.

    Totals exist only for complete bins; the ``observed_*`` and ``paired_*``
    columns use exactly the pairs at hand. Bins without a row are emitted too.
    With a list of scales the result carries a ``scale`` column.
    """
    from .timeline import grid

    scales = [scale] if isinstance(scale, str) else list(scale)
    starts = {"hour": lambda c: clock.floor_to(c, 60), "day": clock.day_start, "month": clock.month_start}
    e, m = finite(expected), finite(measured)
    both = e.isNotNull() & m.isNotNull()
    pe, pm = F.when(both, e), F.when(both, m)
    tags = F.array(*[F.struct(F.lit(s).alias("scale"), starts[s](F.col(ts)).alias("bin")) for s in scales])
    rows = intervals.select(e.alias("e"), m.alias("m"), pe.alias("pe"), pm.alias("pm"), F.col(clear).alias("q"), F.inline(tags))
    bins = rows.groupBy("scale", "bin").agg(
        F.avg("e").alias("__e"), F.avg("m").alias("__m"), F.count("pe").alias("valid_intervals"),
        F.avg("pe").alias("paired_expected_kw"), F.avg("pm").alias("paired_measured_kw"),
        F.sum("pe").alias("__se"), F.sum("pm").alias("__sm"), F.bool_and("q").alias("qc_clear"))
    span = intervals.agg(F.min(ts).alias("a"), F.max(ts).alias("z"))
    steps = None
    for s in scales:
        ends = span.select(starts[s](F.col("a")).alias("a"), starts[s](F.col("z")).alias("z"))
        if s == "month":
            months = F.sequence(F.col("a").cast("date"), F.col("z").cast("date"), F.expr("interval 1 month"))
            part = ends.select(F.explode(months).alias("m")).select(F.col("m").cast("timestamp_ntz").alias("bin"))
        else:
            part = grid(ends, "a", "z", 3600 if s == "hour" else 86400, "bin")
        part = part.withColumn("scale", F.lit(s))
        steps = part if steps is None else steps.unionByName(part)
    out = steps.join(bins, ["scale", "bin"], "left").withColumn("valid_intervals", F.coalesce("valid_intervals", F.lit(0)))
    need = (F.when(F.col("scale") == "hour", F.lit(per_hour)).when(F.col("scale") == "day", F.lit(per_hour * 24))
            .otherwise(F.dayofmonth(F.last_day(F.col("bin").cast("date"))) * per_hour * 24))
    out = out.withColumn("required_intervals", need.cast("long"))
    full = F.col("valid_intervals") == F.col("required_intervals")
    hours = F.col("required_intervals") / per_hour
    named = [] if isinstance(scale, str) else ["scale"]
    return out.select(
        *named, "bin", "valid_intervals", "required_intervals",
        (F.col("valid_intervals") / F.col("required_intervals")).alias("coverage"),
        full.alias("complete"), F.coalesce("qc_clear", F.lit(True)).alias("qc_clear"),
        F.when(full, F.col("__e")).alias("expected_kw"), F.when(full, F.col("__m")).alias("measured_kw"),
        F.when(full, F.col("__e") * hours).alias("expected_kwh"), F.when(full, F.col("__m") * hours).alias("measured_kwh"),
        "paired_expected_kw", "paired_measured_kw",
        (F.col("__se") / per_hour).alias("observed_expected_kwh"), (F.col("__sm") / per_hour).alias("observed_measured_kwh"),
        F.when(full, F.col("__m") - F.col("__e")).alias("residual_kw"))
