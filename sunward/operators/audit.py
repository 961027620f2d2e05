"""Structural and statistical audits of raw channels."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import clock
from ..functions.binning import equal_width_bin
from ..functions.values import INFINITY, beside, circular_difference, count_if, finite, is_finite
from .ordered import TIME_WIDTHS, condition_runs, islands, neighbours, numbered, with_quantiles

# Fixed patterns: channel names look like inv_07_ac_power_inv_1234.
CHANNEL_PATTERN = r"^inv_(\d{2})_([a-z]+(?:_[a-z]+)*)_inv_(\d+)$"
TRAILING_NUMBER = r"(\d+)$"


def record_widths(lines: DataFrame, text: str = "value", separator: str = ",") -> DataFrame:
    """Fields per physical record with counts; an empty record has width 0."""
    width = F.when(F.length(F.trim(text)) == 0, 0).otherwise(F.size(F.split(text, separator, -1)))
    return lines.groupBy(width.alias("width")).agg(F.count(F.lit(1)).alias("records"))


def repeated(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def duplicate_rows(df: DataFrame, columns) -> DataFrame:
    """Exact duplicates beyond the first copy, by row digest."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    digests = df.select(F.sha2(text, 256).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("c"))
    return digests.agg(F.sum("c").alias("records"), F.sum(F.col("c") - 1).alias("duplicates"),
                       count_if(F.col("c") > 1).alias("repeated_digests"))


def parse_channels(names: DataFrame, name: str = "name") -> DataFrame:
    """Split channel names; ``canonical`` says whether the name rebuilds exactly."""
    unit, quantity, metric = (F.regexp_extract(name, CHANNEL_PATTERN, i) for i in (1, 2, 3))
    out = names.withColumn("inverter", F.when(unit != "", unit.cast("int")))
    out = out.withColumn("quantity", F.when(quantity != "", quantity))
    out = out.withColumn("metric_id", F.when(metric != "", metric.cast("long")))
    rebuilt = F.concat(F.lit("inv_"), F.lpad(F.col("inverter").cast("string"), 2, "0"), F.lit("_"),
                       F.col("quantity"), F.lit("_inv_"), F.col("metric_id").cast("string"))
    return out.withColumn("canonical", F.coalesce(rebuilt == F.col(name), F.lit(False)))


def channel_roster(parsed: DataFrame, quantities) -> DataFrame:
    """One row per inverter, the channel of each quantity, and what is wrong with it."""
    count = {q: count_if(F.col("quantity") == q) for q in quantities}
    return parsed.groupBy("inverter").agg(
        *[F.min(F.when(F.col("quantity") == q, F.col("name"))).alias(q) for q in quantities],
        sum((F.when(c == 0, 1).otherwise(0) for c in count.values()), F.lit(0)).alias("missing"),
        sum((F.when(c > 1, 1).otherwise(0) for c in count.values()), F.lit(0)).alias("duplicated"))


def check_roster(roster: DataFrame, allowed_missing: int = 0) -> DataFrame:
    """Raise when a channel is duplicated or more than the allowed number is absent."""
    bad = roster.where((F.col("duplicated") > 0) | (F.col("missing") > allowed_missing)).limit(5).collect()
    if bad:
        raise ValueError(f"inverters with missing or duplicate channels: {[r['inverter'] for r in bad]}")
    return roster


def metadata_conformance(channels: DataFrame, metrics: DataFrame, key: str, checks: dict) -> DataFrame:
    """Channels beside their metadata record; one Boolean per named check."""
    found = channels.join(metrics.withColumn("__found", F.lit(True)), key, "left")
    out = found.withColumn("in_metadata", F.coalesce("__found", F.lit(False))).drop("__found")
    for name, condition in checks.items():
        out = out.withColumn(name, F.coalesce(condition, F.lit(False)))
    return out


def check_units(conformance: DataFrame, checks) -> DataFrame:
    """Raise unless every channel passes every check."""
    bad = conformance.where(~F.expr(" AND ".join(f"`{c}`" for c in ["in_metadata", *checks]))).limit(5).collect()
    if bad:
        raise ValueError(f"units not confirmed, for example {bad[0].asDict()}")
    return conformance


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return (a.join(b, key, "left_anti").withColumn("side", F.lit("left_only"))
            .unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only"))))


def availability_crosstab(df: DataFrame, roster, unit: str, quantity: str, quantities) -> DataFrame:
    """Channels per unit and quantity (0, 1 or more) over the full roster."""
    base = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(u) for u in roster])).alias(unit))
    counts = df.groupBy(unit).pivot(quantity, list(quantities)).count()
    return base.join(counts, unit, "left").na.fill(0, list(quantities))


def dtype_report(df: DataFrame, columns) -> DataFrame:
    """How many values of each text column read as integer, double or timestamp."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.*")
    return long.groupBy("column").agg(
        F.count("v").alias("present"),
        F.count(F.try_to_number("v", F.lit("S999999999999999999"))).alias("integers"),
        F.count(F.expr("try_cast(v AS double)")).alias("doubles"),
        F.count(F.expr("try_cast(v AS timestamp_ntz)")).alias("timestamps"))


def token_report(df: DataFrame, text: str, keys=()) -> DataFrame:
    """Non-numeric tokens and infinities of a text column."""
    number = F.expr(f"try_cast(`{text}` AS double)")
    return df.groupBy(*keys).agg(
        F.count(text).alias("present"),
        count_if(F.col(text).isNotNull() & number.isNull()).alias("nonnumeric"),
        count_if(F.abs(number) == F.lit(INFINITY)).alias("infinite"))


def channel_stats(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Counts, extremes, mean, sample deviation, zeros, negatives and constancy."""
    v, f = F.col(value), finite(value)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.count(f).alias("finite"), count_if(v.isNull()).alias("missing"),
        F.min(f).alias("minimum"), F.max(f).alias("maximum"), F.avg(f).alias("mean"),
        F.stddev_samp(f).alias("std"), count_if(f == 0).alias("zeros"), count_if(f < 0).alias("negatives"),
        (F.count(f) == 0).alias("all_null"),
        F.coalesce(F.min(f) == F.max(f), F.lit(False)).alias("constant"))


def channel_quantiles(df: DataFrame, keys, probabilities, value: str = "value") -> DataFrame:
    """Exact quantiles per key beside the finite count."""
    rows = df.withColumn("__f", finite(value))
    counted = rows.groupBy(*keys).agg(F.count("__f").alias("finite"))
    wanted = {f"p{str(p).replace('.', '_')}": ("__f", p / 100.0) for p in probabilities}
    return with_quantiles(counted, rows, keys, wanted)


def threshold_counts(df: DataFrame, keys, value: str, tiny: float, high: float) -> DataFrame:
    """Tiny positives, values above a threshold, and copies of the maximum."""
    by_value = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    v, c = F.col(value), F.col("c")
    return by_value.groupBy(*keys).agg(
        F.sum(F.when((v > 0) & (v < tiny), c).otherwise(0)).alias("tiny_positive"),
        F.sum(F.when(v > high, c).otherwise(0)).alias("above_threshold"),
        F.max(value).alias("maximum"), F.max_by("c", v).alias("maximum_copies"))


def missing_runs(df: DataFrame, row: str, missing: Column, keys=(), widths=(100_000, 10_000_000)) -> DataFrame:
    """Missing runs in row order, row numbers being consecutive."""
    runs = condition_runs(df, keys, row, 1, missing, 1, widths)
    last = df.groupBy(*keys).agg(F.max(row).alias("last_row"))
    both = runs.join(last, list(keys)) if keys else beside(runs, last)
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), count_if(F.col("samples") == 1).alias("isolated"),
        count_if(F.col("samples") > 1).alias("blocks"), F.max("samples").alias("longest"),
        F.max(F.when(F.col("end") == F.col("last_row"), F.col("samples")).otherwise(0)).alias("trailing_run"),
        F.min("start").alias("first_row"), F.max("end").alias("last_missing_row"))


def timed_missing_runs(df: DataFrame, missing: Column, cadence: int, keys=(), ts: str = "ts") -> DataFrame:
    """Missing runs that also end where the clock jumps."""
    runs = condition_runs(df.withColumn("sec", clock.seconds(ts)), keys, "sec", cadence, missing)
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), count_if(F.col("samples") == 1).alias("isolated"),
        F.max("samples").alias("longest"), F.sum("samples").alias("missing"))


def outage_rows(df: DataFrame, unit: str, value: str, ts: str = "ts") -> DataFrame:
    """Labels at which every channel of a unit is missing, per unit."""
    state = df.groupBy(ts, unit).agg(F.bool_and(F.col(value).isNull()).alias("out"))
    return state.groupBy(unit).agg(F.count(F.lit(1)).alias("labels"), count_if(F.col("out")).alias("outage_labels"))


def missingness_rollup(df: DataFrame, unit: str, quantity: str, value: str) -> DataFrame:
    per = df.groupBy(unit, quantity).agg(F.count(F.lit(1)).alias("n"), count_if(F.col(value).isNull()).alias("m"))
    return per.groupBy(unit).agg(
        F.count(F.lit(1)).alias("channels"), F.sum("m").alias("missing"), F.max("m").alias("worst_channel_missing"),
        (100.0 * F.sum("m") / F.sum("n")).alias("missing_pct"))


def neighbourhood(df: DataFrame, chosen: DataFrame, row: str, reach: int, keys=()) -> DataFrame:
    """Rows within ``reach`` row numbers of each chosen row, by equi-join."""
    asked = chosen.select(*keys, F.col(row).alias("centre"),
                          F.explode(F.sequence(F.col(row) - reach, F.col(row) + reach)).alias(row))
    return asked.join(df, [*keys, row])


def extrema(df: DataFrame, keys, value: str, order: str, reach: int = 2, widths=(100_000, 10_000_000)) -> DataFrame:
    """Minimum and maximum per key with their neighbours in row order.

    ``ratio_to_p99`` divides the extreme by the 99th percentile of positive values.
    """
    keys = list(keys)
    rows = numbered(df.select(*keys, order, value), keys, order, "position", widths)
    first = F.struct(F.col(value), -F.col(order))
    low = df.groupBy(*keys).agg(F.min_by(order, F.struct(F.col(value), F.col(order))).alias(order)).withColumn(
        "extreme", F.lit("minimum"))
    high = df.groupBy(*keys).agg(F.max_by(order, first).alias(order)).withColumn("extreme", F.lit("maximum"))
    centres = rows.join(low.unionByName(high), [*keys, order])
    p99 = with_quantiles(df.select(*keys).distinct(), df.where(F.col(value) > 0), keys, {"p99": (value, 0.99)})
    asked = centres.select(*keys, "extreme", F.col(value).alias("extreme_value"), F.col("position").alias("centre"),
                           F.explode(F.sequence(F.col("position") - reach, F.col("position") + reach)).alias("position"))
    near = asked.join(rows, [*keys, "position"]).join(p99, keys)
    return near.select(*keys, "extreme", "extreme_value", (F.col("position") - F.col("centre")).alias("offset"),
                       F.col(order), F.col(value), (F.col("extreme_value") / F.col("p99")).alias("ratio_to_p99"))


def range_table(df: DataFrame, unit: str, quantity: str, quantities, value: str) -> DataFrame:
    """Minimum and maximum of each quantity, one row per unit."""
    return df.groupBy(unit).agg(
        *[fn(F.when(F.col(quantity) == q, finite(value))).alias(f"{q}_{name}")
          for q in quantities for name, fn in (("min", F.min), ("max", F.max))])


def joint_availability(df: DataFrame, columns) -> DataFrame:
    flags = [F.col(c).isNotNull().alias(f"has_{c}") for c in columns]
    return df.groupBy(*flags).agg(F.count(F.lit(1)).alias("records"))


def hourly_constancy(df: DataFrame, value: str, per_hour: int = 4, ts: str = "ts") -> DataFrame:
    """Complete hours, and those whose readings are all equal."""
    hours = df.groupBy(clock.floor_to(ts, 60).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("c"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    full = (F.col("n") == per_hour) & (F.col("c") == per_hour)
    return hours.agg(F.count(F.lit(1)).alias("hours"), count_if(full).alias("complete_hours"),
                     count_if(full & (F.col("lo") == F.col("hi"))).alias("constant_hours"))


def change_minutes(df: DataFrame, value: str, cadence: int, ts: str = "ts") -> DataFrame:
    """Minute of the hour at which an adjacent reading differs."""
    rows = neighbours(df.withColumn("sec", clock.seconds(ts)), [], "sec", ["sec", value])
    changed = (F.col("sec") - F.col("prev_sec") == cadence) & (F.col(value) != F.col(f"prev_{value}"))
    return rows.where(changed).groupBy(F.minute(ts).alias("minute")).agg(F.count(F.lit(1)).alias("changes"))


def constant_runs(df: DataFrame, value: str, cadence: int, minimum: int = 2, keys=(), ts: str = "ts") -> DataFrame:
    """Runs of one repeated value at exact cadence."""
    rows = df.where(F.col(value).isNotNull()).withColumn("sec", clock.seconds(ts))
    runs = islands(rows, [*keys, value], "sec", cadence).where(F.col("samples") >= minimum)
    return runs.select(*keys, value, clock.from_seconds("start").alias("start"),
                       clock.from_seconds("end").alias("end"), "samples")


def top_values(df: DataFrame, value: str, k: int = 10) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("records"))
    return counts.orderBy(F.desc("records"), value).limit(k)


def direction_changes(df: DataFrame, direction: str, cadence: int, ts: str = "ts") -> DataFrame:
    """Circular difference between exactly adjacent directions."""
    rows = neighbours(df.withColumn("sec", clock.seconds(ts)), [], "sec", ["sec", direction])
    near = F.col("sec") - F.col("prev_sec") == cadence
    return rows.select(ts, direction, F.when(near, circular_difference(direction, f"prev_{direction}")).alias("turn"))


def local_contrast(df: DataFrame, value: str, cadence: int, keys=(), ts: str = "ts") -> DataFrame:
    """Value minus the mean of its two neighbours, both exactly one cadence away."""
    rows = neighbours(df.withColumn("sec", clock.seconds(ts)), keys, "sec", ["sec", value])
    both = ((F.col("sec") - F.col("prev_sec") == cadence) & (F.col("next_sec") - F.col("sec") == cadence))
    mean = (F.col(f"prev_{value}") + F.col(f"next_{value}")) / 2.0
    return rows.select(*keys, ts, value, F.when(both, F.col(value) - mean).alias("contrast"))


def hour_profile(df: DataFrame, value: str, ts: str = "ts", keys=()) -> DataFrame:
    rows = df.withColumn("hour", F.hour(ts))
    group = [*keys, "hour"]
    base = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("records"), F.count(value).alias("present"),
                                    F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    return with_quantiles(base, rows, group, {"median": (value, 0.5)})


def night_summary(df: DataFrame, value: str, before_hour: int = 5, ts: str = "ts") -> DataFrame:
    v = F.col(value)
    return df.where(F.hour(ts) < before_hour).agg(
        F.count(F.lit(1)).alias("records"), F.count(v).alias("present"), count_if(v > 0).alias("positive"),
        count_if(v == 0).alias("zero"), count_if(v < 0).alias("negative"), F.max(v).alias("maximum"))


def night_dates(df: DataFrame, value: str, floor: float = 0.0, before_hour: int = 5, ts: str = "ts") -> DataFrame:
    """Dates with night readings above ``floor``: how many, and the largest one."""
    rows = df.where((F.hour(ts) < before_hour) & (F.col(value) > floor))
    rank = F.struct(F.col(value), -clock.seconds(ts))
    return rows.groupBy(F.col(ts).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("readings"), F.max(value).alias("largest"), F.max_by(ts, rank).alias("largest_at"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram over the observed range, last edge inclusive."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = beside(df, span)
    counted = rows.groupBy(equal_width_bin(value, "lo", "hi", bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("records"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select("bin", "records", (F.col("lo") + F.col("bin") * width).alias("left_edge"))


def complete_days(df: DataFrame, value: str, per_day: int, ts: str = "ts") -> DataFrame:
    days = df.groupBy(F.col(ts).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("records"), F.count(value).alias("present"), F.max(F.abs(value)).alias("largest"))
    full = (F.col("records") == per_day) & (F.col("present") == per_day)
    return days.select("day", "records", "present", full.alias("complete"),
                       (full & (F.col("largest") == 0)).alias("all_zero"))


def accumulation(df: DataFrame, value: str, keys=(), ts: str = "ts") -> DataFrame:
    """Does the channel behave like a counter? Rises, falls and within-day falls."""
    rows = neighbours(df.withColumn("sec", clock.seconds(ts)), keys, "sec", [ts, value])
    return accumulation_from(rows, value, keys, ts)


def accumulation_from(rows: DataFrame, value: str, keys=(), ts: str = "ts") -> DataFrame:
    """:func:`accumulation` over rows that already carry their predecessor."""
    v, p = F.col(value), F.col(f"prev_{value}")
    same = F.col(ts).cast("date") == F.col(f"prev_{ts}").cast("date")
    return rows.groupBy(*keys).agg(
        count_if(v > p).alias("increases"), count_if(v < p).alias("decreases"),
        count_if((v < p) & same).alias("within_day_decreases"), (count_if(v < p) == 0).alias("monotone"))


def unit_hypotheses(df: DataFrame, value: str, capacity: float) -> DataFrame:
    """Second-largest value read as average power and as energy per quarter hour."""
    top = df.where(F.col(value).isNotNull()).orderBy(F.desc(value)).limit(2)
    second = top.agg(F.min(value).alias("second_largest"))
    options = F.array(F.struct(F.lit("kW average").alias("hypothesis"), F.lit(1.0).alias("factor")),
                      F.struct(F.lit("kWh per 15 min").alias("hypothesis"), F.lit(4.0).alias("factor")))
    out = second.select("second_largest", F.inline(options))
    implied = F.col("second_largest") * F.col("factor")
    return out.select("hypothesis", "second_largest", implied.alias("implied_kw"),
                      (implied / capacity).alias("fraction_of_capacity"))


def review_candidates(selections: dict, row: str) -> DataFrame:
    """Union of labelled selections, one line per row with its labels."""
    out = None
    for label, df in selections.items():
        part = df.select(row, F.lit(label).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(row).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def trailing_number(name) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    digits = F.regexp_extract(c, TRAILING_NUMBER, 1)
    return F.when(digits != "", digits.cast("long"))
