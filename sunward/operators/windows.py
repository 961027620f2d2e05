"""Neighbour, rank and selection operators built on chunked ordering."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import clock
from ..functions.values import holds, strict_greatest
from .align import _tag, offset_block
from .ordered import TIME_WIDTHS, exact_quantiles, islands, join_null_safe, neighbours, numbered


def adjacent(df: DataFrame, value: str, cadence: int = 300, keys=(), ts: str = "ts") -> DataFrame:
    """Previous and next value, only where the neighbouring label is exactly one cadence away."""
    rows = neighbours(df.withColumn("__s", clock.seconds(ts)), keys, "__s", ["__s", value])
    before = F.when(F.col("__s") - F.col("prev___s") == cadence, F.col(f"prev_{value}"))
    after = F.when(F.col("next___s") - F.col("__s") == cadence, F.col(f"next_{value}"))
    return rows.withColumn(f"prev_{value}", before).withColumn(f"next_{value}", after).drop("__s", "prev___s", "next___s")


def relative_ramp(df: DataFrame, value: str, out: str, cadence: int = 300, keys=(), ts: str = "ts") -> DataFrame:
    """Largest relative change to the two exact neighbours; NULL at gaps and endpoints."""
    rows = adjacent(df, value, cadence, keys, ts)
    v = F.col(value)
    base = F.when(v != 0, v)
    up, down = F.abs(v - F.col(f"prev_{value}")) / base, F.abs(v - F.col(f"next_{value}")) / base
    return rows.withColumn(out, strict_greatest(up, down)).drop(f"prev_{value}", f"next_{value}")


def consensus(df: DataFrame, value: str, expected_units: int, out: str, keys=("ts",)) -> DataFrame:
    """Median, extremes and largest relative deviation from the median across the units of a label.

    The largest deviation follows from minimum, median and maximum, so one
    grouped pass is enough. NULL unless every unit reported.
    """
    v = F.col(value)
    full = F.count(v) == expected_units
    med, lo, hi = F.median(v), F.min(v), F.max(v)
    dev = F.when(full & (med > 0), F.greatest(hi - med, med - lo) / F.when(med > 0, med))
    return df.groupBy(*keys).agg(
        F.when(full, med).alias(f"{out}_median"), F.when(full, lo).alias(f"{out}_min"), F.when(full, hi).alias(f"{out}_max"),
        dev.alias(f"{out}_deviation"))


def persistent_jumps(months: DataFrame, unit: str, value: str, usable: Column, shift: float = .10, spread: float = .05,
                     month: str = "month") -> DataFrame:
    """Two-month levels before and after each month that differ and are each stable.

    Works on a dense month grid per unit, so an absent month never counts as adjacent.
    """
    rows = months.select(unit, F.col(month).cast("date").alias("boundary"), F.when(holds(usable), F.col(value)).alias("__v"))
    span = rows.groupBy(unit).agg(F.min("boundary").alias("__a"), F.max("boundary").alias("__z"))
    dense = span.select(unit, F.explode(F.sequence("__a", "__z", F.expr("interval 1 month"))).alias("boundary"))
    dense = dense.join(rows, [unit, "boundary"], "left")
    w = W.partitionBy(unit).orderBy("boundary")
    for name, c in (("__b2", F.lag("__v", 2)), ("__b1", F.lag("__v", 1)), ("__a2", F.lead("__v", 1))):
        dense = dense.withColumn(name, c.over(w))
    before, after = (F.col("__b2") + F.col("__b1")) / 2, (F.col("__v") + F.col("__a2")) / 2
    wide = F.greatest(F.abs(F.col("__b2") - F.col("__b1")), F.abs(F.col("__v") - F.col("__a2")))
    known = F.col("__b2").isNotNull() & F.col("__b1").isNotNull() & F.col("__v").isNotNull() & F.col("__a2").isNotNull()
    out = dense.select(unit, "boundary", before.alias("level_before"), after.alias("level_after"),
                       (after - before).alias("shift"), wide.alias("__w"), known.alias("__k"))
    return out.where(F.col("__k") & (F.abs("shift") >= shift) & (F.col("__w") <= spread)).drop("__w", "__k")


def alternate_dates(df: DataFrame, ts: str = "ts", keys=()) -> DataFrame:
    """Every second date of each month held out: ``split`` is selection or validation."""
    days = df.select(*keys, F.col(ts).cast("date").alias("__day")).distinct()
    w = W.partitionBy(*keys, F.trunc("__day", "month")).orderBy("__day")
    days = days.withColumn("split", F.when((F.row_number().over(w) - 1) % 2 == 0, "selection").otherwise("validation"))
    return df.withColumn("__day", F.col(ts).cast("date")).join(days, [*keys, "__day"]).drop("__day")


def peer_normalised(df: DataFrame, value: str, period: str, out: str, scale: float = 100.0) -> DataFrame:
    """Value over the median of all units in the same period.

    The median is exact and bracketed first, so no period's values are gathered in one place.
    """
    mid = exact_quantiles(df, [period], {"__m": (value, .5)})
    return join_null_safe(df, mid, [period]).withColumn(out, scale * F.col(value) / F.col("__m")).drop("__m")


def run_edges(df: DataFrame, value: str, condition: Column, cadence: int, keys=(), ts: str = "ts") -> DataFrame:
    """First and last value of every run of a condition."""
    rows = df.withColumn("__s", clock.seconds(ts))
    runs = islands(rows.where(holds(condition)), keys, "__s", cadence)
    edge = rows.select(*keys, "__s", value)
    first = edge.withColumnRenamed("__s", "start").withColumnRenamed(value, f"first_{value}")
    last = edge.withColumnRenamed("__s", "end").withColumnRenamed(value, f"last_{value}")
    out = runs.join(first, [*keys, "start"]).join(last, [*keys, "end"])
    return out.select(*keys, clock.from_seconds("start").alias("start"), clock.from_seconds("end").alias("end"), "samples",
                      f"first_{value}", f"last_{value}")


def ramp_pairs(df: DataFrame, poa: str, response: str, valid: str, offsets, minimum: float, floor: float = 100.0,
               cadence_minutes: int = 5, ts: str = "ts") -> DataFrame:
    """Changes of response and of irradiance at several offsets, on identical support."""
    c = cadence_minutes
    reach = sorted({*offsets, *[o - c for o in offsets]})
    light = offset_block(df.select(ts, F.col(poa).alias("__p")), ["__p"], reach, (), ts)
    own = df.select(ts, F.when(F.col(valid), F.col(response)).alias("__r"))
    prior = offset_block(own, ["__r"], [-c], (), ts)
    wide = df.join(light, ts).join(prior, ts)
    delta = F.col(response) - F.col(f"__r_{_tag(-c)}")
    ok = F.col(valid) & (F.abs(delta) >= minimum)
    for o in offsets:
        ok = ok & (F.col(f"__p_{_tag(o)}") >= floor) & (F.col(f"__p_{_tag(o - c)}") >= floor)
    cols = [(F.col(f"__p_{_tag(o)}") - F.col(f"__p_{_tag(o - c)}")).alias(f"poa_change_{_tag(o)}") for o in offsets]
    return wide.where(holds(ok)).select(ts, delta.alias("electrical_change"), *cols)


def early_stopping(history: DataFrame, trial: str, epoch: str, error: str, minimum_delta: float) -> DataFrame:
    """Best epoch, its error and stale epochs since, folding each trial's short history in order."""
    state = F.struct(F.lit(0).cast("long").alias("selected"), F.lit(float("inf")).alias("best"), F.lit(0).cast("long").alias("stale"))
    steps = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("long").alias("epoch"), F.col(error).alias("error"))))

    def fold(s, x):
        better = s["best"] - x["error"] >= minimum_delta
        return F.struct(F.when(better, x["epoch"]).otherwise(s["selected"]).alias("selected"),
                        F.when(better, x["error"]).otherwise(s["best"]).alias("best"),
                        F.when(better, F.lit(0).cast("long")).otherwise(s["stale"] + 1).alias("stale"))

    grouped = history.groupBy(trial).agg(steps.alias("__h"))
    return grouped.select(trial, F.aggregate("__h", state, fold).alias("s")).select(trial, "s.*")


def sorted_by(df: DataFrame, keys, tie_break) -> DataFrame:
    """Total order: the sort keys, then a unique tie-break."""
    return df.orderBy(*keys, *tie_break)


def largest(df: DataFrame, order, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def largest_per(df: DataFrame, keys, order, k: int) -> DataFrame:
    """First ``k`` rows per key; the rank filter is pushed below the shuffle by Spark."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def arg_extreme(df: DataFrame, keys, value: str, tie: str, highest: bool = True) -> DataFrame:
    """Whole row of the extreme value per key, ties by the smaller ``tie``."""
    pack = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    rank = F.struct(F.col(value) if not highest else -F.col(value), F.col(tie))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(pack, rank).alias("__r")).select(*keys, "__r.*")


def best_candidate(df: DataFrame, keys, error: str, order: str) -> DataFrame:
    """Lowest error, the earlier candidate on a tie."""
    pack = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.min_by(pack, F.struct(F.col(error), F.col(order))).alias("__r")).select(*keys, "__r.*")


def every_nth(df: DataFrame, order: str, step: int, keys=(), widths=TIME_WIDTHS) -> DataFrame:
    """Systematic sample: rows 0, step, 2 step ... of each key."""
    return numbered(df, keys, order, "__n", widths).where(F.col("__n") % step == 0).drop("__n")


def histogram_mode(df: DataFrame, keys, value: str, width: float) -> DataFrame:
    """Fullest bin per key; the lower bin on a tie."""
    bins = df.where(F.col(value).isNotNull()).groupBy(*keys, (F.floor(F.col(value) / width) * width).cast("double").alias("bin")).agg(
        F.count(F.lit(1)).alias("records"))
    return bins.groupBy(*keys).agg(F.max_by("bin", F.struct("records", -F.col("bin"))).alias("bin"), F.max("records").alias("records"))


def busiest_day(df: DataFrame, condition: Column, ts: str = "ts", keys=()) -> DataFrame:
    """Date with most qualifying rows, the earliest on a tie."""
    days = df.where(holds(condition)).groupBy(*keys, F.col(ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("records"))
    rank = F.struct("records", -F.date_diff("day", F.lit("1970-01-01").cast("date")))
    return days.groupBy(*keys).agg(F.max_by("day", rank).alias("day"), F.max("records").alias("records"))


def middle_complete_day(df: DataFrame, per_day: int, ts: str = "ts") -> DataFrame:
    """The middle one among days with every label present."""
    days = df.groupBy(F.col(ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == per_day)
    all_days = days.agg(F.array_sort(F.collect_list("day")).alias("d"))  # one entry per calendar day
    return all_days.select(F.get("d", F.floor(F.size("d") / 2).cast("int")).alias("day"), F.size("d").alias("complete_days")).where(
        "complete_days > 0")
