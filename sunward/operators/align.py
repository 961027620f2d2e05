"""Exact, interval-anchored and bounded time joins.

Lookups are by exact label. The only inexact ones, the bounded backward
as-of join and the nearest join, cut time into buckets and equi-join on the
bucket, so no pair of rows outside one bucket is ever compared.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock
from ..functions.values import count_if, holds, is_finite


def exact_left(base: DataFrame, other: DataFrame, keys=("ts",)) -> DataFrame:
    """Left equi-join; base rows are all kept."""
    return base.join(other, list(keys), "left")


def interval_anchor(base: DataFrame, slow: DataFrame, minutes: int, ts: str = "ts") -> DataFrame:
    """Give each row the slow record labelled with its own interval start.

    An absent anchor leaves NULLs: nothing is carried across intervals.
    """
    anchored = base.withColumn("__anchor", clock.floor_to(ts, minutes))
    return anchored.join(slow.withColumnRenamed(ts, "__anchor"), "__anchor", "left").drop("__anchor")


def expand_interval(slow: DataFrame, offsets, ts: str = "ts") -> DataFrame:
    """Each slow record repeated at its label plus every offset in minutes."""
    shifts = F.array(*[F.lit(o) for o in offsets])
    out = slow.withColumn("__o", F.explode(shifts))
    return out.withColumn(ts, clock.shift(ts, F.col("__o"))).drop("__o")


def _tag(offset: int) -> str:
    return f"m{-offset}" if offset < 0 else f"p{offset}"


def offset_block(series: DataFrame, values, offsets, keys=(), ts: str = "ts") -> DataFrame:
    """``x(t + k)`` for several offsets ``k``: one row per anchor label reached.

    Instead of one self-join per offset, every reading is sent to the anchors
    it serves and the block is assembled by a single grouped shuffle.
    Columns are named ``<value>_p15`` / ``<value>_m15``.
    """
    sent = series.select(*keys, ts, *values, F.explode(F.array(*[F.lit(o) for o in offsets])).alias("__o"))
    sent = sent.withColumn(ts, clock.shift(ts, -F.col("__o")))
    return sent.groupBy(*keys, ts).agg(*[
        F.max(F.when(F.col("__o") == o, F.col(v))).alias(f"{v}_{_tag(o)}") for v in values for o in offsets])


def with_offsets(anchors: DataFrame, series: DataFrame, values, offsets, keys=(), ts: str = "ts") -> DataFrame:
    """Anchors widened by the exact offset lookups of another series."""
    return anchors.join(offset_block(series, values, offsets, keys, ts), [*keys, ts], "left")


def strict_mean(anchors: DataFrame, series: DataFrame, value: str, offsets, out: str, keys=(), ts: str = "ts"):
    """Mean over exact offsets, NULL unless every sample exists and none is repeated; plus the count of samples.

    An offset whose label stands twice in the series has no sample.
    """
    sent = series.select(*keys, ts, value, F.explode(F.array(*[F.lit(o) for o in offsets])).alias("__o"))
    sent = sent.withColumn(ts, clock.shift(ts, -F.col("__o")))
    v = F.when(is_finite(value), F.col(value))
    # per anchor the samples are at most the offsets and their repeats; each offset is told by its own column of counts
    single = [(F.count(F.when(F.col("__o") == o, F.lit(1))) == 1, F.max(F.when(F.col("__o") == o, v))) for o in offsets]
    block = sent.groupBy(*keys, ts).agg(F.array_compact(F.array(*[F.when(one, x) for one, x in single])).alias("__v"))
    block = block.select(*keys, ts, F.size("__v").cast("long").alias(f"{out}_samples"), F.aggregate("__v", F.lit(0.0), lambda a, x: a + x).alias("__s"))
    joined = anchors.join(block, [*keys, ts], "left")
    n = F.coalesce(F.col(f"{out}_samples"), F.lit(0))
    return (joined.withColumn(f"{out}_samples", n)
            .withColumn(out, F.when(n == len(offsets), F.col("__s") / len(offsets))).drop("__s"))


def meter_intervals(plant: DataFrame, meter: DataFrame, flagged: DataFrame, power: str, reading: str,
                    scale: float = 1000.0, offsets=(0, 5, 10)) -> DataFrame:
    """Meter intervals beside the strict mean of the model samples inside them."""
    out = strict_mean(meter, plant, power, offsets, "expected_kw")
    out = out.withColumn("expected_kw", F.col("expected_kw") / scale)
    marks = flagged.select("ts").distinct().withColumn("__f", F.lit(True))
    out = out.join(marks, "ts", "left").withColumn("meter_qc_clear", F.col("__f").isNull()).drop("__f")
    return out.withColumn("model_available", F.col("expected_kw_samples") == len(offsets)).withColumn(
        "residual_kw", F.col(reading) - F.col("expected_kw"))


def _reach(sec: Column, low: int, high: int, width: int) -> Column:
    """Buckets of the anchors a record at ``sec`` can serve."""
    return F.explode(F.sequence(F.floor((sec + low) / width), F.floor((sec + high) / width)))


def asof_backward(anchors: DataFrame, records: DataFrame, values, min_age: int = 15, max_age: int = 30,
                  ts: str = "ts") -> DataFrame:
    """Latest record whose age at the anchor lies in ``[min_age, max_age]`` minutes.

    Only distinct anchor labels enter the lookup; the answer is joined back
    on the exact label, so many rows sharing one label cost nothing extra.
    """
    width, lo, hi = max(max_age * 30, 300), min_age * 60, max_age * 60
    wanted = anchors.select(ts).distinct().withColumn("__t", clock.seconds(ts))
    wanted = wanted.withColumn("__b", F.floor(F.col("__t") / width))
    have = records.select(clock.seconds(ts).alias("__s"), *[F.col(v).alias(f"__v_{v}") for v in values])
    have = have.withColumn("__b", _reach(F.col("__s"), lo, hi, width))
    near = wanted.join(have, "__b").where((F.col("__t") - F.col("__s")).between(lo, hi))
    pack = F.struct(F.col("__s"), *[F.col(f"__v_{v}").alias(v) for v in values])
    best = near.groupBy(ts).agg(F.max_by(pack, F.col("__s")).alias("__r"))
    best = best.select(ts, clock.from_seconds(F.col("__r.__s")).alias("record_ts"), *[f"__r.{v}" for v in values])
    return anchors.join(best, ts, "left")


def nearest(anchors: DataFrame, records: DataFrame, values, tolerance_seconds: int = 450, ts: str = "ts") -> DataFrame:
    """Nearest record within a tolerance; the later one on a tie."""
    width = 2 * tolerance_seconds
    wanted = anchors.select(ts).distinct().withColumn("__t", clock.seconds(ts))
    wanted = wanted.withColumn("__b", F.floor(F.col("__t") / width))
    have = records.select(clock.seconds(ts).alias("__s"), *[F.col(v).alias(f"__v_{v}") for v in values])
    have = have.withColumn("__b", _reach(F.col("__s"), -tolerance_seconds, tolerance_seconds, width))
    gap = F.abs(F.col("__t") - F.col("__s"))
    near = wanted.join(have, "__b").where(gap <= tolerance_seconds)
    pack = F.struct(F.col("__s"), *[F.col(f"__v_{v}").alias(v) for v in values])
    best = near.groupBy(ts).agg(F.min_by(pack, F.struct(gap, -F.col("__s"))).alias("__r"))
    best = best.select(ts, clock.from_seconds(F.col("__r.__s")).alias("record_ts"), *[f"__r.{v}" for v in values])
    return anchors.join(best, ts, "left")


def key_differences(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Counts of keys on both sides, and on one side only."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    return both.agg(
        count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("shared"),
        count_if(F.col("__r").isNull()).alias("left_only"), count_if(F.col("__l").isNull()).alias("right_only"))


def check_same_keys(left: DataFrame, right: DataFrame, keys) -> None:
    row = key_differences(left, right, keys).first()
    if row["left_only"] or row["right_only"]:
        raise ValueError(f"tables are not aligned: {row.asDict()}")


def unequal_labels(left: DataFrame, right: DataFrame, keys, columns) -> DataFrame:
    """Per column, how many keys disagree between two saved tables (NULL-safe)."""
    b = right.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__r"))
    both = left.withColumn("__l", F.lit(True)).join(b, list(keys), "full_outer")
    paired = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return both.agg(
        count_if(paired).alias("paired"), count_if(~paired).alias("unpaired"),
        *[count_if(paired & ~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(f"unequal_{c}") for c in columns])


def matched_to_reference(bins: DataFrame, keys, period: str, reference) -> DataFrame:
    """Bins of every other period beside the same bins of the reference period."""
    values = [c for c in bins.columns if c not in (*keys, period)]
    ref = bins.where(F.col(period) == reference).select(*keys, *[F.col(v).alias(f"{v}_reference") for v in values])
    return bins.where(F.col(period) != reference).join(ref, list(keys))


def relative_to_reference(df: DataFrame, keys, value: str, is_reference: Column, out: str, scale: float = 100.0):
    """Value over the mean of the same unit's reference rows."""
    ref = df.where(is_reference).groupBy(*keys).agg(F.avg(value).alias("__ref"))
    return df.join(ref, list(keys), "left").withColumn(out, scale * F.col(value) / F.col("__ref")).drop("__ref")


def semi(df: DataFrame, times: DataFrame, ts: str = "ts") -> DataFrame:
    return df.join(times.select(ts).distinct(), ts, "left_semi")


def anti(df: DataFrame, times: DataFrame, ts: str = "ts") -> DataFrame:
    return df.join(times.select(ts).distinct(), ts, "left_anti")


def event_context(ledger: DataFrame, sources: dict, ts: str = "ts") -> DataFrame:
    """QC events with the reading every source has at the same label."""
    out = ledger
    for name, (df, value) in sources.items():
        out = out.join(df.select(ts, F.col(value).alias(name)), ts, "left")
    return out


def peer_range(ledger: DataFrame, readings: DataFrame, unit: str, value: str, ts: str = "ts") -> DataFrame:
    """Per event, the range of the other units at its label.

    Per label the two lowest and two highest units suffice to leave out any
    one unit, so a label is a fixed-size summary and peers are never paired up.
    """
    v = F.col(value)
    ranked = readings.where(v.isNotNull()).groupBy(ts, unit).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    low1 = ranked.groupBy(ts).agg(
        F.min(F.struct("lo", unit)).alias("low"), F.max(F.struct("hi", unit)).alias("high"))
    rest = ranked.join(low1, ts)
    low2 = rest.groupBy(ts).agg(
        F.first("low").alias("low"), F.first("high").alias("high"),
        F.min(F.when(F.col(unit) != F.col(f"low.{unit}"), F.col("lo"))).alias("second_low"),
        F.max(F.when(F.col(unit) != F.col(f"high.{unit}"), F.col("hi"))).alias("second_high"))
    out = ledger.join(low2, ts, "left")
    lowest = F.when(F.col(unit) == F.col(f"low.{unit}"), F.col("second_low")).otherwise(F.col("low.lo"))
    highest = F.when(F.col(unit) == F.col(f"high.{unit}"), F.col("second_high")).otherwise(F.col("high.hi"))
    return out.withColumn("peer_min", lowest).withColumn("peer_max", highest).drop(
        "low", "high", "second_low", "second_high")


def align_sources(base: DataFrame, power: DataFrame, poa: DataFrame, environment: DataFrame, ledgers: dict,
                  slow_minutes: int = 15, window: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """The aligned model table: every base label inside the common window, once.

    ``power`` holds the strict fleet sum per label; ``ledgers`` maps a flag
    column to its QC ledger.
    """
    from .quality import availability_flags, flag_membership

    rows = base.select(ts).distinct()
    if window is not None:
        rows = rows.join(F.broadcast(window), F.col(ts).between(F.col("first"), F.col("last"))).select(ts)  # one row
    out = exact_left(exact_left(rows, power), poa)
    out = interval_anchor(out, environment, slow_minutes, ts)
    env = [c for c in environment.columns if c != ts]
    irradiance = [c for c in poa.columns if c != ts][0]
    total = [c for c in power.columns if c != ts][0]
    out = availability_flags(out, irradiance, env, total)
    for name, ledger in ledgers.items():
        out = flag_membership(out, ledger, name, ts)
    return out.withColumn("dst_fall_ambiguous", clock.fall_ambiguous(ts))
