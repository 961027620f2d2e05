"""Timestamps, grids, gaps, daylight-saving days and runs.

Series arguments are DataFrames with a ``ts`` column (TIMESTAMP_NTZ, unique
within ``keys``). Cadences are in seconds.
"""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import clock
from ..functions.values import beside, count_if
from .ordered import TIME_WIDTHS, condition_runs, neighbours

DAY = 86400


def strict_parse(df: DataFrame, text: str, pattern: str = "yyyy-MM-dd HH:mm:ss", out: str = "ts") -> DataFrame:
    """Parse with one fixed pattern; anything else becomes NULL, never a guess."""
    return df.withColumn(out, F.try_to_timestamp(F.col(text), F.lit(pattern)).cast("timestamp_ntz"))


def parse_report(df: DataFrame, text: str, parsed: str = "ts") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        count_if(F.col(parsed).isNotNull()).alias("parsed"),
        count_if(F.col(text).isNotNull() & F.col(parsed).isNull()).alias("failed"),
        F.min(parsed).alias("first"), F.max(parsed).alias("last"))


def order_report(df: DataFrame, row: str, ts: str = "ts", widths=(100_000, 10_000_000)) -> DataFrame:
    """Monotonic / strictly increasing / duplicates, in the order of an explicit row number."""
    steps = neighbours(df.select(row, ts), [], row, [ts], widths)
    flow = steps.agg(
        count_if(F.col(ts) < F.col(f"prev_{ts}")).alias("backward_steps"),
        count_if(F.col(ts) == F.col(f"prev_{ts}")).alias("equal_steps"))
    dup = df.groupBy(ts).agg(F.count(F.lit(1)).alias("c")).agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_labels"))
    return (beside(flow, dup).withColumn("is_monotonic", F.col("backward_steps") == 0)
            .withColumn("is_strict", (F.col("backward_steps") == 0) & (F.col("equal_steps") == 0)))


def check_timestamp_basis(df: DataFrame, ts: str, basis: str) -> DataFrame:
    """Refuse a label column whose type contradicts the declared basis."""
    wanted = {"aware": T.TimestampType, "wall_clock": T.TimestampNTZType}
    if basis not in wanted:
        raise ValueError(f"unknown timestamp basis: {basis}")
    if not isinstance(df.schema[ts].dataType, wanted[basis]):
        raise ValueError(f"{ts} is {df.schema[ts].dataType.simpleString()}, not {basis}")
    return df


def with_steps(df: DataFrame, keys=(), ts: str = "ts", carry=()) -> DataFrame:
    """Add ``step``: seconds since the previous label of the key."""
    out = neighbours(df.withColumn("sec", clock.seconds(ts)), keys, "sec", ["sec", *carry])
    return out.withColumn("step", F.col("sec") - F.col("prev_sec"))


def interval_histogram(df: DataFrame, keys=(), ts: str = "ts") -> DataFrame:
    """Interval lengths with counts and shares."""
    steps = with_steps(df.select(*keys, ts), keys, ts).where(F.col("step").isNotNull())
    counts = steps.groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("intervals"))
    total = counts.groupBy(*keys).agg(F.sum("intervals").alias("all"))
    joined = counts.join(total, list(keys)) if keys else beside(counts, total)
    return joined.select(*keys, "step", "intervals", (F.col("intervals") / F.col("all")).alias("share"))


def modal_interval(df: DataFrame, keys=(), ts: str = "ts") -> DataFrame:
    """Most frequent interval; the smaller one on a tie."""
    rank = F.struct(-F.col("intervals"), F.col("step"))
    return interval_histogram(df, keys, ts).groupBy(*keys).agg(
        F.min_by("step", rank).alias("step"), F.max("intervals").alias("intervals"))


def gaps(df: DataFrame, cadence: int, keys=(), ts: str = "ts") -> DataFrame:
    """Intervals longer than the cadence, absent slots between, grid conformity."""
    steps = with_steps(df.select(*keys, ts), keys, ts, [ts]).where(F.col("step") > cadence)
    return steps.select(
        *keys, F.col(f"prev_{ts}").alias("gap_start"), F.col(ts).alias("gap_end"), "step",
        (F.ceil(F.col("step") / cadence) - 1).alias("absent_slots"),
        (F.pmod(F.col("step"), F.lit(cadence)) == 0).alias("on_grid"))


def irregular(df: DataFrame, cadence: int, keys=(), ts: str = "ts") -> DataFrame:
    steps = with_steps(df.select(*keys, ts), keys, ts, [ts]).where(F.col("step") != cadence)
    return steps.select(*keys, f"prev_{ts}", ts, "step")


def dst_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Transition days of every year that occurs in the data."""
    years = df.select(F.year(ts).alias("year")).distinct()
    return years.select("year", clock.nth_sunday(F.col("year"), 3, 2).alias("spring_forward"),
                        clock.nth_sunday(F.col("year"), 11, 1).alias("fall_back"))


def dst_day_audit(df: DataFrame, cadence: int, ts: str = "ts") -> DataFrame:
    """Per transition day: rows, rows in the critical hour, duplicates, irregular steps.

    Transition days are recognised by arithmetic on the label, so only their
    rows reach the shuffle; a day is one chunk of the ordered axis.
    """
    day = F.col(ts).cast("date")
    kind = (F.when(day == clock.spring_date(ts), "spring").when(day == clock.fall_date(ts), "fall"))
    rows = df.select(ts).withColumn("kind", kind).where(F.col("kind").isNotNull())
    labels = rows.groupBy(ts, "kind").agg(F.count(F.lit(1)).alias("copies"))
    steps = with_steps(labels, ["kind"], ts)
    same_day = F.col("sec") - F.col("prev_sec") < DAY
    critical = F.hour(ts) == F.when(F.col("kind") == "spring", 2).otherwise(1)
    return steps.groupBy(F.col(ts).cast("date").alias("day"), "kind").agg(
        F.sum("copies").alias("records"),
        F.sum(F.when(critical, F.col("copies")).otherwise(0)).alias("critical_hour_records"),
        F.sum(F.col("copies") - 1).alias("duplicate_labels"),
        count_if(same_day & (F.col("step") != cadence)).alias("irregular_steps"))


def bounds(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


def grid(limits: DataFrame, first, last, cadence: int, ts: str = "ts", keep=()) -> DataFrame:
    """Every slot from ``first`` to ``last`` inclusive, per row of ``limits``.

    Expanded by day and then by slot, so no row ever carries a long array.
    """
    lo, hi = clock.seconds(first), clock.seconds(last)
    days = limits.select(*keep, lo.alias("__lo"), hi.alias("__hi")).withColumn(
        "__d", F.explode(F.sequence(F.floor(F.col("__lo") / DAY), F.floor(F.col("__hi") / DAY))))
    floor_ = F.col("__lo") + F.ceil(F.greatest(F.col("__d") * DAY - F.col("__lo"), F.lit(0)) / cadence) * cadence
    top = F.least(F.col("__hi"), (F.col("__d") + 1) * DAY - 1)
    days = days.withColumn("__a", floor_.cast("long")).withColumn("__z", top.cast("long"))
    slots = days.where(F.col("__a") <= F.col("__z")).withColumn(
        "sec", F.explode(F.sequence("__a", "__z", F.lit(cadence).cast("long"))))
    return slots.select(*keep, clock.from_seconds("sec").alias(ts))


def expected_slots(df: DataFrame, cadence: int, ts: str = "ts") -> DataFrame:
    """Grid over the series' own span with ``observed`` and ``spring_absent`` marks."""
    slots = grid(bounds(df, ts), "first", "last", cadence, ts)
    seen = df.select(ts).distinct().withColumn("observed", F.lit(True))
    return (slots.join(seen, ts, "left").withColumn("observed", F.coalesce("observed", F.lit(False)))
            .withColumn("spring_absent", clock.spring_nonexistent(ts)))


def grid_coverage(df: DataFrame, cadence: int, ts: str = "ts", by=()) -> DataFrame:
    """Expected, observed and missing slots, plain and without nonexistent labels."""
    slots = expected_slots(df, cadence, ts)
    for name, expr in by:
        slots = slots.withColumn(name, expr)
    real = ~F.col("spring_absent")
    return slots.groupBy(*[n for n, _ in by]).agg(
        F.count(F.lit(1)).alias("expected_naive"),
        count_if(real).alias("expected_dst"),
        count_if(F.col("observed")).alias("observed"),
        count_if(~F.col("observed")).alias("missing_naive"),
        count_if(~F.col("observed") & real).alias("missing_dst"),
        (100.0 * count_if(F.col("observed")) / F.count(F.lit(1))).alias("coverage_pct"))


def yearly_coverage(df: DataFrame, cadence: int, ts: str = "ts") -> DataFrame:
    return grid_coverage(df, cadence, ts, [("year", F.year(ts))])


def spring_slots_inside(start, end, cadence: int) -> Column:
    """Nonexistent spring labels strictly between two labels, by arithmetic."""
    a, b = clock.seconds(start), clock.seconds(end)

    def of_year(y):
        day = clock.nth_sunday(y.cast("int"), 3, 2)
        base = F.date_diff(day, F.lit("1970-01-01").cast("date")).cast("long") * DAY + 7200
        top = F.least(b - 1, base + 3600 - cadence)
        low = F.greatest(a + 1, base)
        first = F.ceil((low - base) / cadence)
        final = F.floor((top - base) / cadence)
        return F.greatest(final - first + 1, F.lit(0)).cast("long")

    years = F.sequence(F.year(start), F.year(end))
    return F.aggregate(F.transform(years, of_year), F.lit(0).cast("long"), lambda s, x: s + x)


def classify_gaps(gap_rows: DataFrame, cadence: int) -> DataFrame:
    """Label each gap by how much of it daylight saving explains."""
    inside = spring_slots_inside(F.col("gap_start"), F.col("gap_end"), cadence)
    out = gap_rows.withColumn("dst_slots", inside)
    kind = (F.when((F.col("dst_slots") > 0) & (F.col("dst_slots") == F.col("absent_slots")), "dst_only")
            .when(F.col("dst_slots") > 0, "dst_plus_missing")
            .when(F.col("step") > DAY, "long").otherwise("short"))
    return out.withColumn("kind", kind)


def dataset_gaps(series: dict, cadences: dict) -> DataFrame:
    """Gaps of several named series in one table; ``long`` means over a day."""
    out = None
    for name, df in series.items():
        part = gaps(df.select("ts"), cadences[name]).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("kind", F.when(F.col("step") > DAY, "long").otherwise("short"))


def gap_summary(all_gaps: DataFrame) -> DataFrame:
    return all_gaps.groupBy("dataset", "kind").agg(
        F.count(F.lit(1)).alias("gaps"), F.sum("absent_slots").alias("absent_slots"),
        F.max("step").alias("longest_seconds"))


def missing_inside(gap_rows: DataFrame, series: dict, cadence: int) -> DataFrame:
    """For every gap and every series, slots of the gap the series also lacks."""
    inner = gap_rows.select(
        "dataset", "gap_start", "gap_end",
        clock.from_seconds(clock.seconds("gap_start") + cadence).alias("a"),
        clock.from_seconds(clock.seconds("gap_end") - cadence).alias("z"))
    slots = grid(inner, "a", "z", cadence, "ts", keep=("dataset", "gap_start", "gap_end"))
    for name, df in series.items():
        seen = df.select("ts").distinct().withColumn(f"has_{name}", F.lit(1))
        slots = slots.join(seen, "ts", "left")
    return slots.groupBy("dataset", "gap_start", "gap_end").agg(
        F.count(F.lit(1)).alias("slots"),
        *[count_if(F.col(f"has_{n}").isNull()).alias(f"missing_{n}") for n in series])


def hour_by_interval(df: DataFrame, classes, ts: str = "ts", keys=()) -> DataFrame:
    """Rows per hour of day and interval class (``classes``: seconds)."""
    steps = with_steps(df.select(*keys, ts), keys, ts).where(F.col("step").isNotNull())
    label = F.lit("other")
    for c in reversed(classes):
        label = F.when(F.col("step") == c, F.lit(str(c))).otherwise(label)
    steps = steps.select(F.hour(ts).alias("hour"), label.alias("interval"))
    names = [str(c) for c in classes] + ["other"]
    out = steps.groupBy("hour").pivot("interval", names).count().na.fill(0)
    return out.select("hour", *[F.col(f"`{n}`").alias(f"s_{n}") for n in names])


def overlap_window(series: dict) -> DataFrame:
    """Common window: latest first label to earliest last label."""
    out = None
    for name, df in series.items():
        part = bounds(df).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.agg(F.max("first").alias("first"), F.min("last").alias("last"))


def label_intersections(series: dict) -> DataFrame:
    """Shared label counts of every pair and of all series, in one shuffle."""
    out = None
    for name, df in series.items():
        part = df.select("ts", F.lit(name).alias("dataset"))
        out = part if out is None else out.unionByName(part)
    names = list(series)
    present = out.groupBy("ts").agg(
        *[F.max((F.col("dataset") == n).cast("int")).alias(n) for n in names])
    sums = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            sums.append(F.sum(F.col(a) * F.col(b)).alias(f"{a}_and_{b}"))
    every = F.lit(1)
    for n in names:
        every = every * F.col(n)
    return present.agg(*sums, F.sum(every).alias("all_series"))


def grid_conformity(df: DataFrame, cadence: int, ts: str = "ts") -> DataFrame:
    sec = clock.seconds(ts)
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        count_if(F.pmod(sec, F.lit(cadence)) != 0).alias("off_grid"),
        count_if(F.pmod(sec, F.lit(900)) == 0).alias("quarter_hour"),
        F.count_distinct(F.second(ts)).alias("distinct_seconds"),
        F.count_distinct(F.minute(ts)).alias("distinct_minutes"))


def with_clock_flags(df: DataFrame, ts: str = "ts") -> DataFrame:
    return (df.withColumn("dst_fall_ambiguous", clock.fall_ambiguous(ts))
            .withColumn("dst_spring_nonexistent", clock.spring_nonexistent(ts))
            .withColumn("clock_valid", clock.resolvable(ts)))


def dst_rows_by_dataset(series: dict) -> DataFrame:
    """Transition-day rows per day and dataset."""
    out = None
    for name, df in series.items():
        part = df.select(F.col("ts").cast("date").alias("day"), "ts", F.lit(name).alias("dataset"))
        part = part.where((F.col("day") == clock.spring_date("ts")) | (F.col("day") == clock.fall_date("ts")))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("day").pivot("dataset", list(series)).count().na.fill(0)


def label_runs(df: DataFrame, condition: Column, cadence: int = 300, minimum: int = 1, keys=(),
               ts: str = "ts", label: str | None = None) -> DataFrame:
    """Runs of a condition with exact adjacency; a missing label ends a run."""
    rows = df.withColumn("sec", clock.seconds(ts))
    found = condition_runs(rows, keys, "sec", cadence, condition, minimum, TIME_WIDTHS)
    out = found.select(
        *keys, clock.from_seconds("start").alias("start"), clock.from_seconds("end").alias("end"), "samples",
        (F.col("samples") * cadence / 3600.0).alias("nominal_hours"))
    return out if label is None else out.withColumn("kind", F.lit(label))
