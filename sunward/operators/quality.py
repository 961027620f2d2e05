"""Cleaning rules, the QC ledger and its verification.

Readings are never filled, clipped or moved. A rule either writes a ledger
line, or blanks exactly the approved observations.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock
from ..functions.values import beside, count_if, finite, holds, is_finite


def arrange_channels(df: DataFrame, renames: dict, absent, order) -> DataFrame:
    """Rename channels, add absent ones as all-NULL doubles, fix the order."""
    for old, new in renames.items():
        df = df.withColumnRenamed(old, new)
    for name in absent:
        df = df.withColumn(name, F.lit(None).cast("double"))
    return df.select(*order)


def apply_approved(raw: DataFrame, ledger: DataFrame, keys, value: str = "value", out: str = "clean",
                   corrupt: str = "qc_corrupt") -> DataFrame:
    """Blank the readings a ledger approves, only where key *and* value agree.

    The ledger carries ``keys, raw_value, flag``.
    """
    marks = ledger.where(F.col("flag") == corrupt).select(*keys, "raw_value").distinct()
    joined = raw.join(marks, list(keys), "left")
    blank = holds(F.col("raw_value") == F.col(value))
    return joined.withColumn(out, F.when(~blank, F.col(value))).withColumn("blanked", blank).drop("raw_value")


def unmatched_approvals(raw: DataFrame, ledger: DataFrame, keys, value: str = "value") -> DataFrame:
    """Ledger lines that name no existing reading with that value."""
    have = raw.select(*keys, F.col(value).alias("raw_value"))
    return ledger.join(have, [*keys, "raw_value"], "left_anti")


def check_approvals(raw, ledger, keys, value="value") -> None:
    bad = unmatched_approvals(raw, ledger, keys, value).limit(5).collect()
    if bad:
        raise ValueError(f"approved changes that match no reading, for example {bad[0].asDict()}")


def build_ledger(df: DataFrame, keys, value: str, rules: dict) -> DataFrame:
    """One ledger line per row and rule met; ``rules`` maps flag -> (condition, reason).

    All rules are evaluated in one pass over the readings.
    """
    lines = F.array_compact(F.array(*[
        F.when(holds(cond), F.struct(F.lit(flag).alias("flag"), F.lit(reason).alias("reason")))
        for flag, (cond, reason) in rules.items()]))
    return df.select(*keys, F.col(value).alias("raw_value"), F.explode(lines).alias("l")).select(
        *keys, "raw_value", "l.flag", "l.reason")


def ledger_duplicates(ledger: DataFrame, keys) -> DataFrame:
    return ledger.groupBy(*keys, "flag").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def changed_cells(raw: DataFrame, clean: DataFrame, keys, value: str = "value") -> DataFrame:
    """Cells that differ between two versions, NULL-safe, with rows present on one side only."""
    a = raw.select(*keys, F.col(value).alias("before"), F.lit(True).alias("in_raw"))
    b = clean.select(*keys, F.col(value).alias("after"), F.lit(True).alias("in_clean"))
    both = a.join(b, list(keys), "full_outer")
    lost = F.col("in_raw").isNull() | F.col("in_clean").isNull()
    return both.where(lost | ~F.col("before").eqNullSafe(F.col("after"))).select(
        *keys, "before", "after", lost.alias("unpaired"))


def unexplained_changes(raw, clean, ledger, keys, value="value") -> DataFrame:
    """Changed cells that no ledger line explains; must be empty."""
    return changed_cells(raw, clean, keys, value).join(ledger.select(*keys).distinct(), list(keys), "left_anti")


def formula_mismatches(df: DataFrame, stored: str, recomputed: Column, tolerance: float = 1e-12) -> DataFrame:
    """Rows where a stored value departs from its formula, or is missing when the other is not."""
    again = recomputed
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        count_if(F.abs(F.col(stored) - again) > tolerance).alias("value_mismatches"),
        count_if(F.col(stored).isNull() != again.isNull()).alias("null_mismatches"))


def flag_membership(df: DataFrame, ledger: DataFrame, out: str, ts: str = "ts") -> DataFrame:
    """True where any ledger line carries the row's label.

    The ledger is reduced to distinct labels; the join strategy follows its size.
    """
    times = ledger.select(ts).distinct().withColumn(out, F.lit(True))
    return df.join(times, ts, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def flag_counts(ledger: DataFrame, keys=()) -> DataFrame:
    return ledger.groupBy(*keys, "flag").agg(F.count(F.lit(1)).alias("events"))


def check_flag_counts(ledger: DataFrame, expected: dict) -> DataFrame:
    counts = flag_counts(ledger)
    found = {r["flag"]: r["events"] for r in counts.limit(len(expected) + 1).collect()}
    if found != expected:
        raise ValueError(f"ledger counts {found} differ from the expected {expected}")
    return counts


def valid_readings(df: DataFrame, value: str, out: str, flagged: str | None = None, minimum: float | None = 0.0,
                   local_time: str | None = None) -> DataFrame:
    """Readings that are finite, not below ``minimum``, unflagged and at a resolvable label; else NULL."""
    ok = is_finite(value)
    if minimum is not None:
        ok = ok & (F.col(value) >= minimum)
    if flagged:
        ok = ok & ~F.col(flagged)
    if local_time:
        ok = ok & clock.resolvable(local_time)
    return df.withColumn(out, F.when(holds(ok), F.col(value)))


def measurement_violations(df: DataFrame, ts: str, poa: str, ambient: str, wind: str) -> DataFrame:
    """Counts of everything the physics refuses to accept."""
    weather = [poa, ambient, wind]
    labels = df.groupBy(ts).agg(F.count(F.lit(1)).alias("c")).agg(
        F.count(F.lit(1)).alias("labels"), F.sum(F.col("c") - 1).alias("duplicate_labels"))
    bad = df.agg(
        F.count(F.lit(1)).alias("records"), count_if(F.col(ts).isNull()).alias("missing_labels"),
        *[count_if(~is_finite(c)).alias(f"nonfinite_{c}") for c in weather],
        count_if(finite(poa) < 0).alias(f"negative_{poa}"), count_if(finite(wind) < 0).alias(f"negative_{wind}"))
    return beside(bad, labels)


def check_measurements(df: DataFrame, ts="ts", poa="poa", ambient="ambient", wind="wind") -> DataFrame:
    """Reject unusable measurement tables; nothing is repaired."""
    row = measurement_violations(df, ts, poa, ambient, wind).first()
    if not row["records"]:
        raise ValueError("measurements are empty")
    bad = {k: v for k, v in row.asDict().items() if k not in ("records", "labels") and v}
    if bad:
        raise ValueError(f"unusable measurements: {bad}")
    return df


def availability_flags(df: DataFrame, poa: str, environment, ac: str) -> DataFrame:
    """Plain availability of irradiance, environment, complete AC and all model inputs."""
    env = F.lit(True)
    for c in environment:
        env = env & F.col(c).isNotNull()
    out = df.withColumn("poa_available", F.col(poa).isNotNull()).withColumn("environment_available", env)
    out = out.withColumn("ac_complete", F.col(ac).isNotNull())
    return out.withColumn("model_inputs_available", F.col("poa_available") & F.col("environment_available"))


def daylight_clear(poa: str, flags) -> Column:
    """Positive irradiance and no QC or clock flag."""
    ok = F.col(poa) > 0
    for f in flags:
        ok = ok & ~F.col(f)
    return holds(ok)
