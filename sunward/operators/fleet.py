"""Named device rosters: representation, completeness and strict sums."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import all_of, holds, is_finite


def _ids(roster) -> Column:
    roster = list(roster)
    if not roster or len(set(roster)) != len(roster) or not all(str(r).strip() for r in roster):
        raise ValueError("a roster needs distinct, non-empty device ids")
    return F.array(*[F.lit(r) for r in roster])


def represent(nominal: DataFrame, roster, unit: str = "inverter_id") -> DataFrame:
    """One row per nominal row and named device, expanded in place from the literal roster."""
    return nominal.withColumn(unit, F.explode(_ids(roster)))


def roster_problems(outputs: DataFrame, times: DataFrame, roster, unit: str = "inverter_id", ts: str = "ts"):
    """Missing, duplicate and unexpected devices per label, and missing labels.

    Each label is summarised in one grouped pass: a count per device, then
    set arithmetic against the literal roster.
    """
    per = outputs.groupBy(ts, unit).agg(F.count(F.lit(1)).alias("c"))
    seen = per.groupBy(ts).agg(F.collect_set(unit).alias("__seen"),
                               F.sum((F.col("c") > 1).cast("long")).alias("duplicated"))
    want = times.select(ts).distinct().withColumn("__wanted", F.lit(True))
    both = want.join(seen, ts, "full_outer")
    empty = F.array().cast("array<string>")
    have = F.coalesce("__seen", empty)
    return both.select(
        ts, F.col("__seen").isNull().alias("missing_label"), F.col("__wanted").isNull().alias("unexpected_label"),
        F.size(F.array_except(_ids(roster), have)).alias("missing"),
        F.size(F.array_except(have, _ids(roster))).alias("unexpected"),
        F.coalesce("duplicated", F.lit(0)).alias("duplicated"))


def check_roster_complete(outputs, times, roster, unit="inverter_id", ts="ts") -> None:
    bad = roster_problems(outputs, times, roster, unit, ts).where(
        "missing_label or unexpected_label or missing > 0 or unexpected > 0 or duplicated > 0").limit(3).collect()
    if bad:
        raise ValueError(f"the fleet is not complete, for example {bad[0].asDict()}")


def per_unit(outputs: DataFrame, values, keys, unit: str) -> DataFrame:
    """One row per key and device: each value where the device has exactly one row and it is finite, else NULL.

    A repeated device is not a second device, and which of its rows holds is not known, so it
    counts as uncomputed.
    """
    single = F.count(F.lit(1)) == 1
    return outputs.groupBy(*keys, unit).agg(*[F.when(single, F.max(F.when(is_finite(v), F.col(v)))).alias(v) for v in values])


def strict_sum(outputs: DataFrame, value: str, roster, out: str, keys=("ts",), unit: str = "inverter_id") -> DataFrame:
    """Fleet sum, NULL unless every rostered device has exactly one row with a finite value.

    Also counts the computed devices and names the others.
    """
    size = len(list(roster))
    devices = per_unit(outputs.where(F.col(unit).isin(*roster)), [value], keys, unit)
    named = F.collect_set(F.when(F.col(value).isNotNull(), F.col(unit)))
    grouped = devices.groupBy(*keys).agg(F.count(value).alias("computed"), F.sum(value).alias("__sum"), named.alias("__have"))
    absent = F.array_sort(F.array_except(_ids(roster), F.col("__have")))
    return grouped.select(*keys, F.when(F.col("computed") == size, F.col("__sum")).alias(out), "computed",
                          absent.alias("uncomputed_ids"))


def represented_sum(nominal: DataFrame, value: str, roster, out: str, keys=("ts",)) -> DataFrame:
    """:func:`strict_sum` of :func:`represent`, from the nominal rows themselves.

    Every device repeats the same nominal rows, so a label's devices are all computed or all not,
    and no row has to be sent once for each device.
    """
    ids = _ids(roster)
    size = len(list(roster))
    single = F.count(F.lit(1)) == 1
    labels = nominal.groupBy(*keys).agg(F.when(single, F.max(F.when(is_finite(value), F.col(value)))).alias("__v"))
    known = F.col("__v").isNotNull()
    return labels.select(*keys, (F.col("__v") * size).alias(out), F.when(known, size).otherwise(0).cast("long").alias("computed"),
                         F.when(known, F.array().cast("array<string>")).otherwise(F.array_sort(ids)).alias("uncomputed_ids"))


def complete_fleet(outputs: DataFrame, value: str, roster_size: int, flagged: DataFrame | None, out: str,
                   ts: str = "ts", unit: str = "inverter_id") -> DataFrame:
    """Sum per label where all devices are finite, single, not negative and the label is unflagged; else NULL."""
    devices = per_unit(outputs, [value], [ts], unit)
    good = F.when(F.col(value) >= 0, F.col(value))
    sums = devices.groupBy(ts).agg(F.count(good).alias("__n"), F.sum(good).alias("__s"))
    keep = F.col("__n") == roster_size
    if flagged is not None:
        sums = sums.join(flagged.select(ts).distinct().withColumn("__f", F.lit(True)), ts, "left")
        keep = keep & F.col("__f").isNull()
    return sums.select(ts, F.when(keep, F.col("__s")).alias(out))


def to_long(wide: DataFrame, keys, pattern: str = r"^(inv_\d{2})_([a-z_]+?)_inv_\d+$") -> DataFrame:
    """Wide channel table to (keys, inverter_id, quantity, value)."""
    channels = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(list(keys), channels, "channel", "value")
    return long.select(*keys, F.regexp_extract("channel", pattern, 1).alias("inverter_id"),
                       F.regexp_extract("channel", pattern, 2).alias("quantity"), "value")


def per_device(long: DataFrame, quantities, keys=("ts", "inverter_id")) -> DataFrame:
    """One row per label and device, a column per quantity."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("quantity") == q, F.col("value"))).alias(q) for q in quantities])


def to_matrix(long: DataFrame, value: str, roster, ts: str = "ts", unit: str = "inverter_id") -> DataFrame:
    """One row per label, a column per device, with the number of devices present."""
    cols = [F.max(F.when(F.col(unit) == r, F.col(value))).alias(r) for r in roster]
    return long.groupBy(ts).agg(*cols, F.count_distinct(F.when(F.col(unit).isin(*roster), F.col(unit))).alias("devices"))


def device_masks(mask: DataFrame, readings: DataFrame, roster, candidate: str, value: str, ts="ts", unit="inverter_id"):
    """Label-level mask repeated per device, with the device's own eligibility."""
    rows = represent(mask.select(ts, candidate), roster, unit)
    finite_now = readings.select(ts, unit, is_finite(value).alias("__ok"))
    out = rows.join(finite_now, [ts, unit], "left")
    return out.withColumn("eligible", F.col(candidate) & F.coalesce("__ok", F.lit(False))).drop("__ok")
