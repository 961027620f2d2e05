"""Row predicates, funnels, split windows and set unions."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock
from ..functions.values import all_of, count_if, holds, is_finite

# Fixed status texts of a modelled row, in order of precedence.
STATUS_UNAVAILABLE = "inputs unavailable"
STATUS_NONFINITE = "nonfinite inputs"
STATUS_NEGATIVE = "unsupported negative inputs"
STATUS_COMPUTED = "computed ideal"


def with_model_status(df: DataFrame, available: str, poa: str, ambient: str, wind: str) -> DataFrame:
    """Eligibility of each row for the DC model, and why not."""
    known = is_finite(poa) & is_finite(ambient) & is_finite(wind)
    supported = known & (F.col(poa) >= 0) & (F.col(wind) >= 0)
    status = (F.when(~holds(F.col(available)), STATUS_UNAVAILABLE).when(~known, STATUS_NONFINITE)
              .when(~holds(supported), STATUS_NEGATIVE).otherwise(STATUS_COMPUTED))
    out = df.withColumn("dc_model_status", status)
    return out.withColumn("dc_model_computed", F.col("dc_model_status") == STATUS_COMPUTED)


def in_band(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(value) >= low) & (F.col(value) < high))


def funnel_counts(df: DataFrame, rules: dict) -> DataFrame:
    """Rows lost at each rule in order, and what remains; one pass."""
    cols, before = [F.count(F.lit(1)).alias("saved_rows")], F.lit(True)
    for name, rule in rules.items():
        ok = holds(rule)
        cols.append(count_if(before & ~ok).alias(name))
        before = before & ok
    return df.agg(*cols, count_if(before).alias("eligible"))


def target_in_period(origin, start: str, end: str, horizon: int = 15) -> Column:
    """Half-open period membership decided by the target label."""
    target = clock.shift(origin, horizon)
    return (target >= F.lit(start).cast("timestamp_ntz")) & (target < F.lit(end).cast("timestamp_ntz"))


def window_mask(df: DataFrame, valid: Column, label, horizon: int, history: int = 30, step: int = 5, ts: str = "ts"):
    """Origins whose whole exact history and target lie in one non-zero split.

    ``label`` maps a time column to its split number. Every valid reading is
    sent to the origins it serves, so one grouped shuffle answers all lags.
    """
    lags = list(range(0, history + 1, step))
    sent = df.where(holds(valid)).select(ts, label(F.col(ts)).alias("__l"),
                                         F.explode(F.array(*[F.lit(x) for x in lags])).alias("__o"))
    sent = sent.withColumn(ts, clock.shift(ts, F.col("__o")))
    count = sent.where(F.col("__l") == label(F.col(ts))).groupBy(ts).agg(F.count(F.lit(1)).alias("__n"))
    out = df.join(count, ts, "left")
    here = label(F.col(ts))
    ok = (F.col("__n") == len(lags)) & (here != 0) & (here == label(clock.shift(ts, horizon)))
    return out.withColumn("usable", holds(ok)).drop("__n")


def constrained(prediction: Column, variable: str, elevation: Column) -> Column:
    """Physical limits: irradiance and wind not negative, no irradiance with the sun down."""
    out = F.when(prediction.isNotNull(), F.greatest(prediction, F.lit(0.0))) if variable in ("poa", "wind") else prediction
    return F.when(elevation <= 0, F.lit(0.0)).otherwise(out) if variable == "poa" else out


def equal_support(df: DataFrame, columns) -> DataFrame:
    """Rows where every alternative is available."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def activity(x: str, y: str, floor: float) -> dict:
    """Populations 'all' and 'active' (either side above the floor)."""
    return {"all": F.lit(True), "active": (F.col(x) > floor) | (F.col(y) > floor)}


def union_labelled(frames: dict, label: str = "dataset") -> DataFrame:
    parts = [df.withColumn(label, F.lit(n)) for n, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def rule_funnel(df: DataFrame, rules: dict) -> DataFrame:
    """Ordered screening: remaining, removed and independent failures per stage.

    All stages are counted in one aggregate; the short result is then unpivoted.
    """
    names, passed = list(rules), F.lit(True)
    cols = [F.count(F.lit(1)).alias("__r0")]
    for i, n in enumerate(names, 1):
        ok = holds(rules[n])
        passed = passed & ok
        cols += [count_if(passed).alias(f"__r{i}"), count_if(~ok).alias(f"__f{i}")]
    row = df.agg(*cols)
    stages = [F.struct(F.lit(0).alias("step"), F.lit("all_timestamps").alias("stage"), F.col("__r0").alias("remaining"),
                       F.lit(0).cast("long").alias("removed"), F.lit(0).cast("long").alias("failed_independently"))]
    for i, n in enumerate(names, 1):
        stages.append(F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(f"__r{i}").alias("remaining"),
                               (F.col(f"__r{i - 1}") - F.col(f"__r{i}")).alias("removed"),
                               F.col(f"__f{i}").alias("failed_independently")))
    return row.select(F.inline(F.array(*stages)))


def rule_mask(df: DataFrame, rules: dict, out: str = "candidate") -> DataFrame:
    """One Boolean column per rule and their conjunction."""
    for n, rule in rules.items():
        df = df.withColumn(n, holds(rule))
    return df.withColumn(out, all_of([F.col(n) for n in rules]))
