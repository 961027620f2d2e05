"""The frozen baseline run: weather to fleet, fleet to plant, plant to meter."""

from pyspark.sql import DataFrame, functions as F

from ..functions import clock
from ..functions.errors import Pair, metrics_from_sums
from ..functions.values import count_if, finite
from ..operators import fleet
from ..operators.modelling import PlantModel

ORDER = ["stage", "population", "total", "n", "excluded", "mae", "rmse", "mbe", "r_squared"]


def nominal_model(prepared: DataFrame, model: PlantModel, **names) -> DataFrame:
    """Nominal AC per label; all labels kept."""
    return model.research_baseline(prepared, **names)


def device_table(nominal: DataFrame, readings: DataFrame, roster, value: str, ts="ts", unit="inverter_id") -> DataFrame:
    """Every label and rostered device with expected and measured AC."""
    rows = fleet.represent(nominal, roster, unit)
    return rows.join(readings.select(ts, unit, F.col(value).alias("measured_ac_power")), [ts, unit], "left")


SUMS = ("n", "sum_abs", "sum_sq", "sum_r", "sum_m", "sum_mm")


def _sums(name: str, expected, measured, mask=None) -> list:
    """Mergeable error sums of a group as columns of a stage."""
    return [c.alias(f"{name}_{k}") for c, k in zip(Pair(expected, measured, mask).sums()[1:], SUMS)]


def _carried(names) -> list:
    return [F.sum(f"{name}_{k}").alias(f"{name}_{k}") for name in names for k in SUMS]


def _label_sums(devices: DataFrame, populations: dict, roster, ts: str, unit: str) -> DataFrame:
    """Per label: error sums and rows of each population, and strict plant sums of both sides."""
    inside = {name: F.coalesce(c, F.lit(False)) for name, c in populations.items()}
    e, m = "expected_ac_power", "measured_ac_power"
    single, listed = F.count(F.lit(1)) == 1, F.first(F.col(unit).isin(*roster))
    cols = [x for name, c in inside.items() for x in (*_sums(name, e, m, c), count_if(c).alias(f"{name}_total"))]
    cols += [F.when(single & listed, F.max(finite(v))).alias(f"one_{side}") for side, v in (("e", e), ("m", m))]
    per = devices.groupBy(ts, unit).agg(*cols)
    size = len(tuple(roster))
    plant = [F.when(F.count(f"one_{side}") == size, F.sum(f"one_{side}")).alias(f"plant_{side}") for side in ("e", "m")]
    return per.groupBy(ts).agg(*_carried(inside), *[F.sum(f"{name}_total").alias(f"{name}_total") for name in inside], *plant)


def _intervals(labels: DataFrame, meter: DataFrame, populations, reading: str, scale: float, ts: str, offsets=(0, 5, 10)) -> DataFrame:
    """Per quarter hour: the label sums, and where the meter has a reading the strict mean beside it."""
    start = clock.floor_to(ts, 15)
    used = F.when(F.round((clock.seconds(ts) - clock.seconds(start)) / 60).isin(*offsets), F.col("plant_e"))
    per = labels.withColumn("anchor", start).groupBy("anchor").agg(
        *_carried(populations), *[F.sum(f"{name}_total").alias(f"{name}_total") for name in populations], F.count(F.lit(1)).alias("plant_ac_total"), *_sums("plant_ac", "plant_e", "plant_m"),
        F.when(F.count(used) == len(offsets), F.sum(used) / len(offsets) / scale).alias("e"))
    read = meter.select(F.col(ts).alias("anchor"), F.col(reading).alias("m"), F.lit(True).alias("metered"))
    return per.join(read, "anchor", "full_outer")


def _rolled(rows: DataFrame, scale: str, start, names, per_hour: int = 4) -> DataFrame:
    """One level of time scales up: bins of ``rows``, the sums of all lower levels, and the scores of the bins that were filled."""
    need = {"hour": F.lit(per_hour), "day": F.lit(24 * per_hour)}.get(scale, F.dayofmonth(F.last_day(F.col("anchor").cast("date"))) * 24 * per_hour)
    parts = ("n_e", "n_m", "s_e", "s_m", "n_p", "s_pe", "s_pm")
    grouped = rows.withColumn("anchor", start(F.col("anchor"))).groupBy("anchor").agg(
        *[F.sum(c).alias(c) for c in names], *[F.sum(c).alias(c) for c in parts], F.min("first").alias("first"), F.max("last").alias("last"))
    full = F.col("n_p") == need
    sides = {f"meter_{scale}_complete": (F.when(full, F.col("s_e") / F.col("n_e")), F.when(full, F.col("s_m") / F.col("n_m"))),
             f"meter_{scale}_observed": (F.col("s_pe") / F.when(F.col("n_p") > 0, F.col("n_p")), F.col("s_pm") / F.when(F.col("n_p") > 0, F.col("n_p")))}
    return grouped.select("*", *[c.alias(f"{name}_{k}") for name, (e, m) in sides.items() for c, k in zip(_row_sums(e, m), SUMS)])


def _row_sums(e, m) -> list:
    both = e.isNotNull() & m.isNotNull()
    r, seen = F.when(both, m - e), F.when(both, m)
    return [both.cast("long"), F.abs(r), r * r, r, seen, seen * seen]


def frozen_baseline(prepared: DataFrame, readings: DataFrame, meter: DataFrame, roster, model: PlantModel,
                    populations: dict, value: str = "value", reading: str = "meter", scale: float = 1000.0, ts: str = "ts", unit: str = "inverter_id", **names) -> DataFrame:
    """Metrics of every stage of the run in one table.

    One chain of grouped passes, each over the few rows of the one before: devices to labels,
    labels to quarter hours beside the meter, then hours, days and months. Every level adds its
    error sums to those it carries, so the last row has the sums of all stages and each
    input is read once.
    """
    devices = device_table(nominal_model(prepared, model, **names), readings, roster, value, ts, unit)
    labels = _label_sums(devices, populations, roster, ts, unit)
    rows = _intervals(labels, meter, populations, reading, scale, ts)
    e, m = finite("e"), finite("m")
    metered, both = F.col("metered").isNotNull(), finite("e").isNotNull() & finite("m").isNotNull()
    side = lambda c, v: F.when(metered & c, v)
    seen = F.when(metered, F.col("anchor"))
    carried = [f"{name}_{k}" for name in (*populations, "plant_ac") for k in (*SUMS, "total")]
    rows = rows.select(
        "anchor", *carried, metered.cast("long").alias("meter_15min_total"), *[F.when(metered, c).alias(f"meter_15min_{k}") for c, k in zip(_row_sums(e, m), SUMS)],
        side(e.isNotNull(), F.lit(1)).alias("n_e"), side(m.isNotNull(), F.lit(1)).alias("n_m"), side(F.lit(True), e).alias("s_e"), side(F.lit(True), m).alias("s_m"),
        side(both, F.lit(1)).alias("n_p"), side(both, e).alias("s_pe"), side(both, m).alias("s_pm"), seen.alias("first"), seen.alias("last"))
    carried += [f"meter_15min_{k}" for k in (*SUMS, "total")]
    starts = {"hour": lambda c: clock.floor_to(c, 60), "day": clock.day_start, "month": clock.month_start}
    for name, start in starts.items():
        rows = _rolled(rows, name, start, carried)
        carried += [f"meter_{name}_{view}_{k}" for view in ("complete", "observed") for k in SUMS]
    whole = rows.agg(*[F.sum(f"`{c}`").alias(c) for c in carried], F.min("first").alias("first"), F.max("last").alias("last"))
    # bins without a reading count too
    months = lambda c: F.year(c) * 12 + F.month(c)
    bins = {"hour": (clock.seconds(clock.floor_to("last", 60)) - clock.seconds(clock.floor_to("first", 60))) / 3600 + 1, "day": F.datediff("last", "first") + 1, "month": months("last") - months("first") + 1}
    stages = [("inverter_ac", p, f"`{p}_", F.col(f"`{p}_total`")) for p in populations] + [(s, "all", f"`{s}_", F.col(f"`{s}_total`")) for s in ("plant_ac", "meter_15min")]
    stages += [(f"meter_{s}", view, f"`meter_{s}_{view}_", F.coalesce(n.cast("long"), F.lit(0))) for s, n in bins.items() for view in ("complete", "observed")]
    told = [F.struct(F.lit(stage).alias("stage"), F.lit(population).alias("population"), F.coalesce(total, F.lit(0)).cast("long").alias("total"),
                     *[F.col(f"{name}{k}`").alias(k) for k in SUMS]) for stage, population, name, total in stages]
    long = whole.select(F.inline(F.array(*told))).withColumn("n", F.coalesce(F.col("n").cast("long"), F.lit(0)))
    return long.groupBy("stage", "population").agg(*metrics_from_sums()).select(*ORDER)
