"""Weather to DC to AC: the model as chained DataFrame transforms."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..config import InverterParameters, LossConfig, SystemConfig
from ..functions import physics as ph
from ..functions.values import count_if, finite, is_finite, ratio
from .align import offset_block
from .fleet import represent, represented_sum
from .masks import with_model_status

MODULE_VALUES = ("vmp", "imp", "voc", "isc")


def performance_cells(points: DataFrame, poa_step: float, temp_step: float) -> DataFrame:
    """Turn a module performance map (``poa, temp`` + module values) into grid cells.

    A point is a corner of up to four cells; each cell row carries its corners. The
    upper edges of the map belong to its last cells: a key on an edge leads to the cell below
    it (``bi``, ``bj``), so the highest irradiance and temperature of the grid have values.
    """
    i = F.round(F.col("poa") / poa_step).cast("long")
    j = F.round(F.col("temp") / temp_step).cast("long")
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    sent = points.withColumn("__c", F.explode(corners)).withColumn("pi", i - F.col("__c.a")).withColumn(
        "ti", j - F.col("__c.b"))
    cols = [F.max(F.when((F.col("__c.a") == a) & (F.col("__c.b") == b), F.col(v))).alias(f"{v}{a}{b}")
            for v in MODULE_VALUES for a in (0, 1) for b in (0, 1)]
    cells = sent.groupBy("pi", "ti").agg(*cols).where(F.col("vmp11").isNotNull() & F.col("vmp00").isNotNull()
                                                      & F.col("vmp01").isNotNull() & F.col("vmp10").isNotNull())
    names = [c for c in cells.columns if c not in ("pi", "ti")]
    keyed = cells.select(F.col("pi").alias("bi"), F.col("ti").alias("bj"), *names, F.explode(corners).alias("__c")).select(
        (F.col("bi") + F.col("__c.a")).alias("pi"), (F.col("bj") + F.col("__c.b")).alias("ti"), F.struct((F.col("__c.a") + F.col("__c.b")).alias("__far"), F.col("__c.a").alias("__right"), "bi", "bj", *names).alias("__cell"))
    nearest = keyed.groupBy("pi", "ti").agg(F.min("__cell").alias("__cell"))
    return nearest.select("pi", "ti", "__cell.bi", "__cell.bj", *[F.col(f"__cell.{n}") for n in names])


def module_dc(df: DataFrame, cells: DataFrame, poa_step: float, temp_step: float, poa: str = "poa",
              temp: str = "temp_cell", prefix: str = "", values=MODULE_VALUES) -> DataFrame:
    """Module operating point by bilinear look-up; exact zeros at zero irradiance.

    The map is bounded by the module's range of irradiance and temperature, not by the readings, so
    it is broadcast: its size is not known beforehand, and a join of unknown sides would shuffle every
    reading, once for each scenario and once for each pass over the result.
    """
    p, t = F.col(poa), F.col(temp)
    pi, ti = F.floor(p / poa_step).cast("long"), F.floor(t / temp_step).cast("long")
    left = df.withColumn("__pi", pi).withColumn("__ti", ti)
    joined = left.join(F.broadcast(cells), (F.col("__pi") == F.col("pi")) & (F.col("__ti") == F.col("ti")), "left")
    x = (p - F.col("bi") * poa_step) / poa_step
    y = (t - F.col("bj") * temp_step) / temp_step
    on_map = (x <= 1) & (y <= 1)
    out = []
    for v in values:
        blend = ((F.col(f"{v}00") * (1 - x) + F.col(f"{v}10") * x) * (1 - y)
                 + (F.col(f"{v}01") * (1 - x) + F.col(f"{v}11") * x) * y)
        out.append(F.when(p == 0, F.lit(0.0)).when(on_map, blend).alias(f"{prefix}{v}"))
    joined = joined.select(*df.columns, *out)
    return joined.withColumn(f"{prefix}pmp", F.col(f"{prefix}vmp") * F.col(f"{prefix}imp"))


class PlantModel:
    """Everything the model needs besides data."""

    def __init__(self, cells: DataFrame, poa_step: float, temp_step: float, inverter: InverterParameters,
                 config: SystemConfig = SystemConfig()):
        self.cells, self.poa_step, self.temp_step = cells, poa_step, temp_step
        self.inverter, self.config = inverter, config

    def module(self, df, poa="poa", temp="temp_cell", prefix="", values=MODULE_VALUES):
        return module_dc(df, self.cells, self.poa_step, self.temp_step, poa, temp, prefix, values)

    def dc_foundation(self, df: DataFrame, poa="poa", ambient="ambient", wind="wind") -> DataFrame:
        """Cell temperature, module point and ideal array voltage, current, power."""
        df = df.withColumn("temp_cell", ph.cell_temperature(poa, ambient, wind, self.config.thermal))
        df = self.module(df, poa)
        return (df.withColumn("expected_dc_voltage_ideal", ph.array_voltage("vmp", self.config))
                .withColumn("expected_dc_current_ideal", ph.array_current("imp", self.config))
                .withColumn("expected_dc_power_ideal", ph.array_power("pmp", self.config)))

    def prepared_baseline(self, df: DataFrame, available="model_inputs_available", poa="poa", ambient="ambient",
                          wind="wind") -> DataFrame:
        """Ideal DC for eligible rows; every row kept, status explained."""
        df = with_model_status(df, available, poa, ambient, wind)
        ok = F.col("dc_model_computed")
        names = {"__poa": poa, "__ambient": ambient, "__wind": wind}
        for tmp, col in names.items():
            df = df.withColumn(tmp, F.when(ok, F.col(col)))
        return self.dc_foundation(df, "__poa", "__ambient", "__wind").drop(*names)

    def dc_model(self, df: DataFrame, losses: LossConfig | None = None) -> DataFrame:
        """Static derate of ideal DC; an unset factor leaves NULL columns."""
        losses = losses or self.config.losses
        if losses.k_dc is None:
            for q in ("voltage", "current", "power"):
                df = df.withColumn(f"expected_dc_{q}", F.lit(None).cast("double"))
            return df
        return apply_dc_losses(df, losses)

    def inverter_model(self, df: DataFrame, v="expected_dc_voltage", p="expected_dc_power") -> DataFrame:
        return df.withColumn("expected_ac_power", ph.sandia_ac(v, p, self.inverter))

    def no_loss_reference(self, df: DataFrame) -> DataFrame:
        """AC of the ideal DC, beside a flag for rows where it could be computed."""
        v, p = "expected_dc_voltage_ideal", "expected_dc_power_ideal"
        return (df.withColumn("expected_ac_power_no_loss", ph.sandia_ac(v, p, self.inverter))
                .withColumn("no_loss_ac_computed", is_finite(v) & is_finite(p)))

    def research_baseline(self, df: DataFrame, **names) -> DataFrame:
        """Ideal DC used directly, rated AC and AC under the external ceiling."""
        out = self.prepared_baseline(df, **names)
        v, p = "expected_dc_voltage_ideal", "expected_dc_power_ideal"
        out = out.withColumn("expected_ac_power_rated", ph.sandia_ac(v, p, self.inverter))
        out = out.withColumn("expected_ac_power", ph.sandia_ac(v, p, self.inverter, self.inverter.ceiling))
        return out.withColumn("model_available", is_finite("expected_ac_power"))

    def plant_model(self, df: DataFrame, roster, keys=("ts",), value="expected_ac_power"):
        """Device outputs for a roster, and the strict plant sum per label."""
        return represent(df, roster), represented_sum(df, value, roster, "expected_plant_ac_power", keys)

    def scenarios(self, df: DataFrame, scenarios=ph.THERMAL_SCENARIOS, measured=None, poa="poa", ambient="ambient",
                  wind="wind") -> DataFrame:
        """Each row under every thermal scenario, with measured/expected ratios."""
        rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(a).alias("u0"), F.lit(b).alias("u1"))
                         for n, a, b in scenarios])
        out = df.withColumn("__s", F.explode(rows)).select(*df.columns, "__s.*")
        out = out.withColumn("scenario_temp", ph.cell_temperature(poa, ambient, wind, u0="u0", u1="u1"))
        out = self.module(out, poa, "scenario_temp", "s_", ("vmp", "imp"))
        out = (out.withColumn("scenario_dc_voltage", ph.array_voltage("s_vmp", self.config))
               .withColumn("scenario_dc_current", ph.array_current("s_imp", self.config))
               .withColumn("scenario_dc_power", ph.array_power("s_pmp", self.config)).drop("s_vmp", "s_imp", "s_pmp"))
        for q, col in (measured or {}).items():
            out = out.withColumn(f"{q}_ratio", ratio(col, f"scenario_dc_{q}"))
        return out

    def voltage_sensitivity(self, df: DataFrame, measured: str, expected="expected_dc_voltage_ideal", poa="poa",
                            temp="temp_cell") -> DataFrame:
        """Central +-1 C slope of array voltage and the temperature offset it implies."""
        out = df.withColumn("__hi", F.col(temp) + 1.0).withColumn("__lo", F.col(temp) - 1.0)
        out = self.module(out, poa, "__hi", "h_", ("vmp", "imp"))
        out = self.module(out, poa, "__lo", "l_", ("vmp", "imp"))
        slope = (F.col("h_vmp") - F.col("l_vmp")) * self.config.modules_per_string / 2.0
        out = out.withColumn("dv_dt", slope)
        offset = F.when(F.col("dv_dt") != 0, (F.col(measured) - F.col(expected)) / F.col("dv_dt"))
        return out.withColumn("equivalent_offset_c", offset).select(*df.columns, "dv_dt", "equivalent_offset_c")

    def offset_currents(self, candidates: DataFrame, source: DataFrame, offsets, poa="poa", clear="qc_clear",
                        temp="temp_cell", ts="ts") -> DataFrame:
        """Expected current from irradiance at other labels, temperature frozen; long by offset.

        Missing, non-positive or flagged irradiance gives NULL.
        """
        usable = source.select(ts, F.when((F.col(poa) > 0) & F.col(clear), F.col(poa)).alias("__x"))
        block = offset_block(usable, ["__x"], offsets, (), ts)
        wide = candidates.join(block, ts, "left")
        names = [(o, f"__x_{'m' if o < 0 else 'p'}{abs(o)}") for o in offsets]
        pairs = F.array(*[F.struct(F.lit(o).alias("offset_minutes"), F.col(n).alias("shifted_poa")) for o, n in names])
        long = wide.select(*candidates.columns, F.inline(pairs))
        long = self.module(long, "shifted_poa", temp, "o_", ("vmp", "imp"))
        return long.withColumn("expected_current", ph.array_current("o_imp", self.config)).drop("o_vmp", "o_imp", "o_pmp")


def apply_dc_losses(df: DataFrame, losses: LossConfig) -> DataFrame:
    """P scaled by k, V unchanged, I from P/V."""
    if losses.k_dc is None:
        raise ValueError("k_dc is not calibrated; give a reviewed factor")
    v, p = "expected_dc_voltage_ideal", "expected_dc_power_ideal"
    return (df.withColumn("dc_loss_factor", F.lit(losses.k_dc)).withColumn("expected_dc_voltage", F.col(v))
            .withColumn("expected_dc_power", ph.derated_power(p, losses.k_dc))
            .withColumn("expected_dc_current", ph.derated_current("expected_dc_power", v)))


def ideal_dc_violations(df: DataFrame, rtol: float = 1e-10, atol: float = 1e-9) -> DataFrame:
    """Counts of ideal DC rows the derate may not touch."""
    v, i, p = (F.col(f"expected_dc_{q}_ideal") for q in ("voltage", "current", "power"))
    vi = v * i
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        count_if(~(is_finite(v) & is_finite(i) & is_finite(p))).alias("nonfinite"),
        count_if((v < 0) | (i < 0) | (p < 0)).alias("negative"),
        count_if(F.abs(p - vi) > atol + rtol * F.abs(vi)).alias("inconsistent_power"),
        count_if((v == 0) & (p != 0)).alias("power_without_voltage"))


def check_ideal_dc(df: DataFrame) -> None:
    row = ideal_dc_violations(df).first().asDict()
    if any(v for k, v in row.items() if k != "records"):
        raise ValueError(f"ideal DC is not usable: {row}")


def measured_conversion(df: DataFrame, q: InverterParameters, voltage="measured_dc_voltage", current="measured_dc_current",
                        ac="measured_ac_power", clear="electrical_qc_clear", ts="ts") -> DataFrame:
    """Measured DC through the inverter equation, ratio and physical efficiency."""
    v, i, a = finite(voltage), finite(current), finite(ac)
    df = df.withColumn("measured_dc_power", ph.measured_power(voltage, current))
    p = F.col("measured_dc_power")
    day = (F.hour(ts) >= 6) & (F.hour(ts) < 20)
    positive = F.coalesce((v > 0) & (i > 0) & (a > 0), F.lit(False))
    df = df.withColumn("daytime_clock_proxy", day)
    df = df.withColumn("positive_day_qc", positive & day & F.col(clear))
    df = df.withColumn("conversion_analysis_mask",
                       F.col("positive_day_qc") & (p >= 0.01 * q.pdco) & (F.col(ac) >= 0.01 * q.paco))
    ok = F.col("conversion_analysis_mask")
    df = df.withColumn("sandia_ac_from_measured_dc", F.when(ok, ph.sandia_ac(voltage, "measured_dc_power", q)))
    df = df.withColumn("ac_dc_power_ratio", F.when(ok, F.col(ac) / p))
    r = F.col("ac_dc_power_ratio")
    df = df.withColumn("efficiency_physically_plausible", ok & (r > 0) & (r <= 1))
    df = df.withColumn("efficiency", F.when(F.col("efficiency_physically_plausible"), r))
    return df.withColumn("residual_ac_power", F.when(ok, F.col(ac) - F.col("sandia_ac_from_measured_dc")))


def physics_labels(forecasts: DataFrame, actual: DataFrame, model: PlantModel, actual_value: str, target="target_ts",
                   ts="ts") -> DataFrame:
    """Plant physics forecast, actual power at the target, correction label and validity text."""
    poa, ambient, wind = "forecast_poa", "forecast_ambient", "forecast_wind"
    rows = forecasts.withColumn("__ok", is_finite(poa) & is_finite(ambient) & is_finite(wind)
                                & F.coalesce((F.col(poa) >= 0) & (F.col(wind) >= 0), F.lit(False)))
    based = model.research_baseline(rows, available="__ok", poa=poa, ambient=ambient, wind=wind)
    based = based.withColumn("physics_forecast_kw", F.col("expected_ac_power") * model.config.inverter_count / 1000.0)
    based = based.select(*forecasts.columns, "physics_forecast_kw")
    truth = actual.select(F.col(ts).alias(target), F.col(actual_value).alias("actual_target_power_kw"))
    out = based.join(truth, target, "left")
    p, a = is_finite("physics_forecast_kw"), is_finite("actual_target_power_kw")
    out = out.withColumn("correction_kw", F.when(p & a, F.col("actual_target_power_kw") - F.col("physics_forecast_kw")))
    validity = (F.when(~p & ~a, "physics_failed_and_actual_missing").when(~p, "physics_failed")
                .when(~a, "actual_missing").otherwise("labelled"))
    return out.withColumn("validity", validity)


def correction_scale(train: DataFrame, label: str = "correction_kw") -> DataFrame:
    """Population deviation of the training labels, as one row."""
    return train.agg(F.stddev_pop(label).alias("scale"))


def final_power(physics, normalised, scale) -> Column:
    return F.col(physics) + F.col(normalised) * F.col(scale)
