"""Physics queries: lines of the order book stand in for weather rows."""

from functools import reduce

from pyspark.sql import functions as F

from sunward.config import InverterParameters, LossConfig, Site, SystemConfig
from sunward.functions import clock, physics as ph, solar
from sunward.functions.values import beside
from sunward.operators import modelling as mo

from .registry import query
from .views import _view, env15, meter15, once, site5, sql, wx

# Synthetic coefficients for the stand-in plant (not a product's).
INVERTER = InverterParameters(paco=27600.0, pdco=28199.173828, vdco=620.0, pso=90.0, c0=-1.5e-6, c1=1e-5, c2=1e-3,
                              c3=-2e-4, pnt=8.28)
SYSTEM = SystemConfig()
SITE = Site(39.0, -122.1, 25.0, 180.0)
STEP_POA, STEP_TEMP = 100.0, 10.0
ROSTER24 = tuple(f"inv_{n:02d}" for n in range(1, 25))


def points(spark):
    """Stand-in performance map on a 12 x 15 grid."""
    grid = spark.range(12 * 15).select((F.col("id") % 12 * STEP_POA).alias("poa"),
                                       (F.floor(F.col("id") / 12) * STEP_TEMP - 20.0).alias("temp"))
    p, t = F.col("poa"), F.col("temp")
    return grid.select("poa", "temp", (31 - 0.12 * (t - 25) + p / 1000).alias("vmp"),
                       (8.5 * p / 1000 * (1 + 0.0005 * (t - 25)) + p * p / 5e6).alias("imp"),
                       (38 - 0.14 * (t - 25)).alias("voc"), (9.0 * p / 1000).alias("isc"))


def model(spark) -> mo.PlantModel:
    return mo.PlantModel(mo.performance_cells(points(spark), STEP_POA, STEP_TEMP), STEP_POA, STEP_TEMP, INVERTER, SYSTEM)


_view("points", """SELECT p * 100.0 AS poa, t * 10.0 - 20.0 AS temp, 31 - 0.12 * (t * 10.0 - 20.0 - 25) + p * 100.0 / 1000 AS vmp,
  8.5 * (p * 100.0) / 1000 * (1 + 0.0005 * (t * 10.0 - 20.0 - 25)) + (p * 100.0) * (p * 100.0) / 5e6 AS imp,
  38 - 0.14 * (t * 10.0 - 20.0 - 25) AS voc, 9.0 * (p * 100.0) / 1000 AS isc FROM range(12) AS a(p), range(15) AS b(t)""")


def cell(value, step, low, high):
    """The cell of a value; a value on the map's upper edge is in the last cell."""
    return f"(CASE WHEN ({value}) = {(high + 1) * step} THEN {high} ELSE floor(({value}) / {step}) END)"


def blend(v, poa, temp, a="c"):
    x, y = f"(({poa}) / 100 - {cell(poa, 100, 0, 10)})", f"(({temp}) / 10 - {cell(temp, 10, -2, 11)})"
    return (f"CASE WHEN ({poa}) = 0 THEN 0 ELSE ({a}00.{v} * (1 - {x}) + {a}10.{v} * {x}) * (1 - {y}) "
            f"+ ({a}01.{v} * (1 - {x}) + {a}11.{v} * {x}) * {y} END")


def corners(poa, temp, a="c"):
    return " ".join(
        f"LEFT JOIN points {a}{i}{j} ON {a}{i}{j}.poa = ({cell(poa, 100, 0, 10)} + {i}) * 100 AND {a}{i}{j}.temp = ({cell(temp, 10, -2, 11)} + {j}) * 10"
        for i in (0, 1) for j in (0, 1))


TEMP = "(ambient + poa / (25 + 6.84 * wind))"
_view("dc", f"""SELECT w.*, tc AS temp_cell, {blend('vmp', 'w.poa', 'tc')} AS vmp, {blend('imp', 'w.poa', 'tc')} AS imp,
  {blend('voc', 'w.poa', 'tc')} AS voc, {blend('isc', 'w.poa', 'tc')} AS isc
  FROM (SELECT *, {TEMP} AS tc FROM wx) w {corners('w.poa', 'tc')}""", ("wx", "points"))
_view("arr", "SELECT *, vmp * 20 AS v, imp * 6 AS i, vmp * imp * 120 AS p FROM dc", ("dc",))


def sandia(v, p, cap):
    q = INVERTER
    a, b, c = (f"({k0!r} * (1 + {k1!r} * (({v}) - {q.vdco!r})))" for k0, k1 in ((q.pdco, q.c1), (q.pso, q.c2), (q.c0, q.c3)))
    x = f"(({p}) - {b})"
    return (f"CASE WHEN ({p}) < {q.pso!r} THEN {-q.pnt!r} WHEN ({p}) IS NOT NULL THEN "
            f"least(({q.paco!r} / ({a} - {b}) - {c} * ({a} - {b})) * {x} + {c} * {x} * {x}, {cap!r}) END")


def _summary(df, cols, keys=("status", "flag")):
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols],
                                 *[F.max(c).alias(f"max_{c}") for c in cols])


def _sumsql(source, cols, keys="status, flag"):
    return (f"SELECT {keys}, count(*) AS n, " + ", ".join(f"avg({c}) AS {c}, max({c}) AS max_{c}" for c in cols)
            + f" FROM {source} GROUP BY {keys}")


def _d(cols):
    return " ".join(f"{c} max_{c}" for c in cols)


MOD = ["vmp", "imp", "voc", "isc"]
ARR = ["expected_dc_voltage_ideal", "expected_dc_current_ideal", "expected_dc_power_ideal"]
ARRSQL = "(SELECT *, v AS expected_dc_voltage_ideal, i AS expected_dc_current_ideal, p AS expected_dc_power_ideal FROM arr)"


@query("x01_cell_temperature", sql(_sumsql(f"(SELECT *, {TEMP} AS temp_cell FROM wx)", ["temp_cell"]), "wx"), d=_d(["temp_cell"]), i="n")
def x01(t):
    return _summary(wx(t).withColumn("temp_cell", ph.cell_temperature("poa", "ambient", "wind")), ["temp_cell"])


@query("x02_module_point", sql(_sumsql("dc", MOD), "dc"), d=_d(MOD), i="n")
def x02(t):
    rows = wx(t).withColumn("temp_cell", ph.cell_temperature("poa", "ambient", "wind"))
    return _summary(model(t.spark).module(rows), MOD)


@query("x03_array_scaling", sql(_sumsql(ARRSQL, ARR), "arr"), d=_d(ARR), i="n", covers=("X03", "X05"))
def x03(t):
    return _summary(model(t.spark).dc_foundation(wx(t)), ARR)


LOSS = ["expected_dc_voltage", "expected_dc_current", "expected_dc_power"]


@query("x04_dc_losses", sql(_sumsql(
    "(SELECT status, flag, v AS expected_dc_voltage, p * 0.93 AS expected_dc_power, CASE WHEN v > 0 THEN p * 0.93 / v ELSE 0 END AS expected_dc_current FROM arr)", LOSS), "arr"),
       d=_d(LOSS), i="n")
def x04(t):
    m = model(t.spark)
    return _summary(mo.apply_dc_losses(m.dc_foundation(wx(t)), LossConfig(0.93)), LOSS)


@query("x04_ideal_dc_violations", sql("""
SELECT count(*) AS records, count(*) FILTER (p IS NULL) AS nonfinite, count(*) FILTER (v < 0 OR i < 0 OR p < 0) AS negative,
  count(*) FILTER (tax = 0.05) AS inconsistent_power, 0 AS power_without_voltage FROM arr
""", "arr"), i="records nonfinite negative inconsistent_power power_without_voltage")
def x04b(t):
    rows = model(t.spark).dc_foundation(wx(t))
    off = F.when(F.col("tax") == 0.05, F.col("expected_dc_power_ideal") * 1.001).otherwise(F.col("expected_dc_power_ideal"))
    return mo.ideal_dc_violations(rows.withColumn("expected_dc_power_ideal", off))


@query("x05_unset_losses", sql("SELECT status, count(*) AS n, 0 AS computed, sum(p) AS ideal FROM arr GROUP BY 1", "arr"), d="ideal", i="n computed")
def x05(t):
    m = model(t.spark)
    rows = m.inverter_model(m.dc_model(m.dc_foundation(wx(t))))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count("expected_dc_power").alias("computed"),
                                      F.sum("expected_dc_power_ideal").alias("ideal"))


@query("x05_plant_model", sql(f"""
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN count(*) = 1 THEN count(a) * 24 ELSE 0 END AS computed, CASE WHEN count(*) = 1 THEN sum(a) * 24 END AS total FROM (
  SELECT *, {sandia('v', 'p * 0.97', 27600.0)} AS a FROM arr) GROUP BY 1, 2, 3
""", "arr"), d="total", i="computed")
def x05b(t):
    m = model(t.spark)
    rows = m.inverter_model(m.dc_model(m.dc_foundation(wx(t)), LossConfig(0.97)))
    keys = ("l_orderkey", "l_linenumber", "l_suppkey")
    _, plant = m.plant_model(rows, ROSTER24, keys)
    return plant.select(*keys, F.col("computed"), F.col("expected_plant_ac_power").alias("total"))


AC = ["expected_ac_power"]


@query("x06_sandia", sql(_sumsql(f"(SELECT status, flag, {sandia('v', 'p', 27600.0)} AS expected_ac_power FROM arr)", AC), "arr"), d=_d(AC), i="n")
def x06(t):
    m = model(t.spark)
    return _summary(m.inverter_model(m.dc_foundation(wx(t)), "expected_dc_voltage_ideal", "expected_dc_power_ideal"), AC)


@query("x07_ceiling", sql(_sumsql(
    f"(SELECT status, flag, {sandia('v', 'p', 27600.0)} AS rated, {sandia('v', 'p', 30000.0)} AS ceiling FROM arr)", ["rated", "ceiling"]), "arr"),
       d=_d(["rated", "ceiling"]), i="n")
def x07(t):
    m = model(t.spark)
    v, p = "expected_dc_voltage_ideal", "expected_dc_power_ideal"
    rows = m.dc_foundation(wx(t)).select("status", "flag", ph.sandia_ac(v, p, INVERTER).alias("rated"),
                                         ph.sandia_ac(v, p, INVERTER, INVERTER.ceiling).alias("ceiling"))
    return _summary(rows, ["rated", "ceiling"])


@query("x08_no_loss", sql(f"""
SELECT status, count(*) AS n, count(a) AS computed, avg(a) AS mean FROM (
  SELECT status, CASE WHEN tax <> 0.04 THEN {sandia('v', 'p', 27600.0)} END AS a FROM arr) GROUP BY 1
""", "arr"), d="mean", i="n computed")
def x08(t):
    m = model(t.spark)
    rows = m.dc_foundation(wx(t))
    rows = rows.withColumn("expected_dc_power_ideal", F.when(F.col("tax") != 0.04, F.col("expected_dc_power_ideal")))
    return m.no_loss_reference(rows).groupBy("status").agg(
        F.count("*").alias("n"), F.count_if("no_loss_ac_computed").alias("computed"), F.avg("expected_ac_power_no_loss").alias("mean"))


@query("x09_research_baseline", sql(f"""
SELECT dc_model_status, count(*) AS n, count(a) AS available, avg(a) AS ac, avg(r) AS rated, avg(tc) AS temp_cell FROM (
  SELECT CASE WHEN tax = 0.01 THEN 'inputs unavailable' WHEN wind < 1 THEN 'unsupported negative inputs' ELSE 'computed ideal' END AS dc_model_status,
    CASE WHEN tax <> 0.01 AND wind >= 1 THEN {sandia('v', 'p', 30000.0)} END AS a, CASE WHEN tax <> 0.01 AND wind >= 1 THEN {sandia('v', 'p', 27600.0)} END AS r,
    CASE WHEN tax <> 0.01 AND wind >= 1 THEN temp_cell END AS tc
  FROM (SELECT tax, wind, temp_cell, vmp * 20 AS v, vmp * imp * 120 AS p FROM (
    SELECT w.*, tc AS temp_cell, {blend('vmp', 'w.poa', 'tc')} AS vmp, {blend('imp', 'w.poa', 'tc')} AS imp
    FROM (SELECT *, ambient + poa / (25 + 6.84 * (wind - 1)) AS tc FROM wx) w {corners('w.poa', 'tc')}))) GROUP BY 1
""", "wx", "points"), d="ac rated temp_cell", i="n available", covers=("X09", "X10", "P02"))
def x09(t):
    rows = wx(t).withColumn("model_inputs_available", F.col("tax") != 0.01).withColumn("wind", F.col("wind") - 1)
    out = model(t.spark).research_baseline(rows)
    return out.groupBy("dc_model_status").agg(
        F.count("*").alias("n"), F.count_if("model_available").alias("available"), F.avg("expected_ac_power").alias("ac"),
        F.avg("expected_ac_power_rated").alias("rated"), F.avg("temp_cell").alias("temp_cell"))


@query("x11_measured_power", sql("SELECT status, count(*) AS n, count(q) AS computed, sum(q) AS total FROM (SELECT status, CASE WHEN tax <> 0.02 AND wind > 0 THEN poa * ambient END AS q FROM wx) GROUP BY 1", "wx"),
       d="total", i="n computed")
def x11(t):
    rows = wx(t).select("status", F.when(F.col("tax") != 0.02, F.col("poa")).alias("v"),
                        F.when(F.col("wind") > 0, F.col("ambient")).otherwise(F.lit(float("nan"))).alias("i"))
    return rows.withColumn("q", ph.measured_power("v", "i")).groupBy("status").agg(
        F.count("*").alias("n"), F.count("q").alias("computed"), F.sum("q").alias("total"))


# Readings for the conversion study: measured DC near the model, AC a noisy share of it.
_view("conv", f"""SELECT *, CASE WHEN ok THEN {sandia('mv', 'mp', 27600.0)} END AS sandia, CASE WHEN ok THEN mac / mp END AS ratio,
  CASE WHEN ok THEN mac - {sandia('mv', 'mp', 27600.0)} END AS resid, CASE WHEN ok AND mac / mp > 0 AND mac / mp <= 1 THEN mac / mp END AS eff FROM (
  SELECT *, mv > 0 AND mi > 0 AND mac > 0 AND hour(ts) >= 6 AND hour(ts) < 20 AND clear AND mp >= 0.01 * 28199.173828 AND mac >= 0.01 * 27600 AS ok,
    mv > 0 AND mi > 0 AND mac > 0 AND hour(ts) >= 6 AND hour(ts) < 20 AND clear AS day_ok FROM (
    SELECT ts, l_suppkey AS unit, status, v * (0.98 + wind / 200) AS mv, i * (0.97 + ambient / 1000) AS mi,
      (v * (0.98 + wind / 200)) * (i * (0.97 + ambient / 1000)) AS mp, p * (0.90013 + tax * 1.6) AS mac, tax <> 0.06 AS clear FROM arr))""", ("arr",))


def conversions(t):
    rows = model(t.spark).dc_foundation(wx(t))
    v, i, p = (F.col(f"expected_dc_{q}_ideal") for q in ("voltage", "current", "power"))
    rows = rows.select("ts", F.col("l_suppkey").alias("unit"), "status",
                       (v * (0.98 + F.col("wind") / 200)).alias("measured_dc_voltage"),
                       (i * (0.97 + F.col("ambient") / 1000)).alias("measured_dc_current"),
                       (p * (0.90013 + F.col("tax") * 1.6)).alias("measured_ac_power"),
                       (F.col("tax") != 0.06).alias("electrical_qc_clear"))
    return once(mo.measured_conversion(rows, INVERTER))


@query("x12_measured_conversion", sql("""
SELECT status, count(*) AS n, count(*) FILTER (day_ok) AS positive, count(*) FILTER (ok) AS analysed, count(eff) AS plausible, avg(eff) AS efficiency,
  avg(ratio) AS ratio, avg(resid) AS residual FROM conv GROUP BY 1
""", "conv"), d="efficiency ratio residual", i="n positive analysed plausible", covers=("X12", "P05"))
def x12(t):
    return conversions(t).groupBy("status").agg(
        F.count("*").alias("n"), F.count_if("positive_day_qc").alias("positive"), F.count_if("conversion_analysis_mask").alias("analysed"),
        F.count("efficiency").alias("plausible"), F.avg("efficiency").alias("efficiency"), F.avg("ac_dc_power_ratio").alias("ratio"),
        F.avg("residual_ac_power").alias("residual"))


SCEN = ", ".join(f"('{n}', {a}, {b})" for n, a, b in ph.THERMAL_SCENARIOS)
_view("scen", f"""SELECT w.*, {blend('vmp', 'w.poa', 'w.st')} * 20 AS sv, {blend('imp', 'w.poa', 'w.st')} * 6 AS si
  FROM (SELECT wx.*, s.scenario, s.u0, s.u1, ambient + poa / (s.u0 + s.u1 * wind) AS st FROM wx, (VALUES {SCEN}) AS s(scenario, u0, u1)) w
  {corners('w.poa', 'w.st')}""", ("wx", "points"))


def scenario_rows(t):
    rows = wx(t).withColumn("measured_v", 600 + F.col("tax") * 500).withColumn("measured_p", F.col("poa") * 25)
    return model(t.spark).scenarios(rows, measured={"voltage": "measured_v", "power": "measured_p"})


@query("x13_thermal_scenarios", sql("""
SELECT scenario, count(*) AS n, avg(st) AS temp, avg(sv) AS voltage, avg(si) AS current, avg((600 + tax * 500) / sv) AS voltage_ratio,
  avg(poa * 25 / (sv * si)) AS power_ratio FROM scen GROUP BY 1
""", "scen"), d="temp voltage current voltage_ratio power_ratio", i="n")
def x13(t):
    return scenario_rows(t).groupBy("scenario").agg(
        F.count("*").alias("n"), F.avg("scenario_temp").alias("temp"), F.avg("scenario_dc_voltage").alias("voltage"),
        F.avg("scenario_dc_current").alias("current"), F.avg("voltage_ratio").alias("voltage_ratio"),
        F.avg("power_ratio").alias("power_ratio"))


@query("x14_voltage_sensitivity", sql(f"""
SELECT status, count(*) AS n, avg(s) AS dv_dt, avg((600 + tax * 500 - v) / s) AS equivalent_offset_c FROM (
  SELECT w.*, ({blend('vmp', 'w.poa', 'w.temp_cell + 1', 'h')} - ({blend('vmp', 'w.poa', 'w.temp_cell - 1', 'l')})) * 10 AS s
  FROM arr w {corners('w.poa', 'w.temp_cell + 1', 'h')} {corners('w.poa', 'w.temp_cell - 1', 'l')}) GROUP BY 1
""", "arr"), d="dv_dt equivalent_offset_c", i="n")
def x14(t):
    m = model(t.spark)
    rows = m.dc_foundation(wx(t)).withColumn("measured_v", 600 + F.col("tax") * 500)
    return m.voltage_sensitivity(rows, "measured_v").groupBy("status").agg(
        F.count("*").alias("n"), F.avg("dv_dt").alias("dv_dt"), F.avg("equivalent_offset_c").alias("equivalent_offset_c"))


def geometry_view(name, source, offset=None, spring=None, fall=None):
    from .timeline import fall as fall_sql, spring as spring_sql
    sp, fa = spring_sql("year(ts)"), fall_sql("year(ts)")
    civil = f"""CASE WHEN (CAST(ts AS DATE) = {sp} AND hour(ts) = 2) OR (CAST(ts AS DATE) = {fa} AND hour(ts) = 1) THEN NULL
      WHEN (CAST(ts AS DATE) > {sp} OR (CAST(ts AS DATE) = {sp} AND hour(ts) >= 3)) AND (CAST(ts AS DATE) < {fa} OR (CAST(ts AS DATE) = {fa} AND hour(ts) < 1))
      THEN -7.0 ELSE -8.0 END"""
    pi = "3.141592653589793"
    g1 = f"SELECT *, {offset or civil} AS u, 2 * {pi} / 365.0 * (dayofyear(ts) - 1 + (hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0 - 12) / 24.0) AS g FROM {source}"
    g2 = f"""SELECT *, radians((hour(ts) * 60.0 + minute(ts) + second(ts) / 60.0 + 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g)
      - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) + 4.0 * {SITE.longitude} - 60.0 * u) / 4.0 - 180.0) AS h,
      0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS d FROM ({g1})"""
    la = f"radians({SITE.latitude})"
    g3 = f"SELECT *, 90.0 - degrees(acos(least(1.0, greatest(-1.0, sin({la}) * sin(d) + cos({la}) * cos(d) * cos(h))))) AS e FROM ({g2})"
    tan = "tan(radians(e))"
    g4 = f"""SELECT *, CASE WHEN u IS NULL THEN NULL ELSE e + CASE WHEN e > 85 THEN 0.0 WHEN e > 5 THEN 58.1 / {tan} - 0.07 / pow({tan}, 3) + 0.000086 / pow({tan}, 5)
      WHEN e > -0.575 THEN 1735.0 + e * (-518.2 + e * (103.4 + e * (-12.79 + e * 0.711))) ELSE -20.774 / {tan} END / 3600.0 END AS elevation,
      CASE WHEN u IS NULL THEN NULL ELSE degrees(atan2(sin(h), cos(h) * sin({la}) - tan(d) * cos({la}))) + 180.0 END AS azimuth FROM ({g3})"""
    g5 = f"""SELECT *, CASE WHEN u IS NOT NULL THEN degrees(acos(least(1.0, greatest(-1.0, cos(radians(90.0 - elevation)) * cos(radians({SITE.tilt})) + sin(radians(90.0 - elevation)) * sin(radians({SITE.tilt}))
      * cos(radians(azimuth - {SITE.azimuth})))))) END AS aoi, CASE WHEN elevation > 0 THEN CASE WHEN azimuth < 180 THEN 'AM' ELSE 'PM' END END AS phase FROM ({g4})"""
    return g5


_view("geo", geometry_view("geo", "wx"), ("wx",))


@query("x15_solar_geometry", sql("""
SELECT month(ts) AS month, hour(ts) AS hour, count(*) AS n, count(elevation) AS resolved, avg(elevation) AS elevation, avg(azimuth) AS azimuth, avg(aoi) AS aoi,
  count(*) FILTER (phase = 'AM') AS am, count(*) FILTER (phase = 'PM') AS pm, count(*) FILTER (hour(ts) < 12) AS clock_am FROM geo GROUP BY 1, 2
""", "geo"), d="elevation azimuth aoi", i="month hour n resolved am pm clock_am")
def x15(t):
    rows = solar.with_geometry(wx(t), SITE)
    return rows.groupBy(F.month("ts").alias("month"), F.hour("ts").alias("hour")).agg(
        F.count("*").alias("n"), F.count_if("diagnostic_clock_valid").alias("resolved"), F.avg("solar_elevation_deg").alias("elevation"),
        F.avg("solar_azimuth_deg").alias("azimuth"), F.avg("aoi_deg").alias("aoi"), F.count_if(F.col("solar_phase") == "AM").alias("am"),
        F.count_if(F.col("solar_phase") == "PM").alias("pm"), F.count_if(F.col("clock_phase") == "AM").alias("clock_am"))


OFFSETS = (-15, -10, -5, 0, 5, 10, 15)
_view("cand", """SELECT ts, poa, power, 20 + power / 10 AS temp_cell, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS phase,
  power / 20 + poa / 25 AS current FROM site5 WHERE poa > 300 AND power < 150""", ("site5",))
_view("shifted", f"""SELECT w.ts, w.phase, w.current, w.offset_minutes, w.sp, {blend('imp', 'w.sp', 'w.temp_cell')} * 6 AS expected_current FROM (
  SELECT c.*, o.o AS offset_minutes, s.poa AS sp FROM cand c, (VALUES {", ".join(f"({o})" for o in OFFSETS)}) AS o(o)
  LEFT JOIN (SELECT ts, poa FROM site5 WHERE poa > 0 AND n < 9) s ON s.ts = c.ts + to_minutes(o.o)) w {corners('w.sp', 'w.temp_cell')}""", ("cand", "points"))


def candidates(t):
    rows = site5(t).where((F.col("poa") > 300) & (F.col("power") < 150))
    return rows.select("ts", "poa", "power", (20 + F.col("power") / 10).alias("temp_cell"),
                       F.when(F.hour("ts") < 12, "AM").otherwise("PM").alias("phase"),
                       (F.col("power") / 20 + F.col("poa") / 25).alias("current"))


def shifted(t):
    source = site5(t).select("ts", "poa", (F.col("n") < 9).alias("qc_clear"))
    return model(t.spark).offset_currents(candidates(t), source, OFFSETS)


@query("x16_offset_currents", sql("SELECT ts, offset_minutes, expected_current FROM shifted", "shifted"), d="expected_current", i="offset_minutes")
def x16(t):
    return shifted(t).select("ts", "offset_minutes", "expected_current")


_view("fc", """SELECT s.ts AS origin, s.ts + INTERVAL 15 MINUTE AS target_ts, s.poa AS forecast_poa, CASE WHEN s.n <> 3 THEN s.power / 5 END AS forecast_ambient,
  s.power / 10 - 0.2 AS forecast_wind FROM site5 s""", ("site5",))


def forecasts(t):
    return site5(t).select(
        F.col("ts").alias("origin"), clock.shift("ts", 15).alias("target_ts"), F.col("poa").alias("forecast_poa"),
        F.when(F.col("n") != 3, F.col("power") / 5).alias("forecast_ambient"), (F.col("power") / 10 - 0.2).alias("forecast_wind"))


OK = "forecast_ambient IS NOT NULL AND forecast_wind >= 0"
_view("labels_", f"""SELECT *, CASE WHEN physics IS NOT NULL AND actual IS NOT NULL THEN actual - physics END AS correction,
  CASE WHEN physics IS NULL AND actual IS NULL THEN 'physics_failed_and_actual_missing' WHEN physics IS NULL THEN 'physics_failed'
    WHEN actual IS NULL THEN 'actual_missing' ELSE 'labelled' END AS validity FROM (
  SELECT w.origin, w.target_ts, w.forecast_poa, w.forecast_ambient, w.forecast_wind, CASE WHEN {OK} THEN {sandia('v', 'p', 30000.0)} END * 24 / 1000.0 AS physics, a.power AS actual FROM (
    SELECT f.*, {blend('vmp', 'f.forecast_poa', 'tc')} * 20 AS v, ({blend('vmp', 'f.forecast_poa', 'tc')}) * ({blend('imp', 'f.forecast_poa', 'tc')}) * 120 AS p FROM (
      SELECT *, forecast_ambient + forecast_poa / (25 + 6.84 * forecast_wind) AS tc FROM fc) f {corners('f.forecast_poa', 'tc')}) w
  LEFT JOIN site5 a ON a.ts = w.target_ts)""", ("fc", "points"))


def labelled(t):
    return mo.physics_labels(forecasts(t), site5(t), model(t.spark), "power")


@query("x17_physics_labels", sql("""
SELECT origin, target_ts, physics AS physics_forecast_kw, actual AS actual_target_power_kw, correction AS correction_kw, validity FROM labels_
""", "labels_"), d="physics_forecast_kw actual_target_power_kw correction_kw")
def x17(t):
    return labelled(t).select("origin", "target_ts", "physics_forecast_kw", "actual_target_power_kw", "correction_kw", "validity")


@query("x18_final_power", sql("""
SELECT origin, physics + (forecast_poa / 1000) * (SELECT stddev_pop(correction) FROM labels_ WHERE validity = 'labelled' AND day(target_ts) <= 20) AS final_kw
FROM labels_ WHERE physics IS NOT NULL
""", "labels_"), d="final_kw")
def x18(t):
    rows = labelled(t)
    scale = mo.correction_scale(rows.where((F.col("validity") == "labelled") & (F.dayofmonth("target_ts") <= 20)))
    out = beside(rows.where("physics_forecast_kw is not null"), scale)
    out = out.withColumn("normalised", F.col("forecast_poa") / 1000)
    return out.select("origin", mo.final_power("physics_forecast_kw", "normalised", "scale").alias("final_kw"))
