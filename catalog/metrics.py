"""Strict sums, error metrics and complete time scales."""

from pyspark.sql import functions as F

from sunward.functions import clock
from sunward.functions.errors import Normalization, Pair
from sunward.operators import align as al
from sunward.operators import fleet as fl
from sunward.operators import validation as va

from .align import SIDES, _two_sides
from .quality import RULES, ledger
from .registry import query
from .views import ROSTER, fleeth, meter15, pairs, site5, slots15, sql

MET = """count(r) AS n, avg(abs(r)) AS mae, sqrt(avg(r * r)) AS rmse, avg(r) AS mbe,
  CASE WHEN count(r) >= 2 AND var_pop(measured) > 0 THEN 1 - sum(r * r) / (var_pop(measured) * count(r)) END AS r_squared"""
PR = "(SELECT *, measured - expected AS r FROM pairs)"


@query("a01_strict_sum", sql("""
SELECT ts, CASE WHEN count(value) = 5 THEN sum(value) END AS plant, count(value) AS computed,
  concat_ws(',', """ + ", ".join(f"CASE WHEN count(value) FILTER (inverter_id = '{r}') = 0 THEN '{r}' END" for r in ROSTER) + """) AS missing
FROM (SELECT ts, inverter_id, CASE WHEN k <> 50 THEN value END AS value FROM fleeth) GROUP BY ts
""", "fleeth"), d="plant", i="computed")
def a01(t):
    rows = fleeth(t).withColumn("value", F.when(F.col("k") != 50, F.col("value")))
    out = fl.strict_sum(rows, "value", ROSTER, "plant")
    return out.select("ts", "plant", "computed", F.array_join("uncomputed_ids", ",").alias("missing"))


@query("a02_mae", sql(f"SELECT unit, avg(abs(r)) AS mae FROM {PR} GROUP BY 1", "pairs"), d="mae", i="unit")
def a02(t):
    return pairs(t).groupBy("unit").agg(Pair("expected", "measured").mae().alias("mae"))


@query("a03_rmse", sql(f"SELECT unit, sqrt(avg(r * r)) AS rmse FROM {PR} GROUP BY 1", "pairs"), d="rmse", i="unit")
def a03(t):
    return pairs(t).groupBy("unit").agg(Pair("expected", "measured").rmse().alias("rmse"))


@query("a04_mbe", sql(f"SELECT unit, avg(r) AS mbe FROM {PR} GROUP BY 1", "pairs"), d="mbe", i="unit")
def a04(t):
    return pairs(t).groupBy("unit").agg(Pair("expected", "measured").mbe().alias("mbe"))


@query("a05_normalized", sql(f"SELECT flag, avg(abs(r)) / 27600 AS nmae, sqrt(avg(r * r)) / 27600 AS nrmse, 'rated power' AS basis FROM {PR} GROUP BY 1", "pairs"),
       d="nmae nrmse")
def a05(t):
    norm, p = Normalization(27600.0, "rated power"), Pair("expected", "measured")
    return pairs(t).groupBy("flag").agg((p.mae() / norm.value).alias("nmae"), (p.rmse() / norm.value).alias("nrmse")).withColumn(
        "basis", F.lit(norm.basis))


@query("a06_r_squared", sql(f"SELECT unit, {MET} FROM {PR} GROUP BY 1", "pairs"), d="mae rmse mbe r_squared", i="unit n")
def a06(t):
    return pairs(t).groupBy("unit").agg(*Pair("expected", "measured").metrics())


COUNTED = """count(*) AS total_samples, count(r) AS valid_paired_samples, count(*) - count(r) AS excluded_samples, count(*) FILTER (finite_pair) AS finite_paired_samples,
  count(*) FILTER (NOT finite_pair) AS missing_or_nonfinite_samples, count(*) FILTER (finite_pair AND r IS NULL) AS excluded_by_masks_samples,
  count(*) FILTER (NOT expected_record_present) AS missing_expected_records, count(*) FILTER (NOT measured_record_present) AS missing_measured_records,
  avg(abs(r)) AS mae, sqrt(avg(r * r)) AS rmse, avg(r) AS mbe,
  CASE WHEN count(r) >= 2 AND var_pop(mm) > 0 THEN 1 - sum(r * r) / (var_pop(mm) * count(r)) END AS r_squared,
  CASE WHEN count(r) > 0 THEN 'computed' ELSE 'no valid pairs' END AS metric_status, avg(abs(r)) / 50 AS normalized_mae, sqrt(avg(r * r)) / 50 AS normalized_rmse,
  50.0 AS normalization_value, 'channel range' AS normalization_basis"""


@query("a07_counted_report", sql(f"""
WITH {SIDES}, v AS (SELECT *, CASE WHEN finite_pair AND extract(day FROM ts) <= 15 AND hour(ts) >= 6 THEN measured - expected END AS r,
  CASE WHEN finite_pair AND extract(day FROM ts) <= 15 AND hour(ts) >= 6 THEN measured END AS mm FROM p)
SELECT 'ac_power' AS quantity, 'W' AS unit, inverter_id, {COUNTED} FROM v GROUP BY inverter_id
""", "devh"), d="mae rmse mbe r_squared normalized_mae normalized_rmse normalization_value",
       i="total_samples valid_paired_samples excluded_samples finite_paired_samples missing_or_nonfinite_samples excluded_by_masks_samples missing_expected_records missing_measured_records")
def a07(t):
    e, m = _two_sides(t)
    times = e.select("ts").union(m.select("ts")).distinct()
    notes = times.withColumn("period_label", F.when(F.dayofmonth("ts") <= 15, "first").otherwise("second"))
    healthy = times.withColumn("healthy", F.hour("ts") >= 6)
    out = va.validate(e, m, {"ac_power": ("e", "m", "W")}, True, {"ac_power": Normalization(50.0, "channel range")},
                      period_labels=notes, periods=["first"], healthy=healthy)
    return out.metrics


@query("a07_plant_report", sql(f"""
WITH p AS (SELECT coalesce(s.ts, m.ts) AS ts, s.power AS expected, m.meter AS measured, s.ts IS NOT NULL AS expected_record_present, m.ts IS NOT NULL AS measured_record_present,
  s.power IS NOT NULL AND m.meter IS NOT NULL AS finite_pair FROM site5 s FULL JOIN meter15 m ON s.ts = m.ts),
v AS (SELECT *, measured - expected AS r, CASE WHEN finite_pair THEN measured END AS mm FROM p)
SELECT 'plant_ac_power' AS quantity, 'W' AS unit, {COUNTED} FROM v
""", "site5", "meter15").replace("avg(abs(r)) / 50", "CAST(NULL AS DOUBLE)").replace("sqrt(avg(r * r)) / 50", "CAST(NULL AS DOUBLE)").replace("50.0 AS", "CAST(NULL AS DOUBLE) AS").replace("'channel range' AS", "CAST(NULL AS VARCHAR) AS"),
       d="mae rmse mbe r_squared normalized_mae normalized_rmse normalization_value",
       i="total_samples valid_paired_samples excluded_samples finite_paired_samples missing_or_nonfinite_samples excluded_by_masks_samples missing_expected_records missing_measured_records")
def a07b(t):
    e = site5(t).select("ts", F.col("power").alias("expected_plant_ac_power"))
    m = meter15(t).select("ts", F.col("meter").alias("measured_meter_power"))
    return va.validate_plant_ac(e, m).metrics


@query("a08_pooled_sums", sql(f"SELECT flag, count(*) AS total, {MET}, count(*) - count(r) AS excluded FROM {PR} GROUP BY 1", "pairs"),
       d="mae rmse mbe r_squared", i="total n excluded")
def a08(t):
    return va.merge_sums(va.partial_sums(pairs(t), "expected", "measured", ["unit", "flag"]), ["flag"])


MASKS = {"all": "true", "clear": "discount < 0.08", "candidate": "discount < 0.08 AND expected < 20000 AND measured > 5000"}


@query("a09_populations", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS population, unit, count(*) AS total, {MET}, count(*) - count(r) AS excluded FROM {PR} WHERE {c} GROUP BY unit" for n, c in MASKS.items()), "pairs"),
       d="mae rmse mbe r_squared", i="unit total n excluded")
def a09(t):
    return va.population_metrics(pairs(t), "expected", "measured", {n: F.expr(c) for n, c in MASKS.items()}, ["unit"]).where("total > 0")


_GEN = {"hour": ("INTERVAL 1 HOUR", "4"), "day": ("INTERVAL 1 DAY", "96"), "month": ("INTERVAL 1 MONTH", "day(last_day(g.b)) * 96")}


def scale_sql(scale, per_hour=4):
    step, need = _GEN[scale]
    if per_hour != 4:
        need = need.replace("96", str(24 * per_hour)) if scale != "hour" else str(per_hour)
    return f"""
WITH iv AS ({{iv}}), c AS (SELECT date_trunc('{scale}', ts) AS b, avg(e) AS ae, avg(m) AS am, count(*) FILTER (e IS NOT NULL AND m IS NOT NULL) AS n,
  avg(CASE WHEN m IS NOT NULL THEN e END) AS pe, avg(CASE WHEN e IS NOT NULL THEN m END) AS pm, sum(CASE WHEN m IS NOT NULL THEN e END) AS se,
  sum(CASE WHEN e IS NOT NULL THEN m END) AS sm, bool_and(clear) AS q FROM iv GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(b) FROM c), (SELECT max(b) FROM c), {step})) AS b),
j AS (SELECT g.b, coalesce(n, 0) AS n, {need} AS req, ae, am, pe, pm, se, sm, coalesce(q, true) AS q FROM g LEFT JOIN c ON c.b = g.b)
SELECT b AS bin, n AS valid_intervals, req AS required_intervals, n / req AS coverage, n = req AS complete, q AS qc_clear,
  CASE WHEN n = req THEN ae END AS expected_kw, CASE WHEN n = req THEN am END AS measured_kw, CASE WHEN n = req THEN ae * req / {per_hour} END AS expected_kwh,
  CASE WHEN n = req THEN am * req / {per_hour} END AS measured_kwh, pe AS paired_expected_kw, pm AS paired_measured_kw, se / {per_hour} AS observed_expected_kwh,
  sm / {per_hour} AS observed_measured_kwh, CASE WHEN n = req THEN am - ae END AS residual_kw FROM j"""


IV = """SELECT s.ts, s.power AS e, CASE WHEN s.n <> 9 THEN s.power * 0.9 + s.poa / 100 END AS m, s.n < 8 AS clear FROM (
  SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(power) AS power, avg(poa) AS poa, sum(n) AS n FROM site5 GROUP BY 1) s"""
SCALED = "coverage expected_kw measured_kw expected_kwh measured_kwh paired_expected_kw paired_measured_kw observed_expected_kwh observed_measured_kwh residual_kw"


def intervals(t):
    rows = site5(t).groupBy(clock.floor_to("ts", 15).alias("ts")).agg(
        F.avg("power").alias("e"), F.avg("poa").alias("poa"), F.sum("n").alias("n"))
    return rows.select("ts", "e", F.when(F.col("n") != 9, F.col("e") * 0.9 + F.col("poa") / 100).alias("m"), (F.col("n") < 8).alias("clear"))


for _scale in ("hour", "day", "month"):
    def _make(scale):
        @query(f"a10_complete_{scale}", sql(scale_sql(scale).replace("{iv}", IV), "site5"), d=SCALED, i="valid_intervals required_intervals",
               covers=("A10", "A11"))
        def run(t):
            return va.complete_scales(intervals(t), scale, "e", "m", "clear")
        return run
    _make(_scale)


@query("a11_observed_support", sql(f"""
WITH iv AS ({IV}), d AS (SELECT CAST(ts AS DATE) AS day, avg(e) AS pe, avg(m) AS pm FROM iv WHERE e IS NOT NULL AND m IS NOT NULL GROUP BY 1)
SELECT count(*) AS n, avg(abs(pm - pe)) AS mae, sqrt(avg((pm - pe) * (pm - pe))) AS rmse, avg(pm - pe) AS mbe,
  1 - sum((pm - pe) * (pm - pe)) / (var_pop(pm) * count(*)) AS r_squared FROM d
""", "site5"), d="mae rmse mbe r_squared", i="n")
def a11(t):
    days = va.complete_scales(intervals(t), "day", "e", "m", "clear")
    return days.agg(*Pair("paired_expected_kw", "paired_measured_kw").metrics())
