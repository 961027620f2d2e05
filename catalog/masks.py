"""Filter, predicate, mask and set-operation queries."""

from pyspark.sql import functions as F

from sunward.functions import clock
from sunward.operators import fleet as fl
from sunward.operators import masks as mk
from sunward.operators import quality as qc
from sunward.operators import validation as va

from .align import STRICT, aligned
from .quality import RULES, ledger
from .registry import query
from .views import ROSTER, env15, ev, fleeth, meter15, pairs, site5, sql, wx


@query("p01_measurement_violations", sql("""
SELECT count(*) AS records, count(*) - count(ts) AS missing_labels, 0 AS nonfinite_poa, count(*) - count(ambient) AS nonfinite_ambient,
  0 AS nonfinite_wind, 0 AS negative_poa, count(*) FILTER (wind < 0) AS negative_wind, count(DISTINCT ts) AS labels, count(*) - count(DISTINCT ts) AS duplicate_labels
FROM (SELECT ts, poa, CASE WHEN tax <> 0.03 THEN ambient END AS ambient, wind - 1 AS wind FROM wx)
""", "wx"), i="records missing_labels nonfinite_poa nonfinite_ambient nonfinite_wind negative_poa negative_wind labels duplicate_labels")
def p01(t):
    rows = wx(t).select("ts", "poa", F.when(F.col("tax") != 0.03, F.col("ambient")).alias("ambient"), (F.col("wind") - 1).alias("wind"))
    return qc.measurement_violations(rows, "ts", "poa", "ambient", "wind")


@query("p02_model_status", sql("""
SELECT CASE WHEN tax = 0.01 THEN 'inputs unavailable' WHEN a IS NULL THEN 'nonfinite inputs' WHEN w < 0 THEN 'unsupported negative inputs'
  ELSE 'computed ideal' END AS dc_model_status, count(*) AS records
FROM (SELECT tax, CASE WHEN tax <> 0.03 THEN ambient END AS a, wind - 1 AS w FROM wx) GROUP BY 1
""", "wx"), i="records")
def p02(t):
    rows = wx(t).select("ts", "poa", F.when(F.col("tax") != 0.03, F.col("ambient")).alias("ambient"),
                        (F.col("wind") - 1).alias("wind"), (F.col("tax") != 0.01).alias("available"))
    out = mk.with_model_status(rows, "available", "poa", "ambient", "wind")
    return out.groupBy("dc_model_status").agg(F.count("*").alias("records"))


@query("p03_availability_flags", sql(f"""
WITH {STRICT} SELECT a AS poa_available, e AS environment_available, c AS ac_complete, a AND e AS model_inputs_available, count(*) AS records FROM (
  SELECT CASE WHEN s.poa > 100 THEN s.poa END IS NOT NULL AS a, n.ambient IS NOT NULL AND n.wind IS NOT NULL AS e, p.plant_power IS NOT NULL AS c
  FROM site5 s LEFT JOIN env15 n ON n.ts = s.ts LEFT JOIN strict p ON p.ts = s.ts) GROUP BY 1, 2, 3, 4
""", "site5", "env15", "fleeth"), i="records")
def p03(t):
    power = fl.strict_sum(fleeth(t), "value", ROSTER, "plant_power").select("ts", "plant_power")
    rows = site5(t).select("ts", F.when(F.col("poa") > 100, F.col("poa")).alias("poa")).join(env15(t), "ts", "left").join(power, "ts", "left")
    flags = ["poa_available", "environment_available", "ac_complete", "model_inputs_available"]
    out = qc.availability_flags(rows, "poa", ["ambient", "wind"], "plant_power")
    return out.groupBy(*flags).agg(F.count("*").alias("records"))


@query("p04_daylight_clear", sql(f"""
WITH {RULES} SELECT CAST(ts AS DATE) AS day, count(*) AS labels, sum(power) AS total FROM site5 WHERE poa > 0 AND hour(ts) BETWEEN 6 AND 19
  AND ts NOT IN (SELECT time_bucket(INTERVAL 5 MINUTE, ts) FROM lines) GROUP BY 1
""", "site5"), d="total", i="labels", t="day")
def p04(t):
    lines = ledger(t).withColumn("ts", clock.floor_to("ts", 5))
    rows = qc.flag_membership(site5(t), lines, "qc_flag").where(F.hour("ts").between(6, 19))
    return rows.where(qc.daylight_clear("poa", ["qc_flag"])).groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count("*").alias("labels"), F.sum("power").alias("total"))


@query("p07_populations", sql("""
SELECT population, count(*) AS records, sum(measured) AS total FROM (
  SELECT 'all' AS population, measured FROM pairs UNION ALL SELECT 'open', measured FROM pairs WHERE status = 'O'
  UNION ALL SELECT 'guarded', measured FROM pairs WHERE expected < 40000 AND measured < 40000) GROUP BY 1
""", "pairs"), d="total", i="records")
def p07(t):
    rows = va.in_populations(pairs(t), {"all": F.lit(True), "open": F.col("status") == "O",
                                        "guarded": (F.col("expected") < 40000) & (F.col("measured") < 40000)})
    return rows.groupBy("population").agg(F.count("*").alias("records"), F.sum("measured").alias("total"))


@query("p08_band", sql("SELECT unit, count(*) AS records, avg(expected) AS mean_expected FROM pairs WHERE measured >= 27500 AND measured < 27700 GROUP BY 1", "pairs"),
       d="mean_expected", i="unit records")
def p08(t):
    return mk.in_band(pairs(t), "measured", 27500, 27700).groupBy("unit").agg(
        F.count("*").alias("records"), F.avg("expected").alias("mean_expected"))


@query("p09_complete_fleet", sql(f"""
WITH {RULES} SELECT ts, CASE WHEN count(CASE WHEN value >= 0 THEN 1 END) = 5 AND ts NOT IN (SELECT date_trunc('hour', ts) FROM lines) THEN sum(value) END AS plant
FROM (SELECT ts, inverter_id, value - 1.5 AS value FROM fleeth) GROUP BY ts
""", "fleeth"), d="plant")
def p09(t):
    flagged = ledger(t).withColumn("ts", clock.floor_to("ts", 60))
    return fl.complete_fleet(fleeth(t).withColumn("value", F.col("value") - 1.5), "value", 5, flagged, "plant")


@query("p10_eligibility_funnel", sql("""
SELECT count(*) AS saved_rows, count(*) FILTER (NOT a) AS missing_label, count(*) FILTER (a AND NOT b) AS missing_power,
  count(*) FILTER (a AND b AND NOT c) AS missing_poa, count(*) FILTER (a AND b AND c) AS eligible FROM (
  SELECT n.ts IS NOT NULL AS a, s.power > 10 AS b, s.poa > 200 AS c FROM site5 s LEFT JOIN site5 n ON n.ts = s.ts + INTERVAL 15 MINUTE)
""", "site5"), i="saved_rows missing_label missing_power missing_poa eligible")
def p10(t):
    s = site5(t)
    later = s.select(clock.shift("ts", -15).alias("ts"), F.lit(True).alias("label"))
    return mk.funnel_counts(s.join(later, "ts", "left"), {
        "missing_label": F.col("label").isNotNull(), "missing_power": F.col("power") > 10, "missing_poa": F.col("poa") > 200})


@query("p11_period_by_target", sql("""
SELECT count(*) AS origins, min(ts) AS first_origin, max(ts) AS last_origin FROM site5
WHERE ts + INTERVAL 15 MINUTE >= TIMESTAMP '2024-01-10' AND ts + INTERVAL 15 MINUTE < TIMESTAMP '2024-01-20'
""", "site5"), i="origins")
def p11(t):
    rows = site5(t).where(mk.target_in_period("ts", "2024-01-10 00:00:00", "2024-01-20 00:00:00"))
    return rows.agg(F.count("*").alias("origins"), F.min("ts").alias("first_origin"), F.max("ts").alias("last_origin"))


PART = "CASE WHEN day({c}) <= 14 THEN 1 WHEN day({c}) <= 22 THEN 2 WHEN day({c}) <= 28 THEN 3 ELSE 0 END"


def part_label(c):
    d = F.dayofmonth(c)
    return F.when(d <= 14, 1).when(d <= 22, 2).when(d <= 28, 3).otherwise(0)


@query("p12_window_mask", sql(f"""
WITH v AS (SELECT ts FROM site5 WHERE poa > 100),
c AS (SELECT o.ts, count(v.ts) AS n FROM v o JOIN v ON v.ts BETWEEN o.ts - INTERVAL 30 MINUTE AND o.ts AND {PART.format(c='v.ts')} = {PART.format(c='o.ts')} GROUP BY 1)
SELECT s.ts, coalesce(c.n = 7, false) AND {PART.format(c='s.ts')} <> 0 AND {PART.format(c='s.ts')} = {PART.format(c='(s.ts + INTERVAL 15 MINUTE)')} AS usable
FROM site5 s LEFT JOIN c ON c.ts = s.ts
""", "site5"))
def p12(t):
    return mk.window_mask(site5(t), F.col("poa") > 100, part_label, 15).select("ts", "usable")


@query("p13_constrained", sql("""
SELECT ts, CASE WHEN hour(ts) < 6 OR hour(ts) >= 20 THEN 0 ELSE greatest(power - 20, 0) END AS poa, greatest(power - 30, 0) AS wind FROM site5
""", "site5"), d="poa wind")
def p13(t):
    elevation = F.when((F.hour("ts") < 6) | (F.hour("ts") >= 20), -5.0).otherwise(20.0)
    return site5(t).select("ts", mk.constrained(F.col("power") - 20, "poa", elevation).alias("poa"),
                           mk.constrained(F.col("power") - 30, "wind", elevation).alias("wind"))


@query("p14_equal_support", sql("""
SELECT a.ts FROM site5 a JOIN site5 b ON b.ts = a.ts - INTERVAL 5 MINUTE JOIN site5 c ON c.ts = a.ts + INTERVAL 5 MINUTE JOIN site5 d ON d.ts = a.ts + INTERVAL 15 MINUTE
""", "site5"))
def p14(t):
    from sunward.operators.align import with_offsets
    s = site5(t).select("ts", "power")
    out = with_offsets(s.select("ts"), s, ["power"], [-5, 5, 15])
    return mk.equal_support(out, ["power_m5", "power_p5", "power_p15"]).select("ts")


@query("p15_activity_subsets", sql("""
SELECT 'all' AS subset, count(*) AS n FROM site5 JOIN meter15 USING (ts) UNION ALL
SELECT 'active', count(*) FROM site5 JOIN meter15 USING (ts) WHERE power > 50 OR meter > 50
""", "site5", "meter15"), i="n")
def p15(t):
    rows = site5(t).join(meter15(t), "ts")
    rows = va.in_populations(rows, mk.activity("power", "meter", 50.0))
    return rows.groupBy(F.col("population").alias("subset")).agg(F.count("*").alias("n"))


@query("u01_union_all", sql("""
SELECT 'site' AS dataset, ts FROM site5 UNION ALL SELECT 'env', ts FROM env15 UNION ALL SELECT 'meter', ts FROM meter15
""", "site5", "env15", "meter15"))
def u01(t):
    return mk.union_labelled({"site": site5(t).select("ts"), "env": env15(t).select("ts"), "meter": meter15(t).select("ts")})


@query("u02_intersection", sql("SELECT ts FROM site5 INTERSECT SELECT ts FROM meter15", "site5", "meter15"))
def u02(t):
    return site5(t).select("ts").intersect(meter15(t).select("ts"))


@query("u03_difference", sql("SELECT ts FROM meter15 EXCEPT SELECT ts FROM env15", "meter15", "env15"))
def u03(t):
    return meter15(t).select("ts").exceptAll(env15(t).select("ts"))


@query("u04_distinct_union", sql("SELECT ts FROM meter15 UNION SELECT ts FROM env15", "meter15", "env15"))
def u04(t):
    return meter15(t).select("ts").union(env15(t).select("ts")).distinct()


@query("u05_outer_union", sql("SELECT coalesce(e.ts, m.ts) AS ts, ambient, meter FROM env15 e FULL JOIN meter15 m ON e.ts = m.ts", "meter15", "env15"),
       d="ambient meter")
def u05(t):
    return env15(t).select("ts", "ambient").join(meter15(t), "ts", "full_outer")
