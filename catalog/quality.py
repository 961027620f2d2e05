"""Cleaning and QC-ledger queries."""

from pyspark.sql import functions as F

from sunward.functions import clock
from sunward.functions.values import to_celsius, to_metres_per_second
from sunward.operators import quality as qc

from .registry import query
from .views import ev, site5, slots15, sql, wx

RULES = """lines AS (
  SELECT event_id, ts, value AS raw_value, 'qc_ceiling' AS flag, 'above channel ceiling' AS reason FROM ev WHERE value > 250
  UNION ALL SELECT event_id, ts, value, 'qc_night', 'positive at night' FROM ev WHERE hour(ts) < 5 AND value > 100
  UNION ALL SELECT event_id, ts, value, 'qc_zero', 'daytime zero' FROM ev WHERE k = 0 AND hour(ts) BETWEEN 10 AND 15)"""


def ledger(t):
    return qc.build_ledger(ev(t), ["event_id", "ts"], "value", {
        "qc_ceiling": (F.col("value") > 250, "above channel ceiling"),
        "qc_night": ((F.hour("ts") < 5) & (F.col("value") > 100), "positive at night"),
        "qc_zero": ((F.col("k") == 0) & F.hour("ts").between(10, 15), "daytime zero")})


@query("c01_arrange_channels", sql("SELECT inverter_id AS unit, ts AS measured_on, count(*) AS n, CAST(NULL AS DOUBLE) AS dc_voltage FROM ev GROUP BY 1, 2", "ev"),
       d="dc_voltage", i="n")
def c01(t):
    rows = ev(t).groupBy("inverter_id", "ts").agg(F.count("*").alias("n"))
    return qc.arrange_channels(rows, {"inverter_id": "unit", "ts": "measured_on"}, ["dc_voltage"],
                               ["unit", "measured_on", "n", "dc_voltage"])


@query("c02_apply_approved", sql(f"""
WITH {RULES} SELECT event_type, count(*) AS records, count(*) FILTER (flagged) AS blanked, sum(CASE WHEN NOT flagged THEN value END) AS clean_total
FROM (SELECT event_type, value, event_id IN (SELECT event_id FROM lines WHERE flag = 'qc_ceiling') AS flagged FROM ev) GROUP BY 1
""", "ev"), d="clean_total", i="records blanked")
def c02(t):
    lines = ledger(t)
    out = qc.apply_approved(ev(t), lines, ["event_id"], "value", "clean", "qc_ceiling")
    return out.groupBy("event_type").agg(F.count("*").alias("records"), F.count_if("blanked").alias("blanked"),
                                         F.sum("clean").alias("clean_total"))


@query("c03_build_ledger", sql(f"WITH {RULES} SELECT * FROM lines", "ev"), d="raw_value")
def c03(t):
    return ledger(t)


@query("c03_ledger_duplicates", sql(f"WITH {RULES} SELECT ts, flag, count(*) AS copies FROM (SELECT date_trunc('hour', ts) AS ts, flag FROM lines) GROUP BY 1, 2 HAVING count(*) > 1", "ev"),
       i="copies")
def c03b(t):
    hourly = ledger(t).withColumn("ts", clock.floor_to("ts", 60))
    return qc.ledger_duplicates(hourly, ["ts"])


@query("c04_unit_conversion", sql("""
SELECT status, flag, avg((ambient - 32) * 5 / 9) AS celsius, avg(wind * 0.44704) AS metres_per_second FROM wx GROUP BY 1, 2
""", "wx"), d="celsius metres_per_second")
def c04(t):
    return wx(t).groupBy("status", "flag").agg(
        F.avg(to_celsius("ambient")).alias("celsius"), F.avg(to_metres_per_second("wind")).alias("metres_per_second"))


def _versions(t):
    raw = ev(t).select("event_id", "value")
    blank = F.when(~((F.col("value") > 250) | (F.col("event_id") % 1009 == 3)), F.col("value"))
    return raw, raw.withColumn("value", blank)


@query("c05_unexplained_changes", sql(f"""
WITH {RULES} SELECT event_id, value AS before, CAST(NULL AS DOUBLE) AS after, false AS unpaired FROM ev
WHERE (value > 250 OR event_id % 1009 = 3) AND event_id NOT IN (SELECT event_id FROM lines)
""", "ev"), d="before after")
def c05(t):
    raw, clean = _versions(t)
    return qc.unexplained_changes(raw, clean, ledger(t), ["event_id"])


@query("c06_formula_check", """
SELECT count(*) AS records, count(*) FILTER (l_quantity = 7) AS value_mismatches, count(*) FILTER (l_quantity = 9) AS null_mismatches FROM lineitem
""", i="records value_mismatches null_mismatches")
def c06(t):
    exact = to_celsius("l_quantity")
    stored = F.when(F.col("l_quantity") == 7, exact + 1e-6).when(F.col("l_quantity") != 9, exact)
    return qc.formula_mismatches(t.lineitem.withColumn("stored", stored), "stored", exact)


@query("c07_flag_membership", sql(f"""
WITH {RULES}, hours AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM lines)
SELECT CAST(ts AS DATE) AS day, count(*) AS labels, count(*) FILTER (date_trunc('hour', ts) IN (SELECT ts FROM hours)) AS flagged
FROM (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM ev) GROUP BY 1
""", "ev"), i="labels flagged", t="day")
def c07(t):
    hours = ev(t).select(clock.floor_to("ts", 60).alias("ts")).distinct()
    out = qc.flag_membership(hours, ledger(t).withColumn("ts", clock.floor_to("ts", 60)), "qc_flag")
    return out.groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count("*").alias("labels"), F.count_if("qc_flag").alias("flagged"))


@query("c08_flag_counts", sql(f"WITH {RULES} SELECT flag, count(*) AS events FROM lines GROUP BY 1", "ev"), i="events")
def c08(t):
    return qc.flag_counts(ledger(t))


@query("c09_valid_readings", sql("""
SELECT year(ts) AS year, count(*) AS records, count(*) FILTER (NOT flagged AND NOT bad) AS valid,
  sum(CASE WHEN NOT flagged AND NOT bad THEN poa END) AS total FROM (
  SELECT ts, poa, tax = 0.08 AS flagged, (month(ts) = 11 AND day(ts) <= 7 AND dayofweek(ts) = 0 AND hour(ts) = 1)
   OR (month(ts) = 3 AND day(ts) BETWEEN 8 AND 14 AND dayofweek(ts) = 0 AND hour(ts) = 2) AS bad FROM wx) GROUP BY 1
""", "wx"), d="total", i="year records valid")
def c09(t):
    rows = wx(t).withColumn("flagged", F.col("tax") == 0.08)
    out = qc.valid_readings(rows, "poa", "valid_poa", "flagged", 0.0, "ts")
    return out.groupBy(F.year("ts").alias("year")).agg(
        F.count("*").alias("records"), F.count("valid_poa").alias("valid"), F.sum("valid_poa").alias("total"))
