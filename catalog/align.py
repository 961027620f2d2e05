"""Join and alignment queries."""

from pyspark.sql import functions as F

from sunward.functions import clock
from sunward.operators import align as al
from sunward.operators import fleet as fl
from sunward.operators import quality as qc
from sunward.operators import timeline as tl
from sunward.operators import validation as va

from .quality import RULES, ledger
from .registry import query
from .views import ROSTER, devh, env15, ev, fleeth, meter15, pairs, site5, sql, unitmonth

UNITS = tuple(f"inv_{n:02d}" for n in range(1, 25))


@query("j01_exact_left", sql("SELECT s.ts, s.power, e.ambient, e.wind FROM site5 s LEFT JOIN env15 e ON s.ts = e.ts", "site5", "env15"),
       d="power ambient wind")
def j01(t):
    return al.exact_left(site5(t).select("ts", "power"), env15(t))


@query("j02_interval_anchor", sql("""
SELECT s.ts, s.power, e.ambient, e.wind FROM site5 s LEFT JOIN env15 e ON time_bucket(INTERVAL 15 MINUTE, s.ts) = e.ts
""", "site5", "env15"), d="power ambient wind")
def j02(t):
    return al.interval_anchor(site5(t).select("ts", "power"), env15(t), 15)


@query("j03_inverse_expansion", sql("""
SELECT ts + to_minutes(o) AS ts, ambient, wind FROM env15, (VALUES (0), (5), (10)) AS v(o)
""", "env15"), d="ambient wind")
def j03(t):
    return al.expand_interval(env15(t), [0, 5, 10])


STRICT = """strict AS (SELECT ts, CASE WHEN count(value) = 5 THEN sum(value) END AS plant_power FROM fleeth GROUP BY 1)"""


def aligned(t):
    power = fl.strict_sum(fleeth(t), "value", ROSTER, "plant_power").select("ts", "plant_power")
    poa = site5(t).select("ts", "poa")
    lines = ledger(t).withColumn("ts", clock.floor_to("ts", 5))
    window = tl.overlap_window({"site": site5(t), "environment": env15(t)})
    return al.align_sources(site5(t), power, poa, env15(t), {"electrical_qc_flag": lines}, 15, window)


@query("j04_aligned_build", sql(f"""
WITH {STRICT}, {RULES}, w AS (SELECT greatest((SELECT min(ts) FROM site5), (SELECT min(ts) FROM env15)) AS a,
  least((SELECT max(ts) FROM site5), (SELECT max(ts) FROM env15)) AS z)
SELECT s.ts, plant_power, s.poa, e.ambient, e.wind, s.poa IS NOT NULL AS poa_available, e.ambient IS NOT NULL AND e.wind IS NOT NULL AS environment_available,
  plant_power IS NOT NULL AS ac_complete, s.poa IS NOT NULL AND e.ambient IS NOT NULL AND e.wind IS NOT NULL AS model_inputs_available,
  s.ts IN (SELECT time_bucket(INTERVAL 5 MINUTE, ts) FROM lines) AS electrical_qc_flag,
  month(s.ts) = 11 AND day(s.ts) <= 7 AND dayofweek(s.ts) = 0 AND hour(s.ts) = 1 AS dst_fall_ambiguous
FROM site5 s LEFT JOIN strict p ON p.ts = s.ts LEFT JOIN env15 e ON e.ts = time_bucket(INTERVAL 15 MINUTE, s.ts), w WHERE s.ts BETWEEN w.a AND w.z
""", "site5", "env15", "fleeth"), d="plant_power poa ambient wind")
def j04(t):
    return aligned(t)


@query("j05_exact_offsets", sql("""
SELECT a.ts, a.power, """ + ", ".join(f"(SELECT power FROM site5 b WHERE b.ts = a.ts {'+' if o >= 0 else '-'} INTERVAL {abs(o)} MINUTE) AS x_{'p' if o >= 0 else 'm'}{abs(o)}" for o in (-10, -5, 0, 15)) + " FROM site5 a", "site5"),
       d="power x_m10 x_m5 x_p0 x_p15")
def j05(t):
    s = site5(t).select("ts", "power")
    out = al.with_offsets(s, s.withColumnRenamed("power", "x"), ["x"], [-10, -5, 0, 15])
    return out


@query("j06_strict_mean", sql("""
SELECT m.ts, count(s.power) AS mean_samples, CASE WHEN count(s.power) = 3 THEN sum(s.power) / 3 END AS mean
FROM meter15 m LEFT JOIN site5 s ON s.ts IN (m.ts, m.ts + INTERVAL 5 MINUTE, m.ts + INTERVAL 10 MINUTE) GROUP BY 1
""", "site5", "meter15"), d="mean", i="mean_samples")
def j06(t):
    return al.strict_mean(meter15(t).select("ts"), site5(t), "power", [0, 5, 10], "mean")


@query("j07_meter_intervals", sql(f"""
WITH {RULES} SELECT m.ts, m.meter, count(s.power) AS expected_kw_samples, CASE WHEN count(s.power) = 3 THEN sum(s.power) / 3 END AS expected_kw,
  m.ts NOT IN (SELECT time_bucket(INTERVAL 15 MINUTE, ts) FROM lines) AS meter_qc_clear, count(s.power) = 3 AS model_available,
  m.meter - CASE WHEN count(s.power) = 3 THEN sum(s.power) / 3 END AS residual_kw
FROM meter15 m LEFT JOIN site5 s ON time_bucket(INTERVAL 15 MINUTE, s.ts) = m.ts GROUP BY m.ts, m.meter
""", "site5", "meter15"), d="meter expected_kw residual_kw", i="expected_kw_samples")
def j07(t):
    flagged = ledger(t).withColumn("ts", clock.floor_to("ts", 15))
    return al.meter_intervals(site5(t), meter15(t), flagged, "power", "meter", 1.0)


@query("j08_asof_bounded", sql("""
SELECT s.ts, e.ts AS record_ts, e.ambient, e.wind FROM (SELECT ts, ts - INTERVAL 15 MINUTE AS lim FROM site5) s
ASOF LEFT JOIN (SELECT ts AS ts, ambient, wind FROM env15) e ON s.lim >= e.ts
QUALIFY true
""", "site5", "env15").replace("SELECT s.ts, e.ts AS record_ts, e.ambient, e.wind FROM",
    "SELECT s.ts, CASE WHEN e.ts >= s.ts - INTERVAL 30 MINUTE THEN e.ts END AS record_ts, "
    "CASE WHEN e.ts >= s.ts - INTERVAL 30 MINUTE THEN e.ambient END AS ambient, "
    "CASE WHEN e.ts >= s.ts - INTERVAL 30 MINUTE THEN e.wind END AS wind FROM").replace("QUALIFY true", ""), d="ambient wind")
def j08(t):
    return al.asof_backward(site5(t).select("ts"), env15(t), ["ambient", "wind"])


@query("j09_nearest", sql("""
SELECT s.ts, arg_min(m.ts, (abs(epoch(m.ts) - epoch(s.ts)), -epoch(m.ts))) AS record_ts,
  arg_min(m.meter, (abs(epoch(m.ts) - epoch(s.ts)), -epoch(m.ts))) AS meter
FROM site5 s LEFT JOIN meter15 m ON m.ts BETWEEN s.ts - INTERVAL 450 SECOND AND s.ts + INTERVAL 450 SECOND GROUP BY 1
""", "site5", "meter15"), d="meter")
def j09(t):
    return al.nearest(site5(t).select("ts"), meter15(t), ["meter"])


def _two_sides(t):
    d = devh(t)
    expected = d.where("k > 30").select("ts", "inverter_id", (F.col("value") * 1.1).alias("e"))
    measured = d.where("k < 80").select("ts", "inverter_id", F.when(F.col("n") != 3, F.col("value")).alias("m"))
    return expected, measured


SIDES = """e AS (SELECT ts, inverter_id, value * 1.1 AS expected FROM devh WHERE k > 30),
m AS (SELECT ts, inverter_id, CASE WHEN n <> 3 THEN value END AS measured FROM devh WHERE k < 80),
p AS (SELECT coalesce(e.ts, m.ts) AS ts, coalesce(e.inverter_id, m.inverter_id) AS inverter_id, expected, measured,
  e.ts IS NOT NULL AS expected_record_present, m.ts IS NOT NULL AS measured_record_present,
  expected IS NOT NULL AND measured IS NOT NULL AS finite_pair FROM e FULL JOIN m ON e.ts = m.ts AND e.inverter_id = m.inverter_id)"""


@query("j10_outer_pairs", sql(f"WITH {SIDES} SELECT * FROM p", "devh"), d="expected measured")
def j10(t):
    e, m = _two_sides(t)
    return va.pair_keys(e, m, ["ts", "inverter_id"], "e", "m")


@query("j11_annotations", sql(f"""
WITH {SIDES} SELECT p.ts, p.inverter_id, CASE WHEN extract(day FROM p.ts) <= 15 THEN 'first' ELSE 'second' END AS period_label, finite_pair FROM p
""", "devh"))
def j11(t):
    e, m = _two_sides(t)
    pairs_ = va.pair_keys(e, m, ["ts", "inverter_id"], "e", "m")
    notes = devh(t).select("ts").distinct().withColumn(
        "period_label", F.when(F.dayofmonth("ts") <= 15, "first").otherwise("second"))
    va.check_covered(pairs_, notes, ["ts"])
    return va.annotate(pairs_, notes, "period_label", ["ts"]).select("ts", "inverter_id", "period_label", "finite_pair")


@query("j12_period_masks", sql("""
SELECT ts, hour(ts) < 8 AS early, hour(ts) >= 16 AS late, CASE WHEN hour(ts) < 8 THEN 'early' WHEN hour(ts) >= 16 THEN 'late' ELSE 'unlabelled' END AS period_label,
  (hour(ts) < 8)::INT + (hour(ts) >= 16)::INT AS "overlaps" FROM (SELECT DISTINCT ts FROM devh)
""", "devh"), i='"overlaps"')
def j12(t):
    masks = devh(t).select("ts").distinct().select("ts", (F.hour("ts") < 8).alias("early"), (F.hour("ts") >= 16).alias("late"))
    va.check_exclusive(masks, ["early", "late"])
    return va.period_from_masks(masks, ["early", "late"])


@query("j13_alignment_gate", sql("""
WITH a AS (SELECT DISTINCT ts FROM fleeth WHERE inverter_id = 'click'), b AS (SELECT DISTINCT ts FROM fleeth WHERE inverter_id = 'view')
SELECT (SELECT count(*) FROM a WHERE ts IN (SELECT ts FROM b)) AS shared, (SELECT count(*) FROM a WHERE ts NOT IN (SELECT ts FROM b)) AS left_only,
  (SELECT count(*) FROM b WHERE ts NOT IN (SELECT ts FROM a)) AS right_only
""", "fleeth"), i="shared left_only right_only")
def j13(t):
    f = fleeth(t)
    return al.key_differences(f.where("inverter_id = 'click'"), f.where("inverter_id = 'view'"), ["ts"])


@query("j14_roster_expansion", sql("""
SELECT u.inverter_id, count(*) AS records, sum(power) AS total FROM site5,
  (SELECT 'inv_' || lpad(CAST(g AS VARCHAR), 2, '0') AS inverter_id FROM range(1, 25) AS r(g)) u GROUP BY 1
""", "site5"), d="total", i="records")
def j14(t):
    return fl.represent(site5(t), UNITS).groupBy("inverter_id").agg(
        F.count("*").alias("records"), F.sum("power").alias("total"))


@query("j15_roster_problems", sql("""
WITH o AS (SELECT ts, inverter_id FROM fleeth WHERE k > 20 UNION ALL SELECT ts, inverter_id FROM fleeth WHERE k > 80
  UNION ALL SELECT ts, 'stranger' FROM fleeth WHERE k > 90), w AS (SELECT DISTINCT ts FROM fleeth WHERE hour(ts) <> 3),
c AS (SELECT ts, inverter_id, count(*) AS c FROM o GROUP BY 1, 2),
s AS (SELECT ts, count(*) FILTER (inverter_id <> 'stranger') AS known, count(*) FILTER (inverter_id = 'stranger') AS unexpected, count(*) FILTER (c > 1) AS duplicated FROM c GROUP BY 1)
SELECT coalesce(w.ts, s.ts) AS ts, s.ts IS NULL AS missing_label, w.ts IS NULL AS unexpected_label, 5 - coalesce(known, 0) AS missing,
  coalesce(unexpected, 0) AS unexpected, coalesce(duplicated, 0) AS duplicated FROM w FULL JOIN s ON w.ts = s.ts
""", "fleeth"), i="missing unexpected duplicated")
def j15(t):
    f = fleeth(t)
    outputs = (f.where("k > 20").select("ts", "inverter_id").unionByName(f.where("k > 80").select("ts", "inverter_id"))
               .unionByName(f.where("k > 90").select("ts", F.lit("stranger").alias("inverter_id"))))
    return fl.roster_problems(outputs, f.where(F.hour("ts") != 3), ROSTER)


@query("j16_wide_to_long", sql("""
SELECT ts, inverter_id, max(CASE WHEN quantity = 'power' THEN v END) AS power, max(CASE WHEN quantity = 'load' THEN v END) AS load FROM (
  SELECT date_trunc('hour', ts) AS ts, 'inv_01' AS inverter_id, 'power' AS quantity, avg(value) AS v FROM ev WHERE event_type = 'click' GROUP BY 1
  UNION ALL SELECT date_trunc('hour', ts), 'inv_01', 'load', avg(k) FROM ev WHERE event_type = 'click' GROUP BY 1
  UNION ALL SELECT date_trunc('hour', ts), 'inv_02', 'power', avg(value) FROM ev WHERE event_type = 'view' GROUP BY 1
  UNION ALL SELECT date_trunc('hour', ts), 'inv_02', 'load', avg(k) FROM ev WHERE event_type = 'view' GROUP BY 1) GROUP BY 1, 2
""", "ev"), d="power load")
def j16(t):
    e = ev(t)
    wide = e.groupBy(clock.floor_to("ts", 60).alias("ts")).agg(*[
        F.avg(F.when(F.col("event_type") == kind, F.col(c))).alias(f"inv_{n}_{q}_inv_{n}7")
        for n, kind in (("01", "click"), ("02", "view")) for q, c in (("power", "value"), ("load", "k"))])
    long = fl.to_long(wide, ["ts"])
    return fl.per_device(long.where("value is not null"), ["power", "load"])


@query("j17_long_to_wide", sql(f"""
SELECT ts, {", ".join(f"max(value) FILTER (inverter_id = '{r}') AS {r}" for r in ROSTER)}, count(DISTINCT inverter_id) AS devices FROM fleeth GROUP BY 1
""", "fleeth"), d=" ".join(ROSTER), i="devices")
def j17(t):
    return fl.to_matrix(fleeth(t), "value", ROSTER)


BINS = """bins AS (SELECT o_orderpriority AS unit, month(o_orderdate) AS month, year(o_orderdate) AS year, avg(o_totalprice) AS mean, count(*) AS n
  FROM orders GROUP BY 1, 2, 3)"""


@query("j18_matched_to_reference", f"""
WITH {BINS} SELECT a.unit, a.month, a.year, a.mean, a.n, b.mean AS mean_reference, b.n AS n_reference FROM bins a JOIN bins b
  ON a.unit = b.unit AND a.month = b.month WHERE b.year = 1997 AND a.year <> 1997
""", d="mean mean_reference", i="month year n n_reference")
def j18(t):
    bins = t.orders.groupBy(F.col("o_orderpriority").alias("unit"), F.month("o_orderdate").alias("month"),
                            F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("mean"), F.count("*").alias("n"))
    return al.matched_to_reference(bins, ["unit", "month"], "year", 1997)


@query("j19_semi_anti", sql(f"""
WITH {RULES}, f AS (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, ts) AS ts FROM lines)
SELECT 'flagged' AS side, count(*) AS labels, sum(power) AS total FROM site5 WHERE ts IN (SELECT ts FROM f)
UNION ALL SELECT 'clear', count(*), sum(power) FROM site5 WHERE ts NOT IN (SELECT ts FROM f)
""", "site5"), d="total", i="labels")
def j19(t):
    times = ledger(t).select(clock.floor_to("ts", 5).alias("ts"))

    def one(df, side):
        return df.agg(F.count("*").alias("labels"), F.sum("power").alias("total")).select(F.lit(side).alias("side"), "labels", "total")

    return one(al.semi(site5(t), times), "flagged").unionByName(one(al.anti(site5(t), times), "clear"))


@query("j20_event_context", sql(f"""
WITH {RULES}, q AS (SELECT l.event_id, time_bucket(INTERVAL 1 HOUR, l.ts) AS ts, flag, e.inverter_id FROM lines l JOIN ev e USING (event_id))
SELECT q.event_id, q.ts, q.flag, q.inverter_id, n.ambient, s.power, m.meter,
  (SELECT min(value) FROM devh d WHERE d.ts = q.ts AND d.inverter_id <> q.inverter_id) AS peer_min,
  (SELECT max(value) FROM devh d WHERE d.ts = q.ts AND d.inverter_id <> q.inverter_id) AS peer_max
FROM q LEFT JOIN env15 n ON n.ts = q.ts LEFT JOIN site5 s ON s.ts = q.ts LEFT JOIN meter15 m ON m.ts = q.ts
""", "devh", "env15", "site5", "meter15"), d="ambient power meter peer_min peer_max")
def j20(t):
    lines = ledger(t).select("event_id", "flag").join(ev(t).select("event_id", "ts", "inverter_id"), "event_id")
    lines = lines.withColumn("ts", clock.floor_to("ts", 60))
    out = al.event_context(lines, {"ambient": (env15(t), "ambient"), "power": (site5(t), "power"), "meter": (meter15(t), "meter")})
    return al.peer_range(out, devh(t), "inverter_id", "value")


@query("j21_label_identity", sql("""
WITH a AS (SELECT ts, n, avg_v FROM (SELECT ts, n, round(power, 3) AS avg_v FROM site5)), b AS (SELECT ts, CASE WHEN minute(ts) = 30 THEN n + 1 ELSE n END AS n,
  CASE WHEN minute(ts) = 45 THEN NULL ELSE avg_v END AS avg_v FROM a WHERE hour(ts) <> 6)
SELECT count(*) FILTER (x AND y) AS paired, count(*) FILTER (NOT (x AND y)) AS unpaired, count(*) FILTER (x AND y AND an IS DISTINCT FROM bn) AS unequal_n,
  count(*) FILTER (x AND y AND av IS DISTINCT FROM bv) AS unequal_avg_v FROM (
  SELECT a.ts IS NOT NULL AS x, b.ts IS NOT NULL AS y, a.n AS an, b.n AS bn, a.avg_v AS av, b.avg_v AS bv FROM a FULL JOIN b ON a.ts = b.ts)
""", "site5"), i="paired unpaired unequal_n unequal_avg_v")
def j21(t):
    a = site5(t).select("ts", "n", F.round("power", 3).alias("avg_v"))
    b = a.where(F.hour("ts") != 6).withColumn("n", F.when(F.minute("ts") == 30, F.col("n") + 1).otherwise(F.col("n")))
    b = b.withColumn("avg_v", F.when(F.minute("ts") != 45, F.col("avg_v")))
    return al.unequal_labels(a, b, ["ts"], ["n", "avg_v"])


@query("j22_relative_to_reference", sql("""
SELECT u.unit, u.month, u.ratio, 100 * u.ratio / r.m AS "index" FROM unitmonth u LEFT JOIN
  (SELECT unit, avg(ratio) AS m FROM unitmonth WHERE year = 1997 GROUP BY 1) r USING (unit)
""", "unitmonth"), d='ratio "index"')
def j22(t):
    out = al.relative_to_reference(unitmonth(t), ["unit"], "ratio", F.col("year") == 1997, "index")
    return out.select("unit", "month", "ratio", "index")


@query("j23_device_masks", sql("""
SELECT s.ts, u.inverter_id, s.poa > 400 AS candidate, s.poa > 400 AND d.value IS NOT NULL AS eligible FROM site5 s,
  (SELECT 'inv_' || lpad(CAST(g AS VARCHAR), 2, '0') AS inverter_id FROM range(1, 25) AS r(g)) u LEFT JOIN devh d ON d.ts = s.ts AND d.inverter_id = u.inverter_id
""", "site5", "devh"))
def j23(t):
    mask = site5(t).select("ts", (F.col("poa") > 400).alias("candidate"))
    return fl.device_masks(mask, devh(t), UNITS, "candidate", "value")
