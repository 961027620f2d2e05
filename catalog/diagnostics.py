"""Screening, matched-condition and study queries, and the flagship run."""

from functools import reduce

from pyspark.sql import functions as F

from sunward.config import CandidateThresholds
from sunward.functions import clock
from sunward.functions.binning import floor_bin
from sunward.functions.values import ratio
from sunward.operators import align as al
from sunward.operators import profiles as pf
from sunward.operators import screening as sc
from sunward.operators import windows as wn
from sunward.plans import baseline as bl

from .metrics import scale_sql
from .physics import OFFSETS, TEMP, blend, corners, geometry_view, model, sandia, shifted
from .profiles import strata
from .quality import RULES, ledger
from .registry import query
from .views import ROSTER, SQL, _view, env15, ev, fleeth, meter15, once, site5, sql, unitmonth, wx
from .windows import _tag, ramps

PACO, PDCO = 10000.0, 12000.0
LIMITS = CandidateThresholds(300.0, 0.10, 0.90, 0.45, 0.75, 0.60)


def baseline_rows(t):
    """Hourly nominal model stand-in with the flags the screens read."""
    hours = ev(t).groupBy(clock.floor_to("ts", 60).alias("ts")).agg((F.avg("k") * 10).alias("poa"), F.count("*").alias("n"), F.avg("value").alias("v"))
    p = F.col("poa")
    return hours.select("ts", "poa", (F.lit(640.0)).alias("expected_dc_voltage_ideal"), (2 + p / 100).alias("expected_dc_current_ideal"),
                        (640.0 * (2 + p / 100)).alias("expected_dc_power_ideal"), (F.col("n") > 6).alias("model_inputs_available"),
                        (F.col("n") > 7).alias("dc_model_computed"), (F.col("v") > 60).alias("electrical_qc_flag"),
                        (F.col("v") < 30).alias("irradiance_qc_flag"), F.lit(False).alias("dst_fall_ambiguous"))


def readings(t):
    """Per-unit hourly DC and AC; the unit 'view' has no voltage channel, and readings are missing where k is 33."""
    here = F.coalesce(F.col("k") != 33, F.lit(False))
    rows = fleeth(t).withColumn("voltage", F.when(here & (F.col("inverter_id") != "view"), 520 + F.col("k") * 2))
    rows = rows.withColumn("current", F.when(here, 4 + F.sqrt("value") / 3))
    return rows.select("ts", "inverter_id", "voltage", "current", (F.col("voltage") * F.col("current")).alias("power"),
                       (600 * F.col("current") + F.col("k")).alias("ac"))


def features(t):
    return once(sc.candidate_features(baseline_rows(t), readings(t), 5, ("view",), 3600))


_view("base", """SELECT ts, poa, 640.0 AS ev_, 2 + poa / 100 AS ei_, 640.0 * (2 + poa / 100) AS ep_, n > 6 AS inputs, n > 7 AS computed, v > 60 AS eqc, v < 30 AS iqc FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(k) * 10 AS poa, count(*) AS n, avg(value) AS v FROM ev GROUP BY 1)""", ("ev",))
_view("reads", """SELECT ts, inverter_id, v, i, v * i AS p, 600 * i + k AS ac FROM (SELECT ts, inverter_id, k, CASE WHEN inverter_id <> 'view' AND k <> 33 THEN 520 + k * 2 END AS v, CASE WHEN k <> 33 THEN 4 + sqrt(value) / 3 END AS i FROM fleeth)""", ("fleeth",))
_view("feat", """WITH m AS (SELECT ts, median(i) AS mi, median(ac) AS mac FROM reads GROUP BY 1),
  g AS (SELECT b.ts, count(v) = 4 AS fv, count(i) = 5 AS fi, count(ac) = 5 AS fa, median(v) AS v_med, median(i) AS i_med, median(p) AS p_med, median(ac) AS ac_med, median(v / ev_) AS v_r, median(i / ei_) AS i_r,
    median(p / ep_) AS p_r, max(abs(v / ev_ - 1)) AS v_dev, max(abs(i - mi) / mi) AS i_dev, max(abs(ac - mac) / mac) AS ac_dev, min(ac) AS ac_min, max(ac) AS ac_max, max(CASE WHEN v IS NOT NULL THEN ac / p END) AS acdc
    FROM reads r JOIN base b ON b.ts = r.ts JOIN m ON m.ts = r.ts GROUP BY b.ts)
  SELECT b.*, coalesce(fv AND fi, false) AS finite_dc, coalesce(fv AND fi, false) AS positive_dc, coalesce(fa, false) AS finite_ac, CASE WHEN fv THEN v_med END AS measured_dc_voltage_median,
    CASE WHEN fi THEN i_med END AS measured_dc_current_median, CASE WHEN fv THEN p_med END AS measured_dc_power_median, CASE WHEN fv THEN v_r END AS voltage_ratio, CASE WHEN fi THEN i_r END AS current_ratio,
    CASE WHEN fv THEN p_r END AS power_ratio, CASE WHEN fv THEN v_dev END AS v_dev, CASE WHEN fi THEN i_dev END AS i_dev, CASE WHEN fa THEN ac_dev END AS ac_dev, CASE WHEN fa THEN ac_min END AS ac_min,
    CASE WHEN fa THEN ac_max END AS ac_max, CASE WHEN fa THEN ac_med END AS ac_med, CASE WHEN fv THEN acdc END AS acdc,
    CASE WHEN x.poa IS NOT NULL AND y.poa IS NOT NULL AND b.poa <> 0 THEN greatest(abs(b.poa - x.poa), abs(b.poa - y.poa)) / b.poa END AS ramp
  FROM base b LEFT JOIN g ON g.ts = b.ts LEFT JOIN base x ON x.ts = b.ts - INTERVAL 1 HOUR LEFT JOIN base y ON y.ts = b.ts + INTERVAL 1 HOUR""", ("base", "reads"))

FEATURES = {"measured_dc_voltage_median": None, "measured_dc_current_median": None, "measured_dc_power_median": None, "voltage_ratio": None, "current_ratio": None, "power_ratio": None,
            "maximum_voltage_mpp_deviation": "v_dev", "maximum_current_consensus_deviation": "i_dev", "maximum_ac_consensus_deviation": "ac_dev", "minimum_ac_power_w": "ac_min",
            "maximum_ac_power_w": "ac_max", "measured_ac_power_median_w": "ac_med", "maximum_ac_to_dc_power_ratio": "acdc", "maximum_adjacent_poa_ramp": "ramp"}


@query("d01_candidate_features", sql("SELECT ts, finite_dc, positive_dc, finite_ac, " + ", ".join(f"{c or n} AS {n}" for n, c in FEATURES.items()) + " FROM feat", "feat"), d=" ".join(FEATURES))
def d01(t):
    return features(t).select("ts", "finite_dc", "positive_dc", "finite_ac", *FEATURES)


def rules_sql(x: CandidateThresholds):
    ramp = "true" if x.maximum_poa_ramp is None else f"ramp <= {x.maximum_poa_ramp}"
    return {"valid_model_inputs": "inputs AND computed", "known_qc_and_dst_clear": "NOT eqc AND NOT iqc", "meaningful_irradiance": f"poa >= {x.minimum_poa}",
            "available_dc_and_ac": "finite_dc AND positive_dc AND finite_ac", "all_inverters_operating": f"ac_min >= {x.minimum_ac_fraction * PACO!r}",
            "below_rating_guards": f"ac_max < {x.rating_margin * PACO!r} AND ep_ < {x.rating_margin * PDCO!r}", "voltage_mpp_compatible": f"v_dev <= {x.voltage_tolerance}",
            "all_inverters_consensus": f"i_dev <= {x.consensus_tolerance} AND ac_dev <= {x.consensus_tolerance}", "stable_adjacent_poa": ramp}


def _funnel():
    rules, parts, done = rules_sql(LIMITS), ["SELECT 0 AS step, 'all_timestamps' AS stage, count(*) AS remaining, 0 AS removed, 0 AS failed_independently FROM feat"], []
    for i, (n, c) in enumerate(rules.items(), 1):
        before = " AND ".join(f"coalesce({x}, false)" for x in done) or "true"
        ok = f"coalesce({c}, false)"
        parts.append(f"SELECT {i}, '{n}', count(*) FILTER ({before} AND {ok}), count(*) FILTER ({before} AND NOT {ok}), count(*) FILTER (NOT {ok}) FROM feat")
        done.append(c)
    return " UNION ALL ".join(parts)


@query("p06_screen_funnel", sql(_funnel(), "feat"), i="step remaining removed failed_independently", covers=("P06", "W05"))
def p06(t):
    return sc.select_candidates(features(t), PACO, PDCO, LIMITS)[1]


ALL = " AND ".join(f"coalesce({c}, false)" for c in rules_sql(LIMITS).values())


@query("p06_candidate_mask", sql(f"SELECT ts, {ALL} AS candidate_healthy_mask FROM feat", "feat"))
def p06b(t):
    return sc.select_candidates(features(t), PACO, PDCO, LIMITS)[0].select("ts", "candidate_healthy_mask")


def _sweep_sql():
    from dataclasses import replace
    parts = []
    for name, values in sc.SWEEP.items():
        for v in values:
            cond = " AND ".join(f"coalesce({c}, false)" for c in rules_sql(replace(LIMITS, **{name: v})).values())
            parts.append(f"SELECT '{name}' AS threshold, '{v}' AS setting, count(*) AS timestamps, median(voltage_ratio) AS voltage_ratio_median, median(current_ratio) AS current_ratio_median, median(power_ratio) AS power_ratio_median FROM feat WHERE {cond}")
    return " UNION ALL ".join(parts)


@query("d02_threshold_sweep", sql(_sweep_sql(), "feat"), d="voltage_ratio_median current_ratio_median power_ratio_median", i="timestamps")
def d02(t):
    return sc.threshold_sweep(features(t), PACO, PDCO, LIMITS)


Q3 = {"voltage": ("v", "ev_"), "current": ("i", "ei_"), "power": ("p", "ep_")}


@query("d03_device_coverage", sql(f"""
WITH c AS (SELECT *, {ALL} AS cand, poa >= 200 AND finite_ac AS pre FROM feat)
SELECT inverter_id, {", ".join(f"count({a} / {b}) FILTER (cand) AS {q}_valid_pairs" for q, (a, b) in Q3.items())},
  avg(CASE WHEN abs(i - measured_dc_current_median) / measured_dc_current_median > 0.2 THEN 1.0 ELSE 0 END) FILTER (pre) AS current_disagreement_fraction,
  avg(CASE WHEN abs(ac - ac_med) / ac_med > 0.2 THEN 1.0 ELSE 0 END) FILTER (pre) AS ac_disagreement_fraction,
  {", ".join(f"quantile_cont({a} / {b}, {p}) FILTER (cand) AS {q}_ratio_p{round(p * 100)}" for q, (a, b) in Q3.items() for p in (.1, .5, .9))}
FROM reads JOIN c ON c.ts = reads.ts GROUP BY 1
""", "feat"), d="current_disagreement_fraction ac_disagreement_fraction " + " ".join(f"{q}_ratio_p{p}" for q in Q3 for p in (10, 50, 90)),
       i=" ".join(f"{q}_valid_pairs" for q in Q3))
def d03(t):
    masks = sc.select_candidates(features(t), PACO, PDCO, LIMITS)[0].withColumn("preliminary", (F.col("poa") >= 200) & F.col("finite_ac"))
    return sc.device_candidate_coverage(masks, readings(t), 0.2)


VALS = ", ".join(f"median({v}) FILTER (phase = '{ph}') AS {ph}_{v}" for ph in ("AM", "PM") for v in sc.MATCHED)
DIFF = ", ".join(f"median({q}_ratio) FILTER (phase = 'PM') - median({q}_ratio) FILTER (phase = 'AM') AS {q}_pm_minus_am" for q in sc.QUANTITIES)


def matched_sql(source="strata", extra=(), minimum=10, groups="", poa_width=100.0, temp_width=10.0, vals=VALS, diff=DIFF):
    made = {"year": "year(ts) AS year_bin", "aoi": "floor(aoi / 10) * 10 AS aoi_bin", "wind": "floor(wind) AS wind_bin"}
    keys = [f"floor(poa / {poa_width}) * {poa_width} AS poa_bin", f"floor(temp_cell / {temp_width}) * {temp_width} AS temp_bin", "season", *[made[e] for e in extra]]
    g = f"{groups}, " if groups else ""
    n = len(keys) + (1 if groups else 0)
    return f"""SELECT {g}{", ".join(keys)}, count(*) FILTER (phase = 'AM') AS AM_samples, count(*) FILTER (phase = 'PM') AS PM_samples, {vals},
  least(count(*) FILTER (phase = 'AM'), count(*) FILTER (phase = 'PM')) AS balanced_weight, least(count(*) FILTER (phase = 'AM'), count(*) FILTER (phase = 'PM')) >= {minimum} AS adequate, {diff}
  FROM {source} GROUP BY {", ".join(str(i + 1) for i in range(n))}"""


MD = "poa_bin temp_bin " + " ".join(f"{ph}_{v}" for ph in ("AM", "PM") for v in sc.MATCHED) + " " + " ".join(f"{q}_pm_minus_am" for q in sc.QUANTITIES)


@query("d04_matched_strata", sql(matched_sql(), "strata"), d=MD, i="AM_samples PM_samples balanced_weight")
def d04(t):
    return sc.matched_strata(strata(t))


@query("d04_matched_strata_fine", sql(matched_sql(extra=("year", "wind"), minimum=2), "strata"), d=MD + " wind_bin", i="AM_samples PM_samples balanced_weight year_bin")
def d04b(t):
    return sc.matched_strata(strata(t), extra=("year", "wind"), minimum=2)


def summary_sql(inner, quantities=sc.QUANTITIES, groups=""):
    g = f"{groups}, " if groups else ""
    avg = ", ".join(f"sum({ph}_{q}_ratio * balanced_weight) FILTER (adequate) / sum(balanced_weight) FILTER (adequate) AS {q}_{ph}" for q in quantities for ph in ("AM", "PM"))
    dif = ", ".join(f"{q}_PM - {q}_AM AS {q}_pm_minus_am" for q in quantities)
    return f"""SELECT *, {dif} FROM (SELECT {g}count(*) AS occupied_bins, count(*) FILTER (adequate) AS adequate_bins, coalesce(sum(balanced_weight) FILTER (adequate), 0) AS balanced_samples, {avg}
      FROM ({inner}) {f'GROUP BY {groups}' if groups else ''})"""


SD = " ".join(f"{q}_AM {q}_PM {q}_pm_minus_am" for q in sc.QUANTITIES)


@query("d05_matched_summary", sql(summary_sql(matched_sql(extra=("aoi",))), "strata"), d=SD, i="occupied_bins adequate_bins balanced_samples")
def d05(t):
    return sc.matched_summary(sc.matched_strata(strata(t), extra=("aoi",)))


@query("d06_scenario_comparison", sql("""
SELECT scenario, quantile_cont(st - tc, 0.1) AS delta_p10, quantile_cont(st - tc, 0.5) AS delta_p50, quantile_cont(st - tc, 0.9) AS delta_p90, median((600 + tax * 500) / sv) AS voltage_median,
  median(poa * 25 / (sv * si)) AS power_median, count(*) AS records FROM (SELECT *, ambient + poa / (25 + 6.84 * wind) AS tc FROM scen) GROUP BY 1
""", "scen"), d="delta_p10 delta_p50 delta_p90 voltage_median power_median", i="records")
def d06(t):
    from .physics import scenario_rows
    from sunward.functions.physics import cell_temperature
    from sunward.operators.ordered import with_quantiles
    rows = scenario_rows(t).withColumn("delta", F.col("scenario_temp") - cell_temperature("poa", "ambient", "wind"))
    base = rows.groupBy("scenario").agg(F.count("*").alias("records"))
    return with_quantiles(base, rows, ["scenario"], {"delta_p10": ("delta", .1), "delta_p50": ("delta", .5), "delta_p90": ("delta", .9),
                                                     "voltage_median": ("voltage_ratio", .5), "power_median": ("power_ratio", .5)})


_view("geofixed", geometry_view("geofixed", "wx", "-8.0"), ("wx",))
_view("clocks", "SELECT 'daylight_zone' AS clock, ts, poa, ambient + poa / (25 + 6.84 * wind) AS temp_cell, phase, (poa / 30 + wind) / (poa / 25) AS current_ratio, 'all' AS season FROM geo UNION ALL "
      "SELECT 'fixed_offset', ts, poa, ambient + poa / (25 + 6.84 * wind), phase, (poa / 30 + wind) / (poa / 25), 'all' FROM geofixed", ("geo", "geofixed"))
ONE = ", ".join(f"median(current_ratio) FILTER (phase = '{ph}') AS {ph}_current_ratio" for ph in ("AM", "PM"))


@query("d07_clock_hypotheses", sql(summary_sql(matched_sql("clocks", groups="clock", vals=ONE, diff="0 AS x"), ("current",), "clock"), "clocks"),
       d="current_AM current_PM current_pm_minus_am", i="occupied_bins adequate_bins balanced_samples")
def d07(t):
    from sunward.functions import physics as ph, solar
    from .physics import SITE
    rows = wx(t).withColumn("temp_cell", ph.cell_temperature("poa", "ambient", "wind")).withColumn("season", F.lit("all"))
    rows = rows.withColumn("current_ratio", (F.col("poa") / 30 + F.col("wind")) / (F.col("poa") / 25))
    zone = solar.with_geometry(rows, SITE).withColumn("clock", F.lit("daylight_zone"))
    fixed = solar.with_geometry(rows, SITE, offset=F.lit(-8.0)).withColumn("clock", F.lit("fixed_offset"))
    both = zone.unionByName(fixed).withColumn("phase", F.col("solar_phase"))
    strata_ = sc.matched_strata(both, values=("current_ratio",), groups=("clock",))
    return sc.matched_summary(strata_, ("current",), ("clock",))


def _timing_rows(t):
    rows = shifted(t).withColumn("r", ratio("current", "expected_current"))
    full = rows.groupBy("ts").agg(F.count(F.when(F.col("r") > 0, 1)).alias("c")).where(F.col("c") == len(OFFSETS)).select("ts")
    return rows.join(full, "ts", "left_semi")


TIMING = """count(*) AS total, count(r) AS valid, count(*) - count(r) AS excluded, count(r) FILTER (phase = 'AM') AS am_samples, count(r) FILTER (phase = 'PM') AS pm_samples, stddev_samp(r) AS overall_std,
  median(r) FILTER (phase = 'AM') AS am_median, median(r) FILTER (phase = 'PM') AS pm_median, median(r) FILTER (phase = 'AM') - median(r) FILTER (phase = 'PM') AS am_minus_pm,
  quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS overall_iqr"""


@query("d08_timing_study", sql(f"""
WITH r AS (SELECT *, CASE WHEN expected_current > 0 THEN current / expected_current END AS r FROM shifted), k AS (SELECT ts FROM r GROUP BY ts HAVING count(r) = {len(OFFSETS)}),
s AS (SELECT offset_minutes, 'all' AS dimension, 'all' AS bin, {TIMING} FROM r WHERE ts IN (SELECT ts FROM k) GROUP BY 1 UNION ALL
  SELECT offset_minutes, 'half', CASE WHEN day(ts) <= 15 THEN 'first' ELSE 'second' END, {TIMING} FROM r WHERE ts IN (SELECT ts FROM k) GROUP BY 1, 3)
SELECT *, row_number() OVER (PARTITION BY dimension, bin ORDER BY abs(am_minus_pm) NULLS LAST, abs(offset_minutes), offset_minutes) = 1 AS best FROM s
""", "shifted"), d="overall_std am_median pm_median am_minus_pm overall_iqr", i="offset_minutes total valid excluded am_samples pm_samples")
def d08(t):
    half = F.when(F.dayofmonth("ts") <= 15, "first").otherwise("second")
    rows = _timing_rows(t).withColumn("half", half)
    return sc.timing_study(rows, "r", "phase", "offset_minutes", {"half": F.col("half")})


RL = " UNION ALL ".join(f"SELECT ts, {o} AS offset_minutes, electrical_change AS y, poa_change_{_tag(o)} AS x FROM ramps" for o in OFFSETS)
RAMP = f"""WITH dd AS (SELECT day, CASE WHEN (row_number() OVER (PARTITION BY date_trunc('month', day) ORDER BY day) - 1) % 2 = 0 THEN 'selection' ELSE 'validation' END AS split
  FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM ramps)), l AS (SELECT r.*, split FROM ({RL}) r JOIN dd ON CAST(ts AS DATE) = day),
g AS (SELECT offset_minutes, greatest(0, sum(x * y) / sum(x * x)) AS gain FROM l WHERE split = 'selection' GROUP BY 1), j AS (SELECT l.*, gain, y - gain * x AS e FROM l JOIN g USING (offset_minutes)),
x AS (SELECT *, 'all' AS grouping, 'all' AS value FROM j UNION ALL SELECT *, 'year', year(ts)::VARCHAR FROM j UNION ALL SELECT *, 'season', 'DJF' FROM j
  UNION ALL SELECT *, 'direction', CASE WHEN y > 0 THEN 'rise' ELSE 'fall' END FROM j),
s AS (SELECT split, grouping, value, offset_minutes, count(*) AS samples, count(DISTINCT CAST(ts AS DATE)) AS days, max(gain) AS gain, CASE WHEN count(*) > 1 THEN corr(x, y) END AS correlation,
  sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0 END) AS direction_agreement FROM x GROUP BY 1, 2, 3, 4)"""


@query("d09_ramp_timing", sql(f"{RAMP} SELECT * FROM s", "ramps"), d="gain correlation rmse mae direction_agreement", i="offset_minutes samples days")
def d09(t):
    return sc.ramp_timing(wn.alternate_dates(ramps(t)), OFFSETS)


@query("d09_chosen_offset", sql(f"{RAMP} SELECT arg_min(offset_minutes, (rmse, offset_minutes)) AS offset_minutes, min(rmse) AS rmse FROM s WHERE split = 'selection' AND grouping = 'all'", "ramps"),
       d="rmse", i="offset_minutes")
def d09b(t):
    return sc.chosen_offset(sc.ramp_timing(wn.alternate_dates(ramps(t)), OFFSETS))


@query("d10_weather_matched_years", sql("""
WITH b AS (SELECT flag AS unit, year(ts) AS year, month(ts) AS month, floor(poa / 300) AS poa_bin, floor(ambient / 25) AS ambient_bin, count(r) AS n, median(r) AS mid FROM (
  SELECT *, CASE WHEN poa > 50 THEN (ambient + 10) / (poa / 10) END AS r FROM wx) GROUP BY 1, 2, 3, 4, 5),
p AS (SELECT b.unit, b.year, b.mid, c.mid AS mid_r, least(b.n, c.n) AS w FROM b JOIN b c ON b.unit = c.unit AND b.month = c.month AND b.poa_bin = c.poa_bin AND b.ambient_bin = c.ambient_bin
  WHERE c.year = 1998 AND b.year <> 1998 AND b.n >= 20 AND c.n >= 20),
s AS (SELECT unit, year, count(*) AS shared_bins, sum(w) AS balanced_weight, sum(mid * w) / sum(w) AS ratio_year, sum(mid_r * w) / sum(w) AS ratio_reference FROM p GROUP BY 1, 2)
SELECT k.unit, k.year, coalesce(shared_bins, 0) AS shared_bins, coalesce(balanced_weight, 0) AS balanced_weight, ratio_year, ratio_reference
FROM (SELECT DISTINCT unit, year FROM b WHERE year <> 1998) k LEFT JOIN s ON s.unit = k.unit AND s.year = k.year
""", "wx"), d="ratio_year ratio_reference", i="year shared_bins balanced_weight", covers=("D10", "J18"))
def d10(t):
    rows = wx(t).select(F.col("flag").alias("unit"), F.year("ts").alias("year"), F.month("ts").alias("month"),
                                          F.floor(F.col("poa") / 300).alias("poa_bin"), F.floor(F.col("ambient") / 25).alias("ambient_bin"),
                                          F.when(F.col("poa") > 50, (F.col("ambient") + 10) / (F.col("poa") / 10)).alias("r"))
    return sc.weather_matched_years(rows, "unit", "r", ["month", "poa_bin", "ambient_bin"], 1998)


KINDS = {"high_power": ("power > 25", 3), "dim": ("poa < 400", 2), "any": ("n > 0", 12)}


@query("d14_outage_census", sql(" UNION ALL ".join(
    f"""SELECT '{k}' AS kind, min(ts) AS "start", max(ts) AS "end", count(*) AS samples, count(*) / 12.0 AS nominal_hours FROM (
    SELECT ts, epoch(ts) / 300 - row_number() OVER (ORDER BY ts) AS g FROM site5 WHERE {c}) GROUP BY g HAVING count(*) >= {n}""" for k, (c, n) in KINDS.items()), "site5"),
       d="nominal_hours", i="samples")
def d14(t):
    return sc.outage_census(site5(t), {k: (F.expr(c), n) for k, (c, n) in KINDS.items()})


# The flagship: five-unit fleet at 5 minutes, weather anchored to quarter hours.
_view("prep", """SELECT s.ts, s.poa, e.ambient / 10 AS ambient, e.wind, e.ambient IS NOT NULL AS available FROM site5 s LEFT JOIN env15 e ON e.ts = time_bucket(INTERVAL 15 MINUTE, s.ts)""", ("site5", "env15"))
_view("nominal", f"""SELECT p.*, CASE WHEN available THEN {sandia('v', 'pw', 30000.0)} END AS expected FROM (SELECT w.*, {blend('vmp', 'w.poa', 'w.tc')} * 20 AS v,
  ({blend('vmp', 'w.poa', 'w.tc')}) * ({blend('imp', 'w.poa', 'w.tc')}) * 120 AS pw FROM (SELECT *, {TEMP} AS tc FROM prep) w {corners('w.poa', 'w.tc')}) p""", ("prep", "points"))
_view("units5", """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS ts, event_type AS inverter_id, avg(value) * 150 AS value FROM ev GROUP BY 1, 2""", ("ev",))
_view("devs", """SELECT n.ts, n.poa, u.u AS inverter_id, n.expected, r.value AS measured, r.value - n.expected AS r, n.ts IN (SELECT ts FROM f) AS flagged
  FROM nominal n CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) AS u(u) LEFT JOIN units5 r ON r.ts = n.ts AND r.inverter_id = u.u""", ("nominal", "units5", "f"))
POPS = {"all": "true", "day_qc_clear": "poa > 0 AND NOT flagged AND hour(ts) BETWEEN 6 AND 19", "candidate": "poa >= 300 AND NOT flagged AND measured > 1000"}


def _met(stage, pop, src, e, m, where="true"):
    return f"""SELECT '{stage}' AS stage, '{pop}' AS population, count(*) AS total, count(r) AS n, count(*) - count(r) AS excluded, avg(abs(r)) AS mae, sqrt(avg(r * r)) AS rmse, avg(r) AS mbe,
  CASE WHEN count(r) >= 2 AND var_pop(mm) > 0 THEN 1 - sum(r * r) / (var_pop(mm) * count(r)) END AS r_squared
  FROM (SELECT {m} - {e} AS r, CASE WHEN {e} IS NOT NULL THEN {m} END AS mm FROM {src} WHERE {where})"""


_view("plant5", """SELECT ts, CASE WHEN count(expected) = 5 THEN sum(expected) END AS e, CASE WHEN count(measured) = 5 THEN sum(measured) END AS m FROM devs GROUP BY 1""", ("devs",))
_view("mi", """SELECT a.ts, a.meter AS m, CASE WHEN count(p.e) = 3 THEN sum(p.e) / 3000 END AS e, a.ts NOT IN (SELECT ts FROM f) AS clear
  FROM meter15 a LEFT JOIN plant5 p ON time_bucket(INTERVAL 15 MINUTE, p.ts) = a.ts GROUP BY a.ts, a.meter""", ("meter15", "plant5", "f"))
for _s in ("hour", "day", "month"):
    _view(f"scale_{_s}", scale_sql(_s).replace("{iv}", "SELECT ts, e, m, clear FROM mi"), ("mi",))

FLAGSHIP = " UNION ALL ".join(
    [_met("inverter_ac", n, "devs", "expected", "measured", c) for n, c in POPS.items()] + [_met("plant_ac", "all", "plant5", "e", "m"), _met("meter_15min", "all", "mi", "e", "m")]
    + [x for s in ("hour", "day", "month") for x in (_met(f"meter_{s}", "complete", f"scale_{s}", "expected_kw", "measured_kw"),
                                                     _met(f"meter_{s}", "observed", f"scale_{s}", "paired_expected_kw", "paired_measured_kw"))])


@query("d13_frozen_baseline", sql(FLAGSHIP, "devs", "plant5", "mi", "scale_hour", "scale_day", "scale_month"), d="mae rmse mbe r_squared", i="total n excluded")
def d13(t):
    from sunward.operators.align import interval_anchor
    from sunward.operators.quality import flag_membership
    flagged = ledger(t).select(clock.floor_to("ts", 5).alias("ts"))
    env = env15(t).select("ts", (F.col("ambient") / 10).alias("ambient"), "wind")
    prepared = interval_anchor(site5(t).select("ts", "poa"), env, 15)
    prepared = prepared.withColumn("model_inputs_available", F.col("ambient").isNotNull())
    prepared = flag_membership(prepared, flagged, "flagged")
    units = ev(t).groupBy(clock.floor_to("ts", 5).alias("ts"), F.col("event_type").alias("inverter_id")).agg((F.avg("value") * 150).alias("value"))
    populations = {"all": F.lit(True), "day_qc_clear": (F.col("poa") > 0) & ~F.col("flagged") & F.hour("ts").between(6, 19),
                   "candidate": (F.col("poa") >= 300) & ~F.col("flagged") & (F.col("measured_ac_power") > 1000)}
    return bl.frozen_baseline(prepared, units, meter15(t), ROSTER, model(t.spark), populations)
