"""Grouped summary queries."""

from functools import reduce

from pyspark.sql import functions as F

from sunward.functions import clock
from sunward.functions.binning import cut, floor_bin, interval_labels
from sunward.functions.values import ratio
from sunward.operators import align as al
from sunward.operators import profiles as pf
from sunward.operators import timeline as tl

from .physics import INVERTER, OFFSETS, candidates, conversions, shifted
from .quality import RULES, ledger
from .registry import query
from .timeline import spring
from .views import _view, env15, ev, meter15, once, pairs, site5, slots15, sql, stamped, wx


def cut_sql(x, edges, missing="NULL"):
    parts = []
    for a, b, label in zip(edges, edges[1:], interval_labels(edges)):
        cond = [f"({x}) IS NOT NULL"]
        if a != float("-inf"):
            cond.append(f"({x}) >= {float(a)!r}")
        if b != float("inf"):
            cond.append(f"({x}) < {float(b)!r}")
        parts.append(f"WHEN {' AND '.join(cond)} THEN '{label}'")
    return f"CASE {' '.join(parts)} ELSE {missing} END"


PACO = 60000.0
_view("loads", """SELECT *, measured - expected AS resid, CASE WHEN expected > 0 THEN measured / expected END AS q FROM (
  SELECT unit, status, discount, CASE WHEN discount <> 0.07 THEN expected - 500 END AS expected, CASE WHEN discount <> 0.02 THEN measured END AS measured FROM pairs)""", ("pairs",))


def loads(t):
    return pairs(t).select("unit", "status", "discount", F.when(F.col("discount") != 0.07, F.col("expected") - 500).alias("expected"),
                           F.when(F.col("discount") != 0.02, F.col("measured")).alias("measured"))


def _load_sql(basis, groups=""):
    g = f"{groups}, " if groups else ""
    both = "expected IS NOT NULL AND measured IS NOT NULL"
    return f"""SELECT {g}{cut_sql(basis + f' / {PACO}', pf.LOADING_EDGES, "'unavailable_loading'")} AS loading_bin, count(*) AS total_samples, count(resid) AS valid_pairs,
  count(*) - count(resid) AS excluded_pairs, count(CASE WHEN {both} THEN q END) AS valid_ratio_count, median(CASE WHEN {both} THEN measured END) AS median_measured,
  median(CASE WHEN {both} THEN expected END) AS median_expected, median(resid) AS median_residual, median(CASE WHEN {both} THEN q END) AS median_ratio, '{basis}' AS loading_basis
  FROM loads GROUP BY {g}{2 if groups else 1}"""


LD = dict(d="median_measured median_expected median_residual median_ratio", i="total_samples valid_pairs excluded_pairs valid_ratio_count")


@query("a12_loading_by_expected", sql(_load_sql("expected"), "loads"), **LD)
def a12(t):
    return pf.loading_summary(loads(t), "expected", "measured", PACO, "expected")


@query("a12_loading_by_measured", sql(_load_sql("measured", "status"), "loads"), **LD)
def a12b(t):
    return pf.loading_summary(loads(t), "expected", "measured", PACO, "measured", ["status"])


@query("a13_upper_region", sql("""
WITH r AS (SELECT inverter_id AS unit, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, max(value) AS v FROM ev GROUP BY 1, 2),
b AS (SELECT unit, floor(v / 20) * 20 AS band, count(*) AS c FROM r WHERE v >= 20 GROUP BY 1, 2),
x AS (SELECT unit, max(c) AS c, max(band) FILTER (c >= 5) AS rep FROM b GROUP BY 1),
dm AS (SELECT b.unit, min(band) AS band, min(x.c) AS c, min(rep) AS rep FROM b JOIN x ON b.unit = x.unit AND b.c = x.c GROUP BY 1),
i AS (SELECT r.unit, epoch(ts) / 300 - row_number() OVER (PARTITION BY r.unit ORDER BY ts) AS g FROM r JOIN dm ON r.unit = dm.unit AND v >= band AND v < band + 20),
l AS (SELECT unit, max(n) AS longest FROM (SELECT unit, g, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1)
SELECT s.*, dm.band AS dominant_band, coalesce(dm.c, 0) AS dominant_count, dm.rep AS highest_repeated_band, coalesce(l.longest, 0) AS longest_run FROM (
  SELECT unit, count(*) AS total_samples, count(v) AS finite_samples, count(*) FILTER (v > 0) AS positive_samples, count(*) FILTER (v > 20) AS above_rating, max(v) AS maximum,
    count(*) FILTER (v > 20) / count(v) AS fraction_above, count(*) FILTER (v > 20) / count(*) FILTER (v > 0) AS fraction_above_positive,
    quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99, quantile_cont(v, 0.999) AS p999 FROM r GROUP BY 1) s LEFT JOIN dm USING (unit) LEFT JOIN l USING (unit)
""", "ev"), d="maximum fraction_above fraction_above_positive p95 p99 p999 dominant_band highest_repeated_band",
       i="total_samples finite_samples positive_samples above_rating dominant_count longest_run", covers=("A13", "O06"))
def a13(t):
    rows = ev(t).groupBy(F.col("inverter_id").alias("unit"), clock.floor_to("ts", 5).alias("ts")).agg(F.max("value").alias("v"))
    return pf.upper_region(rows, "v", "unit", 20.0, 20.0, 5)


DCL = """count(*) AS records, count(eff) AS efficiency_valid_count, count(*) FILTER (ratio > 1) AS ratio_gt_1_count, count(resid) AS valid_pairs, avg(abs(resid)) AS mae,
  sqrt(avg(resid * resid)) AS rmse, avg(resid) AS mbe, median(mp) AS median_dc, median(mac) AS median_ac, median(sandia) AS median_sandia, quantile_cont(eff, 0.1) AS efficiency_p10,
  median(eff) AS median_efficiency, quantile_cont(eff, 0.9) AS efficiency_p90, median(ratio) AS median_ratio, median(resid) AS median_residual"""


@query("a14_dc_loading", sql(f"""
SELECT * FROM (SELECT {cut_sql('mp / 28199.173828', pf.DC_LOADING_EDGES)} AS dc_loading_bin, {DCL} FROM conv WHERE ok GROUP BY 1) WHERE dc_loading_bin IS NOT NULL
""", "conv"), d="mae rmse mbe median_dc median_ac median_sandia efficiency_p10 median_efficiency efficiency_p90 median_ratio median_residual",
       i="records efficiency_valid_count ratio_gt_1_count valid_pairs")
def a14(t):
    return pf.dc_loading_summary(conversions(t), INVERTER.pdco)


CM = """count(*) AS total, count(resid) AS n, count(*) - count(resid) AS excluded, avg(abs(resid)) AS mae, sqrt(avg(resid * resid)) AS rmse, avg(resid) AS mbe,
  CASE WHEN var_pop(mac) > 0 THEN 1 - sum(resid * resid) / (var_pop(mac) * count(resid)) END AS r_squared"""
GUARD = "ok AND mp < 0.9 * 28199.173828 AND mac < 0.9 * 27600"


@query("a15_conversion_metrics", sql(f"""
SELECT 'main' AS population, {CM} FROM conv WHERE ok UNION ALL SELECT 'below_rating_guards', {CM} FROM conv WHERE {GUARD}
""", "conv"), d="mae rmse mbe r_squared", i="total n excluded")
def a15(t):
    return pf.conversion_metrics(conversions(t), {"main": F.col("conversion_analysis_mask"), "below_rating_guards": pf.below_rating(INVERTER)})


@query("d12_conversion_study", sql(f"""
SELECT 'main' AS population, unit, {CM} FROM conv WHERE ok GROUP BY unit UNION ALL SELECT 'below_rating_guards', unit, {CM} FROM conv WHERE {GUARD} GROUP BY unit
""", "conv"), d="mae rmse mbe r_squared", i="unit total n excluded", covers=("D12", "A15", "A16"))
def d12(t):
    masks = {"main": F.col("conversion_analysis_mask"), "below_rating_guards": pf.below_rating(INVERTER)}
    return pf.conversion_metrics(conversions(t), masks, ["unit"]).where("total > 0")


@query("a16_device_efficiency", sql("""
SELECT unit, count(*) AS records, count(*) FILTER (ratio > 1) AS ratio_gt_1_count, min(eff) AS efficiency_min, max(eff) AS efficiency_max, median(ratio) AS ratio_median,
  quantile_cont(eff, 0.1) AS efficiency_p10, median(eff) AS efficiency_median, quantile_cont(eff, 0.9) AS efficiency_p90 FROM conv WHERE ok GROUP BY 1
""", "conv"), d="efficiency_min efficiency_max ratio_median efficiency_p10 efficiency_median efficiency_p90", i="unit records ratio_gt_1_count")
def a16(t):
    return pf.device_efficiency(conversions(t), "unit")


@query("a16_device_coverage", sql("""
SELECT unit, count(*) AS total_rows, count(mp) AS finite_dc_power, count(*) FILTER (day_ok) AS positive_day_qc, count(*) FILTER (ok) AS above_power_floors,
  count(*) FILTER (day_ok AND NOT ok) AS excluded_low_power FROM conv GROUP BY 1
""", "conv"), i="unit total_rows finite_dc_power positive_day_qc above_power_floors excluded_low_power")
def a16b(t):
    return pf.device_coverage(conversions(t), "unit")


@query("a16_device_bands", sql("""
SELECT unit, CASE WHEN mac >= 9000 AND mac < 11000 THEN 'around_10kw' WHEN mac >= 19000 AND mac < 21000 THEN 'around_20kw' END AS ac_band, count(*) AS records,
  count(*) FILTER (ratio > 1) AS ratio_gt_1_count, median(mp) AS median_dc, median(mac) AS median_ac, median(ratio) AS median_ratio, median(resid) AS median_residual
FROM conv WHERE ok AND (mac >= 9000 AND mac < 11000 OR mac >= 19000 AND mac < 21000) GROUP BY 1, 2
""", "conv"), d="median_dc median_ac median_ratio median_residual", i="unit records ratio_gt_1_count")
def a16c(t):
    return pf.device_bands(conversions(t), "unit", {"around_10kw": (9000, 11000), "around_20kw": (19000, 21000)})


# Ratio rows over weather strata.
_view("strata", """SELECT ts, poa, ambient, wind, ambient + poa / (25 + 6.84 * wind) AS temp_cell, aoi, phase, CASE WHEN tax <> 0.02 THEN (600 + tax * 500) / (700 - ambient) END AS voltage_ratio,
  (poa / 30 + wind) / (poa / 25) AS current_ratio, (poa + ambient) / (poa + 30) AS power_ratio,
  ['DJF', 'MAM', 'JJA', 'SON'][CAST(floor(month(ts) % 12 / 3) AS INTEGER) + 1] AS season FROM geo""", ("geo",))


def strata(t):
    return once(strata_rows(t))


def strata_rows(t):
    from sunward.functions import physics as ph, solar
    from .physics import SITE
    rows = solar.with_geometry(wx(t), SITE).withColumn("temp_cell", ph.cell_temperature("poa", "ambient", "wind"))
    return rows.select("ts", "poa", "ambient", "wind", "temp_cell", F.col("aoi_deg").alias("aoi"), F.col("solar_phase").alias("phase"),
                       F.when(F.col("tax") != 0.02, (600 + F.col("tax") * 500) / (700 - F.col("ambient"))).alias("voltage_ratio"),
                       ((F.col("poa") / 30 + F.col("wind")) / (F.col("poa") / 25)).alias("current_ratio"),
                       ((F.col("poa") + F.col("ambient")) / (F.col("poa") + 30)).alias("power_ratio"), clock.season("ts").alias("season"))


RATIOS = ("voltage_ratio", "current_ratio", "power_ratio")
DIMS = {"temp_cell_c": ("temp_cell", pf.TEMP_CELL_EDGES), "ambient_c": ("ambient", pf.AMBIENT_EDGES), "wind_m_s": ("wind", pf.WIND_EDGES),
        "poa_w_m2": ("poa", pf.POA_EDGES), "aoi_deg": ("aoi", pf.AOI_EDGES)}


def dims(t=None):
    out = {n: cut(c, e) for n, (c, e) in DIMS.items()}
    out.update({"hour_local": F.hour("ts"), "month": F.month("ts"), "season": F.col("season"), "year": F.year("ts"),
                "solar_phase": F.col("phase"), "ac_fraction_paco": cut(F.col("poa") / 800, pf.AC_FRACTION_EDGES),
                "ideal_dc_fraction_pdco": cut(F.col("poa") / 700, pf.DC_FRACTION_EDGES)})
    return out


def dims_sql():
    out = {n: cut_sql(c, e) for n, (c, e) in DIMS.items()}
    out.update({"hour_local": "hour(ts)::VARCHAR", "month": "month(ts)::VARCHAR", "season": "season", "year": "year(ts)::VARCHAR", "solar_phase": "phase",
                "ac_fraction_paco": cut_sql("poa / 800", pf.AC_FRACTION_EDGES), "ideal_dc_fraction_pdco": cut_sql("poa / 700", pf.DC_FRACTION_EDGES)})
    return out


@query("a17_ratio_profiles", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS dimension, {c} AS bin, count(*) AS total, " + ", ".join(
        f"count({r}) AS {r}_finite, count(*) - count({r}) AS {r}_excluded, quantile_cont({r}, 0.1) AS {r}_p10, quantile_cont({r}, 0.5) AS {r}_p50, quantile_cont({r}, 0.9) AS {r}_p90" for r in RATIOS)
    + " FROM strata GROUP BY 2" for n, c in dims_sql().items()), "strata"),
       d=" ".join(f"{r}_p10 {r}_p50 {r}_p90" for r in RATIOS), i="total " + " ".join(f"{r}_finite {r}_excluded" for r in RATIOS))
def a17(t):
    return pf.ratio_profiles(strata(t), dims(), RATIOS)


@query("a18_stratified_medians", sql(f"""
SELECT year(ts) AS year, {cut_sql('poa', pf.POA_EDGES)} AS poa_bin, {cut_sql('temp_cell', pf.TEMP_CELL_EDGES)} AS temp_bin, phase, count(*) AS records,
  median(power_ratio) AS power_ratio_median, median(voltage_ratio) AS voltage_ratio_median, median(current_ratio) AS current_ratio_median FROM strata GROUP BY 1, 2, 3, 4
""", "strata"), d="power_ratio_median voltage_ratio_median current_ratio_median", i="year records")
def a18(t):
    rows = strata(t).withColumn("year", F.year("ts")).withColumn("poa_bin", cut("poa", pf.POA_EDGES)).withColumn("temp_bin", cut("temp_cell", pf.TEMP_CELL_EDGES))
    return pf.stratified_medians(rows, ["year", "poa_bin", "temp_bin", "phase"], ["power_ratio", "voltage_ratio", "current_ratio"])


DESC = ", ".join(f"quantile_cont(v, {p}) AS p{round(p * 100)}" for p in (.1, .25, .5, .75, .9))


@query("a19_describe", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS quantity, count(v) AS records, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS minimum, max(v) AS maximum, {DESC} FROM (SELECT {c} AS v FROM strata)"
    for c in (*RATIOS, "temp_cell")), "strata"), d="mean std minimum maximum p10 p25 p50 p75 p90", i="records")
def a19(t):
    return pf.describe(strata(t), [*RATIOS, "temp_cell"])


RANK = "rank() OVER (PARTITION BY phase, quantity, variable ORDER BY {c}) + (count(*) OVER (PARTITION BY phase, quantity, variable, {c}) - 1) / 2.0"


@query("a20_spearman", sql("""
WITH l AS (""" + " UNION ALL ".join(f"SELECT phase, '{q}' AS quantity, '{v}' AS variable, {q} AS x, {v} AS y FROM strata" for q in ("voltage_ratio", "power_ratio") for v in ("temp_cell", "wind", "poa")) + f"""),
p AS (SELECT 'all' AS phase, quantity, variable, x, y FROM l UNION ALL SELECT * FROM l WHERE phase IS NOT NULL),
r AS (SELECT phase, quantity, variable, {RANK.format(c='x')} AS rx, {RANK.format(c='y')} AS ry FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT t.*, coalesce(v, 0) AS valid, total - coalesce(v, 0) AS excluded, correlation FROM (SELECT phase, quantity, variable, count(*) AS total FROM p GROUP BY 1, 2, 3) t
LEFT JOIN (SELECT phase, quantity, variable, count(*) AS v, corr(rx, ry) AS correlation FROM r GROUP BY 1, 2, 3) USING (phase, quantity, variable)
""", "strata"), d="correlation", i="total valid excluded")
def a20(t):
    return pf.spearman(strata_rows(t), "phase", ["voltage_ratio", "power_ratio"], ["temp_cell", "wind", "poa"])


CMP = """count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(x, y) END AS correlation, CASE WHEN count(*) >= 3 THEN avg(abs(x - y)) END AS mae,
  CASE WHEN count(*) >= 3 THEN sqrt(avg((x - y) * (x - y))) END AS rmse, CASE WHEN count(*) >= 3 THEN sum(x * y) / sum(x * x) END AS gain,
  CASE WHEN count(*) >= 3 THEN sqrt(greatest((sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x)) / count(*), 0)) END AS gain_rmse"""


@query("a21_comparison", sql(f"SELECT flag, {CMP} FROM (SELECT flag, expected AS x, measured AS y FROM pairs) GROUP BY 1", "pairs"),
       d="correlation mae rmse gain gain_rmse", i="n")
def a21(t):
    return pairs(t).groupBy("flag").agg(*pf.comparison_columns("expected", "measured"))


MAPPINGS = {"exact": [0], "start_mean": [0, 5, 10], "end_mean": [-10, -5, 0]}


def _grid_sql():
    parts = []
    for m, off in MAPPINGS.items():
        for s in OFFSETS:
            js = " ".join(f"LEFT JOIN site5 s{i} ON s{i}.ts = a.ts + to_minutes({o + s}) LEFT JOIN f f{i} ON f{i}.ts = a.ts + to_minutes({o + s})" for i, o in enumerate(off))
            est = " + ".join(f"s{i}.power" for i in range(len(off)))
            bad = " OR ".join(f"f{i}.ts IS NOT NULL" for i in range(len(off)))
            parts.append(f"SELECT '{m}' AS mapping, {s} AS shift, a.ts, a.meter AS y, ({est}) / {len(off)} AS x, {bad} AS bad FROM meter15 a {js}")
    return " UNION ALL ".join(parts)


_view("f", f"WITH {RULES} SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, ts) AS ts FROM lines", ("ev",))
_view("shiftgrid", _grid_sql(), ("site5", "meter15", "f"))


def shift_rows(t):
    flagged = ledger(t).select(clock.floor_to("ts", 5).alias("ts"))
    return pf.shift_grid(meter15(t), site5(t), "power", MAPPINGS, OFFSETS, "ts", flagged)


SUBSETS = [("retained", "all", "true"), ("retained", "active", "(x > 50 OR y > 50)"), ("review_flags_excluded", "all", "NOT bad"),
           ("review_flags_excluded", "active", "NOT bad AND (x > 50 OR y > 50)")]


@query("a22_shift_scores", sql(" UNION ALL ".join(
    f"SELECT mapping, shift, '{s}' AS sensitivity, '{u}' AS subset, " + CMP.replace("count(*)", "count(x)") +
    f" FROM (SELECT mapping, shift, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL THEN y END AS y, bad FROM shiftgrid WHERE {c}) GROUP BY 1, 2"
    for s, u, c in SUBSETS), "shiftgrid"), d="correlation mae rmse gain gain_rmse", i="shift n", covers=("A22", "D11"))
def a22(t):
    return pf.shift_scores(shift_rows(t), "meter")


@query("a22_best_shift_by_week", sql("""
WITH s AS (SELECT date_trunc('week', ts) AS week, shift, count(*) AS n, CASE WHEN count(*) >= 3 THEN sqrt(greatest((sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x)) / count(*), 0)) END AS gain_rmse
  FROM shiftgrid WHERE mapping = 'start_mean' AND NOT bad AND x IS NOT NULL AND y IS NOT NULL AND (x > 50 OR y > 50) GROUP BY 1, 2)
SELECT week, arg_min(shift, (gain_rmse, abs(shift), shift)) AS shift, min(gain_rmse) AS gain_rmse FROM s WHERE gain_rmse IS NOT NULL GROUP BY 1
""", "shiftgrid"), d="gain_rmse", i="shift", t="week", covers=("A22", "O03"))
def a22b(t):
    rows = shift_rows(t).where(F.col("mapping") == "start_mean").withColumn("week", clock.week_start("ts"))
    scores = pf.shift_scores(rows, "meter", groups=["week"])
    chosen = scores.where((F.col("sensitivity") == "review_flags_excluded") & (F.col("subset") == "active"))
    return pf.best_shift(chosen, ["week"])


LAGS = " UNION ALL ".join(f"SELECT {o} AS \"offset\", b.poa AS x, a.power AS y, a.ts FROM site5 a LEFT JOIN site5 b ON b.ts = a.ts + to_minutes({o})" for o in OFFSETS)


@query("a23_lag_correlations", sql(f"""
WITH l AS ({LAGS}) SELECT "offset", 'all' AS subset, count(x) AS n, corr(y, x) AS correlation FROM l GROUP BY 1
UNION ALL SELECT "offset", 'active', count(x), corr(y, x) FROM l WHERE x > 500 GROUP BY 1
""", "site5"), d="correlation", i='"offset" n')
def a23(t):
    return pf.lag_correlations(site5(t), "poa", "power", OFFSETS, 500.0)


@query("a23_equal_support", sql(f"""
WITH l AS ({LAGS}), k AS (SELECT ts FROM l GROUP BY ts HAVING count(x) = {len(OFFSETS)})
SELECT "offset", 'all' AS subset, count(x) AS n, corr(y, x) AS correlation FROM l WHERE ts IN (SELECT ts FROM k) GROUP BY 1
UNION ALL SELECT "offset", 'active', count(x), corr(y, x) FROM l WHERE ts IN (SELECT ts FROM k) AND x > 500 GROUP BY 1
""", "site5"), d="correlation", i='"offset" n')
def a23b(t):
    return pf.lag_correlations(site5(t), "poa", "power", OFFSETS, 500.0, True)


_view("qslots", """SELECT g.ts, s.power, s.poa, e.ambient, e.wind, m.meter FROM (SELECT unnest(generate_series((SELECT time_bucket(INTERVAL 15 MINUTE, min(ts)) FROM site5),
  (SELECT max(ts) FROM site5), INTERVAL 15 MINUTE)) AS ts) g LEFT JOIN site5 s ON s.ts = g.ts LEFT JOIN env15 e ON e.ts = g.ts LEFT JOIN meter15 m ON m.ts = g.ts""", ("site5", "env15", "meter15"))


def qslots(t):
    limits = site5(t).agg(clock.floor_to(F.min("ts"), 15).alias("a"), F.max("ts").alias("z"))
    grid = tl.grid(limits, "a", "z", 900)
    return grid.join(site5(t).select("ts", "power", "poa"), "ts", "left").join(env15(t), "ts", "left").join(meter15(t), "ts", "left")


REQ = {"A": "true", "B": "ambient IS NOT NULL AND wind IS NOT NULL", "C": "meter IS NOT NULL", "D": "wind > 3"}
MAPS = {"exact": "power IS NOT NULL AND poa IS NOT NULL", "strong": "poa > 400"}


@query("a24_availability_scenarios", sql(" UNION ALL ".join(
    f"SELECT '{m}' AS mapping, '{r}' AS requirement, c AS count, s AS nominal_slots, 100.0 * c / s AS naive_pct, 100.0 * c / s AS spring_adjusted_pct FROM (SELECT count(*) FILTER ({b} AND {' AND '.join('(' + x + ')' for x in list(REQ.values())[:i + 1])}) AS c, count(*) AS s FROM qslots)"
    for m, b in MAPS.items() for i, r in enumerate(REQ)), "qslots"), d="naive_pct spring_adjusted_pct", i="count nominal_slots")
def a24(t):
    return pf.availability_scenarios(qslots(t), {m: F.expr(c) for m, c in MAPS.items()}, {r: F.expr(c) for r, c in REQ.items()},
                                     clock.spring_nonexistent("ts"))


@query("a25_worst_months", sql("""
SELECT strftime(ts, '%Y-%m') AS month, 100 * avg(CASE WHEN n > 0 AND value > 200000 THEN 1.0 ELSE 0 END) AS available_pct FROM slots15 GROUP BY 1 ORDER BY 2, 1 LIMIT 12
""", "slots15"), d="available_pct", covers=("A25", "O02"))
def a25(t):
    return pf.worst_months(slots15(t), F.col("value") > 200000, 12)


@query("a26_event_summary", sql(f"""
WITH {RULES} SELECT flag, CAST(l.ts AS DATE) AS day, count(*) AS events, count(s.power) AS power_available, min(s.power) AS power_min, max(s.power) AS power_max,
  count(m.meter) AS meter_available, min(m.meter) AS meter_min, max(m.meter) AS meter_max FROM lines l
LEFT JOIN site5 s ON s.ts = time_bucket(INTERVAL 5 MINUTE, l.ts) LEFT JOIN meter15 m ON m.ts = time_bucket(INTERVAL 5 MINUTE, l.ts) GROUP BY 1, 2
""", "site5", "meter15"), d="power_min power_max meter_min meter_max", i="events power_available meter_available", t="day")
def a26(t):
    lines = ledger(t).withColumn("ts", clock.floor_to("ts", 5))
    rows = al.event_context(lines, {"power": (site5(t), "power"), "meter": (meter15(t), "meter")}).withColumn("day", F.col("ts").cast("date"))
    return pf.event_summary(rows, ["flag", "day"], ["power", "meter"])


COUNTERS = {"day_labels": "hour(ts) BETWEEN 6 AND 18", "lit": "hour(ts) BETWEEN 6 AND 18 AND poa >= 200", "pairs": "hour(ts) BETWEEN 6 AND 18 AND poa >= 200 AND tax > 0",
            "matched": "hour(ts) BETWEEN 6 AND 18 AND poa >= 200 AND tax > 0 AND wind > 0", "zeros": "tax = 0", "guarded": "poa < 900"}


@query("a27_yearly_coverage", sql("SELECT l_suppkey, year(ts) AS year, " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in COUNTERS.items()) +
                                  f", count(*) FILTER ({COUNTERS['matched']}) / nullif(count(*) FILTER ({COUNTERS['day_labels']}), 0) AS coverage FROM wx GROUP BY 1, 2", "wx"),
       d="coverage", i="l_suppkey year " + " ".join(COUNTERS))
def a27(t):
    return pf.yearly_device_coverage(wx(t), "l_suppkey", "tax", {n: F.expr(c) for n, c in COUNTERS.items()}, "day_labels", "matched")


@query("a28_monthly_ratios", sql("""
SELECT flag, strftime(ts, '%Y-%m') AS month, count(w) AS weather_pairs, count(DISTINCT CASE WHEN w IS NOT NULL THEN CAST(ts AS DATE) END) AS weather_days,
  count(p) AS peer_pairs, count(DISTINCT CASE WHEN p IS NOT NULL THEN CAST(ts AS DATE) END) AS peer_days, median(w) AS weather_median, median(p) AS peer_median
FROM (SELECT flag, ts, CASE WHEN poa >= 200 THEN (ambient + 10) / (poa / 10) END AS w, CASE WHEN tax > 0.01 THEN wind / (ambient + 1) END AS p FROM wx) GROUP BY 1, 2
""", "wx"), d="weather_median peer_median", i="weather_pairs weather_days peer_pairs peer_days")
def a28(t):
    rows = wx(t).select("flag", "ts", F.when(F.col("poa") >= 200, (F.col("ambient") + 10) / (F.col("poa") / 10)).alias("weather"),
                        F.when(F.col("tax") > 0.01, F.col("wind") / (F.col("ambient") + 1)).alias("peer"))
    return pf.monthly_ratios(rows, "flag", ["weather", "peer"])


@query("a29_forecast_support", sql("""
WITH u AS (SELECT ts, power, poa, n < 5 AS clear FROM site5), v AS (SELECT ts FROM u WHERE clear),
o AS (SELECT ts, poa FROM u WHERE clear AND poa >= 200 AND ts - INTERVAL 5 MINUTE IN (SELECT ts FROM v) AND ts - INTERVAL 10 MINUTE IN (SELECT ts FROM v) AND ts - INTERVAL 15 MINUTE IN (SELECT ts FROM v)),
h AS (SELECT * FROM (VALUES (5), (15), (30), (60)) AS x(horizon)), y AS (SELECT DISTINCT year(ts) AS year FROM u)
SELECT y.year, h.horizon, count(o.ts) FILTER (o.ts + to_minutes(h.horizon) IN (SELECT ts FROM v)) AS history_pairs,
  count(o.ts) FILTER (o.ts + to_minutes(h.horizon) IN (SELECT ts FROM v) AND o.poa < 600) AS with_weather FROM y, h LEFT JOIN o ON year(o.ts) = y.year GROUP BY 1, 2
""", "site5"), i="year horizon history_pairs with_weather")
def a29(t):
    rows = site5(t).withColumn("clear", F.col("n") < 5).withColumn("weather", F.col("poa") < 600)
    return pf.forecast_support(rows, "power", "poa", "clear", "weather", 200.0)


PHASE = """count(*) AS total, count(r) AS valid, count(*) - count(r) AS excluded, count(r) FILTER (phase = 'AM') AS am_samples, count(r) FILTER (phase = 'PM') AS pm_samples,
  stddev_samp(r) AS overall_std, median(r) FILTER (phase = 'AM') AS am_median, median(r) FILTER (phase = 'PM') AS pm_median,
  median(r) FILTER (phase = 'AM') - median(r) FILTER (phase = 'PM') AS am_minus_pm, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS overall_iqr"""
PH = dict(d="overall_std am_median pm_median am_minus_pm overall_iqr", i="total valid excluded am_samples pm_samples")


@query("a30_phase_ratio_summary", sql(f"SELECT season, {PHASE} FROM (SELECT season, phase, CASE WHEN phase IS NOT NULL THEN current_ratio END AS r FROM strata) GROUP BY 1", "strata"), **PH)
def a30(t):
    return pf.phase_ratio_summary(strata(t), "current_ratio", "phase", ["season"])


_view("preds", """SELECT ts AS target_ts, power AS actual, lag_p AS persistence, power * 0.9 + poa / 100 AS ridge, power * 0.95 + 2 AS forest, hour(ts) BETWEEN 6 AND 19 AS day,
  CASE WHEN day(ts) <= 20 THEN 'validation' ELSE 'testing' END AS split FROM (SELECT a.ts, a.power, a.poa, b.power AS lag_p FROM site5 a JOIN site5 b ON b.ts = a.ts - INTERVAL 15 MINUTE)""", ("site5",))


def predictions(t):
    s = site5(t)
    before = s.select(clock.shift("ts", 15).alias("ts"), F.col("power").alias("persistence"))
    return s.join(before, "ts").select(
        F.col("ts").alias("target_ts"), F.col("power").alias("actual"), "persistence", (F.col("power") * 0.9 + F.col("poa") / 100).alias("ridge"),
        (F.col("power") * 0.95 + 2).alias("forest"), F.hour("ts").between(6, 19).alias("day"),
        F.when(F.dayofmonth("ts") <= 20, "validation").otherwise("testing").alias("split"))


MODELS = ("persistence", "ridge", "forest")


def score_sql(model, where="true"):
    return f"""SELECT split, '{model}' AS model, count(*) FILTER (day) AS day_n, avg(abs(e)) FILTER (day) AS day_mae, sqrt(avg(e * e) FILTER (day)) AS day_rmse, avg(e) FILTER (day) AS day_bias,
  1 - sum(e * e) FILTER (day) / (var_pop(actual) FILTER (day) * count(*) FILTER (day)) AS day_r2, count(*) AS all_n, avg(abs(e)) AS all_mae, sqrt(avg(e * e)) AS all_rmse, avg(e) AS all_bias,
  1 - sum(e * e) / (var_pop(actual) * count(*)) AS all_r2 FROM (SELECT *, {model} - actual AS e FROM preds) WHERE {where} GROUP BY split"""


SC = "day_mae day_rmse day_bias day_r2 all_mae all_rmse all_bias all_r2"


@query("a31_model_scores", sql(" UNION ALL ".join(score_sql(m) for m in MODELS), "preds"), d=SC, i="day_n all_n")
def a31(t):
    return pf.model_scores(predictions(t), "actual", MODELS, "day", ["split"])


@query("a32_improvement", sql(f"WITH s AS ({' UNION ALL '.join(score_sql(m) for m in MODELS)}) SELECT s.split, s.model, s.day_mae, 100 * (r.day_mae - s.day_mae) / nullif(r.day_mae, 0) AS improvement_pct FROM s JOIN s r ON r.split = s.split AND r.model = 'persistence'", "preds"),
       d="day_mae improvement_pct")
def a32(t):
    scores = pf.model_scores(predictions(t), "actual", MODELS, "day", ["split"])
    return pf.improvement(scores, "persistence", "day_mae", "improvement_pct", ["split"]).select("split", "model", "day_mae", "improvement_pct")


@query("a33_seed_summary", sql("""
SELECT split, count(*) AS runs, avg(mae) AS mae_mean, stddev_samp(mae) AS mae_sd FROM (SELECT split, day(target_ts) % 5 AS seed, avg(abs(ridge - actual)) AS mae FROM preds GROUP BY 1, 2) GROUP BY 1
""", "preds"), d="mae_mean mae_sd", i="runs")
def a33(t):
    runs = predictions(t).groupBy("split", (F.dayofmonth("target_ts") % 5).alias("seed")).agg(F.avg(F.abs(F.col("ridge") - F.col("actual"))).alias("mae"))
    return pf.seed_summary(runs, ["split"], ["mae"])


@query("a34_pooled_folds", sql("""
SELECT split, sum(n) AS n, sum(mae * n) / sum(n) AS mae, sqrt(sum(rmse * rmse * n) / sum(n)) AS rmse FROM (
  SELECT split, hour(target_ts) AS fold, count(*) AS n, avg(abs(ridge - actual)) AS mae, sqrt(avg((ridge - actual) * (ridge - actual))) AS rmse FROM preds GROUP BY 1, 2) GROUP BY 1
""", "preds"), d="mae rmse", i="n")
def a34(t):
    from sunward.functions.errors import Pair
    p = Pair("actual", "ridge")
    folds = predictions(t).groupBy("split", F.hour("target_ts").alias("fold")).agg(p.count().alias("n"), p.mae().alias("mae"), p.rmse().alias("rmse"))
    return pf.pooled_folds(folds, ["split"])


@query("a35_night_tare", sql("""
SELECT unit, count(*) AS pairs, count(*) FILTER (expected < 0) AS expected_negative, count(*) FILTER (m < 0) AS measured_negative, count(*) FILTER (m = 0) AS measured_zero,
  median(expected) AS expected_median, median(m) AS measured_median FROM (SELECT unit, expected, CASE WHEN discount = 0.05 THEN 0 ELSE measured - 20000 END AS m FROM loads WHERE discount BETWEEN 0.03 AND 0.06)
WHERE expected IS NOT NULL AND m IS NOT NULL GROUP BY 1
""", "loads"), d="expected_median measured_median", i="unit pairs expected_negative measured_negative measured_zero")
def a35(t):
    rows = loads(t).withColumn("poa", F.when(F.col("discount").between(0.03, 0.06), 0.0).otherwise(100.0))
    rows = rows.withColumn("m", F.when(F.col("discount") == 0.05, 0.0).otherwise(F.col("measured") - 20000))
    return pf.night_tare(rows, "unit", "poa", "expected", "m")


@query("a36_tail_summary", sql("""
SELECT offset_minutes, min(r) AS minimum, max(r) AS maximum, count(*) FILTER (r > 2) AS above_two, quantile_cont(r, 0.01) AS p01, quantile_cont(r, 0.99) AS p99
FROM (SELECT offset_minutes, CASE WHEN expected_current > 0 THEN current / expected_current END AS r FROM shifted) GROUP BY 1
""", "shifted"), d="minimum maximum p01 p99", i="offset_minutes above_two")
def a36(t):
    rows = shifted(t).withColumn("r", ratio("current", "expected_current"))
    return pf.tail_summary(rows, "r", ["offset_minutes"])


@query("a37_share_above_one", sql("""
SELECT phase, count(*) AS labels, median(s) AS median_share FROM (SELECT ts, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS phase,
  avg(CASE WHEN value / (k / 2) > 1 THEN 1.0 ELSE 0 END) AS s FROM devh WHERE k > 0 GROUP BY 1, 2) GROUP BY 1
""", "devh"), d="median_share", i="labels")
def a37(t):
    from .views import devh
    rows = devh(t).where("k > 0").select("ts", F.when(F.hour("ts") < 12, "AM").otherwise("PM").alias("phase"), (F.col("value") / (F.col("k") / 2)).alias("r"))
    return pf.share_above_one(rows, "r", "phase")


@query("a38_device_ranges", sql("""
SELECT l_suppkey, count(*) FILTER (e IS NOT NULL) AS valid_pairs, min(e) AS expected_min, max(e) AS expected_max, min(m) AS measured_min, max(m) AS measured_max, count(*) FILTER (m < 0) AS negative,
  count(*) FILTER (e IS NOT NULL AND poa >= 600) AS illuminated_pairs, count(*) FILTER (m > 1000) AS above_reference, quantile_cont(m / modv, 0.1) FILTER (e IS NOT NULL AND poa >= 600) AS ratio_p10,
  median(m / modv) FILTER (e IS NOT NULL AND poa >= 600) AS ratio_median, quantile_cont(m / modv, 0.9) FILTER (e IS NOT NULL AND poa >= 600) AS ratio_p90
FROM (SELECT l_suppkey, poa, CASE WHEN tax <> 0.05 THEN poa * 1.1 END AS e, poa + wind - 12 AS m, ambient + 5 AS modv FROM wx) GROUP BY 1
""", "wx"), d="expected_min expected_max measured_min measured_max ratio_p10 ratio_median ratio_p90", i="l_suppkey valid_pairs negative illuminated_pairs above_reference")
def a38(t):
    rows = wx(t).select("l_suppkey", "poa", F.when(F.col("tax") != 0.05, F.col("poa") * 1.1).alias("e"), (F.col("poa") + F.col("wind") - 12).alias("m"),
                        (F.col("ambient") + 5).alias("modv"))
    return pf.device_ranges(rows, "l_suppkey", "e", "m", "modv", "poa", 1000.0)


@query("a39_monthly_counts", sql("""
SELECT g.month, count(s.ts) AS records FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(ts)) FROM stamped), (SELECT date_trunc('month', max(ts)) FROM stamped), INTERVAL 1 MONTH)) AS month) g
LEFT JOIN (SELECT * FROM stamped WHERE value > 498000) s ON date_trunc('month', s.ts) = g.month GROUP BY 1
""", "stamped"), i="records", t="month")
def a39(t):
    return pf.monthly_counts(stamped(t), F.col("value") > 498000)


def _modal(src):
    return f"(SELECT step FROM (SELECT epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) AS step FROM {src}) WHERE step IS NOT NULL GROUP BY step ORDER BY count(*) DESC, step LIMIT 1)"


@query("a40_dataset_summary", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS dataset, count(*) AS records, min(ts) AS \"first\", max(ts) AS \"last\", floor((epoch(max(ts)) - epoch(min(ts))) / {c}) + 1 AS expected_slots, {m} AS missing_cells, {_modal(n)} AS modal_seconds, "
    f"100.0 * count(*) / (floor((epoch(max(ts)) - epoch(min(ts))) / {c}) + 1) AS coverage_pct FROM {n}"
    for n, c, m in (("site5", 300, "count(*) - count(power)"), ("env15", 900, "2 * count(*) - count(ambient) - count(wind)"), ("meter15", 900, "count(*) - count(meter)"))),
    "site5", "env15", "meter15"), d="coverage_pct", i="records expected_slots missing_cells modal_seconds")
def a40(t):
    return pf.dataset_summary({"site5": site5(t), "env15": env15(t), "meter15": meter15(t)}, {"site5": 300, "env15": 900, "meter15": 900},
                              {"site5": ["power"], "env15": ["ambient", "wind"], "meter15": ["meter"]})


@query("a41_closure", sql(f"SELECT 'closure' AS quantity, count(v) AS records, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS minimum, max(v) AS maximum, {DESC} FROM (SELECT voltage_ratio * current_ratio / power_ratio - 1 AS v FROM strata)", "strata"),
       d="mean std minimum maximum p10 p25 p50 p75 p90", i="records")
def a41(t):
    rows = strata(t).withColumn("closure", F.col("voltage_ratio") * F.col("current_ratio") / F.col("power_ratio") - 1)
    return pf.describe(rows, ["closure"])


@query("a42_self_lag", sql(" UNION ALL ".join(
    f"SELECT {o} AS lag_minutes, count(b.v) AS n, corr(b.v, a.v) AS correlation FROM h a LEFT JOIN h b ON b.ts = a.ts + to_minutes({o})" for o in (-60, 0, 60)).join(
    ["WITH h AS (SELECT ts, avg(value) AS v FROM devh GROUP BY 1) ", ""]), "devh"), d="correlation", i="lag_minutes n")
def a42(t):
    from .views import devh
    hours = devh(t).groupBy("ts").agg(F.avg("value").alias("v"))
    return pf.self_lag(hours, "v", [-60, 0, 60])
