"""Timestamp, grid, gap and run queries."""

from pyspark.sql import functions as F

from sunward.functions import clock
from sunward.operators import timeline as tl

from .registry import query
from .views import env15, ev, meter15, site5, slots15, sql, stamped, wx

SPRING = "(make_date({y}, 3, 1) + CAST((7 - dayofweek(make_date({y}, 3, 1))) % 7 + 7 AS INTEGER))"
FALL = "(make_date({y}, 11, 1) + CAST((7 - dayofweek(make_date({y}, 11, 1))) % 7 AS INTEGER))"


def spring(y):
    return SPRING.format(y=y)


def fall(y):
    return FALL.format(y=y)


def _texts(t):
    iso, other = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.date_format("ts", "dd/MM/yyyy HH:mm")
    return ev(t).select("event_id", F.when(F.col("event_id") % 7 == 3, other).otherwise(iso).alias("measured_on"))


@query("t01_strict_parse", sql("""
SELECT count(*) AS records, count(p) AS parsed, count(m) - count(p) AS failed, min(p) AS "first", max(p) AS "last"
FROM (SELECT m, try_strptime(m, '%Y-%m-%d %H:%M:%S') AS p FROM (
  SELECT CASE WHEN event_id % 7 = 3 THEN strftime(ts, '%d/%m/%Y %H:%M') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS m
  FROM ev))
""", "ev"), i="records parsed failed")
def t01(t):
    return tl.parse_report(tl.strict_parse(_texts(t), "measured_on"), "measured_on")


@query("t02_order_report", """
WITH s AS (SELECT event_id, date_trunc('minute', ts) AS m, lag(date_trunc('minute', ts)) OVER (ORDER BY event_id) AS p FROM events)
SELECT sum(CASE WHEN m < p THEN 1 ELSE 0 END) AS backward_steps, sum(CASE WHEN m = p THEN 1 ELSE 0 END) AS equal_steps,
  (SELECT count(*) - count(DISTINCT m) FROM s) AS duplicate_labels,
  sum(CASE WHEN m < p THEN 1 ELSE 0 END) = 0 AS is_monotonic,
  sum(CASE WHEN m <= p THEN 1 ELSE 0 END) = 0 AS is_strict FROM s
""", i="backward_steps equal_steps duplicate_labels")
def t02(t):
    rows = t.events.select("event_id", clock.floor_to("ts", 1).alias("ts"))
    return tl.order_report(rows, "event_id", widths=(4096, 4_000_000))


@query("t03_basis_check", sql("SELECT count(*) AS records, count(ts) AS labels FROM site5", "site5"), i="records labels")
def t03(t):
    return tl.check_timestamp_basis(site5(t), "ts", "wall_clock").agg(
        F.count(F.lit(1)).alias("records"), F.count("ts").alias("labels"))


@query("t04_interval_histogram", sql("""
WITH s AS (SELECT epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) AS step FROM site5)
SELECT step, count(*) AS intervals, count(*) / sum(count(*)) OVER () AS share FROM s WHERE step IS NOT NULL GROUP BY step
""", "site5"), d="share", i="step intervals")
def t04(t):
    return tl.interval_histogram(site5(t))


@query("t04_modal_interval_by_unit", sql("""
WITH u AS (SELECT DISTINCT unit, time_bucket(INTERVAL 15 MINUTE, ts) AS ts FROM stamped),
s AS (SELECT unit, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY unit ORDER BY ts) AS step FROM u),
h AS (SELECT unit, step, count(*) AS intervals FROM s WHERE step IS NOT NULL GROUP BY 1, 2)
SELECT unit, step, intervals FROM h QUALIFY row_number() OVER (PARTITION BY unit ORDER BY intervals DESC, step) = 1
""", "stamped"), i="step intervals")
def t04b(t):
    return tl.modal_interval(stamped(t).select("unit", clock.floor_to("ts", 15).alias("ts")).distinct(), ["unit"])


@query("t05_gaps", sql("""
SELECT * FROM (SELECT lag(ts) OVER (ORDER BY ts) AS gap_start, ts AS gap_end,
  epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) AS step,
  ceil((epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts)) / 300) - 1 AS absent_slots,
  (epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts)) % 300 = 0 AS on_grid FROM site5) WHERE step > 300
""", "site5"), i="step absent_slots")
def t05(t):
    return tl.gaps(site5(t), 300)


@query("t05_irregular", sql("""
SELECT * FROM (SELECT lag(ts) OVER (ORDER BY ts) AS prev_ts, ts,
  epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) AS step FROM env15) WHERE step <> 900
""", "env15"), i="step")
def t05b(t):
    return tl.irregular(env15(t), 900)


@query("t06_dst_calendar", sql(f"""
SELECT y AS year, {spring('y')} AS spring_forward, {fall('y')} AS fall_back FROM (SELECT DISTINCT year(ts) AS y FROM stamped)
""", "stamped"), i="year", t="spring_forward fall_back")
def t06(t):
    return tl.dst_calendar(stamped(t))


@query("t07_dst_day_audit", sql(f"""
WITH d AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS ts, CAST(ts AS DATE) AS day,
  CASE WHEN CAST(ts AS DATE) = {spring('year(ts)')} THEN 'spring' WHEN CAST(ts AS DATE) = {fall('year(ts)')} THEN 'fall' END AS kind
  FROM wx), l AS (SELECT ts, day, kind, count(*) AS copies FROM d WHERE kind IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY day ORDER BY ts) AS step FROM l)
SELECT day, kind, sum(copies) AS records,
  sum(CASE WHEN hour(ts) = CASE kind WHEN 'spring' THEN 2 ELSE 1 END THEN copies ELSE 0 END) AS critical_hour_records,
  sum(copies - 1) AS duplicate_labels, sum(CASE WHEN step <> 300 THEN 1 ELSE 0 END) AS irregular_steps
FROM s GROUP BY 1, 2
""", "wx"), i="records critical_hour_records duplicate_labels irregular_steps", t="day")
def t07(t):
    return tl.dst_day_audit(wx(t), 300)


GRID = """g AS (SELECT unnest(generate_series((SELECT min(ts) FROM slots15), (SELECT max(ts) FROM slots15),
  INTERVAL 15 MINUTE)) AS ts), e AS (SELECT g.ts, s.ts IS NOT NULL AS observed,
  CAST(g.ts AS DATE) = {spring} AND hour(g.ts) = 2 AS absent FROM g LEFT JOIN slots15 s ON g.ts = s.ts)"""
COVER = """count(*) AS expected_naive, count(*) FILTER (NOT absent) AS expected_dst,
  count(*) FILTER (observed) AS observed, count(*) FILTER (NOT observed) AS missing_naive,
  count(*) FILTER (NOT observed AND NOT absent) AS missing_dst, 100.0 * count(*) FILTER (observed) / count(*) AS coverage_pct"""


@query("t08_grid_coverage", sql(f"WITH {GRID.format(spring=spring('year(g.ts)'))} SELECT {COVER} FROM e", "slots15"),
       d="coverage_pct", i="expected_naive expected_dst observed missing_naive missing_dst")
def t08(t):
    return tl.grid_coverage(slots15(t), 900)


@query("t09_yearly_coverage", sql(
    f"WITH {GRID.format(spring=spring('year(g.ts)'))} SELECT year(ts) AS year, {COVER} FROM e GROUP BY 1", "slots15"),
       d="coverage_pct", i="year expected_naive expected_dst observed missing_naive missing_dst")
def t09(t):
    return tl.yearly_coverage(slots15(t), 900)


@query("t10_gap_classes", sql(f"""
WITH gp AS (SELECT lag(ts) OVER (ORDER BY ts) AS a, ts AS z FROM slots15), gg AS (SELECT * FROM gp WHERE epoch(z) - epoch(a) > 900),
years AS (SELECT DISTINCT year(ts) AS y FROM slots15),
sl AS (SELECT CAST({spring('y')} AS TIMESTAMP) + INTERVAL 2 HOUR + to_minutes(CAST(15 * k AS INTEGER)) AS slot
  FROM years, range(4) AS r(k)),
c AS (SELECT a, z, count(slot) AS dst_slots FROM gg LEFT JOIN sl ON slot > a AND slot < z GROUP BY 1, 2)
SELECT a AS gap_start, z AS gap_end, epoch(z) - epoch(a) AS step, ceil((epoch(z) - epoch(a)) / 900) - 1 AS absent_slots,
  (epoch(z) - epoch(a)) % 900 = 0 AS on_grid, dst_slots,
  CASE WHEN dst_slots > 0 AND dst_slots = ceil((epoch(z) - epoch(a)) / 900) - 1 THEN 'dst_only'
       WHEN dst_slots > 0 THEN 'dst_plus_missing' WHEN epoch(z) - epoch(a) > 86400 THEN 'long' ELSE 'short' END AS kind FROM c
""", "slots15"), i="step absent_slots dst_slots")
def t10(t):
    return tl.classify_gaps(tl.gaps(slots15(t), 900), 900)


def _sets(t):
    return {"site": site5(t).select("ts"), "environment": env15(t).select("ts"), "meter": meter15(t).select("ts")}


GAPSETS = """u AS (SELECT 'site' AS dataset, 300 AS c, ts FROM site5 UNION ALL SELECT 'environment', 900, ts FROM env15
  UNION ALL SELECT 'meter', 900, ts FROM meter15),
s AS (SELECT dataset, c, lag(ts) OVER (PARTITION BY dataset ORDER BY ts) AS gap_start, ts AS gap_end,
  epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY dataset ORDER BY ts) AS step FROM u)"""


@query("t11_dataset_gaps", sql(f"""
WITH {GAPSETS} SELECT dataset, CASE WHEN step > 86400 THEN 'long' ELSE 'short' END AS kind, count(*) AS gaps,
  sum(ceil(step / c) - 1) AS absent_slots, max(step) AS longest_seconds FROM s WHERE step > c GROUP BY 1, 2
""", "site5", "env15", "meter15"), i="gaps absent_slots longest_seconds")
def t11(t):
    cad = {"site": 300, "environment": 900, "meter": 900}
    return tl.gap_summary(tl.dataset_gaps(_sets(t), cad))


@query("t12_missing_inside_gaps", sql(f"""
WITH {GAPSETS}, lg AS (SELECT dataset, gap_start, gap_end FROM s WHERE step > c AND step > 5400 AND c = 900),
x AS (SELECT dataset, gap_start, gap_end, unnest(generate_series(gap_start + INTERVAL 15 MINUTE,
  gap_end - INTERVAL 15 MINUTE, INTERVAL 15 MINUTE)) AS ts FROM lg)
SELECT dataset, gap_start, gap_end, count(*) AS slots,
  count(*) FILTER (ts NOT IN (SELECT ts FROM site5)) AS missing_site,
  count(*) FILTER (ts NOT IN (SELECT ts FROM env15)) AS missing_environment,
  count(*) FILTER (ts NOT IN (SELECT ts FROM meter15)) AS missing_meter FROM x GROUP BY 1, 2, 3
""", "site5", "env15", "meter15"), i="slots missing_site missing_environment missing_meter")
def t12(t):
    sets = _sets(t)
    slow = {k: v for k, v in sets.items() if k != "site"}
    found = tl.dataset_gaps(slow, {"environment": 900, "meter": 900}).where(F.col("step") > 5400)
    return tl.missing_inside(found, sets, 900)


@query("t13_hour_by_interval", sql("""
WITH s AS (SELECT ts, epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) AS step FROM site5)
SELECT hour(ts) AS hour, count(*) FILTER (step = 300) AS s_300, count(*) FILTER (step = 600) AS s_600,
  count(*) FILTER (step = 900) AS s_900, count(*) FILTER (step NOT IN (300, 600, 900)) AS s_other
FROM s WHERE step IS NOT NULL GROUP BY 1
""", "site5"), i="hour s_300 s_600 s_900 s_other")
def t13(t):
    return tl.hour_by_interval(site5(t), [300, 600, 900])


@query("t14_overlap_window", sql("""
SELECT max(f) AS "first", min(l) AS "last" FROM (SELECT min(ts) AS f, max(ts) AS l FROM site5
  UNION ALL SELECT min(ts), max(ts) FROM env15 UNION ALL SELECT min(ts), max(ts) FROM meter15)
""", "site5", "env15", "meter15"))
def t14(t):
    return tl.overlap_window(_sets(t))


@query("t15_label_intersections", sql("""
SELECT (SELECT count(*) FROM site5 JOIN env15 USING (ts)) AS site_and_environment,
  (SELECT count(*) FROM site5 JOIN meter15 USING (ts)) AS site_and_meter,
  (SELECT count(*) FROM env15 JOIN meter15 USING (ts)) AS environment_and_meter,
  (SELECT count(*) FROM site5 JOIN env15 USING (ts) JOIN meter15 USING (ts)) AS all_series
""", "site5", "env15", "meter15"), i="site_and_environment site_and_meter environment_and_meter all_series")
def t15(t):
    return tl.label_intersections(_sets(t))


@query("t16_grid_conformity", """
SELECT count(*) AS records, count(*) FILTER (CAST(floor(epoch(ts)) AS BIGINT) % 300 <> 0) AS off_grid,
  count(*) FILTER (CAST(floor(epoch(ts)) AS BIGINT) % 900 = 0) AS quarter_hour,
  count(DISTINCT second(ts)) AS distinct_seconds, count(DISTINCT minute(ts)) AS distinct_minutes FROM events
""", i="records off_grid quarter_hour distinct_seconds distinct_minutes")
def t16(t):
    return tl.grid_conformity(t.events, 300)


@query("t17_fall_ambiguous", sql("""
SELECT year(ts) AS year, count(*) AS records, count(*) FILTER (month(ts) = 11 AND day(ts) <= 7 AND dayofweek(ts) = 0
  AND hour(ts) = 1) AS ambiguous FROM wx GROUP BY 1
""", "wx"), i="year records ambiguous")
def t17(t):
    rows = tl.with_clock_flags(wx(t))
    return rows.groupBy(F.year("ts").alias("year")).agg(
        F.count("*").alias("records"), F.count_if("dst_fall_ambiguous").alias("ambiguous"))


@query("t18_unresolvable_labels", sql("""
SELECT ts, count(*) AS records, bool_and(month(ts) = 11) AS ambiguous FROM wx
WHERE (month(ts) = 11 AND day(ts) <= 7 AND dayofweek(ts) = 0 AND hour(ts) = 1)
   OR (month(ts) = 3 AND day(ts) BETWEEN 8 AND 14 AND dayofweek(ts) = 0 AND hour(ts) = 2) GROUP BY ts
""", "wx"), i="records")
def t18(t):
    rows = tl.with_clock_flags(wx(t)).where(~F.col("clock_valid"))
    return rows.groupBy("ts").agg(F.count("*").alias("records"), F.bool_and("dst_fall_ambiguous").alias("ambiguous"))


@query("t19_dst_rows_by_dataset", sql(f"""
WITH u AS (SELECT CAST(ts AS DATE) AS day, 'orders' AS dataset, ts FROM stamped
  UNION ALL SELECT CAST(ts AS DATE), 'lines', ts FROM wx)
SELECT day, count(*) FILTER (dataset = 'orders') AS orders, count(*) FILTER (dataset = 'lines') AS lines FROM u
WHERE day = {spring('year(ts)')} OR day = {fall('year(ts)')} GROUP BY 1
""", "stamped", "wx"), i="orders lines", t="day")
def t19(t):
    return tl.dst_rows_by_dataset({"orders": stamped(t), "lines": wx(t)})


RUNS = """r AS (SELECT ts, epoch(ts) / {c} - row_number() OVER (ORDER BY ts) AS g FROM {src} WHERE {cond})
SELECT min(ts) AS "start", max(ts) AS "end", count(*) AS samples, count(*) * {c} / 3600.0 AS nominal_hours
FROM r GROUP BY g HAVING count(*) >= {k}"""


@query("t20_condition_runs", sql("WITH " + RUNS.format(c=300, src="site5", cond="power > 20", k=3), "site5"),
       d="nominal_hours", i="samples")
def t20(t):
    return tl.label_runs(site5(t), F.col("power") > 20, 300, 3)


@query("t21_candidate_runs", sql("WITH " + RUNS.format(c=300, src="site5", cond="poa BETWEEN 300 AND 700", k=1), "site5"),
       d="nominal_hours", i="samples")
def t21(t):
    return tl.label_runs(site5(t), F.col("poa").between(300, 700), 300)
