"""Structural and statistical audit queries."""

from pyspark.sql import functions as F

from sunward.functions.values import beside
from sunward.operators import audit as au

from .registry import query
from .views import ROSTER, devh, env15, ev, site5, sql, wx

UNITS = tuple(f"inv_{n:02d}" for n in range(1, 25))
LINE = "event_id || ',' || event_type || ',' || k || CASE WHEN user_id % 50 = 0 THEN ',extra' ELSE '' END"


@query("q01_record_widths", sql("""
SELECT CASE WHEN length(trim(v)) = 0 THEN 0 ELSE len(string_split(v, ',')) END AS width, count(*) AS records
FROM (SELECT CASE WHEN event_id % 101 = 7 THEN '' ELSE event_id || ',' || event_type || CASE WHEN user_id % 50 = 0
  THEN ',extra' ELSE '' END END AS v FROM ev) GROUP BY 1
""", "ev"), i="width records")
def q01(t):
    extra = F.when(F.col("user_id") % 50 == 0, ",extra").otherwise("")
    line = F.concat(F.col("event_id").cast("string"), F.lit(","), "event_type", extra)
    lines = ev(t).select(F.when(F.col("event_id") % 101 == 7, "").otherwise(line).alias("value"))
    return au.record_widths(lines)


def _header(t):
    return t.events.select("event_type", "user_id").distinct().select(
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 24 + 1).cast("string")).alias("name"))


@query("q02_duplicate_headers", """
SELECT name, count(*) AS copies FROM (SELECT DISTINCT event_type, user_id, event_type || '_' || (user_id % 24 + 1) AS name FROM events)
GROUP BY 1 HAVING count(*) > 1
""", i="copies")
def q02(t):
    return au.repeated(_header(t), ["name"])


@query("q03_duplicate_rows", """
SELECT sum(c) AS records, sum(c - 1) AS duplicates, count(*) FILTER (c > 1) AS repeated_digests FROM (
  SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag)
""", i="records duplicates repeated_digests")
def q03(t):
    return au.duplicate_rows(t.lineitem, ["l_orderkey", "l_linenumber", "l_returnflag"])


def _names(t):
    names = t.events.select("event_type", "user_id").distinct()
    unit = (F.col("user_id") % 24 + 1).cast("string")
    padded = F.when(F.col("user_id") % 10 == 9, unit).otherwise(F.lpad(unit, 2, "0"))
    return names.select(F.concat(F.lit("inv_"), padded, F.lit("_"), "event_type", F.lit("_inv_"),
                                 F.col("user_id").cast("string")).alias("name"))


NAMES = """names AS (SELECT DISTINCT 'inv_' || CASE WHEN user_id % 10 = 9 THEN CAST(user_id % 24 + 1 AS VARCHAR)
  ELSE lpad(CAST(user_id % 24 + 1 AS VARCHAR), 2, '0') END || '_' || event_type || '_inv_' || user_id AS name FROM events),
p AS (SELECT name, regexp_matches(name, '^inv_\\d\\d_[a-z_]+_inv_\\d+$') AS canonical,
  regexp_extract(name, '^inv_(\\d\\d)_([a-z]+)_inv_(\\d+)$', 1) AS u, regexp_extract(name, '^inv_(\\d\\d)_([a-z]+)_inv_(\\d+)$', 2) AS q,
  regexp_extract(name, '^inv_(\\d\\d)_([a-z]+)_inv_(\\d+)$', 3) AS m FROM names)"""


@query("q04_channel_names", f"""
WITH {NAMES} SELECT name, CASE WHEN u <> '' THEN CAST(u AS DOUBLE) END AS inverter, CASE WHEN q <> '' THEN q END AS quantity,
  CASE WHEN m <> '' THEN CAST(m AS DOUBLE) END AS metric_id, canonical FROM p
""", d="inverter metric_id")
def q04(t):
    out = au.parse_channels(_names(t))
    return out.withColumn("inverter", F.col("inverter").cast("double")).withColumn(
        "metric_id", F.col("metric_id").cast("double"))


@query("q05_channel_roster", f"""
WITH {NAMES} SELECT CAST(u AS INTEGER) AS inverter, {", ".join(f"min(name) FILTER (q = '{r}') AS {r}" for r in ROSTER)},
  {" + ".join(f"(count(*) FILTER (q = '{r}') = 0)::INT" for r in ROSTER)} AS missing,
  {" + ".join(f"(count(*) FILTER (q = '{r}') > 1)::INT" for r in ROSTER)} AS duplicated FROM p WHERE canonical GROUP BY 1
""", i="inverter missing duplicated")
def q05(t):
    return au.channel_roster(au.parse_channels(_names(t)).where("canonical"), ROSTER)


@query("q06_duplicate_channels", f"""
WITH {NAMES} SELECT CAST(u AS INTEGER) AS inverter, q AS quantity, count(*) AS copies FROM p WHERE canonical
GROUP BY 1, 2 HAVING count(*) > 1
""", i="inverter copies")
def q06(t):
    return au.repeated(au.parse_channels(_names(t)).where("canonical"), ["inverter", "quantity"])


def _channels(t):
    return t.events.select(F.col("user_id").alias("metric_id")).distinct()


def _metrics(t):
    return t.customer.where(F.col("c_custkey") % 9 != 4).select(
        F.col("c_custkey").alias("metric_id"), "c_name", "c_mktsegment", "c_nationkey")


CONF = """SELECT metric_id, c_name IS NOT NULL AS in_metadata, coalesce(c_mktsegment = 'BUILDING', false) AS unit_ok,
  coalesce(regexp_matches(c_name, '^Customer#'), false) AS name_ok, coalesce(c_nationkey < 20, false) AS scale_ok
FROM (SELECT DISTINCT user_id AS metric_id FROM events) LEFT JOIN
  (SELECT c_custkey AS metric_id, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 9 <> 4) USING (metric_id)"""
CHECKS = ("unit_ok", "name_ok", "scale_ok")


def _conformance(t):
    out = au.metadata_conformance(_channels(t), _metrics(t), "metric_id", {
        "unit_ok": F.col("c_mktsegment") == "BUILDING", "name_ok": F.col("c_name").rlike("^Customer#"),
        "scale_ok": F.col("c_nationkey") < 20})
    return out.select("metric_id", "in_metadata", *CHECKS)


@query("q07_metadata_conformance", CONF, i="metric_id")
def q07(t):
    return _conformance(t)


@query("q08_unit_gate", f"""
SELECT count(*) AS channels, count(*) FILTER (in_metadata AND unit_ok AND name_ok AND scale_ok) AS confirmed FROM ({CONF})
""", i="channels confirmed")
def q08(t):
    rows = _conformance(t)
    good = rows.where("in_metadata and unit_ok and name_ok and scale_ok")
    confirmed = au.check_units(good, CHECKS).agg(F.count(F.lit(1)).alias("confirmed"))
    return beside(rows.agg(F.count(F.lit(1)).alias("channels")), confirmed)


@query("q09_set_differences", """
WITH a AS (SELECT DISTINCT user_id AS metric_id FROM events), b AS (SELECT c_custkey AS metric_id FROM customer WHERE c_custkey % 9 <> 4)
SELECT metric_id, 'left_only' AS side FROM a WHERE metric_id NOT IN (SELECT metric_id FROM b)
UNION ALL SELECT metric_id, 'right_only' FROM b WHERE metric_id NOT IN (SELECT metric_id FROM a)
""", i="metric_id")
def q09(t):
    return au.set_differences(_channels(t), _metrics(t), "metric_id")


@query("q10_availability_crosstab", sql(f"""
SELECT r.inverter_id, {", ".join(f"count(*) FILTER (event_type = '{r}') AS {r}" for r in ROSTER)}
FROM (SELECT 'inv_' || lpad(CAST(g AS VARCHAR), 2, '0') AS inverter_id FROM range(1, 25) AS x(g)) r
LEFT JOIN ev e ON r.inverter_id = e.inverter_id GROUP BY 1
""", "ev"), i=" ".join(ROSTER))
def q10(t):
    return au.availability_crosstab(ev(t), UNITS, "inverter_id", "event_type", ROSTER)


@query("q11_dtype_report", sql("""
WITH l AS (SELECT 'number' AS "column", CASE WHEN k > 50 THEN CAST(CAST(k AS BIGINT) AS VARCHAR) ELSE event_type END AS v FROM ev
  UNION ALL SELECT 'stamp', CASE WHEN k > 30 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END FROM ev)
SELECT "column", count(v) AS present, count(TRY_CAST(v AS BIGINT)) AS integers, count(TRY_CAST(v AS DOUBLE)) AS doubles,
  count(TRY_CAST(v AS TIMESTAMP)) AS timestamps FROM l GROUP BY 1
""", "ev"), i="present integers doubles timestamps")
def q11(t):
    text = ev(t).select(
        F.when(F.col("k") > 50, F.col("k").cast("long").cast("string")).otherwise(F.col("event_type")).alias("number"),
        F.when(F.col("k") > 30, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("stamp"))
    return au.dtype_report(text, ["number", "stamp"])


@query("q12_token_report", sql("""
SELECT event_type, count(v) AS present, count(*) FILTER (v = 'n/a') AS nonnumeric, count(*) FILTER (v = 'Infinity') AS infinite
FROM (SELECT event_type, CASE WHEN event_id % 97 = 1 THEN 'n/a' WHEN event_id % 89 = 1 THEN 'Infinity'
  WHEN event_id % 83 = 1 THEN NULL ELSE CAST(k AS VARCHAR) END AS v FROM ev) GROUP BY 1
""", "ev"), i="present nonnumeric infinite")
def q12(t):
    e = F.col("event_id")
    text = (F.when(e % 97 == 1, "n/a").when(e % 89 == 1, "Infinity").when(e % 83 == 1, F.lit(None).cast("string"))
            .otherwise(F.col("k").cast("string")))
    return au.token_report(ev(t).select("event_type", text.alias("v")), "v", ["event_type"])


HOLES = "CASE WHEN event_id % 11 = 5 THEN NULL WHEN event_id % 13 = 5 THEN 0.0 ELSE value - 5 END"


def _holed(t):
    e = F.col("event_id")
    v = F.when(e % 11 == 5, F.lit(None).cast("double")).when(e % 13 == 5, 0.0).otherwise(F.col("value") - 5)
    return ev(t).withColumn("reading", v)


@query("q13_channel_stats", sql(f"""
SELECT inverter_id, event_type, count(*) AS records, count(v) AS "finite", count(*) - count(v) AS missing, min(v) AS minimum,
  max(v) AS maximum, avg(v) AS mean, stddev_samp(v) AS std, count(*) FILTER (v = 0) AS zeros, count(*) FILTER (v < 0) AS negatives,
  count(v) = 0 AS all_null, coalesce(min(v) = max(v), false) AS constant
FROM (SELECT inverter_id, event_type, {HOLES} AS v FROM ev) GROUP BY 1, 2
""", "ev"), d="minimum maximum mean std", i="records missing zeros negatives \"finite\"")
def q13(t):
    return au.channel_stats(_holed(t), ["inverter_id", "event_type"], "reading")


PROBS = (1, 5, 25, 50, 75, 95, 99, 99.9)


@query("q14_exact_quantiles", sql(f"""
SELECT event_type, count(v) AS "finite", {", ".join(f"quantile_cont(v, {p / 100}) AS p{str(p).replace('.', '_')}" for p in PROBS)}
FROM (SELECT event_type, {HOLES} AS v FROM ev) GROUP BY 1
""", "ev"), d=" ".join(f"p{str(p).replace('.', '_')}" for p in PROBS), i="\"finite\"")
def q14(t):
    return au.channel_quantiles(_holed(t), ["event_type"], PROBS, "reading")


@query("q15_threshold_counts", """
SELECT event_type, count(*) FILTER (value > 0 AND value < 1) AS tiny_positive, count(*) FILTER (value > 200) AS above_threshold,
  max(value) AS maximum, count(*) FILTER (value = m) AS maximum_copies
FROM (SELECT event_type, value, max(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1
""", d="maximum", i="tiny_positive above_threshold maximum_copies")
def q15(t):
    return au.threshold_counts(t.events, ["event_type"], "value", 1.0, 200.0)


@query("q16_missing_runs", sql("""
WITH m AS (SELECT event_id, event_id - row_number() OVER (ORDER BY event_id) AS g FROM ev WHERE k < 60),
r AS (SELECT min(event_id) AS s, max(event_id) AS e, count(*) AS n FROM m GROUP BY g)
SELECT count(*) AS runs, count(*) FILTER (n = 1) AS isolated, count(*) FILTER (n > 1) AS blocks, max(n) AS longest,
  max(CASE WHEN e = (SELECT max(event_id) FROM ev) THEN n ELSE 0 END) AS trailing_run, min(s) AS first_row, max(e) AS last_missing_row FROM r
""", "ev"), i="runs isolated blocks longest trailing_run first_row last_missing_row")
def q16(t):
    return au.missing_runs(ev(t), "event_id", F.col("k") < 60, widths=(512, 65536))


@query("q17_timed_missing_runs", sql("""
WITH m AS (SELECT epoch(ts) / 300 - row_number() OVER (ORDER BY ts) AS g FROM site5 WHERE poa < 400),
r AS (SELECT count(*) AS n FROM m GROUP BY g)
SELECT count(*) AS runs, count(*) FILTER (n = 1) AS isolated, max(n) AS longest, sum(n) AS missing FROM r
""", "site5"), i="runs isolated longest missing")
def q17(t):
    return au.timed_missing_runs(site5(t), F.col("poa") < 400, 300)


LONG = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, inverter_id, event_type, CASE WHEN k >= 40 THEN value END AS value FROM ev"""


def _long(t):
    from sunward.functions import clock
    return ev(t).select(clock.floor_to("ts", 60).alias("ts"), "inverter_id", "event_type",
                        F.when(F.col("k") >= 40, F.col("value")).alias("value"))


@query("q18_outage_rows", sql(f"""
SELECT inverter_id, count(*) AS labels, count(*) FILTER (o) AS outage_labels FROM (
  SELECT ts, inverter_id, bool_and(value IS NULL) AS o FROM ({LONG}) GROUP BY 1, 2) GROUP BY 1
""", "ev"), i="labels outage_labels")
def q18(t):
    return au.outage_rows(_long(t), "inverter_id", "value")


@query("q19_missingness_rollup", sql(f"""
SELECT inverter_id, count(*) AS channels, sum(m) AS missing, max(m) AS worst_channel_missing, 100.0 * sum(m) / sum(n) AS missing_pct
FROM (SELECT inverter_id, event_type, count(*) AS n, count(*) - count(value) AS m FROM ({LONG}) GROUP BY 1, 2) GROUP BY 1
""", "ev"), d="missing_pct", i="channels missing worst_channel_missing")
def q19(t):
    return au.missingness_rollup(_long(t), "inverter_id", "event_type", "value")


@query("q20_extrema", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos FROM events),
p AS (SELECT event_type, quantile_cont(value, 0.99) AS p99 FROM events WHERE value > 0 GROUP BY 1),
x AS (SELECT event_type, 'minimum' AS extreme, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS q FROM r) WHERE q = 1
  UNION ALL SELECT event_type, 'maximum', pos, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS q FROM r) WHERE q = 1)
SELECT x.event_type, x.extreme, x.value AS extreme_value, r.pos - x.pos AS "offset", r.event_id, r.value, x.value / p.p99 AS ratio_to_p99
FROM x JOIN r ON r.event_type = x.event_type AND r.pos BETWEEN x.pos - 2 AND x.pos + 2 JOIN p ON p.event_type = x.event_type
""", d="extreme_value value ratio_to_p99", i='"offset"')
def q20(t):
    return au.extrema(t.events, ["event_type"], "value", "event_id", widths=(512, 65536))


@query("q21_range_table", sql(f"""
SELECT inverter_id, {", ".join(f"min(value) FILTER (event_type = '{r}') AS {r}_min, max(value) FILTER (event_type = '{r}') AS {r}_max" for r in ROSTER)}
FROM ev GROUP BY 1
""", "ev"), d=" ".join(f"{r}_min {r}_max" for r in ROSTER))
def q21(t):
    return au.range_table(ev(t), "inverter_id", "event_type", ROSTER, "value")


@query("q22_joint_availability", sql("""
SELECT a IS NOT NULL AS has_a, b IS NOT NULL AS has_b, c IS NOT NULL AS has_c, count(*) AS records FROM (
  SELECT CASE WHEN k > 10 THEN 1 END AS a, CASE WHEN value > 5 THEN 1 END AS b, CASE WHEN user_id % 3 > 0 THEN 1 END AS c FROM ev)
GROUP BY 1, 2, 3
""", "ev"), i="records")
def q22(t):
    rows = ev(t).select(F.when(F.col("k") > 10, 1).alias("a"), F.when(F.col("value") > 5, 1).alias("b"),
                        F.when(F.col("user_id") % 3 > 0, 1).alias("c"))
    return au.joint_availability(rows, ["a", "b", "c"])


@query("q23_hourly_constancy", sql("""
WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n, count(v) AS c, count(DISTINCT v) AS u FROM (
  SELECT ts, floor(poa / 400) AS v FROM site5 WHERE minute(ts) % 15 = 0) GROUP BY 1)
SELECT count(*) AS hours, count(*) FILTER (n = 4 AND c = 4) AS complete_hours,
  count(*) FILTER (n = 4 AND c = 4 AND u = 1) AS constant_hours FROM h
""", "site5"), i="hours complete_hours constant_hours")
def q23(t):
    rows = site5(t).where(F.minute("ts") % 15 == 0).select("ts", F.floor(F.col("poa") / 400).alias("v"))
    return au.hourly_constancy(rows, "v")


@query("q23_change_minutes", sql("""
WITH s AS (SELECT ts, floor(poa / 400) AS v, lag(floor(poa / 400)) OVER (ORDER BY ts) AS p, epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) AS d FROM site5)
SELECT minute(ts) AS minute, count(*) AS changes FROM s WHERE d = 300 AND v <> p GROUP BY 1
""", "site5"), i="minute changes")
def q23b(t):
    return au.change_minutes(site5(t).select("ts", F.floor(F.col("poa") / 400).alias("v")), "v", 300)


@query("q24_constant_runs", sql("""
WITH v AS (SELECT ts, floor(poa / 200) AS band FROM site5),
r AS (SELECT ts, band, epoch(ts) / 300 - row_number() OVER (PARTITION BY band ORDER BY ts) AS g FROM v)
SELECT band, min(ts) AS "start", max(ts) AS "end", count(*) AS samples FROM r GROUP BY band, g HAVING count(*) >= 2
""", "site5"), d="band", i="samples")
def q24(t):
    rows = site5(t).select("ts", F.floor(F.col("poa") / 200).cast("double").alias("band"))
    return au.constant_runs(rows, "band", 300)


@query("q25_top_values", sql("SELECT k, count(*) AS records FROM ev WHERE k IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "ev"),
       d="k", i="records")
def q25(t):
    return au.top_values(ev(t), "k", 10)


@query("q26_direction_changes", sql("""
WITH s AS (SELECT ts, poa * 0.36 AS direction, lag(poa * 0.36) OVER (ORDER BY ts) AS p, epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) AS d FROM site5)
SELECT ts, direction, CASE WHEN d = 300 THEN least(abs(direction - p), 360 - abs(direction - p)) END AS turn FROM s
""", "site5"), d="direction turn")
def q26(t):
    return au.direction_changes(site5(t).select("ts", (F.col("poa") * 0.36).alias("direction")), "direction", 300)


@query("q27_local_contrast", sql("""
WITH s AS (SELECT ts, power, lag(power) OVER w AS p, lead(power) OVER w AS n, epoch(ts) - lag(epoch(ts)) OVER w AS d,
  lead(epoch(ts)) OVER w - epoch(ts) AS e FROM site5 WINDOW w AS (ORDER BY ts))
SELECT ts, power, CASE WHEN d = 300 AND e = 300 THEN power - (p + n) / 2 END AS contrast FROM s
""", "site5"), d="power contrast")
def q27(t):
    return au.local_contrast(site5(t).select("ts", "power"), "power", 300)


@query("q28_hour_profile", """
SELECT hour(ts) AS hour, count(*) AS records, count(value) AS present, min(value) AS minimum, max(value) AS maximum,
  median(value) AS median FROM events GROUP BY 1
""", d="minimum maximum median", i="hour records present")
def q28(t):
    return au.hour_profile(t.events, "value")


@query("q29_night_summary", sql(f"""
SELECT count(*) AS records, count(v) AS present, count(*) FILTER (v > 0) AS positive, count(*) FILTER (v = 0) AS zero,
  count(*) FILTER (v < 0) AS negative, max(v) AS maximum FROM (SELECT ts, {HOLES} AS v FROM ev) WHERE hour(ts) < 5
""", "ev"), d="maximum", i="records present positive zero negative")
def q29(t):
    return au.night_summary(_holed(t), "reading")


@query("q30_night_dates", """
SELECT CAST(ts AS DATE) AS day, count(*) AS readings, max(value) AS largest, arg_max(ts, value) AS largest_at
FROM (SELECT ts, value FROM events ORDER BY ts) WHERE hour(ts) < 5 AND value > 50 GROUP BY 1
""", d="largest", i="readings", t="day")
def q30(t):
    return au.night_dates(t.events, "value", 50.0)


@query("q31_histogram", """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT least(floor((value - lo) / (hi - lo) * 20), 19) AS bin, count(*) AS records,
  min(lo) + least(floor((value - lo) / (hi - lo) * 20), 19) * (min(hi) - min(lo)) / 20 AS left_edge
FROM events, b GROUP BY 1
""", d="left_edge", i="bin records")
def q31(t):
    return au.histogram(t.events, "value", 20)


@query("q32_complete_days", sql("""
WITH h AS (SELECT date_trunc('hour', ts) AS ts, CASE WHEN count(*) > 5 THEN avg(value) END AS v FROM events GROUP BY 1)
SELECT CAST(ts AS DATE) AS day, count(*) AS records, count(v) AS present, count(*) = 24 AND count(v) = 24 AS complete,
  count(*) = 24 AND count(v) = 24 AND max(abs(v)) = 0 AS all_zero FROM h GROUP BY 1
"""), i="records present", t="day")
def q32(t):
    from sunward.functions import clock
    hours = t.events.groupBy(clock.floor_to("ts", 60).alias("ts")).agg(
        F.when(F.count("*") > 5, F.avg("value")).alias("v"))
    return au.complete_days(hours, "v", 24)


@query("q33_accumulation", """
WITH s AS (SELECT *, lag(value) OVER w AS p, lag(ts) OVER w AS q FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT event_type, count(*) FILTER (value > p) AS increases, count(*) FILTER (value < p) AS decreases,
  count(*) FILTER (value < p AND CAST(ts AS DATE) = CAST(q AS DATE)) AS within_day_decreases,
  count(*) FILTER (value < p) = 0 AS monotone FROM s GROUP BY 1
""", i="increases decreases within_day_decreases")
def q33(t):
    from sunward.operators.ordered import neighbours
    rows = neighbours(t.events, ["event_type"], "event_id", ["ts", "value"], (512, 65536))
    return au.accumulation_from(rows, "value", ["event_type"])


@query("q34_unit_hypotheses", """
SELECT h AS hypothesis, s AS second_largest, s * f AS implied_kw, s * f / 500 AS fraction_of_capacity FROM
  (SELECT value AS s FROM events ORDER BY value DESC LIMIT 1 OFFSET 1), (VALUES ('kW average', 1.0), ('kWh per 15 min', 4.0)) AS v(h, f)
""", d="second_largest implied_kw fraction_of_capacity")
def q34(t):
    return au.unit_hypotheses(t.events, "value", 500.0)


REVIEW = """review AS (SELECT event_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
  (SELECT event_id, 'largest' AS label FROM events ORDER BY value DESC, event_id LIMIT 3) UNION ALL
  (SELECT event_id, 'smallest' FROM events ORDER BY value, event_id LIMIT 3) UNION ALL
  SELECT event_id, 'flagged' FROM events WHERE value > 300) GROUP BY 1)"""


def _review(t):
    e = t.events
    return au.review_candidates({
        "largest": e.orderBy(F.desc("value"), "event_id").limit(3),
        "smallest": e.orderBy("value", "event_id").limit(3), "flagged": e.where("value > 300")}, "event_id")


@query("q35_review_candidates", f"WITH {REVIEW} SELECT * FROM review")
def q35(t):
    return _review(t)


@query("q36_neighbourhood", f"""
WITH {REVIEW} SELECT r.event_id AS centre, e.event_id, e.value FROM review r JOIN events e
  ON e.event_id BETWEEN r.event_id - 2 AND r.event_id + 2
""", d="value")
def q36(t):
    return au.neighbourhood(t.events.select("event_id", "value"), _review(t), "event_id", 2)


@query("q37_trailing_number", """
SELECT c_name AS name, CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT) AS logical_id FROM customer
""", i="logical_id")
def q37(t):
    return t.customer.select(F.col("c_name").alias("name"), au.trailing_number("c_name").alias("logical_id"))
