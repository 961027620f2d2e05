"""Neighbour, rank, sort and selection queries."""

from pyspark.sql import functions as F

from sunward.functions import clock
from sunward.operators import masks as mk
from sunward.operators import profiles as pf
from sunward.operators import windows as wn

from .physics import OFFSETS
from .profiles import predictions
from .registry import query
from .views import _view, devh, ev, fleeth, pairs, site5, sql, stamped, unitmonth, wx


@query("w01_exact_neighbours", sql("""
SELECT a.ts, a.power, b.power AS prev_power, c.power AS next_power FROM site5 a LEFT JOIN site5 b ON b.ts = a.ts - INTERVAL 5 MINUTE LEFT JOIN site5 c ON c.ts = a.ts + INTERVAL 5 MINUTE
""", "site5"), d="power prev_power next_power")
def w01(t):
    return wn.adjacent(site5(t).select("ts", "power"), "power")


@query("w01_device_neighbours", sql("""
SELECT a.ts, a.inverter_id, a.value, b.value AS prev_value, c.value AS next_value FROM devh a LEFT JOIN devh b ON b.inverter_id = a.inverter_id AND b.ts = a.ts - INTERVAL 1 HOUR
LEFT JOIN devh c ON c.inverter_id = a.inverter_id AND c.ts = a.ts + INTERVAL 1 HOUR
""", "devh"), d="value prev_value next_value")
def w01b(t):
    return wn.adjacent(devh(t).select("ts", "inverter_id", "value"), "value", 3600, ["inverter_id"])


@query("w02_relative_ramp", sql("""
SELECT a.ts, a.poa, CASE WHEN b.poa IS NOT NULL AND c.poa IS NOT NULL AND a.poa <> 0 THEN greatest(abs(a.poa - b.poa) / a.poa, abs(a.poa - c.poa) / a.poa) END AS ramp
FROM site5 a LEFT JOIN site5 b ON b.ts = a.ts - INTERVAL 5 MINUTE LEFT JOIN site5 c ON c.ts = a.ts + INTERVAL 5 MINUTE
""", "site5"), d="poa ramp")
def w02(t):
    return wn.relative_ramp(site5(t).select("ts", "poa"), "poa", "ramp")


@query("w03_consensus", sql("""
WITH m AS (SELECT ts, count(value) = 5 AS ok, median(value) AS med FROM fleeth GROUP BY 1)
SELECT f.ts, CASE WHEN ok THEN max(med) END AS v_median, CASE WHEN ok THEN min(value) END AS v_min, CASE WHEN ok THEN max(value) END AS v_max,
  CASE WHEN ok AND max(med) > 0 THEN max(abs(value - med) / med) END AS v_deviation FROM fleeth f JOIN m ON m.ts = f.ts GROUP BY f.ts, ok
""", "fleeth"), d="v_median v_min v_max v_deviation")
def w03(t):
    return wn.consensus(fleeth(t), "value", 5, "v")


@query("w04_islands_by_device", sql("""
WITH r AS (SELECT inverter_id, ts, epoch(ts) / 3600 - row_number() OVER (PARTITION BY inverter_id ORDER BY ts) AS g FROM devh WHERE value > 10)
SELECT inverter_id, min(ts) AS "start", max(ts) AS "end", count(*) AS samples, count(*) * 1.0 AS nominal_hours FROM r GROUP BY inverter_id, g
""", "devh"), d="nominal_hours", i="samples")
def w04(t):
    from sunward.operators.timeline import label_runs
    return label_runs(devh(t), F.col("value") > 10, 3600, 1, ["inverter_id"])


@query("w05_cumulative_rules", sql("""
SELECT count(*) FILTER (a) AS first_rule, count(*) FILTER (a AND b) AS second_rule, count(*) FILTER (a AND b AND c) AS third_rule FROM (
  SELECT poa > 300 AS a, power < 100 AS b, n > 1 AS c FROM site5)
""", "site5"), i="first_rule second_rule third_rule")
def w05(t):
    rules = {"first_rule": F.col("poa") > 300, "second_rule": F.col("power") < 100, "third_rule": F.col("n") > 1}
    rows = mk.rule_funnel(site5(t), rules).where("step > 0")
    return rows.agg(*[F.max(F.when(F.col("stage") == n, F.col("remaining"))).alias(n) for n in rules])


@query("w06_persistent_jumps", sql("""
WITH m AS (SELECT unit, month, CASE WHEN n >= 25 THEN ratio END AS v FROM unitmonth),
g AS (SELECT unit, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM unitmonth GROUP BY unit),
x AS (SELECT g.unit, g.month, v, lag(v) OVER w AS b1, lag(v, 2) OVER w AS b2, lead(v) OVER w AS a2 FROM g LEFT JOIN m ON m.unit = g.unit AND m.month = g.month WINDOW w AS (PARTITION BY g.unit ORDER BY g.month))
SELECT unit, month AS boundary, (b1 + b2) / 2 AS level_before, (v + a2) / 2 AS level_after, (v + a2) / 2 - (b1 + b2) / 2 AS "shift" FROM x
WHERE abs((v + a2) / 2 - (b1 + b2) / 2) >= 15 AND greatest(abs(b1 - b2), abs(v - a2)) <= 40
""", "unitmonth"), d='level_before level_after "shift"', t="boundary")
def w06(t):
    return wn.persistent_jumps(unitmonth(t), "unit", "ratio", F.col("n") >= 25, 15.0, 40.0)


@query("w07_alternate_dates", """
WITH d AS (SELECT day, CASE WHEN (row_number() OVER (PARTITION BY date_trunc('month', day) ORDER BY day) - 1) % 2 = 0 THEN 'selection' ELSE 'validation' END AS split
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders))
SELECT split, year(day) AS year, count(*) AS orders FROM orders JOIN d ON CAST(o_orderdate AS DATE) = day GROUP BY 1, 2
""", i="year orders")
def w07(t):
    return wn.alternate_dates(t.orders, "o_orderdate").groupBy("split", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"))


@query("w08_peer_normalised", sql("""
SELECT unit, month, 100 * ratio / median(ratio) OVER (PARTITION BY month) AS peer_index FROM unitmonth
""", "unitmonth"), d="peer_index", covers=("W08", "R10"))
def w08(t):
    return wn.peer_normalised(unitmonth(t), "ratio", "month", "peer_index").select("unit", "month", "peer_index")


@query("w09_run_edges", sql("""
WITH r AS (SELECT ts, poa, epoch(ts) / 300 - row_number() OVER (ORDER BY ts) AS g FROM site5 WHERE power > 25)
SELECT min(ts) AS "start", max(ts) AS "end", count(*) AS samples, arg_min(poa, ts) AS first_poa, arg_max(poa, ts) AS last_poa FROM r GROUP BY g
""", "site5"), d="first_poa last_poa", i="samples")
def w09(t):
    return wn.run_edges(site5(t), "poa", F.col("power") > 25, 300)


def _tag(o):
    return f"m{-o}" if o < 0 else f"p{o}"


REACH = (-20, *OFFSETS)
_view("ramps", f"""SELECT a.ts, a.power - b.power AS electrical_change, {", ".join(f"p{i + 1}.poa - p{i}.poa AS poa_change_{_tag(o)}" for i, o in enumerate(OFFSETS))}
  FROM site5 a JOIN site5 b ON b.ts = a.ts - INTERVAL 5 MINUTE AND b.n < 9 {" ".join(f"JOIN site5 p{i} ON p{i}.ts = a.ts + to_minutes({o}) AND p{i}.poa >= 100" for i, o in enumerate(REACH))}
  WHERE a.n < 9 AND abs(a.power - b.power) >= 2""", ("site5",))


def ramps(t):
    rows = site5(t).withColumn("valid", F.col("n") < 9)
    return wn.ramp_pairs(rows, "poa", "power", "valid", OFFSETS, 2.0)


@query("w10_ramp_pairs", sql("SELECT * FROM ramps", "ramps"), d="electrical_change " + " ".join(f"poa_change_{_tag(o)}" for o in OFFSETS))
def w10(t):
    return ramps(t)


@query("w11_early_stopping", """
WITH RECURSIVE h AS (SELECT o_orderpriority AS trial, row_number() OVER (PARTITION BY o_orderpriority ORDER BY date_trunc('month', o_orderdate)) AS epoch, avg(o_totalprice) / 1000 AS err
  FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate)),
s AS (SELECT trial, 0::BIGINT AS epoch, 0::BIGINT AS selected, CAST('inf' AS DOUBLE) AS best, 0::BIGINT AS stale FROM (SELECT DISTINCT trial FROM h)
  UNION ALL SELECT h.trial, h.epoch, CASE WHEN s.best - h.err >= 2 THEN h.epoch ELSE s.selected END, CASE WHEN s.best - h.err >= 2 THEN h.err ELSE s.best END,
    CASE WHEN s.best - h.err >= 2 THEN 0 ELSE s.stale + 1 END FROM s JOIN h ON h.trial = s.trial AND h.epoch = s.epoch + 1)
SELECT trial, arg_max(selected, epoch) AS selected, arg_max(best, epoch) AS best, arg_max(stale, epoch) AS stale FROM s GROUP BY 1
""", d="best", i="selected stale")
def w11(t):
    months = t.orders.groupBy(F.col("o_orderpriority").alias("trial"), clock.month_start("o_orderdate").alias("m")).agg((F.avg("o_totalprice") / 1000).alias("err"))
    from pyspark.sql import Window as W
    months = months.withColumn("epoch", F.row_number().over(W.partitionBy("trial").orderBy("m")))
    return wn.early_stopping(months, "trial", "epoch", "err", 2.0)


@query("o01_stable_sort", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey", d="o_totalprice")
def o01(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return wn.sorted_by(rows, ["o_orderpriority", F.desc("o_totalprice")], ["o_orderkey"])


@query("o02_largest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", d="o_totalprice")
def o02(t):
    return wn.largest(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25)


@query("o02_largest_per_group", """
SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS "rank" FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3
""", d="o_totalprice", i='"rank"')
def o02b(t):
    rows = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    return wn.largest_per(rows, ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("o03_arg_extreme", """
SELECT l_suppkey, arg_max(k, (l_extendedprice, -k)) AS k, max(l_extendedprice) AS l_extendedprice FROM (SELECT l_suppkey, l_extendedprice, l_orderkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY 1
""", d="l_extendedprice", i="l_suppkey k")
def o03(t):
    rows = t.lineitem.select("l_suppkey", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return wn.arg_extreme(rows, ["l_suppkey"], "l_extendedprice", "k")


@query("o04_best_candidate", sql("""
WITH s AS (SELECT split, 'persistence' AS model, 0 AS rank, avg(abs(persistence - actual)) AS mae FROM preds GROUP BY 1 UNION ALL SELECT split, 'ridge', 1, avg(abs(ridge - actual)) FROM preds GROUP BY 1
  UNION ALL SELECT split, 'forest', 2, avg(abs(forest - actual)) FROM preds GROUP BY 1)
SELECT split, arg_min(model, (mae, rank)) AS model, arg_min(rank, (mae, rank)) AS "rank", min(mae) AS mae FROM s GROUP BY 1
""", "preds"), d="mae", i='"rank"')
def o04(t):
    scores = pf.model_scores(predictions(t), "actual", ("persistence", "ridge", "forest"), "day", ["split"])
    order = F.array_position(F.array(F.lit("persistence"), F.lit("ridge"), F.lit("forest")), F.col("model")) - 1
    return wn.best_candidate(scores.select("split", "model", order.alias("rank"), F.col("all_mae").alias("mae")), ["split"], "mae", "rank")


@query("o05_every_nth", """
SELECT event_type, event_id, value FROM events QUALIFY (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 7 = 0
""", d="value")
def o05(t):
    return wn.every_nth(t.events.select("event_type", "event_id", "value"), "event_id", 7, ["event_type"], (512, 65536))


@query("o06_histogram_mode", sql("""
SELECT flag, bin, records FROM (SELECT flag, floor(poa / 25) * 25 AS bin, count(*) AS records FROM wx GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY flag ORDER BY records DESC, bin) = 1
""", "wx"), d="bin", i="records")
def o06(t):
    return wn.histogram_mode(wx(t), ["flag"], "poa", 25.0)


@query("o07_busiest_day", sql("""
SELECT unit, day, records FROM (SELECT unit, CAST(ts AS DATE) AS day, count(*) AS records FROM stamped WHERE value > 100000 GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY unit ORDER BY records DESC, day) = 1
""", "stamped"), i="records", t="day")
def o07(t):
    return wn.busiest_day(stamped(t), F.col("value") > 100000, "ts", ["unit"])


@query("o07_middle_complete_day", sql("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT date_trunc('hour', ts)) AS n FROM site5 GROUP BY 1 HAVING count(DISTINCT date_trunc('hour', ts)) = 24),
r AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS c FROM d)
SELECT day, c AS complete_days FROM r WHERE i = c // 2
""", "site5"), i="complete_days", t="day")
def o07b(t):
    hours = site5(t).select(clock.floor_to("ts", 60).alias("ts")).distinct()
    return wn.middle_complete_day(hours, 24)
