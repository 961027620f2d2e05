"""Telemetry-shaped views of the given tables, in Spark and in SQL.

Every Spark view has a same-named entry in ``SQL``; ``sql(...)`` prefixes a
query with the views it needs.
"""

from pyspark import StorageLevel
from pyspark.sql import functions as F

from sunward.functions import clock

SQL = {}
NEEDS = {}


def _view(name, text, needs=()):
    SQL[name], NEEDS[name] = text, needs


def sql(body: str, *names) -> str:
    """``WITH`` clause for the named views and what they depend on, then the body."""
    order = []

    def visit(n):
        for dep in NEEDS[n]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if order else body
    return f"WITH {head}\n{body}" if order else body


def once(df):
    """Keep a derived stand-in that several passes of one query read.

    Real readings come straight from a scan; these are computed from the
    order book first, and exact quantiles read their input more than once.
    """
    return df.persist(StorageLevel.DISK_ONLY)


_view("ev", """SELECT event_id, ts, user_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  'inv_' || lpad(CAST(user_id % 24 + 1 AS VARCHAR), 2, '0') AS inverter_id FROM events""")


def ev(t):
    """Raw events with the numeric payload and a 24-unit device id."""
    unit = F.lpad((F.col("user_id") % 24 + 1).cast("string"), 2, "0")
    return t.events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.concat(F.lit("inv_"), unit).alias("inverter_id"))


_view("site5", """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS ts, avg(value) AS power,
  avg(k) * 10 AS poa, count(*) AS n FROM ev GROUP BY 1""", ("ev",))


def site5(t):
    """5-minute site series: power and irradiance stand-in; absent slots stay absent."""
    return (ev(t).groupBy(clock.floor_to("ts", 5).alias("ts"))
            .agg(F.avg("value").alias("power"), (F.avg("k") * 10).alias("poa"), F.count("*").alias("n")))


_view("env15", """SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS ambient,
  avg(k) / 10 AS wind FROM ev WHERE event_type = 'view' GROUP BY 1""", ("ev",))


def env15(t):
    """15-minute weather stand-in."""
    return (ev(t).where(F.col("event_type") == "view").groupBy(clock.floor_to("ts", 15).alias("ts"))
            .agg(F.avg("value").alias("ambient"), (F.avg("k") / 10).alias("wind")))


_view("meter15", """SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS meter
  FROM ev WHERE event_type = 'purchase' GROUP BY 1""", ("ev",))


def meter15(t):
    """15-minute meter stand-in."""
    return (ev(t).where(F.col("event_type") == "purchase").groupBy(clock.floor_to("ts", 15).alias("ts"))
            .agg(F.avg("value").alias("meter")))


_view("devh", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, inverter_id, avg(value) AS value,
  avg(k) AS k, count(*) AS n FROM ev GROUP BY 1, 2""", ("ev",))


def devh(t):
    """Hourly device readings of 24 units, many missing."""
    return (ev(t).groupBy(clock.floor_to("ts", 60).alias("ts"), "inverter_id")
            .agg(F.avg("value").alias("value"), F.avg("k").alias("k"), F.count("*").alias("n")))


_view("fleeth", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, event_type AS inverter_id,
  avg(value) AS value, avg(k) AS k FROM ev GROUP BY 1, 2""", ("ev",))

# The five event types, used as a five-unit roster.
ROSTER = ("click", "error", "purchase", "signup", "view")


def fleeth(t):
    """Hourly readings of a five-unit fleet."""
    return (ev(t).groupBy(clock.floor_to("ts", 60).alias("ts"), F.col("event_type").alias("inverter_id"))
            .agg(F.avg("value").alias("value"), F.avg("k").alias("k")))


_view("pairs", """SELECT l_orderkey, l_linenumber, l_suppkey AS unit, l_shipdate AS ts, l_returnflag AS flag,
  l_linestatus AS status, l_discount AS discount,
  l_quantity * p_retailprice AS expected, l_extendedprice AS measured
  FROM lineitem JOIN part ON l_partkey = p_partkey""")


def pairs(t):
    """Expected/measured pairs per unit; join strategy is left to size statistics."""
    return (t.lineitem.join(t.part.select("p_partkey", "p_retailprice"),
                            F.col("l_partkey") == F.col("p_partkey"))
            .select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("unit"),
                    F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("flag"),
                    F.col("l_linestatus").alias("status"), F.col("l_discount").alias("discount"),
                    (F.col("l_quantity") * F.col("p_retailprice")).alias("expected"),
                    F.col("l_extendedprice").alias("measured")))


_view("wx", """SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice / 100 AS poa, l_quantity AS ambient,
  l_discount * 100 AS wind, l_tax AS tax, l_returnflag AS flag, l_linestatus AS status,
  l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) + to_minutes(CAST(l_partkey % 12 * 5 AS INTEGER)) AS ts
  FROM lineitem""")


def wx(t):
    """Weather rows: irradiance 9-1050, ambient 1-50, wind 0-10, spread over the clock."""
    zero = F.lit(0)
    moved = F.make_dt_interval(zero, (F.col("l_orderkey") % 24).cast("int"),
                               (F.col("l_partkey") % 12 * 5).cast("int"), zero.cast("decimal(18,6)"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_extendedprice") / 100).alias("poa"),
        F.col("l_quantity").alias("ambient"), (F.col("l_discount") * 100).alias("wind"),
        F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"), (F.col("l_shipdate") + moved).alias("ts"))


_view("stamped", """SELECT o_orderkey, o_custkey, o_totalprice AS value, o_orderpriority AS unit, o_orderstatus AS status,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(CAST(o_custkey % 12 * 5 AS INTEGER)) AS ts
  FROM orders""")


def stamped(t):
    """Orders spread over the hours of their day: seven years of wall-clock labels."""
    zero = F.lit(0)
    moved = F.make_dt_interval(zero, (F.col("o_orderkey") % 24).cast("int"),
                               (F.col("o_custkey") % 12 * 5).cast("int"), zero.cast("decimal(18,6)"))
    return t.orders.select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("unit"),
        F.col("o_orderstatus").alias("status"), (F.col("o_orderdate") + moved).alias("ts"))


_view("slots15", """SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS value, count(*) AS n
  FROM stamped GROUP BY 1""", ("stamped",))


def slots15(t):
    """Multi-year 15-minute series with gaps."""
    return (stamped(t).groupBy(clock.floor_to("ts", 15).alias("ts"))
            .agg(F.avg("value").alias("value"), F.count("*").alias("n")))


_view("unitmonth", """SELECT o_orderpriority AS unit, date_trunc('month', o_orderdate) AS month, year(o_orderdate) AS year,
  avg(o_totalprice) / 1000 AS ratio, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS zero_fraction,
  count(*) AS n FROM orders GROUP BY 1, 2, 3""")


def unitmonth(t):
    """Unit x month index stand-in (five units, about eighty months)."""
    return (t.orders.groupBy(F.col("o_orderpriority").alias("unit"), clock.month_start("o_orderdate").alias("month"),
                             F.year("o_orderdate").alias("year"))
            .agg((F.avg("o_totalprice") / 1000).alias("ratio"),
                 F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("zero_fraction"),
                 F.count("*").alias("n")))
