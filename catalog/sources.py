"""Source, sink and content-check queries."""

import os
import tempfile
import uuid

from pyspark.sql import functions as F, types as T

from sunward.functions import clock
from sunward.functions.values import beside
from sunward.operators import timeline as tl
from sunward.sources import tables as src

from .registry import query
from .views import ev, pairs, sql, stamped


def scratch(spark, name):
    """A fresh path in the folder all executors share; one of this machine only where all runs in it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-sunward-")
    return os.path.join(shared, f"{name}-{uuid.uuid4().hex}")


NUMBERS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
                        T.StructField("reading", T.DoubleType())])


@query("s01_typed_csv", sql("SELECT event_type, count(*) AS records, sum(k) AS total FROM ev GROUP BY 1", "ev"),
       d="total", i="records")
def s01(t):
    lines = ev(t).select(F.concat_ws(",", F.col("event_id").cast("string"), "event_type",
                                     F.col("k").cast("string")).alias("line"))
    rows = src.parse_csv_lines(lines, "line", NUMBERS)
    return rows.groupBy("event_type").agg(F.count("*").alias("records"), F.sum("reading").alias("total"))


@query("s02_pruned_csv", "SELECT count(*) AS records, min(ts) AS \"first\", max(ts) AS \"last\" FROM (SELECT date_trunc('second', ts) AS ts FROM events)",
       i="records")
def s02(t):
    path = scratch(t.spark, "events-csv")
    stamped_text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("measured_on")
    t.events.select(stamped_text, "value", F.col("user_id").cast("double").alias("unit")).write.option("header", True).csv(path)
    rows = src.read_wide_csv(t.spark, path, ["value", "unit"], ["measured_on"])
    rows = tl.strict_parse(rows, "measured_on")
    return rows.agg(F.count("*").alias("records"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("s03_text_csv", sql("""
SELECT event_type, count(*) AS records, count(TRY_CAST(v AS DOUBLE)) AS numeric, sum(TRY_CAST(v AS DOUBLE)) AS total
FROM (SELECT event_type, CASE WHEN event_id % 50 = 1 THEN 'bad' ELSE CAST(k AS VARCHAR) END AS v FROM ev) GROUP BY 1
""", "ev"), d="total", i='records "numeric"')
def s03(t):
    path = scratch(t.spark, "texts-csv")
    ev(t).select("event_type", F.when(F.col("event_id") % 50 == 1, "bad").otherwise(F.col("k").cast("string")).alias("v")).write.option("header", True).csv(path)
    rows = src.read_text_csv(t.spark, path, ["event_type", "v"])
    return rows.groupBy("event_type").agg(F.count("*").alias("records"), F.count(src.to_number("v")).alias("numeric"),
                                          F.sum(src.to_number("v")).alias("total"))


@query("s04_json_map", sql("SELECT event_type, 'k' AS key, count(*) AS records, sum(k) AS total FROM ev GROUP BY 1", "ev"),
       d="total", i="records")
def s04(t):
    rows = src.explode_json_map(t.events, "props", ["event_type"], T.DoubleType())
    return rows.groupBy("event_type", "key").agg(F.count("*").alias("records"), F.sum("value").alias("total"))


@query("s05_projected_scan", "SELECT l_returnflag, count(*) AS records, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
       d="quantity", i="records")
def s05(t):
    rows = src.read_series(t.spark, f"{t.path}/lineitem.parquet", ["l_returnflag", "l_quantity"])
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("records"), F.sum("l_quantity").alias("quantity"))


@query("s06_filtered_scan", """SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS records, sum(o_totalprice) AS total FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1""", d="total", i="records", t="day")
def s06(t):
    window = (F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1998-01-01'")) & (
        F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1999-01-01'"))
    rows = src.read_series(t.spark, f"{t.path}/orders.parquet", ["o_orderdate", "o_totalprice"], where=window)
    return rows.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.count("*").alias("records"), F.sum("o_totalprice").alias("total"))


@query("s08_schema_only", """SELECT column_name AS name, count(*) OVER () AS columns, (SELECT count(*) FROM lineitem) AS records
FROM (DESCRIBE lineitem)""", i="columns records")
def s08(t):
    names = src.column_names(t.spark, f"{t.path}/lineitem.parquet")
    total = t.lineitem.agg(F.count("*").alias("records"))
    listed = F.array(*[F.lit(n) for n in names])
    return total.select(F.explode(listed).alias("name"), F.lit(len(names)).alias("columns"), "records")


@query("s09_row_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS records FROM {n}" for n in ("lineitem", "orders", "events", "part")), i="records")
def s09(t):
    out = None
    for n in ("lineitem", "orders", "events", "part"):
        part = getattr(t, n).agg(F.count("*").alias("records")).select(F.lit(n).alias("name"), "records")
        out = part if out is None else out.unionByName(part)
    return out


@query("s10_parquet_roundtrip", "SELECT o_orderpriority, count(*) AS records, sum(o_totalprice) AS total FROM orders GROUP BY 1",
       d="total", i="records", covers=("S10", "S13"))
def s10(t):
    path = scratch(t.spark, "orders")
    src.write_table(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), path, rows_per_file=25_000)
    rows = t.spark.read.parquet(path)
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("records"), F.sum("o_totalprice").alias("total"))


@query("s11_per_device_write", sql("SELECT inverter_id, count(*) AS records, sum(k) AS total FROM ev GROUP BY 1", "ev"),
       d="total", i="records")
def s11(t):
    path = scratch(t.spark, "devices")
    src.write_table(ev(t).select("inverter_id", "event_id", "k"), path, ["inverter_id"])
    rows = t.spark.read.parquet(path)
    return rows.groupBy("inverter_id").agg(F.count("*").alias("records"), F.sum("k").alias("total"))


@query("s12_csv_summary", "SELECT o_orderpriority, count(*) AS records, sum(o_totalprice) AS total FROM orders GROUP BY 1", d="total", i="records")
def s12(t):
    path = scratch(t.spark, "summary")
    sums = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("records"), F.sum("o_totalprice").alias("total"))
    src.write_summary(sums, path)
    return t.spark.read.schema("o_orderpriority string, records long, total double").option("header", True).csv(path)


#: The given tables, and of each the columns that both engines write alike as text.
GIVEN = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_nationkey", "c_mktsegment"], "supplier": ["s_suppkey", "s_nationkey"],
         "part": ["p_partkey", "p_brand", "p_size"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
         "events": ["event_id", "user_id", "event_type", "props"], "documents": ["doc_id", "text", "lang", "source", "n_chars"], "embeddings": [], "pages": ["page_id", "url", "html"],
         "benchmark": ["item_id", "text"], "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn", "role", "text"]}
_TABLE = r"/([a-z]+)\.parquet(/[^/]*)?$"
_COUNTS = " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS records FROM {name}" for name in GIVEN)


def _sums(h):
    return ", ".join(f"sum(CAST('0x' || substr({h}, {1 + 8 * i}, 8) AS BIGINT)) AS word{i + 1}" for i in range(4))


@query("s14_provenance", f"""
SELECT 'input' AS kind, name, '{{"records":' || records || '}}' AS content FROM ({_COUNTS})
UNION ALL SELECT 'count', event_type, '{{"event_type":"' || event_type || '","records":' || count(*) || '}}' FROM events GROUP BY event_type
UNION ALL SELECT 'settings', 'settings', '{{"cadence_minutes": 5}}' UNION ALL SELECT 'policy', 'policy', '{{"cleaning": "none"}}'
""")
def s14(t):
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("records"))
    inputs = src.manifest(t.spark, t.path).groupBy(F.regexp_extract("path", _TABLE, 1).alias("path")).agg(F.sum("records").alias("records"))
    return src.provenance(inputs, counts, {"cadence_minutes": 5}, {"cleaning": "none"})


@query("s15_manifest", _COUNTS, i="records")
def s15(t):
    """Every file of the folder, summed by table; each has to have a digest of its own."""
    files = src.manifest(t.spark, t.path)
    return files.where("length > 0 and length(digest) = 64").groupBy(F.regexp_extract("path", _TABLE, 1).alias("name")).agg(F.sum("records").alias("records"))


@query("s15_manifest_columns", " UNION ALL ".join(
    f"""SELECT '{name}' AS name, '{c}' AS "column", count(*) AS records, {_sums('h')} FROM (SELECT md5(coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')) AS h FROM {name})""" for name, columns in GIVEN.items() for c in columns),
       i="records word1 word2 word3 word4", covers=("S15", "S16"))
def s15c(t):
    """The digest tree down to columns, over all given tables."""
    nodes = src.summed(src.digest_leaves(t.spark, t.path).withColumn("name", F.regexp_extract("path", _TABLE, 1)), ["name", "column"])
    known = F.array(*[F.lit(f"{name}.{c}") for name, columns in GIVEN.items() for c in columns])
    return nodes.where(F.array_contains(known, F.concat_ws(".", "name", "column"))).select("name", "column", "records", *src.WORDS)


@query("s15_manifest_changes", """
SELECT event_type, state, count(*) AS files FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error'), (VALUES ('before'), ('after')) s(state) WHERE event_type = 'click' GROUP BY ALL
UNION ALL SELECT event_type, 'before', 1 FROM (SELECT DISTINCT event_type FROM events WHERE event_type = 'error')
""", i="files")
def s15b(t):
    """Two states of one table, a file for each event type: later, one value of the clicks differs and the errors are gone."""
    first, later = scratch(t.spark, "state"), scratch(t.spark, "state")
    events = t.events.select("event_type", "event_id", "user_id")
    last = events.where("event_type = 'click'").agg(F.max("event_id").alias("last"))
    write = lambda df, path: df.repartition("event_type").sortWithinPartitions("event_id").write.partitionBy("event_type").parquet(path)
    write(events, first)
    moved = beside(events, last).withColumn("user_id", F.when(F.col("event_id") == F.col("last"), F.col("user_id") + 1).otherwise(F.col("user_id"))).drop("last")
    write(moved.where("event_type <> 'error'"), later)
    kind = F.regexp_extract("path", "event_type=([^/]+)", 1)
    return src.manifest_changes(src.manifest(t.spark, first), src.manifest(t.spark, later), kind).groupBy(F.col("path").alias("event_type"), "state").agg(F.count_distinct("path").alias("files"))


_PARTS = "coalesce(length({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_ROW = " || ".join(_PARTS.format(c) for c in ("event_id", "user_id", "event_type", "props"))


@query("s16_fingerprint", f"""
SELECT event_type, count(*) AS records, {', '.join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS word{i + 1}" for i in range(4))}
FROM (SELECT event_type, md5({_ROW}) AS h FROM events) GROUP BY 1
""", i="records word1 word2 word3 word4")
def s16(t):
    return src.fingerprint(t.events, ["event_id", "user_id", "event_type", "props"], ["event_type"])


@query("s16_fingerprint_after", f"""
SELECT event_type, count(*) AS records, {_sums('h')} FROM (SELECT event_type, md5({_ROW}) AS h FROM events WHERE event_type <> 'view') GROUP BY 1
""", i="records word1 word2 word3 word4")
def s16b(t):
    """Views taken from the fingerprint of all rows but the clicks, and the clicks added to it."""
    of = lambda df: src.fingerprint(df, ["event_id", "user_id", "event_type", "props"], ["event_type"])
    kind = F.col("event_type")
    return src.fingerprint_after(of(t.events.where(kind != "click")), of(t.events.where(kind == "click")), of(t.events.where(kind == "view")), ["event_type"])


LEDGER = [("click", 300.0, "above channel ceiling"), ("view", 200.0, "above channel ceiling"), ("error", 330.0, "spike")]


@query("s17_literal_ledger", """
SELECT event_id, e.event_type, value, reason FROM events e JOIN (VALUES ('click', 300.0, 'above channel ceiling'),
  ('view', 200.0, 'above channel ceiling'), ('error', 330.0, 'spike')) AS l(event_type, ceiling, reason)
  ON e.event_type = l.event_type AND value > ceiling
""", d="value")
def s17(t):
    ledger = src.literal_ledger(t.spark, LEDGER, "event_type string, ceiling double, reason string")
    return (t.events.join(ledger, "event_type").where(F.col("value") > F.col("ceiling"))
            .select("event_id", "event_type", "value", "reason"))


@query("s18_time_grid", sql("""
SELECT CAST(ts AS DATE) AS day, count(*) AS slots FROM (SELECT unnest(generate_series(
  (SELECT time_bucket(INTERVAL 15 MINUTE, min(ts)) FROM stamped), (SELECT max(ts) FROM stamped), INTERVAL 15 MINUTE)) AS ts) GROUP BY 1
""", "stamped"), i="slots", t="day")
def s18(t):
    limits = stamped(t).agg(clock.floor_to(F.min("ts"), 15).alias("a"), F.max("ts").alias("z"))
    return tl.grid(limits, "a", "z", 900).groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("slots"))


@query("s19_scenario_grid", """
SELECT y.o_orderpriority, s.o_orderstatus, f.factor, count(o.o_orderkey) AS records, coalesce(sum(o.o_totalprice * f.factor), 0) AS scaled
FROM (SELECT DISTINCT o_orderpriority FROM orders) y, (VALUES ('F'), ('O'), ('P'), ('X')) s(o_orderstatus), (VALUES (0.9), (1.0), (1.1)) f(factor)
LEFT JOIN orders o ON o.o_orderpriority = y.o_orderpriority AND o.o_orderstatus = s.o_orderstatus GROUP BY 1, 2, 3
""", d="factor scaled", i="records")
def s19(t):
    base = t.orders.select("o_orderpriority").distinct()
    grid = src.scenario_grid(base, {"o_orderstatus": ["F", "O", "P", "X"], "factor": [0.9, 1.0, 1.1]})
    sums = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count("*").alias("c"), F.sum("o_totalprice").alias("s"))
    out = grid.join(sums, ["o_orderpriority", "o_orderstatus"], "left")
    return out.select("o_orderpriority", "o_orderstatus", "factor", F.coalesce("c", F.lit(0)).alias("records"),
                      F.coalesce(F.col("s") * F.col("factor"), F.lit(0.0)).alias("scaled"))


@query("s20_pending_work", """
SELECT DISTINCT o_orderpriority AS unit, date_trunc('month', o_orderdate) AS month FROM orders WHERE (o_orderpriority, date_trunc('month', o_orderdate))
NOT IN (SELECT (o_orderpriority, date_trunc('month', o_orderdate)) FROM orders WHERE o_totalprice > 480000)
""")
def s20(t):
    keyed = t.orders.select(F.col("o_orderpriority").alias("unit"), clock.month_start("o_orderdate").alias("month"), "o_totalprice")
    return src.pending(keyed.select("unit", "month").distinct(), keyed.where("o_totalprice > 480000"), ["unit", "month"])


@query("s21_select_one", sql("SELECT unit, count(*) AS n, avg(abs(measured - expected)) AS mae FROM pairs WHERE unit = 7 GROUP BY 1", "pairs"),
       d="mae", i="unit n")
def s21(t):
    from sunward.functions.errors import Pair
    p = Pair("expected", "measured")
    rows = pairs(t).groupBy("unit").agg(p.count().alias("n"), p.mae().alias("mae"))
    return src.select_one(rows, unit=7)


@query("s07_bounded_scan", "SELECT count(*) AS records, sum(l_quantity) AS quantity, min(l_shipdate) AS \"first\", max(l_shipdate) AS \"last\" FROM lineitem",
       d="quantity", i="records")
def s07(t):
    parts = t.lineitem.select("l_quantity", "l_shipdate").groupBy(F.spark_partition_id().alias("batch")).agg(
        F.count("*").alias("c"), F.sum("l_quantity").alias("q"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("z"))
    return parts.agg(F.sum("c").alias("records"), F.sum("q").alias("quantity"), F.min("a").alias("first"), F.max("z").alias("last"))
