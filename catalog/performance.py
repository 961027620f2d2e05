"""Performance-change queries."""

from pyspark.sql import functions as F

from sunward.functions import clock
from sunward.operators import learners as ml
from sunward.operators import performance as pe
from sunward.operators import windows as wn

from .registry import query
from .views import _view, sql, unitmonth, wx

YEARS = {"main": [1996, 1997, 1998, 1999, 2000], "with_first": [1995, 1996, 1997, 1998, 1999, 2000]}


@query("r01_weather_terms", sql("""
WITH s AS (SELECT status, poa / 1000 AS p, ambient / 25 AS a, wind / 5 AS w, (hour(ts) + minute(ts) / 60.0 - 12) / 6 AS h, 2 * 3.141592653589793 * dayofyear(ts) / 365.25 AS q FROM wx)
SELECT status, avg(p) AS w_p, avg(p * p) AS w_pp, avg(p * a) AS w_pa, avg(p * w) AS w_pw, avg(p * h) AS w_ph, avg(p * h * h) AS w_phh, avg(p * sin(q)) AS w_psin, avg(p * cos(q)) AS w_pcos FROM s GROUP BY 1
""", "wx"), d=" ".join(pe.WEATHER_TERMS))
def r01(t):
    rows = pe.scaled_weather(wx(t))
    rows = rows.select("status", *pe.weather_terms("s_poa", "s_ambient", "s_wind", "s_hour", "s_season"))
    return rows.groupBy("status").agg(*[F.avg(c).alias(c) for c in pe.WEATHER_TERMS])


def _reference_rows(t):
    rows = pe.scaled_weather(wx(t)).withColumn("target", F.col("poa") / 40 + F.col("ambient") / 50 - F.col("wind") / 20)
    return rows.select("*", *pe.weather_terms("s_poa", "s_ambient", "s_wind", "s_hour", "s_season"))


@query("r02_reference_regression")
def r02(t):
    rows = _reference_rows(t)
    fit, hold = pe.reference_split(1997, "target")
    model = ml.fit_model(rows.where(fit), pe.WEATHER_TERMS, "target", "ridge", {"alpha": 10.0})
    scored = model.predict(rows.where(hold), "raw").withColumn("prediction", pe.clipped("raw"))
    from sunward.functions.errors import Pair
    p = Pair("target", "prediction")
    return scored.agg(p.count().alias("validation_samples"), F.count_distinct(F.col("ts").cast("date")).alias("validation_dates"),
                      p.mae().alias("mae"), p.rmse().alias("rmse"), p.mbe().alias("bias"))


@query("r02_reference_boosted")
def r02b(t):
    rows = _reference_rows(t)
    fit, hold = pe.reference_split(1997, "target")
    columns = ("s_poa", "s_ambient", "s_wind", "s_hour", "s_season")
    model = ml.fit_model(rows.where(fit), columns, "target", "histogram", {"steps": 10, "depth": 4, "leaf": 100, "rate": 0.2})
    scored = model.predict(rows.where(hold), "raw").withColumn("prediction", pe.clipped("raw"))
    from sunward.functions.errors import Pair
    p = Pair("target", "prediction")
    return scored.agg(p.count().alias("validation_samples"), p.mae().alias("mae"), p.rmse().alias("rmse"), p.mbe().alias("bias"))


@query("r03_weather_cells", sql("""
SELECT month(ts)::VARCHAR || '|' || (hour(ts) // 3)::VARCHAR || '|' || CAST(floor(poa / 150) AS INTEGER)::VARCHAR || '|' || CAST(floor(ambient / 10) AS INTEGER)::VARCHAR AS cell, count(*) AS samples
FROM wx GROUP BY 1
""", "wx"), i="samples")
def r03(t):
    return wx(t).groupBy(pe.weather_cell("poa", "ambient", "ts").alias("cell")).agg(F.count("*").alias("samples"))


_view("cellrows", """SELECT o_orderpriority AS unit, o.outcome, year(o_orderdate) AS year, month(o_orderdate) AS month_number, month(o_orderdate)::VARCHAR || '|' || (o_custkey % 2)::VARCHAR AS cell,
  o_totalprice / 250000 AS ratio, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS zero FROM orders, (VALUES ('delivered'), ('generating')) AS o(outcome) WHERE o.outcome = 'delivered' OR o_totalprice > 60000""")


def cell_rows(t):
    from pyspark.sql.functions import array, array_compact, explode, lit, when
    tags = array_compact(array(lit("delivered"), when(F.col("o_totalprice") > 60000, lit("generating"))))
    return t.orders.select(
        F.col("o_orderpriority").alias("unit"), explode(tags).alias("outcome"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month_number"),
        F.concat_ws("|", F.month("o_orderdate").cast("string"), (F.col("o_custkey") % 2).cast("string")).alias("cell"),
        (F.col("o_totalprice") / 250000).alias("ratio"), (F.col("o_orderstatus") == "F").cast("double").alias("zero"))


def _cells_sql(body):
    period = " UNION ALL ".join(f"SELECT unit, outcome, cell, '{p}' AS period, max(n) FILTER (year = 1997) AS weight FROM cells WHERE year IN ({', '.join(map(str, y))}) AND n >= 10 GROUP BY 1, 2, 3 HAVING count(*) = {len(y)}" for p, y in YEARS.items())
    member = " OR ".join(f"(period = '{p}' AND year IN ({', '.join(map(str, y))}))" for p, y in YEARS.items())
    return f"""WITH cells AS (SELECT unit, outcome, year, cell, avg(ratio) AS ratio, avg(zero) AS zero, count(*) AS n, min(month_number) AS month_number FROM cellrows GROUP BY 1, 2, 3, 4),
support AS ({period}), used AS (SELECT cells.*, period, weight FROM cells JOIN support USING (unit, outcome, cell) WHERE {member}),
monthly AS (SELECT unit, outcome, period, year, month_number, sum(ratio * weight) / sum(weight) AS ratio, sum(zero * weight) / sum(weight) AS zero_fraction, sum(n) AS samples, count(*) AS cells FROM used GROUP BY 1, 2, 3, 4, 5),
idx AS (SELECT m.*, 100 * m.ratio / r.ref AS "index" FROM monthly m LEFT JOIN (SELECT unit, outcome, period, avg(ratio) AS ref FROM monthly WHERE year = 1997 GROUP BY 1, 2, 3) r USING (unit, outcome, period)) {body}"""


def monthly(t):
    return pe.cell_index(cell_rows(t), YEARS, 1997)


@query("r04_cell_index", sql(_cells_sql("SELECT * FROM idx"), "cellrows"), d='ratio zero_fraction "index"', i="year month_number samples cells")
def r04(t):
    return monthly(t)[0]


@query("r04_cell_support", sql(_cells_sql("SELECT unit, outcome, period, count(DISTINCT cell) AS cells, sum(n) AS retained_samples FROM used GROUP BY 1, 2, 3"), "cellrows"), i="cells retained_samples")
def r04b(t):
    return monthly(t)[1]


def slope_sql(source, value, lags=3, unit_count=24, origin=1998, group="'all'", name="fit", rounds=60, zero=None):
    """Alternating projections: unit and calendar-month means are taken off in turn until nothing is left of them; a further column is taken off what remains."""
    if zero:
        return _slope_with_zero_sql(source, value, lags, unit_count, origin, group, name, rounds, zero)
    weights = " + ".join(f"2 * (1 - {l} / {lags + 1}.0) * coalesce(sum(s * lag{l}), 0)" for l in range(1, lags + 1))
    # as many quantiles as there can be months in the given tables, and more
    crit = ", ".join(f"({n}, {pe.t_quantile(0.975, n)!r})" for n in range(1, 400))
    return f"""WITH RECURSIVE a AS (SELECT {group} AS g, unit, month, {value} AS y, (year(month) - {origin}) + (month(month) - 1) / 12.0::DOUBLE AS t FROM {source} WHERE {value} IS NOT NULL),
p AS (SELECT 0 AS round, g, unit, month, t, y FROM a UNION ALL
  SELECT round + 1, g, unit, month, t - avg(t) OVER (PARTITION BY g, month(month)), y - avg(y) OVER (PARTITION BY g, month(month)) FROM (
    SELECT round, g, unit, month, t - avg(t) OVER (PARTITION BY g, unit) AS t, y - avg(y) OVER (PARTITION BY g, unit) AS y FROM p WHERE round < {rounds}) AS half),
b AS (SELECT g, unit, month, t AS td, y AS yd FROM p WHERE round = {rounds}),
f AS (SELECT g, sum(td * yd) / sum(td * td) AS slope, sum(td * td) AS q, count(*) AS observations, count(DISTINCT unit) AS units, count(DISTINCT month(month)) AS months12 FROM b GROUP BY 1),
s AS (SELECT b.g, month, sum(td * (yd - slope * td)) AS s FROM b JOIN f ON f.g = b.g GROUP BY 1, 2),
l AS (SELECT g, s, {", ".join(f"lag(s, {l}) OVER (PARTITION BY g ORDER BY month) AS lag{l}" for l in range(1, lags + 1))} FROM s),
m AS (SELECT g, sum(s * s) + {weights} AS meat, count(*) AS months FROM l GROUP BY 1)
SELECT f.g AS {name}, slope, slope - crit * sqrt(greatest(meat, 0)) / q AS "lower", slope + crit * sqrt(greatest(meat, 0)) / q AS "upper", months, observations,
  units + months12 AS "rank", units + 12 AS parameters FROM f JOIN m ON m.g = f.g JOIN (VALUES {crit}) AS c(n, crit) ON c.n = greatest(1, months - (units + 12) // {unit_count} - 2)"""


def _slope_with_zero_sql(source, value, lags, unit_count, origin, group, name, rounds, zero):
    plain = slope_sql(source, value, lags, unit_count, origin, group, name, rounds)
    plain = plain.replace("AS t FROM", f"AS t, {zero}::DOUBLE AS z FROM").replace("month, t, y FROM a", "month, t, y, z FROM a")
    for part in ("month(month)", "unit"):
        plain = plain.replace(f"y - avg(y) OVER (PARTITION BY g, {part})", f"y - avg(y) OVER (PARTITION BY g, {part}) AS y, z - avg(z) OVER (PARTITION BY g, {part})")
    plain = plain.replace("(PARTITION BY g, month(month)) FROM", "(PARTITION BY g, month(month)) AS z FROM").replace("z - avg(z) OVER (PARTITION BY g, unit) AS y FROM", "z - avg(z) OVER (PARTITION BY g, unit) AS z FROM")
    less = "b0.{0} - k.{0}z / k.zz * b0.z"
    rest = f"b AS (SELECT b0.g, unit, month, {less.format('t')} AS td, {less.format('y')} AS yd FROM b0 JOIN (SELECT g, sum(t * z) AS tz, sum(y * z) AS yz, sum(z * z) AS zz FROM b0 GROUP BY g) k ON k.g = b0.g)"
    plain = plain.replace(f"b AS (SELECT g, unit, month, t AS td, y AS yd FROM p WHERE round = {rounds})", f"b0 AS (SELECT g, unit, month, t, y, z FROM p WHERE round = {rounds}),\n{rest}")
    return plain.replace("units + months12", "units + months12 + 1").replace("units + 12", "units + 13")


SL = dict(d='slope "lower" "upper"', i='months observations "rank" parameters')


def slope_input(t):
    return unitmonth(t).withColumn("index", F.col("ratio"))


@query("r05_slope_fit", sql(f"SELECT * FROM ({slope_sql('unitmonth', 'ratio')})", "unitmonth"), **SL)
def r05(t):
    return pe.fit_slopes(slope_input(t), origin_year=1998)


def _jumps(t):
    return wn.persistent_jumps(unitmonth(t), "unit", "ratio", F.col("n") >= 25, 15.0, 40.0)


JUMPSQL = """jm AS (WITH m AS (SELECT unit, month, CASE WHEN n >= 25 THEN ratio END AS v FROM unitmonth), g AS (SELECT unit, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM unitmonth GROUP BY unit),
x AS (SELECT g.unit, g.month, v, lag(v) OVER w AS b1, lag(v, 2) OVER w AS b2, lead(v) OVER w AS a2 FROM g LEFT JOIN m ON m.unit = g.unit AND m.month = g.month WINDOW w AS (PARTITION BY g.unit ORDER BY g.month))
SELECT unit, month AS boundary FROM x WHERE abs((v + a2) / 2 - (b1 + b2) / 2) >= 15 AND greatest(abs(b1 - b2), abs(v - a2)) <= 40)"""


@query("r06_regime_flags", sql(f"WITH {JUMPSQL} SELECT u.unit, u.month, count(jm.boundary) AS regime FROM unitmonth u LEFT JOIN jm ON jm.unit = u.unit AND u.month >= jm.boundary GROUP BY 1, 2", "unitmonth"), i="regime")
def r06(t):
    return pe.regime_flags(unitmonth(t).select("unit", "month"), _jumps(t))


@query("r06_slope_with_regimes", sql("SELECT * FROM (" + slope_sql(f"""(WITH {JUMPSQL} SELECT u.unit || '|' || count(jm.boundary) AS unit, u.month, u.ratio FROM unitmonth u LEFT JOIN jm ON jm.unit = u.unit AND u.month >= jm.boundary GROUP BY u.unit, u.month, u.ratio)""", "ratio") + ")", "unitmonth"), **SL)
def r06b(t):
    return pe.fit_slopes(slope_input(t), jumps=_jumps(t), origin_year=1998)


_view("statusmonth", """SELECT o_orderstatus AS status, o_orderpriority AS unit, date_trunc('month', o_orderdate) AS month, avg(o_totalprice) / 1000 AS ratio, avg(o_custkey % 7) AS zero_fraction
  FROM orders GROUP BY 1, 2, 3""")


def statusmonth(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("unit"), clock.month_start("o_orderdate").alias("month")).agg(
        (F.avg("o_totalprice") / 1000).alias("index"), F.avg(F.col("o_custkey") % 7).alias("zero_fraction"))


def _grid_sql():
    parts = []
    for p, c in (("all", "true"), ("to_1999", "year(month) <= 1999"), ("from_1997", "year(month) >= 1997")):
        for treatment, zero in (("raw", None), ("zeros", "zero_fraction")):
            parts.append(f"SELECT *, '{treatment}' AS treatment, '{p}' AS period FROM ({slope_sql(f'(SELECT * FROM statusmonth WHERE {c})', 'ratio', group='status', name='status', zero=zero)})")
    return " UNION ALL ".join(parts)


@query("r07_slope_grid", sql(_grid_sql(), "statusmonth"), **SL)
def r07(t):
    periods = {"all": F.lit(True), "to_1999": F.year("month") <= 1999, "from_1997": F.year("month") >= 1997}
    return pe.slope_grid(statusmonth(t), {"raw": {}, "zeros": {"zeros": True}}, periods, "status", origin_year=1998)


@query("r07_slope_with_zeros", sql("SELECT * FROM (" + slope_sql("statusmonth", "ratio", group="status", name="status", zero="zero_fraction") + ")", "statusmonth"), **SL)
def r07b(t):
    return pe.fit_slopes(statusmonth(t), "status", zeros=True, origin_year=1998)


@query("r07_unit_slopes", sql("SELECT * FROM (" + slope_sql("(SELECT unit AS fit_unit, 'one' AS unit, month, 100 * ratio / median(ratio) OVER (PARTITION BY month) AS v FROM unitmonth)", "v", group="fit_unit", name="fit_unit") + ")", "unitmonth"), **SL)
def r07c(t):
    """Each unit's own slope, after peer normalisation."""
    peers = wn.peer_normalised(unitmonth(t), "ratio", "month", "index").withColumn("fit_unit", F.col("unit")).withColumn("unit", F.lit("one"))
    return pe.fit_slopes(peers, "fit_unit", origin_year=1998)


TQ = ", ".join(f"({n}, {pe.t_quantile(0.975, n - 1)!r})" for n in range(2, 13))


@query("r08_annual_index", sql(_cells_sql(f"""
, site AS (SELECT outcome, period, year, month_number, avg("index") AS v, avg(zero_fraction) AS z FROM idx GROUP BY 1, 2, 3, 4),
j AS (SELECT a.*, a.v - b.v AS d FROM site a LEFT JOIN site b ON b.outcome = a.outcome AND b.period = a.period AND b.month_number = a.month_number AND b.year = 1997)
SELECT outcome, period, year, months, 100 + change AS "index", change, change - q * s / sqrt(n) AS "lower", change + q * s / sqrt(n) AS "upper", zero_fraction FROM (
  SELECT outcome, period, year, count(*) AS months, count(d) AS n, avg(d) AS change, stddev_samp(d) AS s, avg(z) AS zero_fraction FROM j GROUP BY 1, 2, 3)
LEFT JOIN (VALUES {TQ}) AS tq(k, q) ON k = n"""), "cellrows"), d='"index" change "lower" "upper" zero_fraction', i="year months")
def r08(t):
    return pe.annual_index(monthly(t)[0], 1997, ["outcome", "period"])


@query("r09_plant_index", sql(_cells_sql("""
, p AS (SELECT outcome, period, year, month_number, avg(ratio) AS ratio, avg(zero_fraction) AS zero_fraction FROM monthly GROUP BY 1, 2, 3, 4)
SELECT p.*, 100 * p.ratio / r.ref AS "index" FROM p LEFT JOIN (SELECT outcome, period, avg(ratio) AS ref FROM p WHERE year = 1997 GROUP BY 1, 2) r USING (outcome, period)"""), "cellrows"),
       d='ratio zero_fraction "index"', i="year month_number")
def r09(t):
    return pe.plant_index(monthly(t)[0], 1997, ["outcome", "period"])
