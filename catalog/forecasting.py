"""Split, feature, model and evaluation queries."""

from pyspark.sql import functions as F

from sunward.functions import clock, solar
from sunward.functions.errors import Pair
from sunward.functions.values import beside
from sunward.operators import boosting
from sunward.operators import evaluation as ev_
from sunward.operators import features as ft
from sunward.operators import learners as ml
from sunward.operators import masks as mk
from sunward.operators import profiles as pf

from .physics import SITE, geometry_view, labelled
from .profiles import MODELS, predictions, score_sql
from .registry import query
from .sources import scratch
from .views import _view, env15, once, site5, sql, stamped, slots15

_view("edges", """SELECT a AS "start", to_timestamp(ceil((epoch(a) + (epoch(z) - epoch(a)) * 0.7) / 300) * 300)::TIMESTAMP AS vstart,
  to_timestamp(ceil((epoch(a) + (epoch(z) - epoch(a)) * 0.85) / 300) * 300)::TIMESTAMP AS tstart, z + INTERVAL 5 MINUTE AS fin FROM (
  SELECT min(ts) + INTERVAL 15 MINUTE AS a, max(ts) + INTERVAL 15 MINUTE AS z FROM site5)""", ("site5",))
_view("origins", """SELECT s.*, s.ts + INTERVAL 15 MINUTE AS target_ts, CASE WHEN s.ts + INTERVAL 15 MINUTE < vstart THEN 'training' WHEN s.ts + INTERVAL 15 MINUTE < tstart THEN 'validation' ELSE 'testing' END AS split
  FROM site5 s, edges""", ("site5", "edges"))


def origins(t):
    return site5(t).withColumn("target_ts", clock.shift("ts", 15))


def edges(t):
    return ft.split_edges(origins(t))


@query("m01_chronological_split", sql("SELECT split, count(*) AS rows, min(target_ts) AS first_target, max(target_ts) AS last_target FROM origins GROUP BY 1", "origins"), i='"rows"')
def m01(t):
    rows = ft.label_splits(origins(t), edges(t))
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.min("target_ts").alias("first_target"), F.max("target_ts").alias("last_target"))


_view("blocks", """SELECT i AS block, to_timestamp(ceil((epoch("start") + (epoch(vstart) - epoch("start")) * lo) / 300) * 300)::TIMESTAMP AS cutoff,
  CASE WHEN i = 3 THEN vstart ELSE to_timestamp(ceil((epoch("start") + (epoch(vstart) - epoch("start")) * hi) / 300) * 300)::TIMESTAMP END AS block_end
  FROM edges, (VALUES (1, 0.4, 0.6), (2, 0.6, 0.8), (3, 0.8, 1.0)) AS v(i, lo, hi)""", ("edges",))


@query("m02_training_blocks", sql("""
SELECT block, cutoff, block_end, count(*) AS issued, (SELECT count(*) FROM origins o WHERE o.target_ts < cutoff) AS fitted FROM blocks JOIN origins ON target_ts >= cutoff AND target_ts < block_end GROUP BY 1, 2, 3
""", "origins", "blocks"), i="block issued fitted")
def m02(t):
    blocks = ft.training_blocks(edges(t))
    rows = ft.assign_blocks(origins(t), blocks).where("block is not null")
    issued = rows.groupBy("block", "cutoff", "block_end").agg(F.count("*").alias("issued"))
    # Rows per block accumulate: each block is fitted on everything before its cutoff.
    before = origins(t).join(F.broadcast(blocks.select("block", "cutoff")), F.col("target_ts") < F.col("cutoff"))
    return issued.join(before.groupBy("block").agg(F.count("*").alias("fitted")), "block")


@query("m03_year_splits", sql("""
SELECT CASE WHEN year(ts) IN (1995, 1996, 1997) THEN 1 WHEN year(ts) = 1998 THEN 2 WHEN year(ts) IN (1999, 2000) THEN 3 ELSE 0 END AS split, count(*) AS rows FROM stamped GROUP BY 1
""", "stamped"), i='split "rows"')
def m03(t):
    return stamped(t).groupBy(ft.year_split("ts", [1995, 1996, 1997], [1998], [1999, 2000]).alias("split")).agg(F.count("*").alias("rows"))


_view("asof5", """SELECT g.ts, CASE WHEN e.ts >= g.ts - INTERVAL 30 MINUTE THEN e.ambient END AS ambient, CASE WHEN e.ts >= g.ts - INTERVAL 30 MINUTE THEN e.wind END AS wind FROM (
  SELECT ts, ts - INTERVAL 15 MINUTE AS lim FROM (SELECT unnest(generate_series((SELECT min(ts) FROM site5) - INTERVAL 2 HOUR, (SELECT max(ts) FROM site5), INTERVAL 5 MINUTE)) AS ts)) g ASOF LEFT JOIN env15 e ON g.lim >= e.ts""", ("site5", "env15"))


def _lag_sql():
    cols = ", ".join(f"p{x}.poa AS poa_lag{x}, e{x}.ambient AS ambient_lag{x}, e{x}.wind AS wind_lag{x}" for x in ft.LAGS)
    joins = " ".join(f"LEFT JOIN site5 p{x} ON p{x}.ts = o.ts - INTERVAL {x} MINUTE LEFT JOIN asof5 e{x} ON e{x}.ts = o.ts - INTERVAL {x} MINUTE" for x in ft.LAGS)
    return f"SELECT o.ts, {cols} FROM site5 o {joins}"


LAGCOLS = [f"{n}_lag{x}" for n in ("poa", "ambient", "wind") for x in ft.LAGS]


@query("m04_lag_features", sql(_lag_sql(), "site5", "asof5"), d=" ".join(LAGCOLS))
def m04(t):
    return ft.lag_features(site5(t), site5(t), "poa", env15(t), ["ambient", "wind"])


_view("geo5", geometry_view("geo5", "site5"), ("site5",))
OF = ["ac_kw_lag0", "ac_kw_lag5", "ac_kw_lag15", "ac_kw_lag30", "poa_lag0", "poa_lag5", "poa_lag15", "poa_lag30", "ac_kw_change5", "ac_kw_change15", "ac_kw_change30",
      "poa_change5", "poa_change15", "poa_change30", "ambient", "wind", "zero_unit_fraction", "hour_sin", "hour_cos", "season_sin", "season_cos", "origin_elevation"]


def plant_rows(t):
    return solar.elevation(site5(t), SITE, "elevation").withColumn("zero_fraction", F.col("n") / 10.0)


def origin_rows(t):
    return ft.origin_features(plant_rows(t), "power", site5(t), "poa", env15(t), ["ambient", "wind"], "elevation", "zero_fraction")


_view("feats", """SELECT o.ts, o.power AS ac_kw_lag0, a.power AS ac_kw_lag5, b.power AS ac_kw_lag15, c.power AS ac_kw_lag30, o.poa AS poa_lag0, a.poa AS poa_lag5, b.poa AS poa_lag15, c.poa AS poa_lag30,
  o.power - a.power AS ac_kw_change5, o.power - b.power AS ac_kw_change15, o.power - c.power AS ac_kw_change30, o.poa - a.poa AS poa_change5, o.poa - b.poa AS poa_change15, o.poa - c.poa AS poa_change30,
  e.ambient, e.wind, o.n / 10.0 AS zero_unit_fraction, sin(2 * pi() * (hour(o.ts) + minute(o.ts) / 60.0) / 24) AS hour_sin, cos(2 * pi() * (hour(o.ts) + minute(o.ts) / 60.0) / 24) AS hour_cos,
  sin(2 * pi() * (dayofyear(o.ts) - 1) / 365.25) AS season_sin, cos(2 * pi() * (dayofyear(o.ts) - 1) / 365.25) AS season_cos, g.elevation AS origin_elevation
  FROM site5 o LEFT JOIN site5 a ON a.ts = o.ts - INTERVAL 5 MINUTE LEFT JOIN site5 b ON b.ts = o.ts - INTERVAL 15 MINUTE LEFT JOIN site5 c ON c.ts = o.ts - INTERVAL 30 MINUTE
  LEFT JOIN asof5 e ON e.ts = o.ts LEFT JOIN geo5 g ON g.ts = o.ts""", ("site5", "asof5", "geo5"))


@query("m05_origin_features", sql("SELECT * FROM feats", "feats"), d=" ".join(OF))
def m05(t):
    return origin_rows(t)


@query("m06_exact_targets", sql("""
SELECT o.ts, o.ts + INTERVAL 15 MINUTE AS target_ts, s.poa, e.ambient, e.wind FROM site5 o LEFT JOIN site5 s ON s.ts = o.ts + INTERVAL 15 MINUTE LEFT JOIN env15 e ON e.ts = o.ts + INTERVAL 15 MINUTE
""", "site5", "env15"), d="poa ambient wind")
def m06(t):
    e = env15(t)
    return ft.exact_targets(site5(t), {"poa": (site5(t), "poa"), "ambient": (e, "ambient"), "wind": (e, "wind")})


_view("examples", """SELECT l.*, a.power AS origin_power_kw, a.power - b.power AS power_change_15_kw, CASE WHEN p.n <> 4 THEN p.poa END AS origin_poa FROM labels_ l
  LEFT JOIN site5 a ON a.ts = l.origin AND a.n <> 5 LEFT JOIN site5 b ON b.ts = l.origin - INTERVAL 15 MINUTE AND b.n <> 5 LEFT JOIN site5 p ON p.ts = l.origin""", ("labels_", "site5"))
EXOK = "physics IS NOT NULL AND actual IS NOT NULL"


def example_rows(t):
    poa = site5(t).select("ts", F.when(F.col("n") != 4, F.col("poa")).alias("poa"))
    return ft.correction_features(labelled(t), site5(t).where("n <> 5"), "power", poa, "poa")


@query("m07_correction_features", sql("""
SELECT origin, forecast_poa, forecast_ambient, forecast_wind, physics AS physics_forecast_kw, origin_power_kw, origin_poa, power_change_15_kw FROM examples
""", "examples"), d=" ".join(ft.CORRECTION_FEATURES))
def m07(t):
    return ft.check_horizon(example_rows(t)).select("origin", *ft.CORRECTION_FEATURES)


@query("m07_example_funnel", sql(f"""
SELECT count(*) AS saved_rows, count(*) FILTER (NOT ({EXOK})) AS missing_label_or_physics, 0 AS invalid_forecast_inputs, count(*) FILTER ({EXOK} AND origin_power_kw IS NULL) AS missing_current_power,
  count(*) FILTER ({EXOK} AND origin_power_kw IS NOT NULL AND origin_poa IS NULL) AS missing_current_poa, count(*) FILTER ({EXOK} AND origin_power_kw IS NOT NULL AND origin_poa IS NOT NULL) AS eligible,
  count(*) FILTER ({EXOK} AND origin_power_kw IS NOT NULL AND origin_poa IS NOT NULL AND power_change_15_kw IS NULL) AS older_power_missing_retained FROM examples
""", "examples"), i="saved_rows missing_label_or_physics invalid_forecast_inputs missing_current_power missing_current_poa eligible older_power_missing_retained", covers=("M07", "P10"))
def m07b(t):
    return ft.eligible_examples(example_rows(t))[1]


COLS = ("ac_kw_lag0", "ac_kw_lag15", "poa_lag0", "poa_lag15", "ambient", "wind")


def split_features(t):
    rows = origin_rows(t).withColumn("target_ts", clock.shift("ts", 15))
    return ft.label_splits(rows, edges(t))


_view("trainmed", f"SELECT {', '.join(f'coalesce(median({c}), 0) AS {c}_m' for c in COLS)} FROM feats JOIN origins USING (ts) WHERE split = 'training'", ("feats", "origins"))


@query("m08_imputation", sql(f"""
SELECT ts, {', '.join(f'coalesce({c}, {c}_m) AS {c}, CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END AS {c}__missing' for c in COLS)} FROM feats, trainmed
""", "feats", "trainmed"), d=" ".join(f"{c} {c}__missing" for c in COLS))
def m08(t):
    rows = split_features(t).select("ts", "split", *COLS)
    medians = ml.training_medians(rows.where("split = 'training'"), COLS)
    return ml.impute(rows.select("ts", *COLS), medians, COLS)


@query("m09_standardisation", sql(f"""
WITH s AS (SELECT {', '.join(f'avg(coalesce({c}, {c}_m)) AS {c}_a, stddev_pop(coalesce({c}, {c}_m)) AS {c}_s' for c in COLS)} FROM feats JOIN origins USING (ts), trainmed WHERE split = 'training')
SELECT ts, {', '.join(f'(coalesce({c}, {c}_m) - {c}_a) / {c}_s AS {c}' for c in COLS)} FROM feats, trainmed, s
""", "feats", "trainmed", "origins"), d=" ".join(COLS))
def m09(t):
    rows = split_features(t).select("ts", "split", *COLS)
    train = rows.where("split = 'training'")
    medians = ml.training_medians(train, COLS)
    scales = ml.scaling(ml.impute(train, medians, COLS), COLS)
    return ml.standardise(ml.impute(rows.select("ts", *COLS), medians, COLS), scales, COLS).select("ts", *COLS)


@query("m10_ridge", """
WITH s AS (SELECT sum((l_quantity - mx) * (l_extendedprice / 1000 - my)) / (sum((l_quantity - mx) * (l_quantity - mx)) + 5000.0) AS b, max(mx) AS mx, max(my) AS my FROM lineitem,
  (SELECT avg(l_quantity) AS mx, avg(l_extendedprice / 1000) AS my FROM lineitem))
SELECT l_returnflag, count(*) AS n, avg(my + b * (l_quantity - mx)) AS prediction, max(my + b * (l_quantity - mx)) AS highest FROM lineitem, s GROUP BY 1
""", d="prediction highest", i="n")
def m10(t):
    from pyspark.ml.feature import VectorAssembler
    rows = t.lineitem.select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    ready = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(rows)
    model = ml.fit_ridge(ready, "y", 5000.0)
    return model.transform(ready).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("prediction").alias("prediction"), F.max("prediction").alias("highest"))


def training_table(t):
    """Origin features with the exact power target and split, evaluated once per query.

    The two series are kept, so splits, features and targets read them and not the readings again.
    """
    for series in (site5(t), env15(t)):
        once(series)
    later = site5(t).select(clock.shift("ts", -15).alias("ts"), F.col("power").alias("target"))
    return split_features(t).join(later, "ts", "left").select("ts", "target_ts", "split", "target", *COLS).cache()


def _scored(t, family, config):
    rows = training_table(t)
    model = ml.fit_model(rows.where("split = 'training'"), COLS, "target", family, config)
    scored = model.predict(rows.where("split = 'validation'"), "prediction")
    p = Pair("target", "prediction")
    return scored.agg(p.count().alias("n"), p.mae().alias("mae"), p.rmse().alias("rmse"), p.mbe().alias("bias"))


@query("m11_forest")
def m11(t):
    return _scored(t, "forest", {"trees": 10, "depth": 6, "leaf": 5})


@query("m12_boosted")
def m12(t):
    """Both boosted families: depth-wise trees of Spark ML, and second-order trees grown best leaf first with a leaf cap and an L2 penalty."""
    rows = training_table(t)
    train, valid, p = rows.where("split = 'training'"), rows.where("split = 'validation'"), Pair("target", "prediction")
    first = ml.fit_model(train, COLS, "target", "histogram", {"steps": 5, "depth": 3, "leaf": 20, "rate": 0.2}).predict(valid, "prediction")
    second = boosting.fit_boosted(train, COLS, "target", steps=5, rate=0.2, leaves=8, l2=1.0, least=20).predict(valid)
    scores = [df.agg(p.count().alias("n"), p.mae().alias("mae"), p.rmse().alias("rmse"), p.mbe().alias("bias")).withColumn("family", F.lit(name)) for name, df in (("depth_wise", first), ("best_leaf_first", second))]
    return scores[0].unionByName(scores[1])


PLAN = [("ridge", {"alpha": 0.1}), ("ridge", {"alpha": 1000.0}), ("forest", {"trees": 5, "depth": 4, "leaf": 5})]


@query("m13_model_selection", covers=("M13", "S20", "A34"))
def m13(t):
    rows = training_table(t)
    train = F.col("split") == "training"
    blocks = ft.training_blocks(edges(t)).orderBy("block").collect()  # three cutoffs
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    folds = [(str(b.block), train & (F.col("target_ts") < at(b.cutoff)), train & (F.col("target_ts") >= at(b.cutoff)) & (F.col("target_ts") < at(b.block_end))) for b in blocks]
    ledger = ml.Ledger(t.spark, scratch(t.spark, "folds"), ml.FOLD, ("fold", "family", "config"))
    score = lambda plan: ml.select_models(rows, COLS, "target", "ac_kw_lag0", folds, plan, lambda c: mk.constrained(c, "wind", F.lit(1.0)), ledger)
    score(PLAN[:1])  # as if interrupted here
    ledger = score(PLAN)
    return pf.pooled_folds(ledger, ["family", "config"])


@query("m14_forecast_block", covers=("M14", "P13"))
def m14(t):
    rows = training_table(t)
    out = ml.forecast_block(rows, COLS, "target", "ridge", {"alpha": 10.0}, F.col("split") == "training", F.col("split") == "validation", "forecast",
                            lambda c: mk.constrained(c, "wind", F.lit(1.0)))
    return out.agg(F.count("*").alias("issued"), F.count("target").alias("with_label"), F.count("forecast").alias("forecast"), F.min("forecast").alias("lowest"))


def _plan_sql():
    def grid(family, space):
        base = "|".join(f"{n}={ml.BASELINES[family][n]}" for n in space)
        text = " || '|' || ".join(f"'{n}=' || {n}" for n in space)
        src = ", ".join(f"(VALUES {', '.join(f'({chr(39)}{v}{chr(39)})' for v in vs)}) AS v_{n}({n})" for n, vs in space.items())
        all_ = f"(SELECT {text} AS config FROM {src})"
        return (f"SELECT '{family}' AS family, config, true AS baseline FROM {all_} WHERE config = '{base}' UNION ALL "
                f"SELECT * FROM (SELECT '{family}', config, false FROM {all_} WHERE config <> '{base}' ORDER BY md5('{ml.SEED}|' || config), config LIMIT {11})")
    ridge = " UNION ALL ".join(f"SELECT 'ridge' AS family, 'alpha={a}' AS config, {str(a == 10.0).lower()} AS baseline" for a in ml.RIDGE_ALPHAS)
    return " UNION ALL ".join([ridge, *[grid(f, s) for f, s in ml.SPACES.items()]])


@query("m15_search_plan", sql(f"WITH p AS ({_plan_sql()}) SELECT family, config, baseline, split, n FROM p, (SELECT split, count(*) AS n FROM origins GROUP BY 1) ", "origins"), i="n")
def m15(t):
    counts = ft.label_splits(origins(t), edges(t)).groupBy("split").agg(F.count("*").alias("n"))
    packed = counts.agg(F.collect_list(F.struct("split", "n")).alias("s"))  # three splits
    plan = ml.search_plan(t.spark)
    return beside(plan, packed).select("family", "config", "baseline", F.inline("s"))


def _ledger(t, label="target"):
    rows = training_table(t).withColumn("day", F.hour("target_ts").between(6, 19))
    train, valid = rows.where("split = 'training' and target is not null"), rows.where("split = 'validation' and target is not null")
    plan = ml.planned(ml.search_plan(t.spark).where("family = 'ridge'")) + [("forest_00", "forest", {"trees": 5, "depth": 4}), ("broken_00", "unknown", {})]
    ledger = ml.Ledger(t.spark, scratch(t.spark, "trials"), ml.TRIAL)
    ml.run_search(train, valid, COLS, label, plan[:-2], "target", "day", ledger=ledger, parallel=4)  # as if interrupted here
    return ml.run_search(train, valid, COLS, label, plan, "target", "day", ledger=ledger, parallel=4)


@query("m16_trial_ledger")
def m16(t):
    return _ledger(t).select("id", "family", "config", "rank", "status", "day_n", "day_mae", "day_rmse", "all_mae")


@query("m16_winners", covers=("M16", "O04"))
def m16b(t):
    return ml.winners(_ledger(t))


@query("m17_direct_power")
def m17(t):
    rows = ft.label_splits(ft.eligible_examples(example_rows(t))[0], edges(t)).cache()
    train, valid = rows.where("split = 'training'"), rows.where("split = 'validation'")
    model = ml.fit_model(train, ft.DIRECT_FEATURES, "actual_target_power_kw", "ridge", {"alpha": 10.0})
    corrected = ml.fit_model(train, ft.CORRECTION_FEATURES, "correction_kw", "ridge", {"alpha": 10.0})
    scored = corrected.predict(model.predict(valid, "direct"), "raw").withColumn("corrected", F.col("physics_forecast_kw") + F.col("raw"))
    scored = scored.withColumn("day", F.hour("target_ts").between(6, 19)).withColumn("persistence", F.col("origin_power_kw"))
    return pf.model_scores(scored, "actual_target_power_kw", ("direct", "corrected", "physics_forecast_kw", "persistence"), "day")


@query("m18_persistence", sql(score_sql("persistence"), "preds"), d="day_mae day_rmse day_bias day_r2 all_mae all_rmse all_bias all_r2", i="day_n all_n")
def m18(t):
    return pf.model_scores(predictions(t), "actual", ("persistence",), "day", ["split"])


@query("m19_delta_target")
def m19(t):
    rows = training_table(t).withColumn("delta", F.col("target") - F.col("ac_kw_lag0"))
    model = ml.fit_model(rows.where("split = 'training'"), COLS, "delta", "ridge", {"alpha": 10.0})
    scored = model.predict(rows.where("split = 'validation'"), "raw")
    scored = scored.withColumn("prediction", F.greatest(F.col("ac_kw_lag0") + F.col("raw"), F.lit(0.0)))
    p = Pair("target", "prediction")
    return scored.agg(p.count().alias("n"), p.mae().alias("mae"), p.rmse().alias("rmse"), p.mbe().alias("bias"))


@query("m23_stored_model")
def m23(t):
    """Fit on the training split, store, load what was stored, and score the testing split with it."""
    rows = training_table(t)
    path = scratch(t.spark, "forecast-model")
    ml.fit_model(rows.where("split = 'training'"), COLS, "target", "ridge", {"alpha": 10.0}).save(path)
    scored = ml.load_model(t.spark, path).predict(rows.where("split = 'testing'"), "prediction").withColumn("persistence", F.col("ac_kw_lag0"))
    scored = scored.withColumn("day", F.hour("target_ts").between(6, 19))
    return pf.model_scores(scored, "target", ("prediction", "persistence"), "day")


IMPR = """count(*) AS samples, count(DISTINCT CAST(target_ts AS DATE)) AS dates, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias,
  100 * (avg(abs(r)) - avg(abs(e))) / nullif(avg(abs(r)), 0) AS mae_improvement_pct, 100 * (sqrt(avg(r * r)) - sqrt(avg(e * e))) / nullif(sqrt(avg(r * r)), 0) AS rmse_improvement_pct"""
SLICES = {"all_daytime": "true", "rapid_change": "abs(actual - persistence) >= 30", "target_recorded_zero": "actual = 0", "target_generating": "actual > 0",
          "origin_recorded_zero": "persistence = 0", "origin_generating": "persistence > 0", "season_DJF": "true", "year_2024": "true"}


@query("m20_score_slices", sql(" UNION ALL ".join(
    f"SELECT split, '{s}' AS slice, '{m}' AS model, {IMPR} FROM (SELECT *, {m} - actual AS e, persistence - actual AS r FROM preds) WHERE {c} GROUP BY 1"
    for m in MODELS for s, c in SLICES.items()), "preds"), d="mae rmse bias mae_improvement_pct rmse_improvement_pct", i="samples dates")
def m20(t):
    return ev_.score_slices(predictions(t), "actual", "persistence", "persistence", MODELS, 30.0, ["split"], "target_ts")


def boot_sql(pairs, draws=2000, seed=17):
    long = " UNION ALL ".join(f"SELECT split, target_ts, '{m}' AS model, '{r}' AS reference, {m} - actual AS e, {r} - actual AS r FROM preds" for m, r in pairs)
    g = "split, model, reference"
    return f"""w AS (SELECT {g}, date_trunc('week', target_ts) AS week, count(*) AS n, sum(abs(e)) AS a, sum(abs(r)) AS p, sum(e * e) AS s, sum(r * r) AS ps FROM ({long}) GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY week) - 1 AS i, count(*) OVER (PARTITION BY {g}) AS b FROM w),
k AS (SELECT DISTINCT {g}, b FROM i),
d AS (SELECT {g}, b, draw, CAST('0x' || substr(md5(draw || '|' || j || '|{seed}'), 1, 8) AS BIGINT) % b AS i FROM k, range({draws}) AS x(draw), range((SELECT max(b) FROM k)) AS y(j) WHERE j < b),
t AS (SELECT split, model, reference, draw, max(d.b) AS b, sum(n) AS n, sum(a) AS a, sum(p) AS p, sum(s) AS s, sum(ps) AS ps FROM d JOIN i USING ({g}, i) GROUP BY 1, 2, 3, 4),
v AS (SELECT *, (p - a) / n AS x, 100 * (p - a) / p AS y, 100 * (sqrt(ps / n) - sqrt(s / n)) / sqrt(ps / n) AS z FROM t),
boot AS (SELECT {g}, max(b) AS blocks, quantile_cont(x, 0.025) AS mae_saving_lower, quantile_cont(x, 0.975) AS mae_saving_upper, quantile_cont(y, 0.025) AS mae_improvement_lower,
  quantile_cont(y, 0.975) AS mae_improvement_upper, quantile_cont(z, 0.025) AS rmse_improvement_lower, quantile_cont(z, 0.975) AS rmse_improvement_upper,
  avg(CASE WHEN p > 0 THEN 0.0 ELSE 1 END) AS undefined_fraction FROM v GROUP BY 1, 2, 3)"""


BOOT = "mae_saving_lower mae_saving_upper mae_improvement_lower mae_improvement_upper rmse_improvement_lower rmse_improvement_upper undefined_fraction"


@query("m21_block_bootstrap", sql(f"WITH {boot_sql([('ridge', 'persistence')])} SELECT * EXCLUDE (model, reference) FROM boot", "preds"), d=BOOT, i="blocks")
def m21(t):
    return ev_.paired_intervals(predictions(t), "actual", "ridge", "persistence", ["split"], ts="target_ts")


PAIRS = [("ridge", "persistence"), ("forest", "persistence"), ("forest", "ridge")]


@query("m22_pairwise", sql(f"""WITH {boot_sql(PAIRS)}, er AS (""" + " UNION ALL ".join(
    f"SELECT split, '{m}' AS model, '{r}' AS reference, {IMPR} FROM (SELECT *, {m} - actual AS e, {r} - actual AS r FROM preds) GROUP BY 1" for m, r in PAIRS) + ") SELECT * FROM er JOIN boot USING (split, model, reference)", "preds"),
       d=BOOT + " mae rmse bias mae_improvement_pct rmse_improvement_pct", i="blocks samples dates")
def m22(t):
    return ev_.pairwise(predictions(t), "actual", PAIRS, ["split"], ts="target_ts")


@query("m24_test_row_loader", sql("""
SELECT count(*) AS rows, count(*) FILTER (l.origin IS NULL) AS without_physics, count(*) FILTER (l.origin IS NOT NULL AND o.n = 6) AS shifted_targets,
  count(*) FILTER (l.origin IS NOT NULL AND (CASE WHEN o.n <> 7 THEN a.power END) IS DISTINCT FROM l.actual) AS altered_labels
FROM site5 o LEFT JOIN labels_ l ON l.origin = o.ts LEFT JOIN site5 a ON a.ts = o.ts + INTERVAL 15 MINUTE
""", "site5", "labels_"), i='"rows" without_physics shifted_targets altered_labels')
def m24(t):
    s = site5(t)
    truth = s.select(clock.shift("ts", -15).alias("ts"), F.col("power").alias("actual_kw"))
    rows = s.join(truth, "ts", "left").select(
        F.col("ts").alias("origin"), F.when(F.col("n") == 6, clock.shift("ts", 20)).otherwise(clock.shift("ts", 15)).alias("target_ts"),
        F.when(F.col("n") != 7, F.col("actual_kw")).alias("actual_kw"))
    current = s.select(F.col("ts").alias("origin"), F.col("poa").alias("origin_poa"))
    return ft.load_test_rows(rows, labelled(t), current)[1]


APPROACH = " UNION ALL ".join(f"SELECT '{a}' AS approach, '{m}' AS family, avg(abs({m} - (actual{x}))) FILTER (day) AS day_mae FROM preds" for a, m, x in
                              (("direct", "ridge", ""), ("direct", "forest", ""), ("correction", "ridge", " + 1"), ("correction", "persistence", " + 1")))


def approaches(t):
    p = predictions(t)
    a = pf.model_scores(p, "actual", ("ridge", "forest"), "day").withColumn("approach", F.lit("direct"))
    b = pf.model_scores(p.withColumn("actual", F.col("actual") + 1), "actual", ("ridge", "persistence"), "day").withColumn("approach", F.lit("correction"))
    return a.unionByName(b).select("approach", F.col("model").alias("family"), "day_mae")


@query("m25_comparison_table", sql(f"""
WITH s AS ({APPROACH}) SELECT coalesce(a.family, b.family) AS family, a.day_mae AS direct_mae, b.day_mae AS correction_mae, b.day_mae - a.day_mae AS correction_minus_direct
FROM (SELECT * FROM s WHERE approach = 'direct') a FULL JOIN (SELECT * FROM s WHERE approach = 'correction') b ON a.family = b.family
""", "preds"), d="direct_mae correction_mae correction_minus_direct")
def m25(t):
    return ev_.comparison_table(approaches(t))


@query("m25_recorded_scores", sql(f"""
WITH s AS ({' UNION ALL '.join(score_sql(m) for m in MODELS)}), r AS (SELECT split, model, CASE WHEN split = 'testing' AND model = 'forest' THEN day_mae + 0.5 ELSE day_mae END AS noted FROM s)
SELECT count(*) AS rows, count(*) FILTER (s.split IS NULL OR r.split IS NULL) AS unpaired, count(*) FILTER (abs(day_mae - noted) > 1e-9) AS differs_day_mae
FROM s FULL JOIN r ON r.split = s.split AND r.model = s.model
""", "preds"), i='"rows" unpaired differs_day_mae')
def m25b(t):
    found = pf.model_scores(predictions(t), "actual", MODELS, "day", ["split"]).select("split", "model", "day_mae")
    odd = (F.col("split") == "testing") & (F.col("model") == "forest")
    recorded = found.withColumn("day_mae", F.when(odd, F.col("day_mae") + 0.5).otherwise(F.col("day_mae")))
    return ev_.score_mismatches(found, recorded, ["split", "model"], ["day_mae"])


@query("m26_consolidation", sql(f"SELECT 'validation' AS phase, approach, family, day_mae FROM ({APPROACH}) UNION ALL SELECT 'repeat', approach, family, day_mae FROM ({APPROACH}) WHERE approach = 'direct'", "preds"), d="day_mae")
def m26(t):
    a = approaches(t)
    table = ev_.consolidate({"validation": a, "repeat": a.where("approach = 'direct'")}, ["approach", "family"])
    return ev_.check_consolidated(table, ["approach", "family"], 6).select("phase", "approach", "family", "day_mae")


@query("m27_label_availability", sql("""
SELECT o.split, count(*) AS rows, count(s.poa) AS poa_available, count(e.ambient) AS ambient_available, count(e.wind) AS wind_available FROM origins o
LEFT JOIN site5 s ON s.ts = o.target_ts LEFT JOIN env15 e ON e.ts = o.target_ts GROUP BY 1
""", "origins", "env15"), i='"rows" poa_available ambient_available wind_available')
def m27(t):
    e = env15(t)
    targets = ft.exact_targets(site5(t), {"poa": (site5(t), "poa"), "ambient": (e, "ambient"), "wind": (e, "wind")})
    return ft.availability_report(ft.label_splits(targets, edges(t)), ["poa", "ambient", "wind"], ["split"])


@query("m28_reconstruction", sql("SELECT count(*) AS records, count(*) FILTER (validity = 'labelled' AND minute(origin) = 35) AS mismatches FROM labels_", "labels_"), i="records mismatches")
def m28(t):
    off = F.when(F.minute("origin") == 35, F.col("actual_target_power_kw") + 0.001).otherwise(F.col("actual_target_power_kw"))
    return ft.reconstruction_errors(labelled(t).withColumn("final", off), "physics_forecast_kw", "correction_kw", "final")


@query("m29_fixed_families", covers=("M29", "M10", "M11", "M12"))
def m29(t):
    rows = ft.label_splits(ft.eligible_examples(example_rows(t))[0], edges(t)).cache()
    train, valid = rows.where("split = 'training'"), rows.where("split = 'validation'")
    pre = ml.fit_preprocessor(train, ft.CORRECTION_FEATURES)
    families = {"ridge": {"alpha": 10.0}, "forest": {"trees": 10, "depth": 6}, "histogram": {"steps": 5, "depth": 3}}
    for name, config in families.items():
        model = ml.fit_model(train, ft.CORRECTION_FEATURES, "correction_kw", name, config, pre)
        valid = model.predict(valid, f"__{name}").withColumn(name, F.col("physics_forecast_kw") + F.col(f"__{name}")).drop(f"__{name}")
    valid = valid.withColumn("persistence", F.col("origin_power_kw")).withColumn("day", F.hour("target_ts").between(6, 19))
    return ev_.pairwise(valid, "actual_target_power_kw", [(m, r) for m in families for r in ("persistence", "physics_forecast_kw")], draws=200, ts="target_ts")


@query("m30_example_loader", sql("""
SELECT p.block, count(*) AS rows, count(*) FILTER (NOT coalesce(target_ts >= cutoff AND target_ts < block_end, false)) AS outside_block FROM (
  SELECT CASE WHEN day(ts) <= 11 THEN 1 WHEN day(ts) <= 20 THEN 2 ELSE 3 END AS block, target_ts FROM origins) p JOIN blocks USING (block)
WHERE target_ts < TIMESTAMP '2024-02-01' GROUP BY 1
""", "origins", "blocks"), i='block "rows" outside_block')
def m30(t):
    rows = origins(t)
    day = F.dayofmonth("ts")
    steps = {1: rows.where(day <= 11), 2: rows.where(day.between(12, 20)), 3: rows.where(day > 20)}
    return ft.load_examples(steps, ft.training_blocks(edges(t)), F.expr("TIMESTAMP_NTZ '2024-02-01'"))[1]


TRIALS = """trials AS (SELECT o_orderpriority || '_' || month(o_orderdate) AS id, o_orderpriority AS family, month(o_orderdate) AS rank, avg(o_totalprice) / 1000 AS day_mae, CASE WHEN month(o_orderdate) = 5 THEN 'failed' ELSE 'complete' END AS status,
  month(o_orderdate) % 2 AS day_n FROM orders GROUP BY 1, 2, 3, 5)"""


@query("m31_ledger_integrity", f"""
WITH {TRIALS} SELECT count(*) AS trials, count(*) - count(DISTINCT id) AS duplicate_ids, count(*) FILTER (status <> 'complete') AS incomplete, count(DISTINCT day_n) AS populations,
  1 AS missing_from_plan, (SELECT count(*) FROM (SELECT family, arg_min(id, (day_mae, rank)) AS id FROM trials WHERE status = 'complete' GROUP BY 1) WHERE id NOT LIKE '%\\_7' ESCAPE '\\') AS winners_differ FROM trials
""", i="trials duplicate_ids incomplete populations missing_from_plan winners_differ")
def m31(t):
    trials = t.orders.groupBy(F.col("o_orderpriority").alias("family"), F.month("o_orderdate").cast("long").alias("rank")).agg((F.avg("o_totalprice") / 1000).alias("day_mae"))
    trials = trials.withColumn("id", F.concat_ws("_", "family", F.col("rank").cast("string"))).withColumn("status", F.when(F.col("rank") == 5, "failed").otherwise("complete"))
    trials = trials.withColumn("config", F.lit("{}")).withColumn("day_n", F.col("rank") % 2)
    plan = trials.select("id").unionByName(trials.select(F.lit("never_run").alias("id")).limit(1))
    recorded = trials.where("rank = 7").select("family", "id")
    return ml.ledger_integrity(trials, plan, recorded)
