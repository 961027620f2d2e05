"""Fixtures with hand-computed expectations."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sunward.config import CandidateThresholds, InverterParameters, LossConfig, Site, SystemConfig
from sunward.functions import clock, physics as ph, solar
from sunward.functions.errors import Normalization, Pair
from sunward.operators import align, audit, evaluation, features, fleet, learners, masks, modelling, performance, profiles, quality, screening
from sunward.operators import timeline, validation, windows

Q = InverterParameters(27600.0, 28199.173828, 620.0, 90.0, -1.5e-6, 1e-5, 1e-3, -2e-4, 8.28)


def ts(text):
    return dt.datetime.fromisoformat(text)


def series(spark, start, values, minutes=5, skip=()):
    t0 = ts(start)
    rows = [(t0 + dt.timedelta(minutes=minutes * i), v) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "ts timestamp_ntz, v double")


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 4.0)], "e double, m double")
    p = Pair("e", "m")
    row = df.agg(*p.metrics()).first()
    assert row.n == 3 and math.isclose(row.mae, 2 / 3) and math.isclose(row.rmse, math.sqrt(2 / 3)) and abs(row.mbe) < 1e-12
    assert math.isclose(row.r_squared, 1 - 2 / 6)


def test_undefined_metrics_stay_undefined(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (float("nan"), 5.0), (3.0, float("inf"))], "e double, m double")
    row = df.agg(*Pair("e", "m").metrics()).first()
    assert row.n == 2 and row.r_squared is None
    empty = df.where("e > 100 and not isnan(e)").agg(*Pair("e", "m").metrics()).first()
    assert empty.n == 0 and empty.mae is None
    with pytest.raises(ValueError):
        Normalization(0.0, "nothing")


def test_dst_labels(spark):
    labels = ["2022-03-13 02:30:00", "2022-03-13 12:00:00", "2022-06-01 15:00:00", "2022-11-06 01:30:00"]
    df = spark.createDataFrame([(ts(x),) for x in labels], "ts timestamp_ntz")
    got = [r.ok for r in df.orderBy("ts").select(clock.resolvable("ts").alias("ok")).collect()]
    assert got == [False, True, True, False]
    geo = solar.with_geometry(df, Site(39.0, -122.1, 25.0, 180.0)).orderBy("ts").collect()
    assert geo[0].solar_elevation_deg is None and geo[3].aoi_deg is None
    assert geo[1].solar_phase == "AM" and geo[2].solar_phase == "PM"
    assert 20 < geo[2].solar_zenith_deg < 40


def test_clock_is_session_zone_free(spark):
    df = series(spark, "2024-03-10 01:50:00", [1.0] * 6)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r.b for r in df.select(clock.floor_to("ts", 15).alias("b")).orderBy("b").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[0] == ts("2024-03-10 01:45:00") and got[-1] == ts("2024-03-10 02:15:00")


def test_physics_golden_values(spark):
    df = spark.createDataFrame([(0.0, 0.0), (650.0, 60000.0), (650.0, 15000.0), (None, 10.0)], "v double, p double")
    rows = df.select(ph.sandia_ac("v", "p", Q).alias("a"), ph.sandia_ac("v", "p", Q, 30000.0).alias("b")).collect()
    assert rows[0].a == -8.28 and rows[1].a == 27600.0 and rows[1].b == 30000.0 and rows[3].a is None
    assert 0 < rows[2].a < 15000


def test_dc_losses(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (600.0, 20.0, 12000.0), (700.0, 40.0, 28000.0)],
                               "expected_dc_voltage_ideal double, expected_dc_current_ideal double, expected_dc_power_ideal double")
    rows = modelling.apply_dc_losses(df, LossConfig(0.9)).collect()
    assert [round(r.expected_dc_current, 9) for r in rows] == [0.0, 18.0, 36.0]
    with pytest.raises(ValueError):
        modelling.apply_dc_losses(df, LossConfig())
    with pytest.raises(ValueError):
        LossConfig(1.5)
    bad = df.withColumn("expected_dc_power_ideal", F.col("expected_dc_power_ideal") * 1.01)
    with pytest.raises(ValueError):
        modelling.check_ideal_dc(bad)


def test_strict_sum_names_missing_devices(spark):
    rows = [(ts("2024-01-01 00:00:00"), f"inv_{i:02d}", -8.28) for i in range(1, 25)]
    rows += [(ts("2024-01-01 01:00:00"), f"inv_{i:02d}", None if i == 5 else 1.0) for i in range(1, 25)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, inverter_id string, v double")
    roster = [f"inv_{i:02d}" for i in range(1, 25)]
    got = fleet.strict_sum(df, "v", roster, "plant").orderBy("ts").collect()
    assert math.isclose(got[0].plant, -24 * 8.28) and got[1].plant is None and got[1].uncomputed_ids == ["inv_05"]
    fleet.check_roster_complete(df, df.select("ts"), roster)
    with pytest.raises(ValueError):
        fleet.check_roster_complete(df.where("inverter_id <> 'inv_03'"), df.select("ts"), roster)


def test_meter_intervals(spark):
    plant = series(spark, "2024-01-01 00:00:00", [-198.72, 3000.0, 6000.0, 1.0, 2.0, None]).withColumnRenamed("v", "p")
    meter = series(spark, "2024-01-01 00:00:00", [5.0, 6.0], 15).withColumnRenamed("v", "m")
    flagged = spark.createDataFrame([(ts("2024-01-01 00:15:00"),)], "ts timestamp_ntz")
    got = align.meter_intervals(plant, meter, flagged, "p", "m").orderBy("ts").collect()
    assert [r.expected_kw_samples for r in got] == [3, 2] and [r.meter_qc_clear for r in got] == [True, False]
    assert math.isclose(got[0].expected_kw, (-198.72 + 3000 + 6000) / 3000) and got[1].expected_kw is None


def test_complete_and_observed_bins(spark):
    rows = [(ts("2024-01-01 00:00:00") + dt.timedelta(minutes=15 * i), 100.0, 90.0, True) for i in range(8) if i != 6]
    rows.append((ts("2024-01-01 04:00:00"), 100.0, None, True))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, e double, m double, c boolean")
    got = {r.bin: r for r in validation.complete_scales(df, "hour", "e", "m", "c").collect()}
    first, second, gap = (got[ts(f"2024-01-01 0{h}:00:00")] for h in (0, 1, 2))
    assert first.complete and first.expected_kwh == 100.0 and first.measured_kwh == 90.0
    assert second.expected_kwh is None and second.observed_expected_kwh == 75.0 and second.observed_measured_kwh == 67.5 and second.coverage == 0.75
    assert gap.valid_intervals == 0 and gap.observed_expected_kwh is None and len(got) == 5


def test_outer_pairs_and_counts(spark):
    e = series(spark, "2024-01-01 00:00:00", [1.0, 2.0, None]).withColumnRenamed("v", "expected_plant_ac_power")
    m = series(spark, "2024-01-01 00:05:00", [4.0, 5.0, 6.0]).withColumnRenamed("v", "measured_meter_power")
    row = validation.validate_plant_ac(e, m).metrics.first()
    assert (row.total_samples, row.valid_paired_samples, row.excluded_samples) == (4, 1, 3)
    assert (row.missing_expected_records, row.missing_measured_records, row.mae) == (1, 1, 2.0)
    with pytest.raises(ValueError):
        validation.validate_plant_ac(e.union(e), m)


def test_devices_never_mix(spark):
    t = ts("2024-01-01 00:00:00")
    e = spark.createDataFrame([(t, "A", 1.0), (t, "B", 10.0)], "ts timestamp_ntz, inverter_id string, expected_ac_power double")
    m = spark.createDataFrame([(t, "B", 20.0), (t, "C", 3.0)], "ts timestamp_ntz, inverter_id string, measured_ac_power double")
    got = {r.inverter_id: r for r in validation.validate_inverter_ac(e, m).metrics.collect()}
    assert set(got) == {"A", "B", "C"} and got["B"].mae == 10.0 and got["A"].metric_status == "no valid pairs"


def test_asof_is_bounded_and_causal(spark):
    env = series(spark, "2024-01-01 00:00:00", [1.0, 2.0, 3.0], 15)
    at = spark.createDataFrame([(ts(f"2024-01-01 {x}:00"),) for x in ("00:10", "00:15", "00:29", "00:30", "00:59", "01:01")], "ts timestamp_ntz")
    got = [r.v for r in align.asof_backward(at, env, ["v"]).orderBy("ts").collect()]
    assert got == [None, 1.0, 1.0, 2.0, 3.0, None]


def test_nearest_prefers_later_on_tie(spark):
    env = series(spark, "2024-01-01 00:00:00", [1.0, 2.0], 15)
    at = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 7, 30),), (dt.datetime(2024, 1, 1, 0, 7, 29),), (dt.datetime(2024, 1, 1, 0, 23),)], "ts timestamp_ntz")
    assert [r.v for r in align.nearest(at, env, ["v"]).orderBy("ts").collect()] == [1.0, 2.0, None]


def test_ramp_is_null_at_gaps(spark):
    df = series(spark, "2024-01-01 00:00:00", [100.0, 110.0, 100.0, 90.0, 100.0, 100.0], skip=(2,))
    got = [r.ramp for r in windows.relative_ramp(df, "v", "ramp").orderBy("ts").collect()]
    assert got[0] is None and got[1] is None and got[2] is None and math.isclose(got[3], 0.1) and got[4] is None


def test_funnel_and_mask(spark):
    df = spark.createDataFrame([(1, True), (2, None), (3, True), (4, False)], "x int, ok boolean")
    rules = {"big": F.col("x") > 1, "ok": F.col("ok")}
    rows = [(r.stage, r.remaining, r.removed, r.failed_independently) for r in masks.rule_funnel(df, rules).orderBy("step").collect()]
    assert rows == [("all_timestamps", 4, 0, 0), ("big", 3, 1, 1), ("ok", 1, 2, 2)]
    with pytest.raises(ValueError):
        CandidateThresholds(minimum_ac_fraction=0.95)


def test_matched_strata_and_summary(spark):
    rows = []
    for phase, v, n in (("AM", 1.0, 10), ("PM", 0.98, 12)):
        rows += [(ts("2024-01-01 09:00:00"), 450.0, 25.0, "DJF", phase, v, v, v, 1.0, 30.0)] * n
    rows.append((ts("2024-01-01 09:00:00"), 950.0, 25.0, "DJF", "AM", 1.0, 1.0, 1.0, 1.0, 30.0))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, poa double, temp_cell double, season string, phase string, voltage_ratio double, current_ratio double, power_ratio double, wind double, aoi double")
    strata = screening.matched_strata(df)
    got = screening.matched_summary(strata).first()
    assert got.occupied_bins == 2 and got.adequate_bins == 1 and got.balanced_samples == 10 and math.isclose(got.voltage_pm_minus_am, -0.02)


def test_lag_features_do_not_see_the_future(spark):
    n = 40
    poa = series(spark, "2024-01-01 00:00:00", [float(i) for i in range(n)])
    env = series(spark, "2024-01-01 00:00:00", [float(i) for i in range(n // 3)], 15).withColumnRenamed("v", "ambient")
    origin = spark.createDataFrame([(ts("2024-01-01 02:00:00"),)], "ts timestamp_ntz")
    a = features.lag_features(origin, poa, "v", env, ["ambient"]).first()
    cut = F.lit("2024-01-01 02:00:00").cast("timestamp_ntz")
    b = features.lag_features(origin, poa.withColumn("v", F.when(F.col("ts") > cut, -1.0).otherwise(F.col("v"))), "v",
                              env.withColumn("ambient", F.when(F.col("ts") > clock.shift(cut, -15), -1.0).otherwise(F.col("ambient"))), ["ambient"]).first()
    assert a == b and a.poa_lag120 == 0.0 and a.poa_lag0 == 24.0 and a.ambient_lag0 == 7.0 and a.ambient_lag120 is None


def test_window_mask_respects_split_and_gap(spark):
    df = series(spark, "2024-12-31 22:00:00", [1.0] * 60, skip=(40,))
    label = lambda c: F.year(c)
    got = {r.ts: r.usable for r in masks.window_mask(df, F.lit(True), label, 15).collect()}
    assert got[ts("2024-12-31 22:30:00")] and not got[ts("2024-12-31 22:25:00")]
    assert not got[ts("2024-12-31 23:50:00")] and not got[ts("2025-01-01 00:10:00")]
    assert got[ts("2025-01-01 00:30:00")] and not got[ts("2025-01-01 01:25:00")]


def test_imputation_is_train_only(spark):
    train = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    other = spark.createDataFrame([(None, 9.0)], "a double, b double")
    medians = learners.training_medians(train, ["a", "b"])
    row = learners.impute(other, medians, ["a", "b"]).first()
    assert (row.a, row.b, row.a__missing, row.b__missing) == (2.0, 9.0, 1.0, 0.0)
    assert learners.impute(train, medians, ["a", "b"]).agg(F.max("b")).first()[0] == 0.0


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    from pyspark.ml.feature import VectorAssembler
    model = learners.fit_ridge(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df), "y", 25.0)
    xc = x - x.mean(0)
    beta = np.linalg.solve(xc.T @ xc + 25 * np.eye(3), xc.T @ (y - y.mean()))
    assert np.allclose(model.coefficients.toArray(), beta, atol=1e-8)


def test_bootstrap_of_exact_half(spark):
    rows = [(ts("2024-01-01 00:00:00") + dt.timedelta(days=i), 0.0, 2.0 * (i % 5 + 1), 1.0 * (i % 5 + 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, actual double, persistence double, model double")
    row = evaluation.paired_intervals(df, "actual", "model", "persistence", draws=100).first()
    assert math.isclose(row.mae_improvement_lower, 50.0) and math.isclose(row.mae_improvement_upper, 50.0)
    perfect = evaluation.paired_intervals(df.withColumn("persistence", F.col("actual")), "actual", "model", "persistence", draws=50).first()
    assert perfect.undefined_fraction == 1.0 and perfect.mae_improvement_lower is None


def _index_rows(spark, step=False):
    rows = []
    for u in range(4):
        for k in range(60):
            y = 100.0 + u - k / 12 + 2 * math.sin(k % 12) + (5.0 if step and u == 1 and k >= 30 else 0.0)
            rows.append((f"u{u}", dt.datetime(2019 + k // 12, k % 12 + 1, 1), y, 0.0))
    return spark.createDataFrame(rows, "unit string, month timestamp_ntz, index double, zero_fraction double")


def test_slope_is_recovered_with_and_without_a_step(spark):
    got = performance.fit_slopes(_index_rows(spark)).first()
    assert math.isclose(got.slope, -1.0, abs_tol=1e-9) and got.months == 60 and got.rank == got.parameters
    jumps = spark.createDataFrame([("u1", dt.datetime(2021, 7, 1))], "unit string, boundary timestamp_ntz")
    stepped = performance.fit_slopes(_index_rows(spark, True), jumps=jumps).first()
    assert math.isclose(stepped.slope, -1.0, abs_tol=1e-9)
    assert abs(performance.fit_slopes(_index_rows(spark, True)).first().slope + 1.0) > 0.1


def test_slopes_of_unbalanced_rows_match_a_direct_solve(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{u}", dt.datetime(2019 + k // 12, k % 12 + 1, 1), float(100 + u - 0.3 * k + rng.normal()), float(rng.random())) for u in range(5) for k in range(40) if rng.random() > 0.3]
    df = spark.createDataFrame(rows, "unit string, month timestamp_ntz, index double, zero_fraction double")
    jumps = spark.createDataFrame([("u2", dt.datetime(2020, 5, 1))], "unit string, boundary timestamp_ntz")
    got = performance.fit_slopes(df, jumps=jumps, zeros=True).first()
    design = np.array([[1, y - 2019 + (m - 1) / 12, *(u == f"u{i}" for i in range(1, 5)), *(m == i for i in range(2, 13)), u == "u2" and (y, m) >= (2020, 5), z]
                       for u, t, _, z in rows for y, m in [(t.year, t.month)]], float)
    value = np.array([r[2] for r in rows])
    beta = np.linalg.lstsq(design, value, rcond=None)[0]
    months = sorted({r[1] for r in rows})
    error = value - design @ beta
    scores = np.array([sum((design[i] * error[i] for i, r in enumerate(rows) if r[1] == t), np.zeros(design.shape[1])) for t in months])
    bread = np.linalg.inv(design.T @ design)
    pure = scores @ bread[1]
    variance = pure @ pure + 2 * sum((1 - lag / 4) * pure[lag:] @ pure[:-lag] for lag in (1, 2, 3))
    width = performance.t_quantile(0.975, max(1, len(months) - design.shape[1] // 24 - 2)) * math.sqrt(max(0, variance))
    assert math.isclose(got.slope, beta[1], abs_tol=1e-8) and math.isclose(got.upper - got.slope, width, rel_tol=1e-6)
    assert (got.months, got.observations, got["rank"], got.parameters) == (len(months), len(rows), np.linalg.matrix_rank(design), design.shape[1])


def test_t_quantiles():
    for df, want in ((1, 12.7062), (5, 2.5706), (30, 2.0423), (200, 1.9719)):
        assert abs(performance.t_quantile(0.975, df) - want) < 1e-3


def test_persistent_jump(spark):
    rows = [("u", dt.datetime(2023, m, 1), 1.0 if m < 6 else 0.8) for m in range(1, 13) if m != 11]
    df = spark.createDataFrame(rows, "unit string, month timestamp_ntz, v double")
    got = windows.persistent_jumps(df, "unit", "v", F.lit(True)).collect()
    assert [str(r.boundary) for r in got] == ["2023-06-01"] and math.isclose(got[0].shift, -0.2)


def test_early_stopping(spark):
    df = spark.createDataFrame([("t", i, e) for i, e in enumerate([5.0, 4.0, 3.95, 3.0, 3.2, 3.1], 1)], "trial string, epoch int, e double")
    row = windows.early_stopping(df, "trial", "epoch", "e", 0.1).first()
    assert (row.selected, row.best, row.stale) == (4, 3.0, 2)


def test_spearman_small(spark):
    rows = [("AM", float(i), float(i * i)) for i in range(20)] + [("PM", float(i), float(-i)) for i in range(20)]
    df = spark.createDataFrame(rows, "phase string, q double, w double")
    got = {r.phase: r.correlation for r in profiles.spearman(df, "phase", ["q"], ["w"]).collect()}
    assert math.isclose(got["AM"], 1.0) and math.isclose(got["PM"], -1.0)


def test_spearman_reads_its_input_once(spark):
    rows = [(("AM", "PM", None)[i % 3], None if i % 7 == 0 else float(i % 40), None if i % 11 == 0 else float(i * i % 97), None if i % 5 == 0 else float(-i % 13)) for i in range(600)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "phase string, q double, v double, w double").mapInArrow(seen, "phase string, q double, v double, w double")
    got = {(r.phase, r.variable): r for r in profiles.spearman(df, "phase", ["q"], ["v", "w"]).collect()}
    assert read.value == len(rows)  # no pass over the rows for each pair, side and join
    frame = pd.DataFrame(rows, columns=["phase", "q", "v", "w"])
    for (phase, variable), r in got.items():
        part = frame if phase == "all" else frame[frame.phase == phase]
        both = part[["q", variable]].dropna()
        assert (r.total, r.valid, r.excluded) == (len(part), len(both), len(part) - len(both))
        assert math.isclose(r.correlation, both.q.rank().corr(both[variable].rank()), abs_tol=1e-9)
    assert len(got) == 6


def test_loading_bins(spark):
    df = spark.createDataFrame([(100.0, 99.0), (100.0, None), (-5.0, 1.0), (None, 1.0)], "e double, m double")
    got = {r.loading_bin: r for r in profiles.loading_summary(df, "e", "m", 100.0, "expected").collect()}
    assert got["[1.0, 1.05)"].total_samples == 2 and got["[1.0, 1.05)"].valid_pairs == 1
    assert got["[-inf, 0.0)"].median_ratio is None and "unavailable_loading" in got


def test_ledger_guard_and_unknown_conditions(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 500.0)], "id int, value double")
    led = quality.build_ledger(df, ["id"], "value", {"qc_corrupt": (F.col("value") > 100, "too high")})
    assert [(r.id, r.flag) for r in led.collect()] == [(3, "qc_corrupt")]
    out = {r.id: r.clean for r in quality.apply_approved(df, led, ["id"]).collect()}
    assert out == {1: 5.0, 2: None, 3: None}
    wrong = led.withColumn("raw_value", F.lit(501.0))
    with pytest.raises(ValueError):
        quality.check_approvals(df, wrong, ["id"])
    assert {r.id: r.clean for r in quality.apply_approved(df, wrong, ["id"]).collect()}[3] == 500.0


def test_basis_check(spark):
    df = series(spark, "2024-01-01 00:00:00", [1.0])
    timeline.check_timestamp_basis(df, "ts", "wall_clock")
    with pytest.raises(ValueError):
        timeline.check_timestamp_basis(df, "ts", "aware")
    with pytest.raises(ValueError):
        SystemConfig(modules_per_string=0)


def test_stored_models_predict_as_before(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(float(x), float(z) if z > 0.2 else None, float(3 * x - z)) for x, z in rng.random((200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    for family, config in (("ridge", {"alpha": 1.0}), ("forest", {"trees": 3, "depth": 3}), ("histogram", {"steps": 3, "depth": 2})):
        fitted = learners.fit_model(df, ["a", "b"], "y", family, config)
        fitted.save(str(tmp_path / family))
        again = learners.load_model(spark, str(tmp_path / family))
        assert again.predict(df, "p").select("p").collect() == fitted.predict(df, "p").select("p").collect()


def test_trees_split_a_step_where_it_is(spark):
    df = spark.createDataFrame([(float(i), 1.0 if i < 30 else 5.0) for i in range(60)], "x double, y double")
    for family, config in (("forest", {"trees": 1, "depth": 2, "leaf": 1}), ("boosted", {"steps": 1, "depth": 2, "leaf": 1})):
        got = learners.fit_model(df, ["x"], "y", family, config).predict(df, "p").groupBy("y").agg(F.avg("p").alias("p"), F.stddev_pop("p").alias("s")).orderBy("y").collect()
        assert all(abs(r.p - r.y) < 0.5 and r.s < 0.5 for r in got)


def test_a_plan_is_what_a_search_runs(spark):
    plan = learners.planned(learners.search_plan(spark))
    assert len({i for i, _, _ in plan}) == len(plan) == 7 + 3 * 12
    assert ("forest_00", "forest", {"depth": 12, "leaf": 5, "subset": "1.0"}) in plan and all("leaves" not in c for _, _, c in plan)
    df = spark.createDataFrame([(float(i), float(2 * i), i % 2 == 0) for i in range(40)], "x double, y double, day boolean")
    ledger = learners.run_search(df, df, ["x"], "y", [p for p in plan if p[1] == "ridge"], "y", "day")
    assert ledger.where("status = 'complete'").count() == 7


def test_gates_refuse_what_they_are_for(spark):
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    align.check_same_keys(keys, keys, ["k"])
    with pytest.raises(ValueError):
        align.check_same_keys(keys, keys.where("k = 1"), ["k"])
    roster = spark.createDataFrame([("inv_01", 0, 0), ("inv_02", 1, 0)], "inverter string, duplicated int, missing int")
    audit.check_roster(roster.where("duplicated = 0"))
    with pytest.raises(ValueError):
        audit.check_roster(roster)
    final = spark.createDataFrame([(2.0, 1.0, 3.0)], "p double, c double, f double")
    features.check_reconstruction(final, "p", "c", "f")
    with pytest.raises(ValueError):
        features.check_reconstruction(final.withColumn("f", F.lit(9.0)), "p", "c", "f")
    profiles.check_predictions(final, ["p", "c"])
    with pytest.raises(ValueError):
        profiles.check_predictions(final.withColumn("p", F.lit(float("nan"))), ["p"])
    weather = spark.createDataFrame([("2023-06-01 12:00:00", 500.0, 20.0, 2.0)], "ts string, poa double, ambient double, wind double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    quality.check_measurements(weather)
    with pytest.raises(ValueError):
        quality.check_measurements(weather.where("poa < 0"))


def test_training_tables_read_the_readings_once(spark):
    from catalog import forecasting, registry
    tables = registry.Tables(spark, "/root/testdata/sf0.001")
    forecasting.training_table(tables)
    plan = forecasting.split_features(tables)._jdf.queryExecution().withCachedData().toString()
    spark.catalog.clearCache()
    assert "InMemoryRelation" in plan and not [line for line in plan.splitlines() if "Relation [event_id" in line]
