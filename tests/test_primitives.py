"""Chunked ordering against brute force in pandas."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sunward.operators import align, fleet, histograms, modelling, performance
from sunward.sources import tables as src
from sunward.operators import ordered as o


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 3000
    keys = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcd"), n))
    pdf = pd.DataFrame({"k": keys, "x": rng.permutation(9000)[:n].astype("int64"), "v": rng.normal(0, 50, n).round(2)})
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "v"] = 0.0
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_neighbours_cross_chunk_borders(df, frame):
    got = o.neighbours(df, ["k"], "x", ["x"], (50, 1000)).toPandas().sort_values(["k", "x"]).reset_index(drop=True)
    want = frame.sort_values(["k", "x"]).reset_index(drop=True)
    assert np.array_equal(got.prev_x.to_numpy(), want.groupby("k").x.shift(1).to_numpy(), equal_nan=True)
    assert np.array_equal(got.next_x.to_numpy(), want.groupby("k").x.shift(-1).to_numpy(), equal_nan=True)


def test_running_total_and_numbering(df, frame):
    got = o.numbered(df, ["k"], "x", "n", (50, 1000)).toPandas().sort_values(["k", "x"])
    want = frame.sort_values(["k", "x"])
    assert got.n.tolist() == want.groupby("k").cumcount().tolist()


def test_islands_match_gaps_and_islands(df, frame):
    got = o.islands(df, ["k"], "x", 1, (64, 512)).toPandas()
    want = frame.sort_values(["k", "x"]).copy()
    want["g"] = (want.groupby("k").x.diff() != 1).cumsum()
    runs = want.groupby(["k", "g"]).x.agg(["min", "max", "size"]).reset_index()
    assert sorted(map(tuple, got[["k", "start", "end", "samples"]].values.tolist())) == sorted(
        map(tuple, runs[["k", "min", "max", "size"]].values.tolist()))


def test_islands_longer_than_many_chunks(spark):
    long = spark.range(0, 5000).select(F.lit("u").alias("k"), F.col("id").alias("x")).where("x <> 2500")
    got = sorted(tuple(r) for r in o.islands(long, ["k"], "x", 1, (16, 128)).collect())
    assert got == [("u", 0, 2499, 2500), ("u", 2501, 4999, 2499)]


@pytest.mark.parametrize("accuracy, small, bound", [(10_000, 2_000, "10m"), (10_000, 100, "-1"), (7, 50, "10m")])
def test_exact_quantiles_by_any_summary_and_join(df, frame, accuracy, small, bound, monkeypatch):
    monkeypatch.setattr(o, "SUMMARY_ACCURACY", accuracy)
    monkeypatch.setattr(o, "SMALL_GROUP", small)
    before = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    probs = (0.0, 0.01, 0.1, 0.5, 0.9, 0.999, 1.0)
    got = o.exact_quantiles(df, ["k"], {f"q{i}": ("v", p) for i, p in enumerate(probs)}).toPandas().set_index("k").sort_index()
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = frame.groupby("k").v.quantile(list(probs)).unstack().sort_index()
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_quantiles_run_no_job_before_they_are_asked_for(df):
    tracker, group = df.sparkSession.sparkContext.statusTracker(), "quantile-plan"
    df.sparkSession.sparkContext.setJobGroup(group, "planning only")
    plan = o.exact_quantiles(df, ["k"], {"a": ("v", .1), "b": ("v", .9)})
    text = plan._jdf.queryExecution().executedPlan().toString()
    df.sparkSession.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not tracker.getJobIdsForGroup(group) and text.count("Exchange hashpartitioning") <= 6


def test_exact_quantiles_without_keys_and_with_null_key(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None)], "k string, v double")
    assert o.exact_quantiles(rows, [], {"m": ("v", 0.5)}).first().m == 3.0
    got = {r.k: r.m for r in o.exact_quantiles(rows, ["k"], {"m": ("v", 0.5)}).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_no_row_is_repeated_for_a_probability(spark):
    rows = spark.range(30_000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    found = o.exact_quantiles(rows, ["k"], {f"p{i}": ("v", i / 8) for i in range(1, 8)})
    assert [round(r.p4) for r in found.orderBy("k").collect()] == [14_999, 15_000]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction") == 0


def test_rows_of_few_groups_are_not_brought_together_for_quantiles(spark):
    rows = spark.range(30_000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes are not known before the first pass
    found = o.exact_quantiles(rows, ["k"], {"m": ("v", .5)})
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert [r.m for r in found.orderBy("k").collect()] == [14_999.0, 15_000.0]


def test_average_ranks(df, frame):
    got = o.average_ranks(df, ["k"], "v", "r").toPandas().set_index(["k", "v"]).r
    want = frame.dropna().assign(r=frame.groupby("k").v.rank()).groupby(["k", "v"]).r.first()
    assert np.allclose(got.sort_index().to_numpy(), want.sort_index().to_numpy())


def test_value_codes_are_the_bits_of_doubles(spark):
    rng = np.random.default_rng(7)
    edges = [x for k in range(-1074, 1024) for x in (2.0 ** k, np.nextafter(2.0 ** k, 0), np.nextafter(2.0 ** k, np.inf))]
    values = np.concatenate([edges, rng.integers(0, 2 ** 63 - 2 ** 53, 3000).view(np.float64), [0.0, 5e-324, 1.7976931348623157e308]])
    values = values[np.isfinite(values)]
    pdf = pd.DataFrame({"v": np.concatenate([values, -values])})
    got = spark.createDataFrame(pdf).select("v", o.value_code(F.col("v")).alias("k")).withColumn("w", o.code_value(F.col("k"))).toPandas()
    bits = np.abs(got.v.to_numpy()).view(np.int64)
    assert (got.k.to_numpy() == np.where(got.v < 0, -bits, bits)).all() and (got.w == got.v).all()


def test_quantiles_of_values_that_lie_together(spark):
    rows = spark.range(20_000).select(F.lit("a").alias("k"), (230.0 + F.col("id") / 40_000).alias("v"))
    odd = spark.createDataFrame([("a", float("nan")), ("a", float("inf")), ("a", float("-inf")), ("b", float("nan"))], "k string, v double")
    got = {r.k: r for r in o.exact_quantiles(rows.unionByName(odd), ["k"], {"m": ("v", 0.5), "top": ("v", 1.0), "q": ("v", 0.1)}).collect()}
    assert got.keys() == {"a"} and abs(got["a"].m - (230 + 9999.5 / 40_000)) < 1e-12 and got["a"].top == 230 + 19_999 / 40_000
    ranks = {r.v: r.r for r in o.average_ranks(rows.unionByName(odd), ["k"], "v", "r").collect()}
    assert len(ranks) == 20_000 and ranks[230.0] == 1.0 and ranks[230 + 19_999 / 40_000] == 20_000


def test_map_edges_have_values(spark):
    grid = [(100.0 * i, 10.0 * j, 30.0 + i, 1.0 + j, 40.0, 2.0) for i in range(3) for j in range(3)]
    cells = modelling.performance_cells(spark.createDataFrame(grid, "poa double, temp double, vmp double, imp double, voc double, isc double"), 100.0, 10.0)
    asked = [(200.0, 20.0), (200.0, 5.0), (50.0, 20.0), (100.0, 10.0), (100.0, 0.0), (200.5, 5.0), (50.0, 20.5), (50.0, -1.0), (0.0, 99.0)]
    rows = spark.createDataFrame(asked, "poa double, temp_cell double")
    got = {(r.poa, r.temp_cell): (r.vmp, r.imp) for r in modelling.module_dc(rows, cells, 100.0, 10.0).collect()}
    assert got == {(200.0, 20.0): (32.0, 3.0), (200.0, 5.0): (32.0, 1.5), (50.0, 20.0): (30.5, 3.0), (100.0, 10.0): (31.0, 2.0), (100.0, 0.0): (31.0, 1.0),
                   (200.5, 5.0): (None, None), (50.0, 20.5): (None, None), (50.0, -1.0): (None, None), (0.0, 99.0): (0.0, 0.0)}


def test_repeated_devices_are_not_computed(spark):
    df = spark.createDataFrame([("t1", "a", 1.0), ("t1", "a", 1.0), ("t2", "a", 1.0), ("t2", "b", 2.0)], "ts string, inverter_id string, v double")
    got = {r.ts: (r.plant, r.computed, r.uncomputed_ids) for r in fleet.strict_sum(df, "v", ["a", "b"], "plant").collect()}
    assert got == {"t1": (None, 0, ["a", "b"]), "t2": (3.0, 2, [])}
    whole = {r.ts: r.plant for r in fleet.complete_fleet(df, "v", 2, None, "plant").collect()}
    assert whole == {"t1": None, "t2": 3.0}
    series = spark.createDataFrame([("2023-01-01 00:00:00", 1.0), ("2023-01-01 00:05:00", 3.0), ("2023-01-01 00:05:00", 3.0), ("2023-01-01 01:00:00", 1.0), ("2023-01-01 01:05:00", 3.0)], "ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    anchors = series.where("minute(ts) = 0").select("ts")
    assert [(r.m, r.m_samples) for r in align.strict_mean(anchors, series, "v", [0, 5], "m").orderBy("ts").collect()] == [(None, 1), (2.0, 2)]


def test_plant_of_represented_devices_sends_no_row_per_device(spark):
    rows = spark.createDataFrame([("t1", 2.5), ("t2", 1.0), ("t2", 1.0), ("t3", None), ("t4", float("nan")), (None, 4.0)], "ts string, expected_ac_power double")
    roster = ["b", "a", "c"]
    units, plant = modelling.PlantModel.plant_model(None, rows, roster)
    plan = plant._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert units.count() == 18
    assert sorted(map(str, plant.collect())) == sorted(map(str, fleet.strict_sum(units, "expected_ac_power", roster, "expected_plant_ac_power").select(*plant.columns).collect()))


def test_module_look_up_shuffles_no_readings(spark):
    grid = [(100.0 * i, 10.0 * j, 30.0, 1.0, 40.0, 2.0) for i in range(3) for j in range(3)]
    cells = modelling.performance_cells(spark.createDataFrame(grid, "poa double, temp double, vmp double, imp double, voc double, isc double"), 100.0, 10.0)
    rows = spark.range(100).select(F.col("id").cast("double").alias("poa"), F.lit(5.0).alias("temp_cell"))
    found = modelling.module_dc(rows, cells, 100.0, 10.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and found.where("round(vmp, 9) = 30").count() == 99


def test_fingerprints_of_fields_that_run_together(spark):
    one = lambda *row: src.fingerprint(spark.createDataFrame([row], "a string, b string"), ["a", "b"]).first()
    assert len({one("x|y", "z"), one("x", "y|z"), one("x", "y"), one(None, "~"), one("~", None), one("-", "~"), one("", "1:x")}) == 7


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_quantiles_of_many_groupings_repeat_no_row(spark, frame):
    rng = np.random.default_rng(4)
    pdf = frame.assign(w=rng.lognormal(0, 1, len(frame)), month=rng.integers(1, 5, len(frame)))
    pdf.loc[rng.random(len(pdf)) < .1, "k"] = None
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(3)
    dims, probs = {"k": F.col("k"), "month": F.col("month"), "all": F.lit("x")}, (0.0, .1, .5, 1.0)
    got = {(r.dimension, r.bin, r.measure): r for r in histograms.grouped_quantiles(df, dims, ["v", "w"], probs).collect()}
    for name, labels in (("k", pdf.k), ("month", pdf.month.astype(str)), ("all", pd.Series("x", pdf.index))):
        for label in set(labels.where(labels.notna(), None)):
            for measure in ("v", "w"):
                own = pdf[measure][labels.isna() if label is None else labels == label]
                r = got.pop((name, label, measure))
                assert (r.total, r.finite) == (len(own), own.count())
                assert np.allclose([r[f"q{i}"] for i in range(len(probs))], own.quantile(list(probs)))
    assert not got
    rows = df.select(*[c.cast("string").alias(n) for n, c in dims.items()], "v", "w")
    out = rows.mapInArrow(histograms._count_task(list(dims), ["v", "w"]), "dimension string, bin string, measure string, bucket long, n long")
    assert out.agg(F.sum("n")).first()[0] == 3 * 2 * len(pdf) and out.groupBy("dimension", "bin", "measure", "bucket").count().agg(F.max("count")).first()[0] <= 3


def test_histogram_tasks_work_on_many_batches_at_once():
    batches = [pa.RecordBatch.from_pydict({"d": pa.array(["a", None, "b", "a"]), "m": pa.array([1.5, 1.5, 7.0, None])}) for _ in range(50)]
    at = histograms.buckets(np.array([1.5]))
    out = pa.Table.from_batches(histograms._values_task(["d"], ["m"], {("d", "a", "m"): at, ("d", None, "m"): at})(iter(batches))).to_pylist()
    assert sorted((str(r["bin"]), r["value"], r["n"]) for r in out) == [("None", 1.5, 50), ("a", 1.5, 50)]  # not a row for each batch
    counts = pa.Table.from_batches(histograms._count_task(["d"], ["m"])(iter(batches))).to_pylist()
    assert {(r["bin"], r["bucket"]): r["n"] for r in counts} == {("a", at[0]): 50, (None, at[0]): 50, ("b", histograms.buckets(np.array([7.0]))[0]): 50, ("a", histograms.NOTHING): 50}


def test_heavy_keys_are_spread_in_a_join(spark):
    left = spark.range(20_000).select(F.when(F.col("id") % 10 < 6, F.lit(None)).otherwise(F.col("id") % 700).alias("k"), F.col("id").alias("x"))
    right = left.select("k").distinct().withColumn("y", F.coalesce("k", F.lit(-1)) * 2)
    got = o.spread_join(left, right, ["k"], salts=16)
    assert got.count() == 20_000 and got.where("y <> coalesce(k, -1) * 2").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts < 12_000  # the heavy key alone is 12,000 rows


def test_slope_grid_is_one_pass_whatever_its_size(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(u, y, m, 100 - (y - 2019) * .5 - (m == 4) + rng.normal() - 3 * (u == 1 and y >= 2021), rng.random()) for u in range(4) for y in range(2019, 2023) for m in range(1, 13)]
    index = spark.createDataFrame(rows, "unit long, y int, m int, index double, zero_fraction double").select("unit", F.make_date("y", "m", F.lit(1)).cast("timestamp_ntz").alias("month"), "index", "zero_fraction", F.lit("s").alias("site"))
    index.write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    jumps = spark.createDataFrame([(1, "2021-01-01")], "unit long, boundary string").withColumn("boundary", F.col("boundary").cast("timestamp_ntz"))
    late = F.year("month") >= 2020
    grid = performance.slope_grid(index, {"raw": {}, "steps": {"jumps": jumps}, "zeros": {"zeros": True}}, {"all": F.lit(True), "late": late}, "site")
    small = performance.slope_grid(index, {"steps": {"jumps": jumps}}, {"all": F.lit(True)}, "site")
    assert scans(grid) == scans(small)
    got = {(r.treatment, r.period): r for r in grid.collect()}
    assert len(got) == 6
    for (t, p), r in got.items():
        alone = performance.fit_slopes(index.where(late) if p == "late" else index, "site", jumps if t == "steps" else None, t == "zeros").first()
        for c in ("slope", "lower", "upper", "months", "observations", "rank", "parameters"):
            assert r[c] == pytest.approx(alone[c]), (t, p, c)
