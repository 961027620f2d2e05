"""Rank correlations: against pandas on odd columns, and what they leave and move on disk."""

import math
import os
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sunward.operators import profiles, rank_pairs


def local_folders(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return manager.localDirsString()


def bytes_in(folders):
    total = 0
    for top in folders:
        for at, _, names in os.walk(top):
            for name in names:
                try:
                    total += os.path.getsize(os.path.join(at, name))
                except OSError:  # it may go meanwhile
                    pass
    return total


def test_rows_of_distinct_values_take_few_bytes_and_leave_none(spark):
    n = 200_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("p"), F.col("id") % 3)).alias("phase"),
                                 *[F.rand(k).alias(c) for k, c in enumerate("abxyz")])
    folders = list(local_folders(spark))
    before, most, over = bytes_in(folders), [0], threading.Event()

    def watch():
        while not over.is_set():
            most[0] = max(most[0], bytes_in(folders) - before)
            time.sleep(0.02)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = profiles.spearman(rows, "phase", ["a", "b"], ["x", "y", "z"]).collect()
    finally:
        over.set()
        watcher.join()
    assert len(got) == 18 and all(abs(r.correlation) < 0.02 for r in got)
    assert 10 * n < most[0] < 120 * n  # some 790 bytes a row when counted rows, ranks and sums were shuffled and kept
    for _ in range(40):
        if bytes_in(folders) <= before + n:
            break
        time.sleep(0.25)
    assert bytes_in(folders) <= before + n


def expected(frame, quantities, variables):
    """As in SQL over a union of all rows, called 'all', and the rows of each phase."""
    groups = [("all", pd.concat([frame, frame[frame.phase == "all"]]))] + [(p, frame[frame.phase == p]) for p in frame.phase.dropna().unique() if p != "all"]
    for phase, group in groups:
        for q in quantities:
            for v in variables:
                both = group[[q, v]].replace([math.inf, -math.inf], math.nan).dropna()
                varied = both[q].nunique() > 1 and both[v].nunique() > 1
                yield (phase, q, v), (len(group), len(both), both[q].rank().corr(both[v].rank()) if varied else None)


@pytest.mark.parametrize("n, phases, small", [(3000, ["AM", "PM", None, ""], False), (20_000, ["AM", None, "all", "="], True), (4000, [f"p{i}" for i in range(150)], True)])
def test_heavy_tied_missing_and_odd_values(spark, monkeypatch, n, phases, small):
    if small:  # many chunks, borders, parts and flushes
        for name, value in {"_CHUNK": 500, "_HELD": 700, "_PART": 200, "_MARKS": 32, "_STRETCHES": 64, "_DIRECT": 20}.items():
            monkeypatch.setattr(rank_pairs, name, value)
    rng = np.random.default_rng(n)
    a = rng.normal(size=n)
    frame = pd.DataFrame({"phase": np.array(phases, object)[rng.integers(0, len(phases), n)], "a": np.where(rng.random(n) < .4, 0.0, a), "b": np.round(50 * rng.normal(size=n)),
                          "x": a + rng.normal(size=n), "y": -1.0 * rng.integers(0, 5, n), "z": np.where(rng.random(n) < .7, -0.0, 1e-300 * rng.exponential(size=n))})
    for c in "abxyz":
        frame.loc[rng.random(n) < .1, c] = math.nan
    frame.loc[rng.random(n) < .01, "x"], frame.loc[rng.random(n) < .01, "a"] = math.inf, -math.inf
    quantities, variables = (["a", "b"], ["x", "y", "z"]) if len(phases) < 9 else (["a"], ["x", "z"])
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "phase string, a double, b double, x double, y double, z double").repartition(5)
    got = {(r.phase, r.quantity, r.variable): r for r in profiles.spearman(df, "phase", quantities, variables).collect()}
    wanted = dict(expected(frame, quantities, variables))
    assert set(got) == set(wanted)
    for key, (total, valid, correlation) in wanted.items():
        r = got[key]
        assert (r.total, r.valid, r.excluded) == (total, valid, total - valid), key
        assert (r.correlation is None) == (correlation is None) and math.isclose(r.correlation or 0, correlation or 0, abs_tol=1e-11), key


def test_no_rows_and_no_pairs(spark):
    df = spark.createDataFrame([("AM", None, 1.0), (None, None, None)], "phase string, a double, x double")
    assert profiles.spearman(df.where("false"), "phase", ["a"], ["x"]).collect() == []
    got = {r.phase: (r.total, r.valid, r.excluded, r.correlation) for r in profiles.spearman(df, "phase", ["a"], ["x"]).collect()}
    assert got == {"all": (2, 0, 2, None), "AM": (1, 0, 1, None)}


def test_packed_columns_come_back():
    rng = np.random.default_rng(2)
    few = rng.choice(rng.integers(-2 ** 62, 2 ** 62, 300), 5000)
    for a in (few, rng.integers(-2 ** 62, 2 ** 62, 1000), np.zeros(0, np.int64), np.array([rank_pairs.NOTHING, 2 ** 63 - 1]), few.astype(np.int32), np.zeros(9, np.uint8)):
        assert (rank_pairs.unpack(rank_pairs.pack(a)) == a).all()
        assert (rank_pairs.unpack(rank_pairs.pack(np.sort(a), True)) == np.sort(a)).all()
    assert len(rank_pairs.pack(few)[2][3]) < 2 * len(few)
