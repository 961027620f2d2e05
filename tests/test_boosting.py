"""Boosted trees against a plain search for splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunward.operators import boosting


def plain_tree(x, slope, leaves, l2, least):
    """Best leaf first by trying every cut of every leaf; x: bins."""
    gain_of = lambda g: g.sum() ** 2 / (len(g) + l2)

    def best(rows):
        out = (0.0, None)
        for f in range(x.shape[1]):
            for cut in range(x[:, f].max()):
                a = x[rows, f] <= cut
                if a.sum() >= least and (~a).sum() >= least:
                    gain = (gain_of(slope[rows[a]]) + gain_of(slope[rows[~a]]) - gain_of(slope[rows])) / 2
                    if gain > out[0] + 1e-12:
                        out = (gain, (f, cut))
        return out

    parts = [np.arange(len(x))]
    while len(parts) < leaves:
        found = [best(rows) for rows in parts]
        i = max(range(len(parts)), key=lambda i: found[i][0])
        if found[i][1] is None:
            break
        f, cut = found[i][1]
        rows = parts.pop(i)
        parts += [rows[x[rows, f] <= cut], rows[x[rows, f] > cut]]
    return parts


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 0] > 0.3, 4.0, 0.0) + np.where(x[:, 1] > 0, x[:, 0], 0) + rng.normal(0, .1, 400)
    frame = spark.createDataFrame([(*map(float, a), float(b), i) for i, (a, b) in enumerate(zip(x, y))], "a double, b double, c double, y double, id long").repartition(3)
    return x, y, frame


@pytest.mark.parametrize("leaves, l2, least", [(2, 0.0, 1), (6, 1.0, 10), (31, 50.0, 5)])
def test_first_tree_is_that_of_a_plain_search(data, leaves, l2, least):
    x, y, frame = data
    model = boosting.fit_boosted(frame, ["a", "b", "c"], "y", steps=1, rate=1.0, leaves=leaves, l2=l2, least=least, bins=16)
    bins = model.binned(x)
    want = plain_tree(bins.astype(int), y.mean() - y, leaves, l2, least)
    expected = np.zeros(len(y))
    for rows in want:
        expected[rows] = y.mean() + (y[rows] - y.mean()).sum() / (len(rows) + l2)
    got = {r.id: r.p for r in model.predict(frame, "p").collect()}
    assert sum(f < 0 for f in model.trees[0].feature) == len(want) <= leaves
    assert np.allclose([got[i] for i in range(len(y))], expected)


def test_steps_go_on_across_refreshes(data, monkeypatch):
    x, y, frame = data
    options = dict(steps=7, rate=.3, leaves=5, l2=1.0, least=5, bins=16)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    a = boosting.fit_boosted(frame, ["a", "b", "c"], "y", **options)
    monkeypatch.setattr(boosting, "REFRESH", 100)
    b = boosting.fit_boosted(frame, ["a", "b", "c"], "y", **options)
    assert np.allclose(a.score(a.binned(x)), b.score(b.binned(x)))
    errors = [np.mean((y - a.base - a.score(a.binned(x), a.trees[:k])) ** 2) for k in range(8)]
    assert all(later < before for before, later in zip(errors, errors[1:])) and errors[-1] < errors[0] / 8


def test_missing_features_labels_and_constants(spark):
    rows = [(None, 1.0, 2.0), (1.0, 1.0, 2.0), (2.0, 1.0, None), (float("nan"), 1.0, 8.0)] * 10
    frame = spark.createDataFrame(rows, "a double, b double, y double")
    model = boosting.fit_boosted(frame, ["a", "b"], "y", steps=3, rate=1.0, least=1, l2=0.0)
    got = model.predict(frame.withColumn("z", F.lit(1))).collect()
    assert len(got) == 40 and all(np.isfinite(r.prediction) for r in got)


def test_interrupted_searches_refit_nothing(data, tmp_path, monkeypatch):
    from sunward.operators import learners as ml
    _, _, frame = data
    rows = frame.withColumn("day", F.lit(True))
    fitted, plain = [], ml.fit_prepared
    monkeypatch.setattr(ml, "fit_prepared", lambda ready, label, family, config, pre: fitted.append((family, config)) or plain(ready, label, family, config, pre))
    plan = [("r0", "ridge", {"alpha": 1.0}), ("bad", "unknown", {}), ("r1", "ridge", {"alpha": 50.0})]
    ledger = ml.Ledger(frame.sparkSession, str(tmp_path / "trials"), ml.TRIAL)
    assert ledger.done() == set()
    ml.run_search(rows, rows, ["a", "b", "c"], "y", plan[:2], "y", "day", ledger=ledger, parallel=2)
    assert len(fitted) == 2
    found = {r.id: r for r in ml.run_search(rows, rows, ["a", "b", "c"], "y", plan, "y", "day", ledger=ledger).collect()}
    assert [f[1] for f in fitted[2:]] == [{"alpha": 50.0}] and {i: r.status for i, r in found.items()} == {"r0": "complete", "bad": "failed", "r1": "complete"}
    ml.run_search(rows, rows, ["a", "b", "c"], "y", plan, "y", "day", ledger=ledger)
    assert len(fitted) == 3 and found["r0"].rank == 0 and found["r1"].rank == 2
    folds = [("one", F.col("id") < 200, F.col("id") >= 200)]
    scores = ml.Ledger(frame.sparkSession, str(tmp_path / "folds"), ml.FOLD, ("fold", "family", "config"))
    for plan in ([("ridge", {"alpha": 1.0})], [("ridge", {"alpha": 1.0}), ("ridge", {"alpha": 9.0})]):
        out = ml.select_models(rows, ["a", "b", "c"], "y", "a", folds, plan, ledger=scores)
    assert out.count() == 3 and len(fitted) == 5
