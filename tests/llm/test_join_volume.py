"""What the n-gram join moves and leaves on disk."""

import time

import numpy as np
import pytest

from sunward.llm import jaccard_join
from sunward.llm.shared import stored


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in manager.getAllFiles().mkString(" ").split() if "shuffle_" in name}


@pytest.fixture(scope="module")
def ring(spark):
    """Texts that share half with either neighbour, so that their rare grams meet and they are not similar; the last is a near copy of the first."""
    parts = [" ".join(f"p{k}w{i}" for i in range(100)) for k in range(40)]
    texts = [f"{parts[k]} {parts[(k + 1) % 40]}" for k in range(40)]
    return spark.createDataFrame([*enumerate(texts), (40, texts[0] + " own")], "doc_id long, text string").repartition(3).cache()


def test_only_sets_that_may_be_similar_move(spark, ring, monkeypatch):
    plans, sizes = {}, {}

    def spy(df, label):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        out = stored(df, label)
        sizes.setdefault(label, out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", spy)
    _, parts, links = jaccard_join.similar_classes(ring)
    assert parts.select("part").distinct().count() == 40 and links.count() == 1
    assert "hashpartitioning" not in plans["gram-sets"]  # sets stay where they were read
    assert sizes["gram-pairs"] > 20 and 1 <= sizes["gram-close"] < 5


def test_shuffle_files_go_with_their_jobs(spark, ring, monkeypatch):
    key, during = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", set()

    def spy(df, label):
        during.add(spark.conf.get(key))
        return stored(df, label)

    monkeypatch.setattr(jaccard_join, "stored", spy)
    ring.count()
    before, setting = shuffle_files(spark), spark.conf.get(key)
    jaccard_join.similar_classes(ring)
    for _ in range(40):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.25)
    assert during == {"true"} and shuffle_files(spark) <= before and spark.conf.get(key) == setting


def test_bitmaps_of_sets_refuse_no_similar_pair():
    rng = np.random.default_rng(3)
    refused = 0
    for n in [1, 2, 3, 7, 40, 255, 256, 257, 900] * 20:
        a = np.unique(rng.integers(0, 2 ** 64, n, np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.6, 1)], rng.integers(0, 2 ** 64, int(rng.integers(1, n // 4 + 2)), np.uint64)]))
        cells = [np.frombuffer(jaccard_join.set_cells(x), np.uint8) for x in (a, b)]
        may_be = jaccard_join.may_be_similar(len(a), cells[0], len(b), cells[1])
        assert may_be or not jaccard_join.similar(a, b)
        refused += not may_be
    assert refused > 20


def test_cells_come_back_from_their_gaps():
    for cells in ([], [0], [5, 6, 300, 70_000, 4_000_000]):
        again = np.arange(len(cells)) % 2 == 1
        data = np.frombuffer(jaccard_join.packed_cells(np.array(cells, np.int64), again), np.uint8)
        met, flags = jaccard_join.unpacked_cells(data)
        assert met.tolist() == cells and flags.tolist() == again.tolist()
