"""Quantiles over many groupings of one table, from histograms that tasks hold.

Grouping one table by many label columns at once would repeat every row once a
column. Here a task counts its own rows instead: per (label column, label,
measure, bucket of values) it holds one number and gives it out once, at its
end. The counts of all tasks say in which bucket a wanted rank lies; a second
reading gives out only the values of those buckets.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

# Bits of a double's ordered code that are left out of its bucket: 1024 buckets between x and 2 x.
_LOW_BITS = 42
#: Bucket of missing and non-finite values.
NOTHING = -(1 << 40)


def buckets(values: np.ndarray) -> np.ndarray:
    """Order-preserving bucket numbers of doubles; missing and non-finite values are in ``NOTHING``."""
    bits = (values + 0.0).view(np.int64)  # one zero
    code = np.where(bits < 0, -(bits & np.int64(0x7FFFFFFFFFFFFFFF)), bits)
    return np.where(np.isfinite(values), code >> _LOW_BITS, NOTHING)


def _columns(table, labels: int):
    """Codes and labels of each label column."""
    for i in range(labels):
        coded = table.column(i).combine_chunks().dictionary_encode()
        coded = coded if isinstance(coded, pa.DictionaryArray) else coded.unify_dictionaries().combine_chunks()
        yield np.asarray(coded.indices.fill_null(len(coded.dictionary))), [*coded.dictionary.to_pylist(), None]


def _measures(table, labels: int) -> list:
    return [np.asarray(table.column(i).cast(pa.float64()).combine_chunks().fill_null(np.nan)) for i in range(labels, table.num_columns)]


#: Rows that a task works on at once.
_ROWS = 1 << 17


def _tables(batches):
    """The batches of a task, put together to some ``_ROWS`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


# A label's number and a bucket as one integer; buckets are 22 bits and a sign, NOTHING goes below all of them.
_SHIFT, _ZERO = 24, 1 << 23


def _keys(numbers: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (numbers.astype(np.int64) << _SHIFT) + np.maximum(bucket, 1 - _ZERO) + _ZERO


def _key_bucket(keys: np.ndarray) -> np.ndarray:
    bucket = (keys & ((1 << _SHIFT) - 1)) - _ZERO
    return np.where(bucket == 1 - _ZERO, NOTHING, bucket)


def _summed(keys: list, counts: list):
    """Distinct keys and the sums of their counts."""
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


def _count_task(dimensions, measures):
    """One row for each (dimension, bin, measure, bucket) that the task has met."""
    def run(batches):
        held, numbers = {}, {name: {} for name in dimensions}
        for table in _tables(batches):
            found = [np.unique(buckets(v), return_inverse=True) for v in _measures(table, len(dimensions))]
            for name, (codes, labels) in zip(dimensions, _columns(table, len(dimensions))):
                known = np.array([numbers[name].setdefault(x, len(numbers[name])) for x in labels])
                for measure, (distinct, place) in zip(measures, found):
                    pairs = codes.astype(np.int64) * len(distinct) + place
                    if len(labels) * len(distinct) <= 16 * _ROWS:
                        counts = np.bincount(pairs)
                        met = np.flatnonzero(counts)
                        n = counts[met]
                    else:
                        met, n = np.unique(pairs, return_counts=True)
                    keys = _keys(known[met // len(distinct)], distinct[met % len(distinct)])
                    if (name, measure) in held:
                        keys, n = _summed([held[name, measure][0], keys], [held[name, measure][1], n])
                    held[name, measure] = keys, n
        for (name, measure), (keys, n) in held.items():
            labels = pa.array(list(numbers[name]), pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(name, len(n)), labels.take(pa.array(keys >> _SHIFT)), pa.repeat(measure, len(n)), pa.array(_key_bucket(keys)), pa.array(n)],
                                             ["dimension", "bin", "measure", "bucket", "n"])
    return run


def _values_task(dimensions, measures, wanted):
    """Values (with their counts in some rows) that lie in a wanted bucket; ``wanted``: (dimension, bin, measure) -> buckets."""
    def run(batches):
        names = {d: {label: i for i, label in enumerate({b for n, b, _ in wanted if n == d})} for d in dimensions}
        asked = {(d, m): np.sort(np.concatenate([np.zeros(0, np.int64), *[_keys(np.full(len(at), names[d][b]), np.asarray(at)) for (n, b, x), at in wanted.items() if (n, x) == (d, m)]]))
                 for d in dimensions for m in measures}
        some = {m: np.unique(np.concatenate([np.zeros(0, np.int64), *[np.asarray(at) for (_, _, x), at in wanted.items() if x == m]])) for m in measures}
        for table in _tables(batches):
            values = []
            for measure, value in zip(measures, _measures(table, len(dimensions))):
                bucket = buckets(value)
                rows = np.flatnonzero(np.isin(bucket, some[measure]))
                values.append((rows, value[rows] + 0.0, bucket[rows]))
            for name, (codes, labels) in zip(dimensions, _columns(table, len(dimensions))):
                known = np.array([names[name].get(x, -1) for x in labels])
                order = pa.array(list(names[name]), pa.string())
                for measure, (rows, value, bucket) in zip(measures, values):
                    keys, mine = _keys(known[codes[rows]], bucket), asked[name, measure]
                    if len(mine) == 0:
                        continue
                    hit = mine[np.minimum(np.searchsorted(mine, keys), len(mine) - 1)] == keys
                    keys, inside = keys[hit], value[hit]
                    if len(keys):
                        by = np.lexsort((inside, keys))
                        keys, inside = keys[by], inside[by]
                        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (inside[1:] != inside[:-1])])
                        n, keys, inside = np.diff(np.r_[first, len(keys)]), keys[first], inside[first]
                        yield pa.RecordBatch.from_arrays([pa.repeat(name, len(n)), order.take(pa.array(keys >> _SHIFT)), pa.repeat(measure, len(n)), pa.array(_key_bucket(keys)), pa.array(inside), pa.array(n)],
                                                         ["dimension", "bin", "measure", "bucket", "value", "n"])
    return run


def grouped_quantiles(df: DataFrame, dimensions: dict, measures, probabilities) -> DataFrame:
    """Per (dimension, bin, measure): total, finite, and exact interpolated quantiles ``q0, q1, ...``.

    ``dimensions`` maps name -> label column. Rows leave neither reading repeated: the first gives
    out one number per label, measure and bucket and task, the second the values of the few buckets
    that hold a wanted rank. Those (at most two for each label, measure and probability) are
    read by the driver in between, so building this result runs a job.
    """
    measures, names = list(measures), list(dimensions)
    rows = df.select(*[c.cast("string").alias(f"__d{i}") for i, c in enumerate(dimensions.values())], *[F.col(m).cast("double").alias(f"__m{i}") for i, m in enumerate(measures)])
    group = ["dimension", "bin", "measure"]
    counts = rows.mapInArrow(_count_task(names, measures), "dimension string, bin string, measure string, bucket long, n long")
    counts = counts.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))
    order = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    finite = F.when(F.col("bucket") != NOTHING, F.col("n"))
    placed = counts.select("*", F.coalesce(F.sum(finite).over(order), F.lit(0)).alias("to"), F.sum("n").over(W.partitionBy(*group)).alias("total"), F.coalesce(F.sum(finite).over(W.partitionBy(*group)), F.lit(0)).alias("finite"))
    ranks = F.array(*[r((F.col("finite") - 1) * F.lit(float(p))) for p in probabilities for r in (F.floor, F.ceil)])
    low = F.col("to") - F.col("n")
    holds = F.exists(ranks, lambda r: (r >= low) & (r < F.col("to"))) & (F.col("bucket") != NOTHING)
    table = placed.withColumn("holds", holds).where(holds | (F.col("bucket") == NOTHING) | (F.col("to") == F.col("n"))).collect()
    wanted, starts, totals = {}, [], {}
    for r in table:
        totals[r.dimension, r.bin, r.measure] = (r.total, r.finite)
        if r.holds:
            wanted.setdefault((r.dimension, r.bin, r.measure), []).append(r.bucket)
            starts.append((r.dimension, r.bin, r.measure, r.bucket, r.to - r.n))
    spark = df.sparkSession
    values = rows.mapInArrow(_values_task(names, measures, {k: np.array(v) for k, v in wanted.items()}), "dimension string, bin string, measure string, bucket long, value double, n long")
    values = values.groupBy(*group, "bucket", "value").agg(F.sum("n").alias("n"))
    # a short list: two buckets at most for each label, measure and probability
    starts = F.broadcast(spark.createDataFrame(starts, "d string, b string, m string, at long, start long"))
    same = F.col("dimension").eqNullSafe(F.col("d")) & F.col("bin").eqNullSafe(F.col("b")) & (F.col("measure") == F.col("m")) & (F.col("bucket") == F.col("at"))
    inside = W.partitionBy(*group, "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    known = values.join(starts, same).withColumn("to", F.col("start") + F.sum("n").over(inside)).withColumn("from", F.col("to") - F.col("n"))
    sizes = F.broadcast(spark.createDataFrame([(*k, *v) for k, v in totals.items()], "dimension string, bin string, measure string, total long, finite long"))
    known = known.select("*").join(sizes.select(F.col("dimension").alias("d2"), F.col("bin").alias("b2"), F.col("measure").alias("m2"), "total", "finite"),
                                   F.col("dimension").eqNullSafe(F.col("d2")) & F.col("bin").eqNullSafe(F.col("b2")) & (F.col("measure") == F.col("m2")))
    at = lambda rank: F.max(F.when((rank >= F.col("from")) & (rank < F.col("to")), F.col("value")))
    cols = []
    for i, p in enumerate(probabilities):
        place = (F.col("finite") - 1) * F.lit(float(p))
        x, y = at(F.floor(place)), at(F.ceil(place))
        cols.append((x + (y - x) * F.max(place - F.floor(place))).alias(f"q{i}"))
    found = known.groupBy(*group).agg(*cols)
    other = found.select(*[F.col(c).alias(f"__{c}") for c in group], *[f"q{i}" for i in range(len(probabilities))])
    match = F.col("dimension").eqNullSafe(F.col("__dimension")) & F.col("bin").eqNullSafe(F.col("__bin")) & (F.col("measure") == F.col("__measure"))
    return sizes.join(other, match, "left").drop("__dimension", "__bin", "__measure")
