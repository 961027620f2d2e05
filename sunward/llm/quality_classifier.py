"""Quality classifier: cumulative-link regression on graded ratings over hashed text (operator 1).

Grades are ordered. One weight a hashed token gives a text a score, and ordered thresholds cut
the line of scores: P(grade >= k) is the logistic function of score minus threshold k. All
grades share the weights, so a few graded rows of one grade help to place the others. The
expected grade is the sum of those tails; selection asks for one tail.

The model is fitted on a bounded sample of graded rows, chosen by a hash of the id; every
document is scored in one narrow pass.
"""

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import LOWER_BYTES, WordHashes, arrow_pass, release, stored

BITS = 18
#: Documents scored at a time.
BATCH = 512
#: Most graded rows that are fitted on; of each its whole text.
SAMPLE = 20_000
#: A token must stand in so many sampled rows to have a weight.
LEAST_ROWS = 5
#: Standard errors by which the share of some grade or better among a token's rows must differ from that of all rows.
APART = 4.5
#: Bytes of the beginnings of words that are tokens too: rare words of one stem share their evidence.
STEMS = (5, 7)
PENALTY, STEP, ROUNDS = 1e-4, 0.1, 400
#: Numbers that the fit works on at a time.
BLOCK = 1 << 19
#: Documents are selected if P(grade >= GOOD) is at least this.
GOOD, SELECT = 2, 0.5

_TOKENS = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x00-\x20\x7f]+")
_WORDS = WordHashes()


def features(text: bytes | None) -> np.ndarray:
    """Ascending distinct buckets of a text's tokens: words and their beginnings, runs of signs, and how often a token follows itself."""
    if not text:
        return np.zeros(0, np.int64)
    row = _TOKENS.findall(text.translate(LOWER_BYTES))
    tokens, again = set(row), sum(map(eq, row, row[1:]))
    tokens |= {b"\x01" + w[:n] for n in STEMS for w in tokens if len(w) > n}
    if again > 2:
        tokens.add(b"\x00again %d" % (10 * again // len(row)))
    return np.unique((_WORDS.of(list(tokens)) >> np.uint64(64 - BITS)).astype(np.int64))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each row."""
        score = np.array([self.weights[r].sum() for r in rows])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def objective(theta, column, bounds, grades, top, block=BLOCK):
    """Penalised mean of -log P(grade) and its gradient; ``theta``: weights, first threshold, logarithms of the gaps."""
    k, n = len(theta) - top, len(grades)
    w, gaps = theta[:k], np.exp(theta[k + 1:])
    cuts = theta[k] + np.concatenate([[0.0], np.cumsum(gaps)])
    loss, by_weight, by_cut = PENALTY * (w @ w) / 2, PENALTY * w, np.zeros(top + 2)
    at = 0
    while at < n:
        # as many rows as have about ``block`` numbers, so that no array as long as all of them is made
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + block, side="right")) - 1)
        own, rows = column[bounds[at]:bounds[to]], np.arange(to - at)
        owner = np.repeat(rows, np.diff(bounds[at:to + 1]))
        score = np.bincount(owner, w[own], minlength=to - at)
        tail = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -50, 50)))
        full = np.concatenate([np.ones((to - at, 1)), tail, np.zeros((to - at, 1))], axis=1)
        slope, g = full * (1 - full), grades[at:to]
        p = np.maximum(full[rows, g] - full[rows, g + 1], 1e-12)
        loss -= np.log(p).sum() / n
        # derivative of -log p by the score, and by each threshold
        by_score = -(slope[rows, g] - slope[rows, g + 1]) / p / n
        np.add.at(by_cut, g, slope[rows, g] / p / n)
        np.add.at(by_cut, g + 1, -slope[rows, g + 1] / p / n)
        by_weight += np.bincount(own, by_score[owner], minlength=k)
        at = to
    later = np.cumsum(by_cut[1:top + 1][::-1])[::-1]
    return loss, np.concatenate([by_weight, later[:1], later[1:] * gaps])


def fit(column: np.ndarray, bounds: np.ndarray, grades: np.ndarray, used: np.ndarray, top: int, rounds=ROUNDS) -> Model | None:
    """Maximum penalised likelihood by full-batch Adam; thresholds stay ordered by their gaps.

    Row i has the tokens ``column[bounds[i]:bounds[i + 1]]``, which are places in ``used``, the
    buckets that have a weight. None if there are fewer than two grades to tell apart.
    """
    if len(set(grades.tolist())) < 2:
        return None
    # start at the thresholds that the grades' shares alone give
    share = np.array([(np.sum(grades >= k) + 1) / (len(grades) + 2) for k in range(1, top + 1)])
    start = np.log((1 - share) / share)
    theta = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        _, gradient = objective(theta, column, bounds, grades, top)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        theta = theta - STEP * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float64)
    weights[used] = theta[:len(used)]
    return Model(weights, theta[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(used) + 1:]))]))


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade from the given labels: 0 bad text, 1 good text that is toxic, 2 good text.

    A row labelled more than once has its worst grade; NULL ids and labels are left out.
    """
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def sample(docs: DataFrame, graded: DataFrame, most=SAMPLE, seed=29) -> DataFrame:
    """Stored: doc_id, grade, features of the ``most`` graded rows that come first by a hash of their id."""
    first = graded.withColumn("order", F.xxhash64(F.lit(seed), "doc_id")).orderBy("order", "doc_id").limit(most).select("doc_id", "grade")

    def scan(batches):
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, len(b), BATCH)):
            found = [features(t).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "features"])

    # at most ``most`` rows of two numbers: a proven bound
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(first), "doc_id").select("doc_id", "grade", "text")
    found = arrow_pass(rows, scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade int, features array<int>")
    return stored(found.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("features").alias("features")), "graded")


def telling(rows: DataFrame, per_grade: dict[int, int]) -> DataFrame:
    """Buckets whose rows have a share of some grade or better that chance alone would not give.

    Each threshold is asked for itself: rows of a middle grade hardly move the mean of all grades.
    Counts are grouped sums, made in part before they are shuffled; at most 2^BITS buckets are left.
    """
    n, top = sum(per_grade.values()), max(per_grade)
    met = rows.select("grade", F.explode("features").alias("bucket"))
    reached = [F.sum((F.col("grade") >= k).cast("long")).alias(f"reached_{k}") for k in range(1, top + 1)]
    counts = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *reached)
    known = F.lit(False)
    for k in range(1, top + 1):
        mean = sum(c for g, c in per_grade.items() if g >= k) / n
        known = known | (F.abs(F.col(f"reached_{k}") / F.col("n") - mean) * F.sqrt("n") >= APART * (mean * (1 - mean)) ** 0.5)
    return counts.filter(known & (F.col("n") >= LEAST_ROWS)).select("bucket")


def train(docs: DataFrame, graded: DataFrame, most=SAMPLE) -> Model | None:
    """``graded`` has doc_id and grade (0, 1, ...). Two passes over the stored sample: the first counts
    (bucket, grade) in Spark, the second sends only telling buckets to the driver, four bytes each."""
    rows = sample(docs, graded, most)
    per_grade = {g: n for g, n in rows.groupBy("grade").count().collect()}
    if len(per_grade) < 2:
        release(rows)
        return None
    used = np.sort(np.asarray(telling(rows, per_grade).toArrow().column("bucket"), np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(used.astype(np.int32))

    def narrow(batches):
        for batch in batches:
            kept, tokens = sent.value, batch.column(2)
            values, lengths = np.asarray(tokens.flatten()), np.diff(np.asarray(tokens.offsets))
            place = np.searchsorted(kept, values)
            known = np.zeros(len(values), bool)
            if len(kept):
                known = kept[np.minimum(place, len(kept) - 1)] == values
            ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(place[known].astype(np.int32)))], ["doc_id", "grade", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # in the order of ids, so that sums of a repeated run round alike
    table = arrow_pass(rows, narrow, f"doc_id {kind}, grade int, tokens array<int>").orderBy("doc_id").select("grade", "tokens").toArrow()
    tokens = table.column("tokens")
    column = np.concatenate([np.zeros(0, np.int32), *[np.asarray(c.flatten()) for c in tokens.chunks]])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(np.asarray(c.offsets)) for c in tokens.chunks]).astype(np.int64))])
    grades = table.column("grade").to_numpy().astype(np.int64)
    del table, tokens
    release(rows)
    sent.destroy()
    return fit(column, bounds, grades, used, max(per_grade))


def scored(docs: DataFrame, model: Model | None, good=GOOD, select=SELECT) -> DataFrame:
    """The columns of ``docs`` and: expected_grade, tail (P(grade >= good)), kept.

    A text without tokens (NULL, empty, blanks) has grade 0, tail 0 and is not kept. Without a
    model (fewer than two grades to learn from) every other row is kept, with NULL grades.
    Rows are scored one by one: repeated rows get equal scores, an empty table stays empty.
    Columns of ``docs`` named like a result are replaced.
    """
    results = ("expected_grade", "tail", "kept")
    others = [c for c in docs.columns if c not in results]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "expected_grade double", "tail double", "kept boolean"])
    place = others.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        known = sent.value
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, len(b), BATCH)):
            rows = [features(None if t is None else t.encode()) for t in batch.column(place).to_pylist()]
            some = np.array([len(r) > 0 for r in rows], bool)
            if known is None:
                grade = tail = [None if s else 0.0 for s in some]
                kept = some
            else:
                tails = known.tails(rows) * some[:, None]
                grade, tail = tails.sum(axis=1), tails[:, min(good, tails.shape[1]) - 1]
                kept = tail >= select
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grade, pa.float64()), pa.array(tail, pa.float64()), pa.array(kept, pa.bool_())], [*others, *results])

    return arrow_pass(docs.select(*[f"`{c}`" for c in others]), scan, schema)
