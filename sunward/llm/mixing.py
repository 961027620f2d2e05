"""Mixing sources to target weights (operator 3).

Every row gets a key from a hash of its id and a seed, uniform in [0, 1). A source is the
sequence of its rows by key, cut into ranges of the key: a range's total is a plain grouped sum,
the totals' running sum over a source's ranges says before which words of the source a range
starts, and only inside the one range that holds the cut are rows sorted. So a source with a
third of all rows is spread over many ranges, and no row is moved to find out that its whole
range is taken or left.
"""

from pyspark.sql import DataFrame, Window, functions as F

from .shared import free_names, release, stored

#: Mean rows in a key range.
RANGE_ROWS = 4096
#: Hexadecimal digits of md5 that make the key: 13 digits are exact in a double.
DIGITS = 13


def mixing_key(id_column, seed: int):
    """A number in [0, 1) from md5 of the id and a seed."""
    text = F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16 ** DIGITS))


def weighted(sizes: DataFrame, weights) -> DataFrame:
    """Sources with weights repeating in the order of their code points, NULL last.

    The position of a source is the number of sources before it; the sources are one row each.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return sizes.select("*", at.alias("position")).select("*", F.element_at(cycle, (F.col("position") % len(weights) + 1).cast("int")).alias("weight"))


def fill_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Targets in proportion to weight, none above ``most`` times its source's size.

    The level is the words per weight once the sources that stop at their limit are taken out:
    by ascending limit per weight, the first k sources are at their limit when the level that
    the others would have reaches them. ``share`` of all words is given out.
    """
    limit = F.lit(most) * F.col("source_size")
    order = Window.orderBy(F.col("limit") / F.col("weight"), "position")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    at = sources.withColumn("limit", limit)
    at = at.select("*", F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("full"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("gone"),
                   (F.sum("source_size").over(everything) * F.lit(share)).alias("words"), F.sum("weight").over(everything).alias("weights"))
    at = at.withColumn("level", (F.col("words") - F.col("full")) / (F.col("weights") - F.col("gone")))
    # the first source whose own limit is above the level ends the filling
    holds = F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.struct(F.col("limit") / F.col("weight"), F.col("position"), F.col("level").alias("level")))
    at = at.withColumn("water", F.min(holds).over(everything)["level"])
    target = F.coalesce(F.least(F.col("limit"), F.col("water") * F.col("weight")), F.col("limit"))
    return at.select("source", "source_size", target.alias("target"))


def source_plan(rows: DataFrame, weights, share, most) -> tuple[DataFrame, DataFrame]:
    """Per source its target, whole epochs, rest and number of key ranges; and the ranges that hold the cuts.

    ``rows`` has source, size and key. The second table has at most one row a source: the range
    in which the running words reach the rest, and the words before that range.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = fill_targets(weighted(per, weights), share, most)
    plan = plan.join(per.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE_ROWS)).cast("long")
    plan = plan.select("*", epochs.alias("epochs"), ranges.alias("ranges"))
    plan = stored(plan.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mix-plan")
    totals = in_ranges(rows, plan).groupBy("source", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    start = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("words"))
    cuts = totals.withColumn("start", start).filter(cut).select("source", F.col("range").alias("cut_range"), F.col("start").alias("cut_start"))
    return plan, stored(cuts, "mix-cuts")


def by_source(left: DataFrame, right: DataFrame, how="inner") -> DataFrame:
    """Join a table of one row a source; Spark broadcasts it when it is small, by its own measure."""
    right = right.withColumnRenamed("source", "mix_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("mix_source")), how).drop("mix_source")


def in_ranges(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return by_source(rows, plan).withColumn("range", F.floor(F.col("key") * F.col("ranges")).cast("long"))


def mix(docs: DataFrame, size, weights=(3, 1, 2), share=1.5, most=2.0, seed=17) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, taken, key.

    ``size`` is a column expression over ``docs`` (its words). ``taken`` is what the mix takes of
    the row: whole epochs, and in the last epoch the rows in the order of their keys up to the
    source's exact budget, the whole part of its target; the row at the cut gives the words up
    to the cut.

    NULL sources are one source, last in order; a NULL id has the key of an empty string. Ties
    in the key (equal ids) are ordered by id, then size; repeated rows are told apart only by
    their place in that order, so the rows returned are the same whatever the order they came
    in. Rows of size 0 take 0 words and none of the target. An empty table gives an empty table.
    """
    rows = docs.select("doc_id", "source", size.cast("long").alias("size")).withColumn("key", mixing_key(F.col("doc_id"), seed))
    rows = stored(rows, "mix-rows")
    plan, cuts = source_plan(rows, weights, share, most)
    placed = by_source(in_ranges(rows, plan), cuts, "left")
    inside = F.coalesce(F.col("range") == F.col("cut_range"), F.lit(False))
    before = F.col("range") < F.coalesce("cut_range", F.lit(0))
    outside = placed.filter(~inside).withColumn("part", F.when(before, F.col("size")).otherwise(F.lit(0)))
    ordered = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("cut_start") - F.coalesce(F.sum("size").over(ordered), F.lit(0))
    split = placed.filter(inside).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long")
    return outside.unionByName(split).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "key")


def mixed_documents(docs: DataFrame, size, weights=(3, 1, 2), share=1.5, most=2.0, seed=17) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as the mix takes it, whole.

    The last epoch of a source ends after the key whose running words are nearest to the rest of
    its budget, so a source is off its target by at most half of that key's words. Only ids,
    sizes and keys are shuffled; a text meets its source's cut in a join with one row a source.
    Equal ids share a key and are taken or left together. Rows without words are in no mix.
    NULLs and empty tables: as ``mix``. The names of other columns are free: those used in between
    are chosen beside them.
    """
    rows = docs.select("doc_id", "source", size.cast("long").alias("size")).withColumn("key", mixing_key(F.col("doc_id"), seed))
    rows = stored(rows, "mix-rows")
    plan, cuts = source_plan(rows, weights, share, most)
    inside = by_source(in_ranges(rows, plan), cuts).filter(F.col("range") == F.col("cut_range"))
    keys = inside.groupBy("source", "key").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("cut_start", "rest", "range", "ranges")])
    ordered = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ends = keys.withColumn("end", F.col("cut_start") + F.sum("words").over(ordered))
    none = keys.select("source", (F.col("range") / F.col("ranges") - F.lit(1e-15)).alias("key"), F.col("cut_start").alias("end"), "rest").distinct()
    ends = ends.select("source", "key", "end", "rest").unionByName(none)
    last = ends.groupBy("source").agg(F.min_by("key", F.struct(F.abs(F.col("end") - F.col("rest")), F.col("key"))).alias("last_key"))
    of, epochs, end, copies, epoch = free_names(docs.columns, "mix_plan", 5)
    take = by_source(plan.select("source", "epochs"), stored(last, "mix-last"), "left").select(
        F.col("source").alias(of), F.col("epochs").alias(epochs), F.coalesce("last_key", F.lit(-1.0)).alias(end))
    release(rows)
    times = F.col(epochs) + (mixing_key(F.col("doc_id"), seed) <= F.col(end)).cast("long")
    chosen = docs.filter(size > 0).join(take, F.col("source").eqNullSafe(F.col(of))).withColumn(copies, times).filter(F.col(copies) > 0)
    return chosen.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[f"`{c}`" for c in docs.columns])
