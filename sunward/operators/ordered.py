"""Order-dependent work without single-task windows.

A window over a whole device, or over a whole site, sorts everything that
shares the key in one task. The helpers here cut the ordered axis into
fixed-width chunks first, so a window only ever sees one chunk, and then
carry a summary row per chunk across chunk borders. Chunks are arithmetic
on the order key, so a lost task recomputes to the same answer.

``widths`` lists chunk sizes from fine to coarse. Each level summarises the
one below, so the last plain window sees (axis length / coarsest width) rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.values import beside, finite, is_finite

DAY = 86400
TIME_WIDTHS = (DAY, 60 * DAY)


def _chunk(order: str, width) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def join_null_safe(left: DataFrame, right: DataFrame, names, how="left") -> DataFrame:
    """Equi-join where NULL keys match; right-hand key copies are dropped."""
    other = right.select(*[F.col(n).alias(f"__k_{n}") if n in names else F.col(n) for n in right.columns])
    cond = reduce(lambda a, b: a & b, [left[n].eqNullSafe(other[f"__k_{n}"]) for n in names])
    return left.join(other, cond, how).drop(*[f"__k_{n}" for n in names])


def spread_join(left: DataFrame, right: DataFrame, keys, salts: int = 32, share: int = 200) -> DataFrame:
    """Inner equi-join of many rows with one row a key, where a few keys may hold most of the rows.

    Keys that hold more than one row in ``share`` are counted (there are fewer than ``share`` of
    them); their rows are dealt over ``salts`` parts, and the other side's row goes to each part.
    Both sides are shuffled by key and part: were the many rows broadcast, a heavy key would be joined
    where the copies of its one row are made.
    """
    keys = list(keys)
    per = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    heavy = per.where(F.col("__n") * share > per.agg(F.sum("__n").alias("a")).select("a").scalar()).select(*keys, F.lit(salts).alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    many = join_null_safe(left, F.broadcast(heavy), keys).withColumn("__salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("__parts")
    one = join_null_safe(right, F.broadcast(heavy), keys).withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return join_null_safe(many, one.hint("merge"), [*keys, "__salt"], "inner").drop("__salt")


def neighbours(df: DataFrame, keys, order: str, carry, widths=TIME_WIDTHS) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>`` for the adjacent rows of each key.

    ``order`` is a numeric column, unique within ``keys``; keys are not NULL.
    """
    keys, carry = list(keys), list(carry)
    cols = [F.col(c) for c in carry]
    if not widths:
        w = W.partitionBy(*keys).orderBy(order)
        for c in carry:
            df = df.withColumn(f"prev_{c}", F.lag(c).over(w)).withColumn(f"next_{c}", F.lead(c).over(w))
        return df
    chunk = f"__chunk{len(widths)}"
    df = df.withColumn(chunk, _chunk(order, widths[0]))
    part = keys + [chunk]
    w = W.partitionBy(*part).orderBy(order)
    packed = F.struct(*cols)
    edges = (
        df.groupBy(*part)
        .agg(F.min_by(packed, F.col(order)).alias("__first"), F.max_by(packed, F.col(order)).alias("__last"))
    )
    edges = neighbours(edges, keys, chunk, ["__first", "__last"],
                       tuple(x / widths[0] for x in widths[1:]))
    edges = edges.select(*part, F.col("prev___last").alias("__before"), F.col("next___first").alias("__after"))
    inner = df.withColumn("__prev", F.lag(packed).over(w)).withColumn("__next", F.lead(packed).over(w))
    joined = inner.join(edges, part, "left")
    for c in carry:
        joined = joined.withColumn(f"prev_{c}", F.coalesce(F.col("__prev"), F.col("__before"))[c])
        joined = joined.withColumn(f"next_{c}", F.coalesce(F.col("__next"), F.col("__after"))[c])
    return joined.drop(chunk, "__prev", "__next", "__before", "__after")


def running_total(df: DataFrame, keys, order: str, weight: str, name: str, widths=TIME_WIDTHS) -> DataFrame:
    """Add ``name``: the total of ``weight`` over strictly earlier rows of the key."""
    keys = list(keys)
    if not widths:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(weight).over(w), F.lit(0)))
    chunk, base, within = (f"__{x}{len(widths)}" for x in ("chunk", "base", "within"))
    df = df.withColumn(chunk, _chunk(order, widths[0]))
    part = keys + [chunk]
    sums = df.groupBy(*part).agg(F.sum(weight).alias("__sum"))
    sums = running_total(sums, keys, chunk, "__sum", base, tuple(x / widths[0] for x in widths[1:]))
    w = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inner = df.withColumn(within, F.coalesce(F.sum(weight).over(w), F.lit(0)))
    joined = join_null_safe(inner, sums.select(*part, base), part)
    return joined.withColumn(name, F.col(within) + F.col(base)).drop(chunk, within, base)


def numbered(df: DataFrame, keys, order: str, name: str, widths=TIME_WIDTHS) -> DataFrame:
    """Add a 0-based row number within ``keys`` by ``order`` (unique)."""
    out = running_total(df.withColumn("__one", F.lit(1).cast("long")), keys, order, "__one", name, widths)
    return out.drop("__one")


def islands(df: DataFrame, keys, order: str, step, widths=TIME_WIDTHS) -> DataFrame:
    """Maximal runs whose ``order`` advances by exactly ``step``.

    Returns ``keys, start, end, samples``. Runs are first found inside a
    chunk; only runs touching a chunk border go on to the next level.
    """
    keys = list(keys)
    level = df.select(*keys, F.col(order).alias("start"), F.col(order).alias("end"),
                      F.lit(1).cast("long").alias("samples"), F.lit(None).cast("double").alias("__done"))
    for width in [*widths, None]:
        place = F.floor(F.col("start") / width) if width else F.lit(0)
        level = level.withColumn("__chunk", F.when(F.col("__done").isNull(), place).cast("long"))
        w = W.partitionBy(*keys, "__chunk", "__done").orderBy("start")
        fresh = F.lag("end").over(w).isNull() | (F.lag("end").over(w) + F.lit(step) != F.col("start"))
        level = level.withColumn("__run", F.sum(fresh.cast("int")).over(
            w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        level = level.groupBy(*keys, "__chunk", "__done", "__run").agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sum("samples").alias("samples"))
        if width:
            low, high = F.col("__chunk") * width, (F.col("__chunk") + 1) * width
            closed = (F.col("start") - F.lit(step) >= low) & (F.col("end") + F.lit(step) < high)
            done = F.coalesce(F.col("__done"), F.when(closed, F.col("start").cast("double")))
            level = level.withColumn("__done", done)
        level = level.drop("__chunk", "__run")
    return level.drop("__done")


def condition_runs(df: DataFrame, keys, order: str, step, condition: Column, minimum=1, widths=TIME_WIDTHS):
    """Runs of rows meeting ``condition`` with exact ``step`` adjacency."""
    kept = islands(df.where(F.coalesce(condition, F.lit(False))), keys, order, step, widths)
    return kept.where(F.col("samples") >= minimum)


# Codes of doubles: a bucket holds 2^40 neighbouring codes, so a factor of two falls into 4096 buckets.
_BUCKET_BITS = 40
# Chunks of codes inside a bucket, and of buckets, in which running counts are taken.
_CODE_WIDTHS, _BUCKET_WIDTHS = (2.0 ** 14, 2.0 ** 27), (2.0 ** 12, 2.0 ** 18)


def _given(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def value_code(v: Column) -> Column:
    """Order-preserving integer of a finite double, one for each double.

    Exponent and the 52 bits behind it, as a signed number; both zeros are 0.
    """
    def from_parts(q):
        # the logarithm may be off by one next to a power of two
        over, under = (q["m"] >= 2).cast("int"), (q["m"] < 1).cast("int")
        m = q["m"] * F.element_at(F.array(F.lit(1.0), F.lit(0.5), F.lit(2.0)), 1 + over + 2 * under)
        normal = (q["g"] + over - under + 1023).cast("long") * F.lit(2 ** 52) + ((m - 1) * F.lit(2.0 ** 52)).cast("long")
        code = F.when(q["a"] < F.lit(2.0 ** -1022), (q["a"] / F.lit(5e-324)).cast("long")).otherwise(normal)
        return F.when(q["v"] > 0, code).when(q["v"] < 0, -code).when(q["v"] == 0, F.lit(0).cast("long"))

    def scaled(s):
        return F.struct(s["v"].alias("v"), s["a"].alias("a"), s["g"].alias("g"), (s["a"] / F.pow(F.lit(2.0), s["g"])).alias("m"))

    guess = F.least(F.floor(F.log2(F.abs(v))).cast("double"), F.lit(1023.0))
    return _given(_given(F.struct(v.alias("v"), F.abs(v).alias("a"), guess.alias("g")), scaled), from_parts)


def code_value(code: Column) -> Column:
    """The double of a code."""
    a = F.abs(code)
    high, low = F.shiftright(a, 52), a.bitwiseAND(F.lit(2 ** 52 - 1)).cast("double")
    normal = (low / F.lit(2.0 ** 52) + 1) * F.pow(F.lit(2.0), (high - 1023).cast("double"))
    return F.when(high > 0, normal).otherwise(low * F.lit(5e-324)) * F.when(code < 0, -1.0).otherwise(1.0)


def value_bucket(code: Column) -> Column:
    """The bucket of a value's code; buckets are bounded by the range of doubles, not by the rows."""
    return F.shiftright(code, _BUCKET_BITS)


def _inside(code: Column, bucket: Column) -> Column:
    """A code's place in its bucket, from 0."""
    return code - F.shiftleft(bucket, _BUCKET_BITS)


# Rank error of the summaries: one part in so many of a group's rows. Brackets allow for twice as much,
# and for two ranks more in groups of over SMALL_GROUP values; of smaller ones all values are inside.
SUMMARY_ACCURACY, SMALL_GROUP = 10_000, 2_000


def _brackets(rows: DataFrame, keys, values: dict, asks: dict) -> DataFrame:
    """Per key, as arrays by request: the number of values (``__n``) and two values between which the wanted ranks lie.

    The summaries are of bounded size and are merged before anything is shuffled; their rank error is
    guaranteed, so the brackets are sure and hold a few in a thousand of a large group's rows.
    """
    slack = 2.0 / SUMMARY_ACCURACY + 2.0 / SMALL_GROUP
    edges = {c: [x for p in asks[c] for x in (max(0.0, p - slack), min(1.0, p + slack))] for c in values}
    found = rows.groupBy(*keys).agg(*[x for c, v in values.items() for x in (
        F.count(v).alias(f"__n_{v}"), F.min(v).alias(f"__min_{v}"), F.max(v).alias(f"__max_{v}"), F.percentile_approx(v, F.array(*map(F.lit, edges[c])), F.lit(SUMMARY_ACCURACY)).alias(f"__e_{v}"))])
    places = [(v, i) for c, v in values.items() for i in range(len(asks[c]))]

    def edge(v, end, i):
        return F.when(F.col(f"__n_{v}") <= SMALL_GROUP, F.col(f"__{end}_{v}")).otherwise(F.get(f"__e_{v}", F.lit(i)))

    return found.select(*keys, F.array(*[F.col(f"__n_{v}") for v, _ in places]).alias("__n"),
                        F.array(*[edge(v, "min", 2 * i) for v, i in places]).alias("__lo"), F.array(*[edge(v, "max", 2 * i + 1) for v, i in places]).alias("__hi"))


def exact_quantiles(df: DataFrame, keys, wanted: dict) -> DataFrame:
    """Exact linearly interpolated quantiles per key, for groups of any size.

    ``wanted`` maps output name -> (column, probability); NULL, NaN and infinite values are
    skipped. A first pass brackets every wanted rank between two values of a mergeable summary.
    The second counts, by value, what lies inside of brackets and, by gap, what lies between them, in
    partial sums before the shuffle; no row is repeated for a probability, and only the values of
    brackets (a few in a thousand of a large group's rows) are put in order. Nothing runs before the
    result is asked for. Rows stay where they are: only brackets of groups of over SMALL_GROUP values
    are broadcast (at most one row for so many rows), and of other groups all values are inside.
    Groups without any value are absent from the result.
    """
    keys = list(keys)
    columns = sorted({c for c, _ in wanted.values()})
    asks = {c: sorted({float(p) for x, p in wanted.values() if x == c}) for c in columns}
    values = {c: f"__v{i}" for i, c in enumerate(columns)}
    rows = df.select(*keys, *[finite(F.col(c).cast("double")).alias(v) for c, v in values.items()])
    requests = [(c, p) for c in columns for p in asks[c]]
    brackets = _brackets(rows, keys, values, asks)
    large = F.broadcast(brackets.where(F.array_max("__n") > SMALL_GROUP))
    met = join_null_safe(rows, large, keys) if keys else beside(rows, brackets)

    def placed(j, c):
        # values inside of a bracket stand for themselves, all others only count in the gap they lie in
        v, mine = F.col(values[c]), [i for i, (x, _) in enumerate(requests) if x == c]
        inside = F.col("__n").isNull() | reduce(lambda a, b: a | b, [(v >= F.get("__lo", F.lit(i))) & (v <= F.get("__hi", F.lit(i))) for i in mine])
        gap = sum([(v > F.get("__hi", F.lit(i))).cast("int") for i in mine], F.lit(0))
        return F.struct(F.lit(j).alias("__j"), F.when(~inside, gap).alias("__gap"), F.when(inside, v).alias("__v"), v.alias("__x"))

    told = met.select(*keys, F.inline(F.array(*[placed(j, c) for j, c in enumerate(columns)]))).where("__x is not null")
    counts = told.groupBy(*keys, "__j", "__gap", "__v").agg(F.count(F.lit(1)).alias("__c"), F.min("__x").alias("__x"))
    column = W.partitionBy(*keys, "__j")
    upto = F.sum("__c").over(column.orderBy("__x").rowsBetween(W.unboundedPreceding, W.currentRow))
    counts = counts.withColumn("__to", upto).withColumn("__n", F.sum("__c").over(column)).withColumn("__from", F.col("__to") - F.col("__c"))

    def ranked(rank, j):
        return F.max(F.when((F.col("__j") == j) & (rank >= F.col("__from")) & (rank < F.col("__to")), F.col("__v")))

    def quantile(c, p):
        j, at = columns.index(c), (F.col("__n") - 1) * F.lit(p)
        x, y = ranked(F.floor(at), j), ranked(F.ceil(at), j)
        part = F.max(F.when(F.col("__j") == j, at - F.floor(at)))
        missed = part.isNotNull() & (x.isNull() | y.isNull())
        return F.when(missed, F.raise_error(F.lit("a wanted rank lies outside of its bracket")).cast("double")).otherwise(x + (y - x) * part)

    out = counts.groupBy(*keys).agg(*[quantile(c, float(p)).alias(n) for n, (c, p) in wanted.items()])
    return out if keys else out.where(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in wanted]))


def with_quantiles(grouped: DataFrame, df: DataFrame, keys, wanted: dict) -> DataFrame:
    """``grouped`` (one row per key) widened by :func:`exact_quantiles`."""
    found = exact_quantiles(df, keys, wanted)
    if not keys:
        return beside(grouped, found)
    return join_null_safe(grouped, found, list(keys))


def average_ranks(df: DataFrame, keys, value: str, name: str, weight: str | None = None) -> DataFrame:
    """Per distinct finite value: its average rank within the key, and its (weighted) count ``__c``."""
    keys = list(keys)
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(is_finite(value)).groupBy(*keys, value).agg(size.alias("__c"))
    counts = counts.withColumn("__k", value_code(F.col(value).cast("double"))).withColumn("__b", value_bucket(F.col("__k")))
    sums = counts.groupBy(*keys, "__b").agg(F.sum("__c").alias("__s"))
    sums = running_total(sums, keys, "__b", "__s", "__base", _BUCKET_WIDTHS)
    counts = counts.withColumn("__i", _inside(F.col("__k"), F.col("__b")))
    counts = running_total(counts, keys + ["__b"], "__i", "__c", "__in", _CODE_WIDTHS)
    out = join_null_safe(counts, sums.select(*keys, "__b", "__base"), keys + ["__b"])
    rank = F.col("__base") + F.col("__in") + (F.col("__c") + 1) / 2.0
    return out.withColumn(name, rank).select(*keys, value, name, "__c")
