"""Score slices, paired block bootstrap and comparison tables."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock
from ..functions.values import count_if


def error_summary(df: DataFrame, actual: str, model: str, reference: str, groups=(), ts: str = "ts") -> DataFrame:
    """Errors of a model and relative improvement over a reference; undefined when that one is perfect."""
    e, r = F.col(model) - F.col(actual), F.col(reference) - F.col(actual)
    out = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct(F.col(ts).cast("date")).alias("dates"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(F.abs(r)).alias("__rm"), F.sqrt(F.avg(r * r)).alias("__rr"))
    for name, base in (("mae", "__rm"), ("rmse", "__rr")):
        out = out.withColumn(f"{name}_improvement_pct", F.when(F.col(base) != 0, 100.0 * (F.col(base) - F.col(name)) / F.col(base)))
    return out.drop("__rm", "__rr")


def long_models(df: DataFrame, models) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in models])
    keep = [c for c in df.columns]
    return df.select(*keep, F.inline(rows))


def score_slices(df: DataFrame, actual: str, origin: str, reference: str, models, rapid: float = 100.0, groups=(),
                 ts: str = "ts") -> DataFrame:
    """Scores over overlapping slices: all, rapid change, zero or generating, season, year."""
    a, o = F.col(actual), F.col(origin)
    tags = F.array_compact(F.array(
        F.lit("all_daytime"), F.when(F.abs(a - o) >= rapid, F.lit("rapid_change")),
        F.when(a == 0, F.lit("target_recorded_zero")), F.when(a > 0, F.lit("target_generating")),
        F.when(o == 0, F.lit("origin_recorded_zero")), F.when(o > 0, F.lit("origin_generating")),
        F.concat(F.lit("season_"), clock.season(ts)), F.concat(F.lit("year_"), F.year(ts).cast("string"))))
    long = long_models(df.withColumn("__ref", F.col(reference)), models).withColumn("slice", F.explode(tags))
    return error_summary(long, actual, "prediction", "__ref", [*groups, "slice", "model"], ts)


def block_sums(df: DataFrame, actual: str, model: str, reference: str, groups=(), ts: str = "ts") -> DataFrame:
    """Per calendar week: rows and summed absolute and squared errors of both sides."""
    e, r = F.col(model) - F.col(actual), F.col(reference) - F.col(actual)
    return df.groupBy(*groups, clock.week_start(ts).alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).alias("mae"), F.sum(F.abs(r)).alias("pmae"),
        F.sum(e * e).alias("mse"), F.sum(r * r).alias("pmse"))


def draw_index(draw: Column, position: Column, seed: int, blocks: Column) -> Column:
    """Reproducible block number: a 32-bit piece of a digest, modulo the number of blocks."""
    digest = F.md5(F.concat_ws("|", draw.cast("string"), position.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % blocks


def paired_intervals(df: DataFrame, actual: str, model: str, reference: str, groups=(), draws: int = 2000, seed: int = 17,
                     ts: str = "ts") -> DataFrame:
    """Paired week-block bootstrap of the MAE saving and the relative improvements.

    The data are reduced to weekly sums first. Each draw of a group is one row with the group's short
    list of weeks; which of them it takes comes from a hash of draw and position, and their sums
    are folded inside the row, so no table of draws by weeks is ever made.
    """
    keys, names = list(groups), ("n", "mae", "pmae", "mse", "pmse")
    sums = block_sums(df, actual, model, reference, keys, ts)
    week = F.struct("week", *[F.col(c).cast("double").alias(c) for c in names])
    lists = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.sort_array(F.collect_list(week)).alias("__weeks"))
    drawn = lists.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))

    def add(total, position):
        taken = F.get("__weeks", draw_index(F.col("draw"), position, seed, F.col("blocks")).cast("int"))
        return F.struct(*[(total[c] + taken[c]).alias(c) for c in names])

    none = F.struct(*[F.lit(0.0).alias(c) for c in names])
    folded = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), none, add)
    t = drawn.select(*keys, "draw", "blocks", folded.alias("__s")).select(*keys, "draw", "blocks", "__s.*")
    ok = F.col("pmae") > 0
    saving = (F.col("pmae") - F.col("mae")) / F.col("n")
    relative = F.when(ok, 100.0 * (F.col("pmae") - F.col("mae")) / F.when(ok, F.col("pmae")))
    root = F.sqrt(F.col("pmse") / F.col("n"))
    rms = F.when(ok & (root > 0), 100.0 * (root - F.sqrt(F.col("mse") / F.col("n"))) / F.when(root > 0, root))
    t = t.select(*keys, "blocks", saving.alias("s"), relative.alias("r"), rms.alias("q"), (~ok).cast("double").alias("u"))
    cols = [F.first("blocks").alias("blocks")]
    for name, c in (("mae_saving", "s"), ("mae_improvement", "r"), ("rmse_improvement", "q")):
        cols += [F.percentile(c, F.lit(0.025)).alias(f"{name}_lower"), F.percentile(c, F.lit(0.975)).alias(f"{name}_upper")]
    return t.groupBy(*keys).agg(*cols, F.avg("u").alias("undefined_fraction"))


def pairwise(df: DataFrame, actual: str, pairs, groups=(), draws: int = 2000, seed: int = 17, ts: str = "ts") -> DataFrame:
    """Several (model, reference) pairs in one pass: errors and intervals."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(r).alias("reference"), F.col(m).alias("__m"), F.col(r).alias("__r"))
                     for m, r in pairs])
    long = df.select(*groups, ts, actual, F.inline(rows))
    keys = [*groups, "model", "reference"]
    return error_summary(long, actual, "__m", "__r", keys, ts).join(
        paired_intervals(long, actual, "__m", "__r", keys, draws, seed, ts), keys)


def comparison_table(scores: DataFrame, direct: str = "direct", corrected: str = "correction", error: str = "day_mae") -> DataFrame:
    """Per family, the error of both approaches and their difference; families on one side stay."""
    a = scores.where(F.col("approach") == direct).select("family", F.col(error).alias("direct_mae"))
    b = scores.where(F.col("approach") == corrected).select("family", F.col(error).alias("correction_mae"))
    return a.join(b, "family", "full_outer").withColumn("correction_minus_direct", F.col("correction_mae") - F.col("direct_mae"))


def score_mismatches(found: DataFrame, recorded: DataFrame, keys, columns, tolerance: float = 1e-9) -> DataFrame:
    """Recorded scores that do not recompute within a tolerance, or exist on one side only."""
    b = recorded.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__r"))
    both = found.withColumn("__f", F.lit(True)).join(b, list(keys), "full_outer")
    one = F.col("__f").isNull() | F.col("__r").isNull()
    return both.agg(F.count(F.lit(1)).alias("rows"), count_if(one).alias("unpaired"),
                    *[count_if(F.abs(F.col(c) - F.col(f"__{c}")) > tolerance).alias(f"differs_{c}") for c in columns])


def consolidate(phases: dict, keys) -> DataFrame:
    """Union of result tables of several phases."""
    out = None
    for name, df in phases.items():
        part = df.withColumn("phase", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def check_consolidated(table: DataFrame, keys, expected_rows: int | None = None) -> DataFrame:
    """Refuse duplicate keys and an unexpected row count."""
    if table.groupBy("phase", *keys).count().where("count > 1").limit(1).collect():
        raise ValueError("duplicate result keys")
    if expected_rows is not None and table.count() != expected_rows:
        raise ValueError("unexpected number of result rows")
    return table
