"""Preprocessing and Spark ML regression, selection and trial ledgers."""

import hashlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressionModel,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.errors import Pair
from ..functions.values import beside, count_if
from .ordered import exact_quantiles

SEED = 17
FAMILIES = ("ridge", "forest", "histogram", "boosted")


def training_medians(train: DataFrame, columns) -> DataFrame:
    """Exact median per column as one row; an all-missing column gets 0."""
    found = exact_quantiles(train, [], {f"{c}__median": (c, .5) for c in columns})
    return found.select(*[F.coalesce(f"{c}__median", F.lit(0.0)).alias(f"{c}__median") for c in columns])


def impute(df: DataFrame, medians: DataFrame, columns) -> DataFrame:
    """Fill from training medians; a 0/1 indicator per column, present or not."""
    joined = beside(df, medians)
    rest = [c for c in df.columns if c not in columns]
    return joined.select(*rest, *[F.coalesce(F.col(c), F.col(f"{c}__median")).alias(c) for c in columns],
                         *[F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in columns])


def scaling(train: DataFrame, columns) -> DataFrame:
    """Mean and population deviation per column as one row; constants scale by 1."""
    return train.agg(*[F.avg(c).alias(f"{c}__mean") for c in columns],
                     *[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}__sd") for c in columns])


def standardise(df: DataFrame, scales: DataFrame, columns) -> DataFrame:
    joined = beside(df, scales)
    rest = [c for c in df.columns if c not in columns]
    return joined.select(*rest, *[((F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__sd")).alias(c) for c in columns])


@dataclass
class Preprocessor:
    """Training-only medians and scales, kept as one-row tables."""

    columns: tuple
    medians: DataFrame
    scales: DataFrame = None
    vector: str = "features"
    outputs: tuple = field(default=())

    def transform(self, df: DataFrame, scaled: bool = False) -> DataFrame:
        out = impute(df, self.medians, self.columns)
        if scaled:
            out = standardise(out, self.scales, self.outputs)
        return VectorAssembler(inputCols=list(self.outputs), outputCol=self.vector).transform(out)


def _frozen(row: DataFrame) -> DataFrame:
    """Evaluate a one-row table once, so later transforms do not rescan the training data."""
    return row.sparkSession.createDataFrame(row.limit(1).collect(), row.schema)


def fit_preprocessor(train: DataFrame, columns) -> Preprocessor:
    columns = tuple(columns)
    medians = _frozen(training_medians(train, columns))
    outputs = columns + tuple(f"{c}__missing" for c in columns)
    scales = _frozen(scaling(impute(train, medians, columns), outputs))
    return Preprocessor(columns, medians, scales, outputs=outputs)


def estimator(family: str, config: dict, label: str, features: str = "features"):
    """Spark ML estimator of a family; tree defaults are 200 trees or steps."""
    common = dict(labelCol=label, featuresCol=features, predictionCol="prediction")
    if family == "forest":
        return RandomForestRegressor(seed=SEED, numTrees=config.get("trees", 200), maxDepth=config.get("depth", 12),
                                     minInstancesPerNode=config.get("leaf", 5), maxMemoryInMB=512,
                                     featureSubsetStrategy=config.get("subset", "all"), **common)
    if family in ("histogram", "boosted"):
        return GBTRegressor(seed=SEED, maxIter=config.get("steps", 200), stepSize=config.get("rate", 0.05),
                            maxDepth=config.get("depth", 4 if family == "histogram" else 5), maxMemoryInMB=512,
                            minInstancesPerNode=config.get("leaf", 20 if family == "histogram" else 1), **common)
    raise ValueError(f"unknown family: {family}")


def fit_ridge(df: DataFrame, label: str, alpha: float, features: str = "features"):
    """Penalised least squares, ``alpha`` times the squared weights added to the squared error.

    The normal-equation solver scales its penalty by the label deviation and
    the row count, which is undone here.
    """
    row = df.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
    penalty = alpha * (row["s"] or 1.0) / max(row["n"], 1)
    return LinearRegression(labelCol=label, featuresCol=features, predictionCol="prediction", elasticNetParam=0.0,
                            standardization=False, solver="normal", regParam=penalty).fit(df)


@dataclass
class Fitted:
    family: str
    preprocessor: Preprocessor
    model: object

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        keep = df.columns
        ready = self.preprocessor.transform(df.select("*", *[F.col(c).alias(f"__keep_{c}") for c in self.preprocessor.columns]),
                                            self.family == "ridge")
        scored = self.model.transform(ready)
        names = [F.col(f"__keep_{c}").alias(c) if c in self.preprocessor.columns else F.col(c) for c in keep]
        return scored.select(*names, F.col("prediction").alias(out))

    def save(self, path: str) -> None:
        """Model, medians and scales below ``path``, a folder that all executors share."""
        self.model.write().overwrite().save(f"{path}/model")
        self.preprocessor.medians.write.mode("overwrite").parquet(f"{path}/medians")
        self.preprocessor.scales.write.mode("overwrite").parquet(f"{path}/scales")
        about = [(self.family, list(self.preprocessor.columns), list(self.preprocessor.outputs))]
        spark = self.preprocessor.medians.sparkSession
        spark.createDataFrame(about, "family string, columns array<string>, outputs array<string>").write.mode("overwrite").parquet(f"{path}/about")


def load_model(spark, path: str) -> Fitted:
    """What :meth:`Fitted.save` has stored."""
    about = spark.read.parquet(f"{path}/about").first()
    kind = {"ridge": LinearRegressionModel, "forest": RandomForestRegressionModel}.get(about.family, GBTRegressionModel)
    rows = {name: _frozen(spark.read.parquet(f"{path}/{name}")) for name in ("medians", "scales")}
    pre = Preprocessor(tuple(about.columns), rows["medians"], rows["scales"], outputs=tuple(about.outputs))
    return Fitted(about.family, pre, kind.load(f"{path}/model"))


def fit_model(train: DataFrame, columns, label: str, family: str, config: dict, pre: Preprocessor | None = None) -> Fitted:
    """Fit one family on rows whose label is known."""
    train = train.where(F.col(label).isNotNull())
    pre = pre or fit_preprocessor(train, columns)
    return fit_prepared(pre.transform(train, family == "ridge").select("features", label), label, family, config, pre)


def fit_prepared(ready: DataFrame, label: str, family: str, config: dict, pre: Preprocessor) -> Fitted:
    """Fit one family on a table of ``features`` (scaled for ridge) and label."""
    model = fit_ridge(ready, label, config.get("alpha", 10.0)) if family == "ridge" else estimator(family, config, label).fit(ready)
    return Fitted(family, pre, model)


def fold_score(df: DataFrame, actual: str, prediction: str) -> dict:
    p = Pair(actual, prediction)
    return df.agg(p.count().alias("n"), p.mae().alias("mae"), p.rmse().alias("rmse")).first().asDict()


TRIAL = ("id string, family string, config string, rank long, status string, message string, day_n long, "
         "day_mae double, day_rmse double, all_mae double")
FOLD = "fold string, family string, config string, n long, mae double, rmse double"


class Ledger:
    """Results of trials, one file each in a shared folder: a trial is there as a whole or not at all.

    A trial's file appears when its write is committed, so what an interrupted run has left half
    done is simply done again, and nothing that is there is.
    """

    def __init__(self, spark, folder: str, schema: str, keys=("id",)):
        self.spark, self.folder, self.schema, self.keys = spark, folder.rstrip("/"), schema, tuple(keys)

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(self.folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def done(self) -> set:
        return {tuple(r) for r in self.rows().select(*self.keys).collect()}  # a short list: one row a trial

    def put(self, row: dict) -> None:
        names = [f.split()[0] for f in self.schema.split(", ")]
        name = hashlib.md5("|".join(str(row[k]) for k in self.keys).encode()).hexdigest()
        self.spark.createDataFrame([tuple(row[n] for n in names)], self.schema).coalesce(1).write.mode("overwrite").json(f"{self.folder}/trial-{name}")


def select_models(df: DataFrame, columns, label: str, persistence: str, folds, plan, constrain=None, ledger: Ledger | None = None):
    """Score a plan of ``(family, config)`` over expanding folds, beside a persistence row.

    ``folds`` is a list of (name, train condition, valid condition). A ``ledger`` (of FOLD rows by
    fold, family and config) receives each score when it is there, and what it holds is not fitted again.
    """
    rows, done = [], set() if ledger is None else ledger.done()

    def keep(row):
        rows.append(row)
        if ledger is not None:
            ledger.put(row)

    for name, train_on, valid_on in folds:
        train, valid = df.where(train_on).where(F.col(label).isNotNull()), df.where(valid_on).where(F.col(label).isNotNull())
        if (name, "persistence", "{}") not in done:
            base = valid.withColumn("__p", constrain(F.col(persistence)) if constrain else F.col(persistence))
            keep(dict(fold=name, family="persistence", config="{}", **fold_score(base, label, "__p")))
        pre = None
        for family, config in plan:
            text = config_text(config)
            if (name, family, text) in done:
                continue
            pre = pre or fit_preprocessor(train, columns)
            scored = fit_model(train, columns, label, family, config, pre).predict(valid, "__raw")
            scored = scored.withColumn("__p", constrain(F.col("__raw")) if constrain else F.col("__raw"))
            keep(dict(fold=name, family=family, config=text, **fold_score(scored, label, "__p")))
    if ledger is not None:
        return ledger.rows()
    return df.sparkSession.createDataFrame([tuple(r[k] for k in ("fold", "family", "config", "n", "mae", "rmse")) for r in rows], FOLD)


def config_text(config: dict) -> str:
    import json
    return json.dumps(config, sort_keys=True)


def forecast_block(df: DataFrame, columns, label: str, family: str, config: dict, fitted_on: Column, issued: Column, out: str,
                   constrain=None) -> DataFrame:
    """Fit on earlier labels only, predict the issue block; rows without a label stay."""
    model = fit_model(df.where(fitted_on), columns, label, family, config)
    scored = model.predict(df.where(issued), out)
    return scored.withColumn(out, constrain(F.col(out))) if constrain else scored


# Fixed search spaces.
RIDGE_ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
SPACES = {
    "forest": {"depth": [6, 12, 18], "leaf": [5, 10, 20], "subset": ["0.5", "1.0"]},
    "histogram": {"rate": [0.03, 0.05, 0.1], "steps": [100, 200, 300], "leaf": [20, 50]},
    "boosted": {"rate": [0.03, 0.05, 0.1], "steps": [100, 200, 300], "depth": [3, 5, 7], "leaf": [1, 5, 10]},
}
BASELINES = {
    "forest": {"depth": 12, "leaf": 5, "subset": "1.0"},
    "histogram": {"rate": 0.05, "steps": 200, "leaf": 20},
    "boosted": {"rate": 0.05, "steps": 200, "depth": 5, "leaf": 1},
}


def search_plan(spark, seed: int = SEED, sampled: int = 11) -> DataFrame:
    """Deterministic candidate plan: the ridge grid, and per tree family the
    baseline plus configurations drawn by hashed order."""
    base = spark.range(1)
    ridge = base.select(F.explode(F.array(*[F.lit(a) for a in RIDGE_ALPHAS])).alias("a"))
    out = ridge.select(F.lit("ridge").alias("family"), F.concat(F.lit("alpha="), F.col("a").cast("string")).alias("config"),
                       (F.col("a") == 10.0).alias("baseline"))
    for family, space in SPACES.items():
        grid = base
        for name, values in space.items():
            grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
        text = F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in space])
        standard = "|".join(f"{n}={BASELINES[family][n]}" for n in space)
        grid = grid.select(F.lit(family).alias("family"), text.alias("config")).withColumn("baseline", F.col("config") == standard)
        drawn = grid.where(~F.col("baseline")).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "config")), "config").limit(sampled)
        out = out.unionByName(grid.where("baseline")).unionByName(drawn)
    return out


def planned(plan: DataFrame) -> list:
    """A plan's candidates as ``(id, family, settings)``, baselines first in each family.

    A plan is a short list by construction, so its rows are read.
    """
    out, numbers = [], {}
    for row in plan.orderBy("family", F.desc("baseline"), "config").collect():
        settings = dict(part.split("=") for part in row.config.split("|"))
        settings = {k: v if k == "subset" else float(v) if k in ("alpha", "rate") else int(v) for k, v in settings.items()}
        numbers[row.family] = numbers.get(row.family, -1) + 1
        out.append((f"{row.family}_{numbers[row.family]:02d}", row.family, settings))
    return out


def run_search(train: DataFrame, valid: DataFrame, columns, label: str, plan, actual: str, day: str, compose=None, ledger: Ledger | None = None, parallel: int = 1):
    """Fit every planned candidate once; failures stay in the ledger with their message.

    ``plan`` is a list of (id, family, config); ``compose`` turns the raw prediction into the
    scored power. With a ``ledger`` each trial is written when it is over, trials that it holds
    are not fitted again, and its rows are returned. ``parallel`` trials are fitted side by
    side, on features that are prepared once.
    """
    known = train.where(F.col(label).isNotNull())
    finished = set() if ledger is None else {i for i, in ledger.done()}
    todo = [(order, *trial) for order, trial in enumerate(plan) if trial[0] not in finished]
    rows = []
    if todo:
        pre = fit_preprocessor(known, columns)
        ready = {scaled: pre.transform(known, scaled).select("features", label).persist(StorageLevel.DISK_ONLY) for scaled in (False, True)}

        def one(trial):
            order, name, family, config = trial
            row = dict(id=name, family=family, config=config_text(config), rank=order, status="complete", message=None,
                       day_n=None, day_mae=None, day_rmse=None, all_mae=None)
            try:
                scored = fit_prepared(ready[family == "ridge"], label, family, config, pre).predict(valid, "__raw")
                scored = scored.withColumn("__p", compose(F.col("__raw")) if compose else F.col("__raw"))
                light, every = Pair(actual, "__p", F.col(day)), Pair(actual, "__p")
                row.update(scored.agg(light.count().alias("day_n"), light.mae().alias("day_mae"), light.rmse().alias("day_rmse"),
                                      every.mae().alias("all_mae")).first().asDict())
            except Exception as problem:  # a failed trial is a result
                row.update(status="failed", message=str(problem))
            if ledger is not None:
                ledger.put(row)
            return row

        with ThreadPoolExecutor(parallel) as pool:
            rows = list(pool.map(one, todo))
        for table in ready.values():
            table.unpersist()
    if ledger is not None:
        return ledger.rows()
    names = [f.split()[0] for f in TRIAL.split(", ")]
    return train.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], TRIAL)


def winners(ledger: DataFrame) -> DataFrame:
    """Best complete trial per family; the earlier candidate on a tie."""
    pack = F.struct("id", "config", "day_mae")
    return ledger.where("status = 'complete'").groupBy("family").agg(
        F.min_by(pack, F.struct("day_mae", "rank")).alias("w")).select("family", "w.*")


def ledger_integrity(ledger: DataFrame, plan_ids: DataFrame, recorded: DataFrame) -> DataFrame:
    """Duplicates, incomplete trials, unequal populations, missing plan items and winners that do not recompute."""
    base = ledger.groupBy().agg(
        F.count(F.lit(1)).alias("trials"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("duplicate_ids"),
        count_if(F.col("status") != "complete").alias("incomplete"), F.count_distinct("day_n").alias("populations"))
    missing = plan_ids.select("id").distinct().join(ledger.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("missing_from_plan"))
    again = winners(ledger).select("family", F.col("id").alias("again"))
    wrong = again.join(recorded.select("family", F.col("id").alias("noted")), "family", "full_outer").agg(
        count_if(~F.col("again").eqNullSafe(F.col("noted"))).alias("winners_differ"))
    return beside(beside(base, missing), wrong)
