"""From documents to a sharded training mix: five stages, each on all that the one before kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from sunward.llm import decontamination, jaccard_join, mixing, quality_classifier, sharding
from sunward.llm.shared import DOCUMENT_COLUMNS, n_words, release, step_tables, stored, table

SHARDS = 40


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the best grade is under one half go, and those without text."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    graded = quality_classifier.grades_of(table(spark, sf_dir, "labels"))
    return quality_classifier.scored(docs, quality_classifier.train(docs, graded)).filter("kept").select(*DOCUMENT_COLUMNS)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return jaccard_join.one_row_of_each(docs.select(*DOCUMENT_COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in 20 stands in a window of the benchmark go."""
    return decontamination.decontaminated(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; documents repeat where the mix takes them again."""
    return mixing.mixed_documents(docs.select(*DOCUMENT_COLUMNS), n_words(F.col("text")))


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix with its shard and its place in it."""
    rows, _ = sharding.shard(docs, SHARDS)
    return rows


STAGES = [("quality", classify_quality), ("near_duplicates", join_near_duplicates), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", put_into_shards)]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with step_tables() as made:
            kept = stored(stage(spark, docs, sf_dir), name)
        release(docs, *[t for t in made if t is not kept])
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
