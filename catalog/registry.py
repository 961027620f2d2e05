"""Registered queries: one Spark callable each, and SQL for the ones SQL can say."""

from dataclasses import dataclass
from typing import Callable, Optional

from pyspark.sql import DataFrame, functions as F, types as T

from sunward.session import prepare

QUERIES: dict = {}


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable
    sql: Optional[str]
    covers: tuple


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles and widen integers so both engines compare bit for bit."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c + F.lit(1e-9), 5)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def wrap_sql(body: str, doubles: str, longs: str, dates: str) -> str:
    swaps = [f"round(CAST({c} AS DOUBLE) + 1e-9, 5) AS {c}" for c in doubles.split()]
    swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
    swaps += [f"CAST({c} AS TIMESTAMP) AS {c}" for c in dates.split()]
    if not swaps:
        return body
    return f"SELECT * REPLACE ({', '.join(swaps)}) FROM (\n{body}\n) AS answer"


def query(name: str, sql: str | None = None, d: str = "", i: str = "", t: str = "", covers=()):
    """Register a query; ``d``/``i``/``t`` name the double, integer and date outputs."""
    def add(run):
        text = None if sql is None else wrap_sql(sql, d, i, t)
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        ids = tuple(covers) or (name.split("_")[0].upper(),)
        QUERIES[name] = Query(name, lambda spark, path: tidy(run(Tables(prepare(spark), path))), text, ids)
        return run
    return add


class Tables:
    """The given parquet tables of one directory, read lazily."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def __getattr__(self, name):
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")
