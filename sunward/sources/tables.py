"""Scans, sinks and content checks."""

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def wide_schema(channels, key: str = "measured_on") -> T.StructType:
    """String label plus one double per channel."""
    return T.StructType([T.StructField(key, T.StringType())]
                        + [T.StructField(c, T.DoubleType()) for c in channels])


def read_wide_csv(spark: SparkSession, path, channels, columns=None) -> DataFrame:
    """Fixed-schema CSV scan that fails on a malformed record; only ``columns`` are parsed."""
    df = spark.read.schema(wide_schema(channels)).option("header", True).option("mode", "FAILFAST").csv(path)
    return df if columns is None else df.select(*columns)


def read_text_csv(spark: SparkSession, path, columns) -> DataFrame:
    """Every field kept as the characters in the file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def parse_csv_lines(lines: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """Fixed-schema parse of CSV records held in a column."""
    parsed = F.from_csv(text, schema.simpleString()[7:-1].replace(":", " "), {"mode": "FAILFAST"})
    return lines.select(parsed.alias("r")).select("r.*")


def to_number(text) -> Column:
    """Diagnostic numeric reading of a text field; NULL when it is no number."""
    name = text if isinstance(text, str) else None
    return F.expr(f"try_cast(`{name}` AS double)") if name else F.try_to_number(text)


METRIC = T.StructType([
    T.StructField("units", T.StringType()), T.StructField("sensor_name", T.StringType()),
    T.StructField("scale", T.DoubleType()), T.StructField("offset", T.DoubleType())])


def read_metadata(spark: SparkSession, path) -> DataFrame:
    """One row per metric of a system metadata document."""
    schema = T.StructType([T.StructField("Metrics", T.MapType(T.StringType(), METRIC))])
    document = spark.read.schema(schema).option("multiLine", True).json(path)
    return document.select(F.explode("Metrics").alias("metric_id", "m")).select("metric_id", "m.*")


def explode_json_map(df: DataFrame, text: str, keep, value_type: T.DataType) -> DataFrame:
    """Key/value rows of a JSON object column."""
    parsed = F.from_json(text, T.MapType(T.StringType(), value_type))
    return df.select(*keep, F.explode(parsed).alias("key", "value"))


def read_series(spark: SparkSession, path, columns, label: str = "measured_on", where: Column | None = None):
    """Projected, filtered Parquet scan with a parsed wall-clock label."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    df = df.select(*columns)
    if label in df.columns and isinstance(df.schema[label].dataType, T.StringType):
        df = df.withColumn("ts", F.try_to_timestamp(F.col(label), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))
        df = df.drop(label)
    return df


def column_names(spark: SparkSession, path) -> list:
    """Names from the schema alone; no row is read."""
    return spark.read.parquet(path).columns


def check_row_count(df: DataFrame, recorded: int, what: str = "table") -> DataFrame:
    """Compare the stored row count with the recorded one and refuse a mismatch."""
    found = df.count()
    if found != recorded:
        raise ValueError(f"{what} has {found} rows, {recorded} were recorded")
    return df


def write_table(df: DataFrame, path, partition_by=(), rows_per_file: int = 0) -> None:
    """Snappy Parquet that refuses to replace an existing table.

    With ``partition_by`` rows are brought together by key, and Spark splits a heavy key by its
    bytes, so it is written by as many tasks as it needs.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode("errorifexists").option("compression", "snappy")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_summary(df: DataFrame, path) -> None:
    """Small result as one headed CSV file."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def provenance(inputs: DataFrame, counts: DataFrame, settings: dict, policy: dict) -> DataFrame:
    """Sidecar rows ``kind, name, content``: a row for each input file and each count, one for settings and one for policy."""
    files = inputs.select(F.lit("input").alias("kind"), F.col("path").alias("name"), F.to_json(F.struct(*[c for c in inputs.columns if c != "path"])).alias("content"))
    names = F.concat_ws("/", *[F.col(c).cast("string") for c in counts.columns[:-1]])
    rows = counts.select(F.lit("count").alias("kind"), names.alias("name"), F.to_json(F.struct(*counts.columns)).alias("content"))
    fixed = inputs.sparkSession.createDataFrame(
        [(kind, kind, json.dumps(value, sort_keys=True)) for kind, value in (("settings", settings), ("policy", policy))], "kind string, name string, content string")
    return files.unionByName(rows).unionByName(fixed)


#: Rows of a block: the finest part of a file that has a digest of its own.
BLOCK_ROWS = 1 << 20
#: Name under which whole rows stand beside the columns, and lines of files that are not Parquet.
WHOLE_ROW, LINES = "*", "lines"


def list_files(spark: SparkSession, path) -> DataFrame:
    """path, length, modificationTime of every file, empty ones too; no content is read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listing.select("path", "length", "modificationTime")


def _folder(path: str) -> str:
    """The folder of a table's part; folders named key=value are inside of it."""
    folder = path.rpartition("/")[0]
    while "=" in folder.rpartition("/")[2]:
        folder = folder.rpartition("/")[0]
    return folder


def _scans(spark: SparkSession, names) -> list:
    """One scan for each folder of parts whose schemas agree, and one for each schema among other files."""
    parts, alone, out = {}, [], []
    for name in names:
        if name.rpartition("/")[2].startswith("part-"):
            parts.setdefault(_folder(name), []).append(name)
        else:
            alone.append(name)
    for files in parts.values():
        try:
            out.append(spark.read.option("mergeSchema", True).parquet(*files))
        except Py4JJavaError as error:
            if "CANNOT_MERGE_SCHEMAS" not in str(error):
                raise
            alone += files  # one name, two types
    schemas = {}
    for name in alone:
        schemas.setdefault(spark.read.parquet(name).schema.json(), []).append(name)
    return out + [spark.read.parquet(*files) for files in schemas.values()]


def digest_leaves(spark: SparkSession, path, rows: int = BLOCK_ROWS) -> DataFrame:
    """Leaves of the digest tree: path, block, column, records and the four summed words of the column's digests.

    One scan for each table (a folder of parts under the schema its files have together, or files of
    one schema), and one for all files that are not Parquet, by lines. A column that a file does
    not have counts as NULL there. Words of a file, or of a column, are sums of its leaves' words.
    """
    names = [r.path for r in list_files(spark, path).select("path").collect()]  # names only, as any scan holds them
    found = [_leaves(df, rows) for df in _scans(spark, [n for n in names if n.endswith(".parquet")])]
    others = [n for n in names if not n.endswith(".parquet")]
    if others:
        found.append(_leaves(spark.read.text(others).withColumnRenamed("value", LINES), None))
    none = spark.createDataFrame([], "path string, block long, column string, records long, word1 long, word2 long, word3 long, word4 long")
    return reduce(DataFrame.unionByName, found) if found else none


def _leaves(df: DataFrame, rows: int | None) -> DataFrame:
    columns = df.schema.fields
    text = {f.name: F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`").cast("string") for f in columns}
    given = [*text, WHOLE_ROW]
    block = F.lit(0).cast("long") if rows is None else F.floor(F.col("_metadata.row_index") / rows)
    # each text is used twice and twice again: columns of their own are worked out once
    texts = df.select(F.col("_metadata.file_path").alias("path"), block.alias("block"), *[c.alias(f"__t{i}") for i, c in enumerate(text.values())])
    fields = texts.select("path", "block", *[_behind_length(F.col(f"__t{i}")).alias(f"__f{i}") for i in range(len(text))])
    behind = [F.col(f"__f{i}") for i in range(len(text))]
    digests = fields.select("path", "block", F.unhex(F.concat(*[F.md5(c) for c in (*behind, F.concat(*behind))])).alias("digests"))
    parts = digests.mapInArrow(_sum_task(len(given)), "path string, block long, records long, words array<long>")
    sums = parts.groupBy("path", "block").agg(F.sum("records").alias("records"), *[F.sum(F.get("words", F.lit(4 * i + k))).alias(f"__{i}_{k}") for i in range(len(given)) for k in range(4)])
    leaf = [F.struct(F.lit(name).alias("column"), *[F.col(f"__{i}_{k}").alias(w) for k, w in enumerate(WORDS)]) for i, name in enumerate(given)]
    return sums.select("path", "block", "records", F.inline(F.array(*leaf))).select("path", "block", "column", "records", *WORDS)


def _sum_task(columns: int):
    """One row for each file and block that the task has met: its rows and the summed words of each column's digests.

    Reading words out of hex digests one by one is most of the work otherwise.
    """
    def run(batches):
        held = {}
        for batch in batches:
            path, block, digests = batch.column(0).dictionary_encode(), np.asarray(batch.column(1)), batch.column(2).cast(pa.binary())
            if not len(block):
                continue
            _, offsets, data = digests.buffers()
            start = int(np.frombuffer(offsets, np.int32)[digests.offset])
            words = np.frombuffer(data, ">u4", len(block) * 4 * columns, start).reshape(len(block), -1)
            codes = np.asarray(path.indices)
            # rows of a file and block follow each other
            first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (block[1:] != block[:-1])])
            for low, high in zip(first.tolist(), [*first[1:].tolist(), len(block)]):
                key = path.dictionary[int(codes[low])].as_py(), int(block[low])
                records, known = held.get(key, (0, 0))
                held[key] = records + high - low, known + words[low:high].sum(axis=0, dtype=np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), pa.array([k[1] for k in held]), pa.array([n for n, _ in held.values()]), pa.array([w for _, w in held.values()], pa.list_(pa.int64()))],
                                             ["path", "block", "records", "words"])
    return run


def summed(leaves: DataFrame, keys) -> DataFrame:
    """Nodes of the digest tree above the leaves: by file, by column, by any ``keys``."""
    return leaves.groupBy(*keys).agg(F.sum("records").alias("records"), *[F.sum(w).alias(w) for w in WORDS])


def manifest(spark: SparkSession, path, leaves: DataFrame | None = None) -> DataFrame:
    """Path, length, modification time, rows and content digest of every file, whatever its size, schema or kind.

    The digest is that of the file's node in the tree of :func:`digest_leaves`: it does not depend on
    the order of rows, and any change of a value, a column or a row changes it. Files without rows
    are listed with none.
    """
    files = list_files(spark, path)
    node = F.sha2(F.concat_ws("/", *[F.col(c).cast("string") for c in ("column", "records", *WORDS)]), 256)
    nodes = summed(digest_leaves(spark, path) if leaves is None else leaves, ["path", "column"]).withColumn("node", node)
    # as many nodes as the file has columns
    roots = nodes.groupBy(F.col("path").alias("__path")).agg(F.max("records").alias("records"), F.sha2(F.concat_ws("/", F.sort_array(F.collect_list("node"))), 256).alias("digest"))
    # a listing and a scan may write a local path with one or three signs
    same = F.regexp_replace(F.col("path"), "^file:/+", "file:/") == F.regexp_replace(F.col("__path"), "^file:/+", "file:/")
    empty = F.sha2(F.lit(""), 256)
    return files.join(roots, same, "left").select("path", "length", "modificationTime", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("digest", empty).alias("digest"))


def manifest_changes(before: DataFrame, after: DataFrame, name: Column | None = None) -> DataFrame:
    """Files that appeared, vanished or changed between two manifests.

    ``name`` says what a file is called in both states where their folders differ. Parquet files with
    rows are told apart by content alone: the same rows take another length when they are
    written in another order, which differs from run to run of a large write.
    """
    shown = F.col("path") if name is None else name
    length = F.when(~F.col("path").endswith(".parquet") | (F.col("records") == 0), F.col("length")).alias("length")
    a, b = [state.select(shown.alias("path"), length, "records", "digest") for state in (before, after)]
    return (a.exceptAll(b).withColumn("state", F.lit("before"))
            .unionByName(b.exceptAll(a).withColumn("state", F.lit("after")))).drop("records")


def changed_columns(before: DataFrame, after: DataFrame, name: Column | None = None) -> DataFrame:
    """Where two sets of leaves differ: path, block, column and the records of both (NULL where there is none)."""
    shown = F.col("path") if name is None else name
    digest = F.struct("records", *WORDS)
    a = before.select(shown.alias("path"), "block", "column", digest.alias("before"))
    b = after.select(shown.alias("path"), "block", "column", digest.alias("after"))
    both = a.join(b, ["path", "block", "column"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.select("path", "block", "column", F.col("before.records").alias("records_before"), F.col("after.records").alias("records_after"))


#: The four words of a row digest.
WORDS = ("word1", "word2", "word3", "word4")


def _behind_length(text: Column) -> Column:
    """A field behind its length; a NULL field is a single sign no length has, so different rows give different texts."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _words(digest: Column) -> list:
    """The summed 32-bit words of a column of hex digests."""
    return [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")) for i in range(4)]


def fingerprint(df: DataFrame, columns, keys=()) -> DataFrame:
    """Order-independent content fingerprint: row count and the summed words of row digests.

    It is a digest of the multiset of rows, so the fingerprints of parts can be added and
    subtracted: see :func:`fingerprint_after`.
    """
    text = F.concat(*[_behind_length(F.col(c).cast("string")) for c in columns])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), *[w.alias(n) for w, n in zip(_words(F.md5(text)), WORDS)])


def fingerprint_after(known: DataFrame, added: DataFrame, removed: DataFrame, keys=()) -> DataFrame:
    """The fingerprint of a table after rows came and went, from its own and those of the rows alone.

    All three have the columns of :func:`fingerprint`; keys that no row is left of are dropped.
    """
    names = ("records", *WORDS)
    signed = [f.select(*keys, *[(sign * F.col(c)).alias(c) for c in names]) for f, sign in ((known, 1), (added, 1), (removed, -1))]
    out = reduce(DataFrame.unionByName, signed).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    return out.where("records > 0") if keys else out


def literal_ledger(spark: SparkSession, rows, schema) -> DataFrame:
    """A short approved list as a DataFrame."""
    return spark.createDataFrame(rows, schema)


def scenario_grid(df: DataFrame, axes: dict) -> DataFrame:
    """Every combination of short literal axes, for each row of ``df``."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def pending(plan: DataFrame, ledger: DataFrame, keys) -> DataFrame:
    """Planned work that the saved ledger does not hold yet."""
    return plan.join(ledger.select(*keys).distinct(), list(keys), "left_anti")


def select_one(df: DataFrame, **criteria) -> DataFrame:
    """The single row that meets exact criteria; anything else is an error."""
    for name, value in criteria.items():
        df = df.where(F.col(name) == F.lit(value))
    found = df.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found)} rows match {criteria}, exactly one is needed")
    return df
