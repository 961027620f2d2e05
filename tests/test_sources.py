"""Files: scans, sinks, manifests and bounded ingestion."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sunward.operators import timeline
from sunward.sources import tables as src
from sunward.streaming import ingest as st


def test_csv_scan_is_strict_and_pruned(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("measured_on,x,y\n2024-01-01 00:00:00,1.5,\n2024-01-01 00:05:00,2.5,3\n")
    df = src.read_wide_csv(spark, str(path), ["x", "y"], ["measured_on", "y"])
    rows = timeline.strict_parse(df, "measured_on").orderBy("ts").collect()
    assert rows[0].y is None and rows[1].y == 3.0
    path2 = tmp_path / "b.csv"
    path2.write_text("measured_on,x\n2024-01-01 00:00:00,oops\n")
    with pytest.raises(Exception):
        src.read_wide_csv(spark, str(path2), ["x"]).collect()


def test_metadata_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "m.json"
    body = {"Metrics": {"11": {"units": "kW", "sensor_name": "s", "scale": 1.0, "offset": 0.0}}}
    path.write_text("﻿" + json.dumps(body), encoding="utf-8")
    row = src.read_metadata(spark, str(path)).first()
    assert row.metric_id == "11" and row.units == "kW"


def test_sink_refuses_to_overwrite_and_counts(spark, tmp_path):
    df = spark.range(100).withColumn("u", (F.col("id") % 3).cast("string"))
    path = str(tmp_path / "t")
    src.write_table(df, path, ["u"])
    with pytest.raises(Exception):
        src.write_table(df, path, ["u"])
    assert src.check_row_count(spark.read.parquet(path), 100).count() == 100
    with pytest.raises(ValueError):
        src.check_row_count(spark.read.parquet(path), 99)
    assert set(src.column_names(spark, path)) == {"id", "u"}


def test_manifest_sees_changes(spark, tmp_path):
    rows = spark.range(2000).withColumn("v", F.col("id") * 7 % 1000)
    rows.where("id < 1000").coalesce(1).write.parquet(str(tmp_path / "d" / "one"))
    rows.where("id >= 1000").coalesce(1).write.parquet(str(tmp_path / "d" / "two"))
    before = src.manifest(spark, str(tmp_path / "d")).collect()
    assert len(before) == 2 and all(r.digest and r.records == 1000 for r in before)
    # one value differs and the file is as long as before
    changed = spark.createDataFrame(before).withColumn("digest", F.when(F.col("path").contains("/one/"), F.lit("other")).otherwise(F.col("digest")))
    changes = src.manifest_changes(spark.createDataFrame(before), changed).collect()
    assert {(r.state, "/one/" in r.path) for r in changes} == {("before", True), ("after", True)}
    kept = src.manifest(spark, str(tmp_path / "d" / "one")).first().digest
    rows.where("id < 1000").withColumn("v", F.when(F.col("id") == 5, F.lit(36)).otherwise(F.col("v"))).coalesce(1).write.parquet(str(tmp_path / "e"))
    assert src.manifest(spark, str(tmp_path / "e")).first().digest != kept
    rows.where("id < 1000").orderBy(F.desc("id")).coalesce(1).write.parquet(str(tmp_path / "f"))
    assert src.manifest(spark, str(tmp_path / "f")).first().digest == kept


def test_rows_written_in_another_order_are_no_change(spark, tmp_path):
    rows = spark.range(2000).select("id", (F.col("id") * 7919 % 1000).alias("v"))
    for name, order in (("a", "id"), ("b", "v")):
        rows.orderBy(order, "id").coalesce(1).write.parquet(str(tmp_path / name))
    a, b = (src.manifest(spark, str(tmp_path / name)) for name in "ab")
    assert a.first().length != b.first().length
    assert src.manifest_changes(a, b, F.lit("t")).count() == 0
    other = b.withColumn("digest", F.lit("other"))
    assert sorted(r.state for r in src.manifest_changes(a, other, F.lit("t")).collect()) == ["after", "before"]


def test_resume_and_selection(spark):
    plan = spark.createDataFrame([(1, "a"), (2, "b")], "id int, f string")
    assert [r.id for r in src.pending(plan, plan.where("id = 1"), ["id"]).collect()] == [2]
    assert src.select_one(plan, id=2).first().f == "b"
    with pytest.raises(ValueError):
        src.select_one(plan, id=3)


def test_bounded_ingestion_resumes(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.range(0, 96).select((F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.expr("make_dt_interval(0, 0, cast(id * 5 as int), 0)")).alias("ts"),
                                     F.col("id").cast("double").alias("v"))
    rows.where("v < 48").write.parquet(source)
    stream = st.new_files(spark, source, rows.schema, 1).where("v % 2 = 0")
    st.append_available(stream, sink, mark)
    assert spark.read.parquet(sink).count() == 24
    rows.where("v >= 48").write.mode("append").parquet(source)
    st.append_available(stream, sink, mark)
    out = spark.read.parquet(sink)
    assert out.count() == 48 and out.select("v").distinct().count() == 48


def test_manifest_of_two_schemas_an_empty_file_and_text(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    two = spark.createDataFrame([(1, 5.0), (2, 7.0)], "x int, z double")
    states = []
    for name, z, extra in (("before", 5.0, "k\n"), ("after", 6.0, "k\nk\n")):
        root = tmp_path / name
        one.coalesce(1).write.parquet(str(root / "t"))
        two.withColumn("z", F.when(F.col("x") == 1, F.lit(z)).otherwise(F.col("z"))).coalesce(1).write.mode("append").parquet(str(root / "t"))
        one.limit(0).coalesce(1).write.parquet(str(root / "none"))
        two.withColumn("x", F.col("x").cast("string")).coalesce(1).write.parquet(str(root / "clash"))
        one.coalesce(1).write.mode("append").parquet(str(root / "clash"))
        (root / "notes.txt").write_text(extra)
        states.append((src.manifest(spark, str(root)), src.digest_leaves(spark, str(root), rows=1)))
    rows = states[0][0].collect()
    assert len(rows) == 6 and sorted(r.records for r in rows) == [0, 1, 2, 2, 2, 2]
    tables = F.regexp_extract("path", r"/(t|none|clash|notes)[^/]*(/[^/]*)?$", 1)
    changed = {r.path for r in src.manifest_changes(states[0][0], states[1][0], tables).collect()}
    assert changed == {"t", "notes"}
    where = {(r.path, r.column) for r in src.changed_columns(*[x.withColumn("path", tables).groupBy("path", "block", "column").agg(*[F.sum(c).alias(c) for c in ("records", *src.WORDS)]) for _, x in states]).collect()}
    assert where == {("t", "z"), ("t", "*"), ("notes", "lines"), ("notes", "*")}


def test_fingerprint_of_parts_adds_up(spark):
    rows = spark.createDataFrame([(i % 3, f"v{i % 7}") for i in range(60)] + [(None, None)] * 3, "k int, v string")
    part = rows.withColumn("no", F.monotonically_increasing_id()).withColumn("part", F.col("no") % 4)
    of = lambda df: src.fingerprint(df, ["k", "v"], ["k"])
    known, added, removed = part.where("part < 3"), part.where("part = 3"), part.where("part = 1")
    found = src.fingerprint_after(of(known), of(added), of(removed), ["k"])
    assert sorted(map(str, found.collect())) == sorted(map(str, of(part.where("part <> 1")).collect()))
    nothing = src.fingerprint_after(of(known), of(added), of(part), ["k"])
    assert nothing.count() == 0
    whole = lambda df: src.fingerprint(df, ["k", "v"])
    assert src.fingerprint_after(whole(known), whole(added), whole(removed)).first() == whole(part.where("part <> 1")).first()


def test_words_of_leaves_are_those_of_the_digests(spark, tmp_path):
    rows = [(i, None if i % 3 == 0 else "x" * (i % 5)) for i in range(50)]
    spark.createDataFrame(rows, "a long, b string").repartition(2, "a").write.parquet(str(tmp_path / "t"))
    leaves = src.digest_leaves(spark, str(tmp_path / "t"), rows=7)
    assert " conv(" not in leaves._jdf.queryExecution().optimizedPlan().toString()  # words are summed as arrays
    assert leaves.where("column = 'a'").agg(F.max("records")).first()[0] == 7
    field = lambda v: "-" if v is None else f"{len(str(v))}:{v}"
    texts = {"a": [field(a) for a, _ in rows], "b": [field(b) for _, b in rows], src.WHOLE_ROW: [field(a) + field(b) for a, b in rows]}
    for r in src.summed(leaves, ["column"]).collect():
        digests = [hashlib.md5(x.encode()).hexdigest() for x in texts.pop(r.column)]
        assert [r.records, *[r[w] for w in src.WORDS]] == [50, *[sum(int(d[8 * i:8 * i + 8], 16) for d in digests) for i in range(4)]]
    assert not texts
