"""The table layer with two writers, merges by files, and schemas."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType, StructField, StructType

from millrace.operators import schema
from millrace.operators.schema import SchemaMismatch
from millrace.operators.tables import ConcurrentCommit, LakeTable, first_of_key


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string")


def _values(lake):
    return sorted(tuple(r) for r in lake.read().collect())


def _with_writer(lake, act):
    """The table, in whose next write another writer acts first."""
    write, other = lake._write, LakeTable(lake.spark, lake.path)

    def writing(*args):
        lake._write = write
        act(other)
        return write(*args)

    lake._write = writing
    return lake


@pytest.fixture
def lake(spark, tmp_path):
    table = LakeTable(spark, f"file://{tmp_path}/t")
    table.write(_rows(spark, (1, "a"), (2, "b")))
    table.write(_rows(spark, (3, "c")), "append")
    return table


def test_a_rewrite_never_loses_the_other_writers_rows(spark, lake):
    for act in (lambda t: t.compact(), lambda t: t.zorder(["k"])):
        before = _values(lake)
        with pytest.raises(ConcurrentCommit):
            act(_with_writer(lake, lambda o: o.write(_rows(spark, (7, "other")), "append")))
        assert _values(lake) == sorted([*before, (7, "other")])


def test_an_append_goes_after_the_other_writer(spark, lake):
    _with_writer(lake, lambda o: o.write(_rows(spark, (7, "other")), "append")).write(_rows(spark, (8, "own")), "append")
    assert _values(lake) == [(1, "a"), (2, "b"), (3, "c"), (7, "other"), (8, "own")]


def test_merges_start_again_from_the_other_writers_version(spark, lake):
    _with_writer(lake, lambda o: o.upsert(_rows(spark, (2, "other"), (9, "other")), "k")).upsert(_rows(spark, (2, "own"), (4, "own")), "k")
    assert _values(lake) == [(1, "a"), (2, "own"), (3, "c"), (4, "own"), (9, "other")]
    _with_writer(lake, lambda o: o.insert_new(_rows(spark, (7, "other")), "k")).insert_new(_rows(spark, (7, "own"), (8, "own")), "k")
    assert [v for k, v in _values(lake) if k in (7, 8)] == ["other", "own"]


def test_the_first_write_of_two(spark, tmp_path):
    table = LakeTable(spark, f"file://{tmp_path}/new")
    _with_writer(table, lambda o: o.insert_new(_rows(spark, (1, "other")), "k")).insert_new(_rows(spark, (1, "own"), (2, "own")), "k")
    assert _values(table) == [(1, "other"), (2, "own")]


def test_a_merge_rewrites_hit_files_only(spark, tmp_path):
    table = LakeTable(spark, f"file://{tmp_path}/many")
    rows = spark.range(20_000).select((F.pmod(F.col("id") * 7919, F.lit(20_000))).alias("k"), F.lit("old").alias("v"))
    table.write(rows.repartition(200))
    some = [11, 222, 3333, 19_999, 30_000]
    table.upsert(_rows(spark, *[(k, "new") for k in some]), "k")
    assert 0 < table.rewritten() <= 4
    assert {r.k for r in table.read().where("v = 'new'").collect()} == set(some)
    assert table.read().count() == 20_001 and table.read().select("k").distinct().count() == 20_001
    # A second merge meets both old and new files, and an older version is still whole.
    table.upsert(_rows(spark, (11, "newer"), (5, "newer")), "k")
    assert table.rewritten() <= 2 and table.read().count() == 20_001 and table.read().where("v = 'newer'").count() == 2
    assert table.read(0).where("v = 'old'").count() == 20_000
    assert table._hit_files(table._manifest(), ["k"], _rows(spark, (50_000, "x"))) == []
    near = table._hit_files(table._manifest(), ["k"], _rows(spark, (12, "x"), (13, "x")))
    assert 1 <= len(near) <= 6
    assert table.insert_new(_rows(spark, (12, "x"), (40_000, "x")), "k") and table.read().where("v = 'x'").count() == 1


def test_many_keys_a_file_make_no_bloom_filters(spark, tmp_path):
    """They would leave out no file; ranges still do, and few keys are looked up in filters."""
    table = LakeTable(spark, f"file://{tmp_path}/wide")
    rows = spark.range(4_000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    table.write(rows.repartitionByRange(20, "k"))
    new = rows.where("k >= 3000 AND k % 2 = 0").withColumn("v", F.lit("new"))
    assert 0 < len(table._hit_files(table._manifest(), ["k"], new)) <= 7
    assert {r.k for r in table.matching(new, "k").collect()} == set(range(3_000, 4_000, 2))
    table.upsert(new.unionByName(new), "k")
    assert 0 < table.rewritten() <= 7 and table.read().where("v = 'new'").count() == 500 and table.read().count() == 4_000
    table.insert_new(rows.withColumn("k", F.col("k") + 3_500), "k")
    assert table.read().count() == 7_500 == table.read().select("k").distinct().count()
    assert not (tmp_path / "wide/_index").exists()
    assert len(table._hit_files(table._manifest(), ["k"], _rows(spark, (12, "x")))) >= 1 and (tmp_path / "wide/_index").exists()


def test_merges_in_partitions_with_odd_names(spark, tmp_path):
    table = LakeTable(spark, f"file://{tmp_path}/odd folder")
    rows = lambda v: spark.createDataFrame([(k, v, p) for k, p in enumerate(["a b", "c:d", "e/f", "g%h", "i+j", None])], "k long, v string, p string")
    table.upsert(rows("old"), "k", partition_by=["p"])
    table.upsert(rows("new").where("k IN (0, 2, 4, 5)"), "k")
    assert table.rewritten() == 4
    assert [(r.k, r.v, r.p) for r in table.read().orderBy("k").collect()] == [(0, "new", "a b"), (1, "old", "c:d"), (2, "new", "e/f"), (3, "old", "g%h"), (4, "new", "i+j"), (5, "new", None)]
    assert table.compact()["after"] <= 6 and table.read().count() == 6


def test_upsert_keeps_newer_rows_and_several_keys(spark, tmp_path):
    table = LakeTable(spark, f"file://{tmp_path}/newer")
    frame = lambda *rows: spark.createDataFrame(list(rows), "a long, b string, t long")
    table.upsert(frame((1, "x", 5), (1, "y", 5), (2, "x", 5)), ["a", "b"])
    table.upsert(frame((1, "x", 4), (1, "y", 6), (3, "z", 1)), ["a", "b"], newer="t")
    assert sorted(map(tuple, table.read().collect())) == [(1, "x", 5), (1, "y", 6), (2, "x", 5), (3, "z", 1)]


def test_compaction_takes_small_files_only(spark, tmp_path, monkeypatch):
    from millrace.operators import tables

    table = LakeTable(spark, f"file://{tmp_path}/sizes")
    table.write(spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")).coalesce(1))
    for k in range(3):
        table.write(_rows(spark, (200_000 + k, "small")).coalesce(1), "append")
    big = max(table._files(table._manifest()).items(), key=lambda x: x[1])[0]
    monkeypatch.setattr(tables, "FILE_BYTES", 1 << 20)
    assert table.compact() == {"before": 4, "after": 2}
    assert big in table._files(table._manifest()) and table.rewritten() == 3 and table.read().count() == 200_003
    assert table.compact() == {"before": 2, "after": 2}


def test_an_append_that_does_not_fit_raises_before_it_writes(spark, lake):
    before = lake.version(), lake.file_count()
    for wrong in ("k string, v string", "k double, v string", "k long, v struct<a: int>"):
        with pytest.raises(SchemaMismatch, match="k|v"):
            lake.write(spark.createDataFrame([], wrong), "append")
    with pytest.raises(SchemaMismatch):
        lake.upsert(spark.createDataFrame([("x", "y")], "k string, v string"), "k")
    assert (lake.version(), lake.file_count()) == before


def test_types_widen_on_append(spark, tmp_path):
    table = LakeTable(spark, f"file://{tmp_path}/wide")
    table.write(spark.createDataFrame([(1, 1.5)], "a int, b float"))
    table.write(spark.createDataFrame([(2**40, 2.5, "new")], "a long, b double, c string"), "append")
    table.write(spark.createDataFrame([(3, 3.5)], "a int, b float"), "append")
    assert table.read().schema.simpleString() == "struct<a:bigint,b:double,c:string>"
    assert sorted(map(tuple, table.read().collect())) == [(1, 1.5, None), (3, 3.5, None), (2**40, 2.5, "new")]


def test_drift_at_any_depth(spark):
    old = StructType([StructField("a", IntegerType(), False), StructField("s", StructType([StructField("x", StringType()), StructField("y", ArrayType(IntegerType()))])), StructField("m", MapType(StringType(), IntegerType())), StructField("gone", StringType())])
    new = StructType([StructField("a", LongType(), True), StructField("s", StructType([StructField("x", IntegerType()), StructField("y", ArrayType(LongType())), StructField("z", StringType())])), StructField("m", MapType(StringType(), StringType())), StructField("added", StringType())])
    got = {(r.path, r.change, r.severity) for r in schema.drift(spark, old, new).collect()}
    assert got == {
        ("a", "widened_type", "info"), ("a", "became_nullable", "info"), ("s.x", "changed_type", "error"), ("s.y[]", "widened_type", "info"), ("s.z", "added_column", "info"),
        ("m{value}", "changed_type", "error"), ("gone", "removed_column", "error"), ("added", "added_column", "info"),
    }
    assert not list(schema.changes(old, old)) and {c[1] for c in schema.changes(LongType(), IntegerType())} == {"narrowed_type"}


def test_small_tables_are_merged_without_an_index(spark, tmp_path):
    table = LakeTable(spark, f"file://{tmp_path}/small")
    rows = spark.range(4_000).select("id", F.lit("old").alias("v"))
    table.write(rows.repartitionByRange(20, "id"))
    table.upsert(rows.where("id IN (7, 3999)").withColumn("v", F.lit("new")), "id")
    assert table.rewritten() == 2 and table.matching(rows.where("id = 7"), "id").first().v == "new"
    assert not (tmp_path / "small/_ranges").exists() and not (tmp_path / "small/_index").exists()


def test_ranges_of_files_are_found_without_sorting_rows(spark, tmp_path):
    """A sort by path would take memory for all rows of a task's files."""
    table = LakeTable(spark, f"file://{tmp_path}/ends")
    table.write(spark.range(1_000).select("id", F.when(F.col("id") % 10 > 0, F.lpad(F.col("id").cast("string"), 4, "0")).alias("b")).repartitionByRange(10, "id"))
    ran = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = ran().size()
    ends = table._ranges(table._manifest(), ["b", "id"])
    plans = [ran().apply(k).physicalPlanDescription() for k in range(before, ran().size())]
    assert any("partial_min" in p for p in plans) and not any("SortAggregate" in p for p in plans)
    # A null is less than any text, so a file's range begins with its first id that 10 divides.
    first, last = F.min(F.when(F.col("b").isNull(), F.col("id"))), F.max("b")
    want = table.read().groupBy(F.input_file_name().alias("file")).agg(first.alias("first"), last.alias("last")).collect()
    for found in (ends, table._index(table._manifest(), ["b", "id"])):
        assert {(r.low.b, r.low.id, r.high.b) for r in found.select("low", "high").collect()} == {(None, r["first"], r["last"]) for r in want}


def test_the_greatest_row_is_found_without_a_copy_of_its_columns(spark):
    rows = spark.createDataFrame([(1, None, "z", 1.0), (1, 5, None, 2.0), (1, 5, "a", None), (2, None, None, None), (2, None, None, float("nan")), (2, None, None, 7.0), (3, 4, "b", 0.5), (3, 4, "b", 0.5)], "k long, n int, s string, x double")
    found = first_of_key(rows, ["k"])
    greatest = rows.groupBy("k").agg(F.max(F.struct("n", "s", "x")).alias("r")).select("k", "r.*")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, greatest.collect())) and found.count() == 3
    assert "struct" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.k for r in first_of_key(rows.select("k"), ["k"]).collect()) == [1, 2, 3]


def test_ranges_of_a_number_are_found_by_its_values(spark, tmp_path):
    """A struct a row, and a set beside its ends, took longer than reading the keys."""
    table, ran = LakeTable(spark, f"file://{tmp_path}/number"), lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    table.write(spark.range(2_000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("k"), F.lit("old").alias("v")).repartitionByRange(20, "k"))
    before = ran().size()
    ends = table._ranges(table._manifest(), ["k"])
    plans = [ran().apply(k).physicalPlanDescription() for k in range(before, ran().size())]
    assert any("partial_min" in p for p in plans) and not any(x in p for p in plans for x in ("ObjectHashAggregate", "SortAggregate"))
    files = table.read().groupBy(F.input_file_name().alias("file")).agg(F.min("k").alias("low"), F.max("k").alias("high")).collect()
    assert len(files) > 8 and {(r.low.k, r.high.k) for r in ends.collect()} == {(r.low, r.high) for r in files}
    # Asked for by ranges: a null in the source doesn't widen its range to all files.
    asked = spark.createDataFrame([(None,), *[(k,) for k in range(1_001, 1_099)]], "k long")
    near = table._hit_files(table._manifest(), ["k"], asked)
    assert 0 < len(near) < len(files) and sorted(near) == sorted(x for x in table._files(table._manifest()) if any(r.file.endswith(x) and r.high and r.high >= 1_001 and r.low <= 1_098 for r in files))
