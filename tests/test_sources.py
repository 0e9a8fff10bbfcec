from __future__ import annotations

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import types as T

from cohortloom import session
from cohortloom.sources import readers, schemas, writers


def test_delimited_options(spark, tmp_path):
    path = tmp_path / "wide.txt"
    path.write_text("ENCOUNTERID|HOUR|WBC_FIRST|NOTE\nA:1|1|7.5|\n\nA:2|6|NA|café\nA:3|x|1e3|NULL\n", encoding="utf-8")
    schema = T.StructType.fromDDL("encounterid string, hour int, wbc_first double, note string")
    df = readers.read_delimited(spark, str(path), schema, sep="|", drop=["hour"])
    assert rows(df, "encounterid") == [("A:1", 7.5, None), ("A:2", None, "café"), ("A:3", 1000.0, None)]
    full = readers.read_delimited(spark, str(path), schema, sep="|")
    assert [r["hour"] for r in full.orderBy("encounterid").collect()] == [1, 6, None]


def test_lookup_file_and_text_columns(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("fin_class,srg9_desc,grouping,count\nself,SELF PAY,NULL,3\nother,,late,4\n")
    df = readers.read_delimited(spark, str(path), schemas.FINANCIAL_CLASS_MAP)
    assert rows(df, "fin_class") == [("other", None, "late", 4), ("self", "SELF PAY", None, 3)]
    assert readers.read_text_columns(spark, str(path)).dtypes[3] == ("count", "string")


def test_columns_in_another_order_are_matched_by_name(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("count,grouping,srg9_desc,fin_class\n3,g,s,f\n")
    assert rows(readers.read_delimited(spark, str(path), schemas.FINANCIAL_CLASS_MAP)) == [("f", "s", "g", 3)]


def test_panel_is_written_by_hour_and_pruned(spark, tmp_path):
    df = spark.createDataFrame([(k, h, k * h) for k in range(5) for h in (1, 6, 24)], "k int, hour int, v int")
    writers.write_panel(df, str(tmp_path / "p"))
    some = writers.read_panel(spark, str(tmp_path / "p"), [1, 6])
    assert some.count() == 10 and "PartitionFilters: [hour" in some._jdf.queryExecution().toString()
    assert writers.read_panel(spark, str(tmp_path / "p")).count() == 15


def test_extracts_of_two_ranges_live_side_by_side(spark, tmp_path):
    a, b = spark.range(3), spark.range(5)
    path = str(tmp_path / "x")
    writers.write_extract(a, path, "2016-01-01", "2017-01-01")
    writers.write_extract(b, path, "2017-01-01", "2018-01-01")
    writers.write_extract(b, path, "2017-01-01", "2018-01-01")
    assert writers.read_extract(spark, path).count() == 8
    assert writers.read_extract(spark, path, first_day="2016-01-01").count() == 3


def test_typed_and_names(spark, tmp_path):
    df = spark.createDataFrame([("1", "2017-01-02 03:04:05", "abc")], "A string, B string, C string")
    out = readers.typed(readers.lower_names(df), T.StructType.fromDDL("a int, b timestamp, c double"))
    assert rows(out) == [(1, datetime(2017, 1, 2, 3, 4, 5), None)]
    out.write.parquet(str(tmp_path / "t"))
    assert readers.read_parquet(spark, str(tmp_path / "t"), ["b"]).columns == ["b"]
    assert readers.renamed(out, {"a": "z"}).columns == ["z", "b", "c"]


def test_keyed_tables_join_without_a_shuffle(spark, tmp_path):
    a = spark.range(200).selectExpr("id % 50 AS k", "id AS v")
    b = spark.range(50).selectExpr("id AS k", "id * 2 AS w")
    writers.write_keyed(a, "keyed_a", ["k"], 4, str(tmp_path / "a"))
    writers.write_keyed(b, "keyed_b", ["k"], 4, str(tmp_path / "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("keyed_a").join(spark.table("keyed_b"), "k")
        assert joined.count() == 200 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE keyed_a")
        spark.sql("DROP TABLE keyed_b")


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, name, default=None):
        return self.values.get(name, default)


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master, **conf):
        self.sparkContext, self.conf = _Context(master), _Conf(conf)


def test_checkpoint_folder_comes_from_the_session():
    named = _Session("spark://cluster", **{"spark.checkpoint.dir": "/shared/x"})
    assert session.ensure_checkpoint_dir(named) == "/shared/x"
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(_Session("spark://cluster"))
    assert session.ensure_checkpoint_dir(_Session("local[2]"))
