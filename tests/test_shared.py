"""Intermediate tables: where they lie, and that they go."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pulsegrid import shared
from pyspark.sql import functions as F


def test_tables_are_written_dropped_and_cleared(spark):
    a, b = shared.written(spark.range(5), "a"), shared.written(spark.range(7).withColumnRenamed("id", "x"), "b")
    folder = shared._folder(spark).removeprefix("file://")
    assert a.count() == 5 and b.columns == ["x"] and len(os.listdir(folder)) >= 2
    shared.drop(a, None, spark.range(3))
    assert not os.path.exists(a._pulsegrid_path.removeprefix("file://")) and b.count() == 7
    shared.clear()
    assert not os.path.exists(folder)
    assert shared.written(spark.range(2), "again").count() == 2


def test_no_machine_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda key: None)
    spark = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="x"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(spark)


def test_the_folder_goes_with_the_process(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from pulsegrid.shared import written
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/cp").getOrCreate()
print(written(s.range(4), "t").count())
s.stop()
"""
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=200)
    assert done.stdout.strip() == "4" and not [x for x in os.listdir(tmp_path / "cp") if x.startswith("pulsegrid-")]


def test_names_and_numbers(spark):
    assert shared.unused("tk", ["a"]) == "tk" and shared.unused("tk", ["TK", "tk0"]) == "tk1"
    df = spark.createDataFrame([(i * 7 % 50, str(i % 3)) for i in range(200)] + [(None, "x")], "id int, part string").repartition(6)
    got = shared.numbered(df, "place", F.col("id").desc_nulls_first(), F.col("part")).collect()
    assert sorted(x.place for x in got) == list(range(201)) and got[0].asDict().keys() == {"id", "part", "place"}
    in_order = [(x.id, x.part) for x in sorted(got, key=lambda x: x.place)]
    assert in_order == sorted(in_order, key=lambda x: (x[0] is not None, -(x[0] or 0), x[1]))
    assert shared.numbered(df.limit(0), "place", F.col("id")).count() == 0


def test_batches_are_bounded_by_bytes_unless_the_session_says_so(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        spark.conf.unset(key)
        shared.small_batches(spark.range(1))
        assert spark.conf.get(key) == "16m"
        spark.conf.set(key, "3m")
        shared.small_batches(spark.range(1))
        assert spark.conf.get(key) == "3m"
    finally:
        spark.conf.unset(key)
