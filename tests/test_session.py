"""Session options and the shared folder."""

from tensorloom import session
from tensorloom.schema import LONG, known, require

import pytest
from pyspark.sql import functions as F


def test_options_reach_the_session(spark):
    assert session.session(**{"spark.sql.shuffle.partitions": "4"}) is not None
    assert session.OPTIONS["spark.sql.adaptive.enabled"] == "true"


def test_settled_tables_lie_in_the_shared_folder(spark):
    df = session.settled(spark.createDataFrame([(1.0, 2.0, "s", 1)], LONG), "t")
    assert df.schema == LONG and df.count() == 1
    assert df.inputFiles()[0].removeprefix("file://").startswith(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    assert session.shared_path(spark, "a") != session.shared_path(spark, "a")


def test_missing_values(spark):
    rows = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double").select(known(F.col("x"))).collect()
    assert [r[0] for r in rows] == [None, None, 1.0]
    with pytest.raises(ValueError):
        require(spark.range(1), "no")


def test_folders_move_as_a_whole(spark, tmp_path):
    from tensorloom.session import exists, forget, moved

    spark.range(3).write.parquet(f"{tmp_path}/a")
    assert exists(spark, f"{tmp_path}/a") and not exists(spark, f"{tmp_path}/x/b")
    moved(spark, f"{tmp_path}/a", f"{tmp_path}/x/b")
    assert not exists(spark, f"{tmp_path}/a") and spark.read.parquet(f"{tmp_path}/x/b").count() == 3
    with pytest.raises(Exception):
        moved(spark, f"{tmp_path}/a", f"{tmp_path}/x/c")
    forget(spark, f"{tmp_path}/x")
    assert not exists(spark, f"{tmp_path}/x/b")
