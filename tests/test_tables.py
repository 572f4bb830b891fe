"""Written tables and the folder they go to."""

import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from conftest import rows

from tablelens.plans.tables import DROP_SHUFFLES, Bucketed, materialize, shared_folder


def session(folder, context_folder, master):
    conf = SimpleNamespace(get=lambda name, default: folder)
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: context_folder)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_folder_comes_from_the_session():
    assert shared_folder(session("hdfs://x/work", None, "yarn")) == "hdfs://x/work"
    assert shared_folder(session(None, "hdfs://x/set", "yarn")) == "hdfs://x/set"


def test_a_cluster_gets_no_folder_of_its_own():
    with pytest.raises(RuntimeError):
        shared_folder(session(None, None, "spark://host:7077"))


def test_materialize_keeps_schema_and_rows(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    df = spark.sql(
        "SELECT id, CAST(id AS DECIMAL(12, 3)) AS d, array(struct(id AS x)) AS a,"
        " timestamp_ntz'2020-01-01 00:00:00' AS t FROM range(50)"
    )
    written = materialize(df)
    assert written.dtypes == df.dtypes
    assert rows(written) == rows(df)
    assert "Range" not in written._jdf.queryExecution().optimizedPlan().toString()
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before, set_before = shuffle_files(spark), spark.conf.get(DROP_SHUFFLES)
    sums = materialize(spark.range(700).selectExpr("id % 7 AS k").groupBy("k").count())
    assert rows(sums) == [(k, 100) for k in range(7)]
    stored = Bucketed(spark.range(1000).repartition(3, "id"), 3, "id")
    for _ in range(50):  # they are removed soon after, not at once
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(DROP_SHUFFLES) == set_before
    assert stored.table.count() == 1000


def test_buckets_need_no_exchange_and_can_be_discarded(spark):
    stored = Bucketed(spark.range(100).selectExpr("id % 5 AS k", "id").repartition(4, "k"), 4, "k", ["id"])
    sums = stored.table.groupBy("k").count()
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    assert rows(sums) == [(k, 20) for k in range(5)]
    stored.discard()
    assert not Path(stored.path.removeprefix("file:")).exists() and not spark.catalog.tableExists(stored.name)
