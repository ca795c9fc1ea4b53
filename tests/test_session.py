"""Submitted settings win; functions reach the workers of a session started anywhere."""

import os
import subprocess
import sys

from pyspark import SparkConf

from conftest import ROOT, SF001
from tagwright import session
from tagwright.session import missing_settings


def test_submitted_settings_are_kept():
    given = SparkConf(loadDefaults=False).setMaster("spark://cluster:7077").set("spark.sql.shuffle.partitions", "400") \
        .set("spark.sql.adaptive.skewJoin.enabled", "false")
    ours = missing_settings(given, "local[2]", "app", 4)
    assert not {"spark.master", "spark.sql.shuffle.partitions", "spark.driver.memory", "spark.sql.adaptive.skewJoin.enabled"} & set(ours)
    assert ours["spark.sql.adaptive.enabled"] == "true"


def test_plain_process_gets_a_local_session():
    ours = missing_settings(SparkConf(loadDefaults=False), "local[2]", "app", 4)
    assert ours["spark.master"] == "local[2]" and ours["spark.sql.shuffle.partitions"] == "4"


def test_submitted_master_and_foreign_folder(tmp_path):
    """As spark-submit would start it: settings kept, and a Python function of the package runs in the workers."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
import __spark_entry__ as E
from tagwright.session import get_spark
spark = get_spark(shuffle_partitions=8)
assert spark.sparkContext.master == "local[3]" and spark.conf.get("spark.sql.shuffle.partitions") == "5"
print("ROWS", E.queries()["batch_score_row_isolation"](spark, {SF001!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYSPARK_SUBMIT_ARGS"] = "--master local[3] --conf spark.sql.shuffle.partitions=5 --conf spark.ui.enabled=false pyspark-shell"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def test_scratch_tables_are_dropped(spark, monkeypatch):
    monkeypatch.setattr(session, "_scratch", [])
    paths = [session.scratch_path(spark, "test") for _ in range(3)]
    for path in paths:
        spark.range(3).write.parquet(path)
    session.drop_path(spark, paths[0])
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [False, True, True]
    session.release_scratch(spark)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths) and not session._scratch
