"""Spark session helpers.

The checkpoint directory is read from the session (``spark.checkpoint.dir``)
and only set here when the cluster left it unset, e.g. in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


def missing_settings(given: SparkConf, master: str | None, app: str, shuffle_partitions: int | None) -> dict[str, str]:
    """Our defaults for what the submitted configuration leaves open; what it sets is never replaced."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = {
        "spark.app.name": app,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # coalesce small shuffles to the advisory partition size instead of keeping >= default parallelism
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoints go when nothing refers to them
    }
    if not given.contains("spark.master"):  # no cluster: a local session
        wanted |= {"spark.master": master or f"local[{cpus}]",
                   "spark.sql.shuffle.partitions": str(shuffle_partitions or int(cpus) * 2),
                   "spark.driver.memory": os.environ.get("TAGWRIGHT_DRIVER_MEMORY", "4g")}
    return {k: v for k, v in wanted.items() if not given.contains(k)}


def submitted_conf() -> SparkConf:
    """What spark-submit (or PYSPARK_SUBMIT_ARGS) set; empty in a plain Python process."""
    if "PYSPARK_GATEWAY_PORT" in os.environ or "PYSPARK_SUBMIT_ARGS" in os.environ:
        SparkContext._ensure_initialized()
        return SparkConf()
    return SparkConf(loadDefaults=False)


def get_spark(master: str | None = None, app: str = "tagwright",
              shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """The active session untouched, else a new one: submitted settings win, our defaults fill the gaps.

    ``master`` and ``shuffle_partitions`` are for local sessions; a submitted master keeps its own.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder
    for k, v in {**missing_settings(submitted_conf(), master, app, shuffle_partitions), **extra}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: checkpoints must survive executor loss")
        conf_dir = tempfile.mkdtemp(prefix="tagwright-ckpt-")  # local runs and tests only
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    _scratch.append(f"{base}/tagwright-{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end (its writer leaves ``_SUCCESS``)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


_scratch: list[str] = []   # what scratch_path has handed out and nobody has dropped


def release_scratch(spark: SparkSession) -> None:
    """Delete every written intermediate table of this process; call it when no lazy result reads them any more."""
    while _scratch:
        drop_path(spark, _scratch[-1])


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table that nothing reads any more."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
    if path in _scratch:
        _scratch.remove(path)
