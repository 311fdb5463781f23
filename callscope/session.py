"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_spark(app_name: str = "callscope", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, RocksDB state).

    On a cluster only the settings missing there should be copied; the master and
    memory are then given by spark-submit.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session fit for the operators: UTC, and this package on its Python workers.

    Workers only find the package if it is installed there or sent to them; it is sent
    once per application, as a small archive of its sources.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="callscope-"), "callscope.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        spark.sparkContext.addPyFile(archive)
        # Stream state is also set up by a worker on the driver, which only knows the path.
        paths = spark.sparkContext.environment
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [archive, paths.get("PYTHONPATH")]))
        _shipped.add(application)
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder for written intermediates, under ``spark.checkpoint.dir``.

    A cluster must name a folder that all executors share. Only a local session in which it
    is unset gets one folder for all its intermediates, which ends with the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the executors")
        base = tempfile.mkdtemp(prefix="callscope-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str):
    """Write an intermediate once and read it back: a lineage cut that survives executor loss."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
