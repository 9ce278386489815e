"""Session helpers: table loading, shared-folder materialisation and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent


def build_session(app_name: str = "caseloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; on a cluster leave ``master`` unset so that spark-submit decides."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map={**settings, **conf}).getOrCreate()


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    ship_package(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before work that is heavy per row, where the input has fewer splits than there are cores.

    A large table has more splits than cores and passes through unchanged, without a shuffle; so does a plan that shuffles
    already, whose partitions are decided while it runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a private one only where that is unset and all run here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="caseloom-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder as parquet and read it back.

    Unlike a cached plan the written table survives the loss of any executor, and unlike an RDD checkpoint it is
    columnar, so later reads prune columns. The folder is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/caseloom/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass  # the session is gone already


def ship_package(spark: SparkSession) -> None:
    """Give executors this package's modules (Python workers import them by name); done once per application."""
    context = spark.sparkContext
    if getattr(context, "_caseloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="caseloom-zip-")) / "caseloom.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(PACKAGE_ROOT.rglob("*.py")):
            bundle.write(source, os.path.join("caseloom", source.relative_to(PACKAGE_ROOT)))
    context.addPyFile(str(archive))
    context._caseloom_shipped = True


def default_parallelism(spark: SparkSession) -> int:
    """Reduce-side partitions as configured for the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
