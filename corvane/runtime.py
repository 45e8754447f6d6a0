"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "corvane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and Arrow transfer switched on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset
    (tests in local mode only) a temporary folder of this machine."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="corvane-")
        context.setCheckpointDir(configured)
    return (configured or context.getCheckpointDir()).rstrip("/")


def reliable_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with files in the shared folder, so that the loss of an executor loses no rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def default_size(df: DataFrame) -> DataFrame:
    """The same rows, whose size the planner takes to be its default.

    A checkpoint keeps its plan's estimate, and a join's is the product of its sides': where a loop joins what the last
    round made, the estimate is a number whose digits multiply with every round, in the driver's memory."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/corvane/{label}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package also where neither PYTHONPATH nor the working folder leads them to
    it: an archive is then handed to the session, which serves it to its executors."""
    package = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(package)
    reachable = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    shipped = any(os.path.basename(f) == f"{name}.zip" for f in spark.sparkContext._python_includes)
    if shipped or any(p and os.path.isdir(os.path.join(p, name)) for p in reachable):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", root, name)
    spark.sparkContext.addPyFile(archive)
