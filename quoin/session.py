"""Session helpers shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: The folder that holds this package, which Python workers need on their path.
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int | str = 8, name: str = "quoin") -> SparkSession:
    """A local session with the settings that every result here assumes: UTC and AQE."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus) if cpus != "*" else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUOIN_DRIVER_MEMORY", "8g"))
        .config("spark.executorEnv.PYTHONPATH", PACKAGE_ROOT)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs on
    one machine (tests, a laptop) is a temporary folder made and set as the checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors would not see a folder of the driver's")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quoin-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
