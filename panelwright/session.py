"""Session construction for scripts, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "panelwright", **conf: str) -> SparkSession:
    """A local session with UTC time and as many shuffle partitions as cores. For one machine: its warehouse is a temporary folder."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "panelwright-warehouse"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df, *keys: str, most: int = 4 << 20):
    """``df`` dealt by keys over all shuffle partitions: a compact file is a task or two, however much work its rows are.

    Large tables go to more partitions, of ``most`` bytes each by the optimiser's estimate, so that a task's share doesn't grow with them.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // most), 10_000)), *keys)


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (at or tempfile.mkdtemp(prefix="panelwright-")).rstrip("/")
