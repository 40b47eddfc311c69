"""Session helpers: table loading, shared checkpoints, local sessions for tests and benches."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "loomtrace", **conf: str) -> SparkSession:
    """A local session for tests and benches. Real runs bring their own session."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once a context, where their path does not hold it already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if getattr(sc, "_loomtrace_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc._loomtrace_shipped = True
    if root.endswith(".zip"):
        return
    folder = tempfile.mkdtemp(prefix="spark-loomtrace-py-")  # served to the executors by the driver
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "loomtrace"), "zip", root, "loomtrace"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, as Spark reads it from Parquet."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; only where none is named (tests) make a local one.

    Spark copies ``spark.checkpoint.dir`` into the context when it starts. A context that got the setting later, or
    not at all, is given it here.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        sc.setCheckpointDir(named)
        return
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-loomtrace-", dir=os.environ.get("TMPDIR", "/tmp")))


def cut(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared checkpoint folder and read it from there: lineage ends, lost executors do not matter.

    Written as Parquet: later steps read the columns they need, in splits, and Spark knows the sizes. The files go when the
    session's file system closes.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    folder = jvm.org.apache.hadoop.fs.Path(jsc.sc().getCheckpointDir().get(), f"table-{uuid.uuid4().hex}")
    df.write.parquet(folder.toString())
    folder.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(folder.toString())
