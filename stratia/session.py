"""Session building and the places where jobs cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stratia", cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is missing (tests, local mode) a folder of this machine is taken instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"{tempfile.gettempdir()}/stratia-checkpoints"
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir() or root


def qualified(spark: SparkSession, folder: str) -> str:
    """The full address of a folder, with the scheme that Spark's default file system adds where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and cuts the plan."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders that this driver's steps have written and that release() has not deleted.
WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a step in the shared folder, until release()."""
    path = f"{shared_root(spark).rstrip('/')}/stratia/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what steps have written so far. Results that were not read yet are lost, so read or write them before."""
    while WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a step as compressed Parquet (by `codec`, or as the session has it) to the shared folder and read it back; release() deletes it."""
    path = scratch(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
