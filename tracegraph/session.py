"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cpus: int | str = "*", app: str = "tracegraph", partitions: int = 8) -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))  # one machine, so its own folder is shared
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # keyed state processors need this store; it also spills to disk
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors must share.

    Where it is unset, a folder of this machine does in local mode only; a cluster has to name one.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, readable by every executor."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tracegraph/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete the tables this application landed; call it when their results are stored elsewhere."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    target.getFileSystem(conf).delete(target, True)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage for results that several branches or loop rounds read; the
    files survive lost executors, and the re-read keeps column pruning and sizes.
    """
    target = scratch_path(df.sparkSession, name)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def land_measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``land``, and aggregates of the rows that are taken on the way, without another job."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    target = scratch_path(df.sparkSession, name)
    df.observe(seen, *[c.alias(k) for k, c in measures.items()]).write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target), seen.get
