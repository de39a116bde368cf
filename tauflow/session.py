"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; on a cluster spark-submit supplies these settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tauflow")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Test tables are small for their work per row; keep their few rows spread over the cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Where ``spark.checkpoint.dir`` is unset, a cluster job stops (a temporary folder would be another one on
    every machine); a local session, as in tests, gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = _local_root(spark.sparkContext)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_local_roots: dict[str, str] = {}


def _local_root(context) -> str:
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_roots[context.applicationId]


def drop_work(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete a work table when the job that staged it is done."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    spark = spark or df_or_path.sparkSession
    for path in paths:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the work folder and read it back.

    For a table that several later steps read, each with other columns: it is computed once, every step
    scans only its own columns, and a lost executor costs a re-read instead of a new shuffle.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
