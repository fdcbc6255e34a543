"""Session settings shared by tests, the benchmark and scripts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: UTC everywhere: dates are derived from epoch milliseconds in an explicit zone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A local session; on a cluster pass SETTINGS to spark-submit instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("fieldweave")
    settings = SETTINGS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": memory,
        "spark.ui.showConsoleProgress": "false",
    } | more
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, a temporary one on a local master, else an error: other machines could not read it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        named = context.getCheckpointDir()
    return named


def place(spark: SparkSession, path: str) -> tuple:
    """The store that holds a path, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def problems(spark: SparkSession) -> list[str]:
    """What would change results or fail later: the zone, the shared folder, and whether what tasks write there can be read back."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = [] if zone == "UTC" else [f"spark.sql.session.timeZone is {zone}; dates are derived in UTC"]
    try:
        probe = f"{shared_folder(spark)}/probe-{uuid.uuid4().hex}"
        try:
            spark.range(4, numPartitions=4).write.parquet(probe)
            rows = spark.read.parquet(probe).count()
            if rows != 4:
                found.append(f"of 4 rows that tasks wrote to {probe} {rows} could be read: machines do not share that folder")
        finally:
            store, path = place(spark, probe)
            store.delete(path, True)
    except Exception as failed:  # noqa: BLE001  whatever is wrong is what is asked for
        found.append(f"spark.checkpoint.dir: {str(failed).splitlines()[0]}")
    return found
