"""Session defaults and the shared place for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The token job turns one byte of source text into about twenty-five bytes of rows inside a
    # task, so its content partitions stay well below the usual 64 MB.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings) -> SparkSession:
    """A session with the settings this package is tuned for; explicit ``settings`` win."""
    builder = SparkSession.builder.appName("leafscan")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session may do without one: it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share: intermediate tables are written there")
        folder = tempfile.mkdtemp(prefix="leafscan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


# HotSpot compiles no method above this size: a stage that Spark has made one such method of runs in the interpreter. Below it Spark runs the
# operators of the stage one by one, each in small methods.
METHOD_BYTES = ("spark.sql.codegen.hugeMethodLimit", "8000")
# What a write has shuffled is removed when it ends: nothing reads it again, and else it stays on the disks until the driver happens to collect garbage.
SHUFFLES_GO = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def settle(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), kept: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; the folder's path is added to ``kept``. ``codec`` compresses it otherwise than the session does.

    Cuts the lineage in a way that survives lost executors, and unlike a checkpointed RDD keeps
    column pruning, filter push-down and partition pruning for the readers.
    """
    folder = f"{shared_folder(df.sparkSession)}/leafscan/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if codec:
        writer = writer.option("compression", codec)
    conf = df.sparkSession.conf
    before = {setting: conf.get(setting, None) for setting, _ in (METHOD_BYTES, SHUFFLES_GO)}
    try:
        for setting, value in (METHOD_BYTES, SHUFFLES_GO):
            conf.set(setting, value)
        writer.parquet(f"{folder}/{name}")
    finally:
        for setting, value in before.items():
            if value is None:
                conf.unset(setting)
            else:
                conf.set(setting, value)
    if kept is not None:
        kept.append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Remove folders that ``settle`` has written."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
