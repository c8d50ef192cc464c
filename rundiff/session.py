"""Session helpers: local sessions for tests and benches, and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "rundiff") -> SparkSession:
    """A local session for tests and benches. On a cluster, pass your own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one ``spark.checkpoint.dir`` names.

    A session in one process without one gets a temporary folder. Any other session without
    one is an error, because a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rundiff-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


def size_shuffles(spark: SparkSession, tasks: int, mb: int = 8) -> None:
    """From now on, shuffles and scans of this session have ``tasks`` partitions, and small partitions are put together up to ``mb`` MB.

    The lines of texts take many times their compressed bytes in a sort. With Spark's 64 MB a task and a fixed number of
    partitions, the memory of a task grows with the input. Settings that make smaller tasks stay.
    """
    now = {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.files.minPartitionNum": spark.conf.get("spark.sql.files.minPartitionNum", "1")}
    for name, least in now.items():
        if int(least) < tasks:
            spark.conf.set(name, str(tasks))
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(name, "64m").lower()).groups()
    if int(number) * 1024 ** " kmgtp".index(unit or " ") > mb << 20:
        spark.conf.set(name, f"{mb}m")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from its files.

    Lost executors cost nothing that was written. Unlike a checkpoint of rows, the table
    is read by column and its size is known to the planner, which can then broadcast it
    when it is small. The files stay until the folder is cleaned.
    """
    path = f"{shared_folder(df.sparkSession)}/rundiff-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
