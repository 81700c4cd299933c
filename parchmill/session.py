"""Session helpers shared by tests, bench and queries."""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_one_machine(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def spread(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """On one machine (master local) only: a scan of fewer than half as many partitions as
    there are cores, spread over all of them, so that a single small file does not keep one
    core busy and the others idle. On a cluster the scan stays as it is planned
    (spark.sql.files.maxPartitionBytes and minPartitionNum).
    ``source`` is the scan that ``df`` is made of, where that is more than a scan; only the
    scan is planned to count its partitions."""
    if not on_one_machine(df.sparkSession):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = 2 * (df if source is None else source).rdd.getNumPartitions() <= cores
    return df.repartition(cores) if few else df


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(table(spark, sf_dir, name))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Within it, at most ``rows`` rows go to Python at a time; for rows of many texts each.
    It holds for what is computed inside, not for what is planned there."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder all executors share.

    The folder comes from spark.checkpoint.dir; a private one is set only where the
    session names none and runs on one machine (tests). A cluster without the setting is an
    error, as its executors may share no folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not on_one_machine(df.sparkSession):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix=f"ckpt-{os.getpid()}-"))
    return df.checkpoint(eager=True)
