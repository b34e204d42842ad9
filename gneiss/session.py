"""Session helpers shared by every plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Catalyst prunes columns and pushes filters into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input that are worth a task of their own where the work is heavy on CPU.
TASK_BYTES = 1 << 20


def spread(scan: DataFrame) -> DataFrame:
    """A scan for work that is heavy on CPU, shuffled over more tasks where its files leave cores idle that have bytes enough.

    A file of one row group is read by one task, whatever splits the scan shows, so tasks are counted by files
    where there are few. A scan that keeps all cores busy, or whose tasks have TASK_BYTES at most, is left alone.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = min(max(1, -(-size // TASK_BYTES)), 4 * cores)
    splits = scan.rdd.getNumPartitions()
    if splits >= 4 * cores or min(splits, len(scan.inputFiles())) >= min(wanted, cores):
        return scan
    return scan.repartition(wanted)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and all executors are on this machine;
    it is removed when Python ends. On a cluster without the setting ValueError is raised.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    own = _own.get(spark.sparkContext.applicationId)
    if own is None:
        own = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="gneiss-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
    return own


_own: dict[str, str] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
