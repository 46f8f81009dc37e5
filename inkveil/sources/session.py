"""Session helpers: parallelism of small inputs and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEYS_PER_TASK = 20_000
WORK_FOLDERS: list[str] = []
_OWN: list[str] = []


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-bound work enough tasks.

    A table in few files or row groups arrives in fewer tasks than there are
    cores; only then it is redistributed by ``keys`` (unique per row, so no key
    is hot).  Large inputs already have more splits than cores and pass as is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def spread_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the few columns of ``df`` that much work hangs on into tasks of at most ``KEYS_PER_TASK`` rows.

    The splits of a file say little here: a row group is read by one task, whatever the splits, and its columns
    are small beside what is made of them.  Rows are counted from the file footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.count()
    return df.repartition(max(cores, -(-rows // KEYS_PER_TASK)), *keys)


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; elsewhere it is installed or sent with ``--py-files``."""
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def is_single_machine(spark: SparkSession) -> bool:
    """True for ``local`` and ``local[n]`` masters, where all tasks share one disk."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession, name: str) -> str:
    """Fresh path below the cluster's shared folder (``spark.checkpoint.dir``).

    Without that setting a single machine uses a temporary folder; a cluster
    stops here, as a folder on one machine's disk would lose rows silently.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_single_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="inkveil-"))
        base = _OWN[0]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    WORK_FOLDERS.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a new pass over
    the texts, and several consumers share one computation.  The rows read back
    are counted (from the file footers) against the rows written.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    expected, found = written.get["rows"], stored.count()
    if found != expected:
        raise RuntimeError(f"{path}: {expected} rows were written, {found} can be read; is the folder shared by all executors?")
    return stored


def release(spark: SparkSession) -> None:
    """Delete the work tables made so far; call it when no result is read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while WORK_FOLDERS:
        path = jvm.org.apache.hadoop.fs.Path(WORK_FOLDERS.pop())
        path.getFileSystem(conf).delete(path, True)
