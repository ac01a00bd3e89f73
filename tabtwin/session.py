"""Spark session helpers.

Library code never builds its own session; it receives one. ``local_session`` is for
tests, the bench and the command-line jobs. ``checkpoint_dir`` reads the cluster's
``spark.checkpoint.dir`` and raises when it is unset, so lineage cuts always land in the
shared folder the cluster names.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "tabtwin", shuffle_partitions: int | None = None,
                  driver_memory: str = "16g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus if cpus != "*" else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    use_local_checkpoints(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; an error when there is none.

    Library code never falls back to a machine-local folder: on a cluster other executors
    could not read it. ``use_local_checkpoints`` sets one for tests and the bench.
    """
    context = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not conf:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(conf)
    return conf


def use_local_checkpoints(spark: SparkSession) -> None:
    """For local masters (tests, bench): a scratch checkpoint folder where none is set."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("only a local master may use a private checkpoint folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tabtwin-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) into the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, rows_in_file: int = 0) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: lineage is cut as by ``cut_lineage``, on a fraction of its disk.
    ``rows_in_file``: the most rows of a file, 0 for any number."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_in_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def together(*jobs: Callable[[], object], at_once: int = 4) -> list:
    """What the jobs return, in order; Spark runs the jobs of several driver threads side by side, which fills the
    cores while others plan or wait for a last task. The first failure is raised."""
    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder for intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")

