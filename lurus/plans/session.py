"""Session and staging helpers shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session as the tests and the bench use it. On a cluster the session is the cluster's own."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("lurus").config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it. On a cluster it is installed or sent with --py-files. Operators
    call it before they hand Python code to Spark, by themselves or through the helpers below."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), root) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where it is unset (local tests) one is made here."""
    importable(spark)
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="lurus-")
        spark.sparkContext.setCheckpointDir(known)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(known)
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame through the shared folder, so that the loss of an executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    if not _made:
        atexit.register(_release_at_exit)
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release() -> None:
    """Deletes what was staged so far. Frames that rest on it must have been used up; at the end of the driver it is called by itself. Checkpoints are
    deleted by Spark where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    spark = SparkSession.getActiveSession()
    while _made and spark is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _release_at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already, and its folders with it
        release()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as compressed parquet to the shared folder and read it back: smaller than a checkpoint, and column-pruned by later readers."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The frame over all cores, for work that is heavy for each row: a small file is one partition, however much is done with its rows.

    A scan has its partitions before anything runs. Behind an exchange their number is known only when it has run, so there the size that the planner
    expects decides: what is small is spread, what is large has partitions enough.
    """
    spark = df.sparkSession
    importable(spark)
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" not in plan.executedPlan().toString():
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
    part = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    return df.repartition(cores) if int(str(plan.optimizedPlan().stats().sizeInBytes())) < cores * part else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
