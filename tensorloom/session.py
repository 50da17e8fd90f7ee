"""Session options and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: One thread for each kernel: parallelism comes from Spark's tasks.
OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
}


def session(app: str = "tensorloom", cores_per_task: int = 1, **options: str) -> SparkSession:
    """A session with the engine's options; cores_per_task sets spark.task.cpus and the kernels' threads."""
    chosen = OPTIONS | {"spark.task.cpus": str(cores_per_task), "spark.executorEnv.OMP_NUM_THREADS": str(cores_per_task)} | options
    return SparkSession.builder.appName(app).config(map=chosen).getOrCreate()


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a temporary folder of a local session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tensorloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settled(df: DataFrame, purpose: str = "settled") -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, lost executors cost nothing."""
    return settled_at(df, purpose)[1]


def settled_at(df: DataFrame, purpose: str = "settled") -> tuple[str, DataFrame]:
    """The folder that settled writes, and its table."""
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _at(spark, path)
    return system.exists(at)


def moved(spark: SparkSession, path: str, to: str) -> None:
    """Renames a folder, so that it appears under its new name as a whole."""
    system, at = _at(spark, path)
    goal = _at(spark, to)[1]
    system.mkdirs(goal.getParent())
    if not system.rename(at, goal):
        raise OSError(f"{path} can't be renamed to {to}")


def forget(spark: SparkSession, path: str) -> None:
    """Removes a folder of settled_at, once no table that is still read comes from it."""
    system, at = _at(spark, path)
    system.delete(at, True)
