"""The few settings the operators read from the session, and tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session: spark.checkpoint.dir, or what setCheckpointDir was given. A temporary folder
    stands in where neither is set and driver and executors are one process (tests); on a cluster that raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="speechloom-ckpt-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is removed when the program ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget_quietly, spark, path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _forget_quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        forget(spark, path)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder: computed once, columns read as they are needed, and no lost executor makes
    it be computed again."""
    return read_back(df, write_shared(df, name))


def write_shared(df: DataFrame, name: str = "table") -> str:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def read_back(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def few_listing_tasks(spark: SparkSession):
    """Folders are listed by as many tasks as a shuffle has, instead of up to one each."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(shuffle_partitions(spark)))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def small_table(df: DataFrame, max_rows: int) -> list:
    """Rows of a table with a proven size bound; raises once it holds more than max_rows, so it can never grow unseen."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a side meant to be small holds more than {max_rows} rows")
    return rows
